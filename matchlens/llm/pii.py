"""Personal data: fixed patterns, and identifiers found by bootstrapping from them.

Base kinds (e-mail, IPv4, card, phone) have exact rules. Their matches are seed
instances. Every occurrence of an identifier-like string (digits mixed into six
or more characters) has lexical patterns: the word before it, the word after
it, both, and the label it is glued to (``key=``). Patterns and instances form a
graph that Spark scores in turns. What speaks against a pattern is that its
words mostly stand beside ordinary words, and that it holds instances found
unsure. An instance is as sure as its patterns together, as far as its
occurrences have a sure pattern; before the first turn an unseen instance
speaks neither for nor against. So a label finds any number of unseen
identifiers, while ``of`` and ``in`` find none. Instances that are sure enough
are marked in kind ``id``.

Base spans always stay. Found spans never overlap them. Null texts count as
empty. Repeated rows get equal spans. Extra columns stay; those named like a
result give way.
"""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import added, released, written

KINDS = ("email", "ip", "card", "phone", "id")
ROUNDS = 3
# A pattern counts from so many different sure instances on, and from this confidence.
MIN_SUPPORT = 3
MIN_PATTERN = 0.8
MIN_INSTANCE = 0.8
SMOOTHING = 1.0

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match can start inside a run of digits: the one at its start would have taken it.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
CANDIDATE = re.compile(r"[A-Za-z0-9_@/+.-]*[0-9][A-Za-z0-9_@/+.-]*")
BEFORE = re.compile(r"(\S+)\s+$")
AFTER = re.compile(r"\s+(\S+)")
MIN_LENGTH, MIN_DIGITS = 6, 3
CONTEXT = 64
SPAN = "struct<kind:string,start:int,end:int>"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; each is the run before an @ and the longest domain after it."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        # An @ inside the match cannot be, as a domain has none.
        at = text.find("@", max(at + 1, free))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of the base kinds, by start, then kind as listed."""
    spans = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                spans.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = NOT_DIGIT.sub("", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    spans.append(("phone", m.start(), m.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _word(text: str) -> str:
    return text.strip(".,;:!?()[]\"'").lower()


def patterns_at(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around one occurrence."""
    head, tail = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    if head and not head[-1].isspace():
        label = re.search(r"(\w+\W{1,3})$", head)
        return [f"glued {label[1].lower()}"] if label else []
    before, after = BEFORE.search(head), AFTER.match(tail)
    left = _word(before[1]) if before else ""
    right = _word(after[1]) if after else ""
    found = [f"after {left}"] * bool(left) + [f"before {right}"] * bool(right)
    return found + [f"between {left} {right}"] * bool(left and right)


def occurrences(text: str) -> tuple[list, list]:
    """Base spans, and all occurrences as ``(start, end, instance, seed, patterns)``."""
    spans = base_spans(text)
    found = [(a, b, text[a:b].lower(), True, patterns_at(text, a, b)) for _, a, b in spans]
    if DIGIT.search(text):
        taken, at = sorted((a, b) for _, a, b in spans), 0
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            while b > a and text[b - 1] in ".-/+":
                b -= 1
            if b - a < MIN_LENGTH or sum(c.isdigit() for c in text[a:b]) < MIN_DIGITS:
                continue
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if any(s < b and a < e for s, e in taken[at : at + 8]):
                continue
            found.append((a, b, text[a:b].lower(), False, patterns_at(text, a, b)))
    return spans, found


def marked(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``_row``, ``base`` spans and ``_seen`` occurrences, written once."""

    seen = "array<struct<start:int,end:int,instance:string,seed:boolean,patterns:array<string>>>"

    @F.pandas_udf(f"struct<base:array<{SPAN}>,seen:{seen}>")
    def found(texts):
        import pandas as pd

        released()
        rows = []
        for t in texts:
            base, seen_ = occurrences(t or "")
            rows.append(
                (
                    [dict(zip(("kind", "start", "end"), s)) for s in base],
                    [dict(zip(("start", "end", "instance", "seed", "patterns"), s)) for s in seen_],
                )
            )
        return pd.DataFrame(rows, columns=["base", "seen"])

    both = docs.withColumn("_found", found(F.col(text)))
    rows = added(
        both,
        {
            "_row": F.monotonically_increasing_id(),
            "_base": F.col("_found.base"),
            "_seen": F.col("_found.seen"),
        },
    ).drop("_found")
    return written(rows if keep_text else rows.drop(text), "marked")


def ordinary(texts: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """``pattern, words``: how often the rarest context word of each pattern stands anywhere in the texts."""
    tokens = texts.select(F.explode(F.split(F.col(text), r"(?U)\s+")).alias("token"))
    plain = F.btrim(F.lower("token"), F.lit(".,;:!?()[]\"'")).alias("word")
    label = F.regexp_extract(F.lower("token"), r"(?U)(\w+\W{1,3})\w", 1).alias("word")
    kind, rest = F.substring_index("pattern", " ", 1), F.expr("substr(pattern, instr(pattern, ' ') + 1)")
    glued = kind == "glued"
    needed = written(
        patterns.select(
            "pattern", glued.alias("glued"), F.explode(F.when(glued, F.array(rest)).otherwise(F.split(rest, " "))).alias("word")
        ),
        "context_words",
    )
    words = needed.filter("NOT glued").select("word").distinct()
    labels = needed.filter("glued").select("word").distinct()
    counted = (
        tokens.select(plain).join(words, "word", "left_semi").groupBy("word").agg(F.count("*").alias("times"))
        .withColumn("glued", F.lit(False))
    )
    glues = (
        tokens.filter(F.col("token").rlike(r"(?U)\w\W")).select(label).join(labels, "word", "left_semi")
        .groupBy("word").agg(F.count("*").alias("times")).withColumn("glued", F.lit(True))
    )
    found = needed.join(counted.unionByName(glues), ["glued", "word"], "left")
    return found.groupBy("pattern").agg(F.min(F.coalesce("times", F.lit(0))).alias("words"))


def scored(seen: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """Confidence of the instances after ``ROUNDS`` turns over the graph.

    ``seen`` has ``instance, seed, patterns``, one row for each occurrence in ``texts``.
    """
    links = written(
        seen.select("instance", "seed", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "instance")
        .agg(F.max("seed").alias("seed"), F.count("*").alias("n")),
        "pattern_links",
    )
    # Seeds only come from the base rules, so patterns without enough of them never count.
    supported = (
        links.groupBy("pattern")
        .agg(F.count_if("seed").alias("support"), F.sum("n").alias("filled"))
        .filter(F.col("support") >= MIN_SUPPORT)
    )
    supported = written(supported, "supported")
    others = F.greatest(F.lit(0), F.coalesce("words", F.lit(0)) - F.col("filled")).alias("others")
    slots = supported.join(ordinary(texts, supported, text), "pattern", "left").select("pattern", others)
    # Even if all of its instances were sure, a pattern with more ordinary words could not be.
    most = F.col("filled") / (F.col("filled") + F.col("others") + SMOOTHING)
    slots = written(
        supported.join(slots, "pattern").filter(most >= MIN_PATTERN).select("pattern", "others"), "slots"
    )
    open_links = written(links.join(slots, "pattern"), "open_links")
    times = seen.groupBy("instance").agg(F.count("*").alias("times"), F.max("seed").alias("seed"))
    times = written(times.join(open_links.select("instance").distinct(), "instance", "left_semi"), "instances")
    # Unknown instances have no confidence yet.
    instances = times.select("instance", F.when(F.col("seed"), F.lit(1.0)).alias("sure"))
    for _ in range(ROUNDS):
        known = open_links.join(instances, "instance")
        # An instance that is sure enough speaks for its pattern, any other one against it.
        good = F.sum(F.when(F.col("sure") >= MIN_INSTANCE, F.col("n") * F.col("sure")).otherwise(0.0))
        bad = F.sum(F.when(F.col("sure") < MIN_INSTANCE, F.col("n") * (1 - F.col("sure"))).otherwise(0.0))
        patterns = (
            known.groupBy("pattern", "others")
            .agg(good.alias("good"), bad.alias("bad"))
            .withColumn("confidence", F.col("good") / (F.col("good") + F.col("bad") + F.col("others") + SMOOTHING))
            .select("pattern", F.when(F.col("confidence") >= MIN_PATTERN, F.col("confidence")).alias("confidence"))
        )
        # The chance that every one of its patterns errs, as a sum of logarithms.
        doubt = F.sum(F.log(F.lit(1.0) - F.least("confidence", F.lit(0.999))))
        evidence = (
            open_links.join(patterns, "pattern")
            .groupBy("instance")
            .agg(doubt.alias("doubt"), F.max(F.when(F.col("confidence").isNotNull(), F.col("n"))).alias("covered"))
        )
        share = F.least(F.lit(1.0), F.col("covered") / F.col("times"))
        sure = F.coalesce((F.lit(1.0) - F.exp("doubt")) * share, F.lit(0.0))
        instances = written(
            times.join(evidence, "instance", "left").select(
                "instance", F.when(F.col("seed"), F.lit(1.0)).otherwise(sure).alias("sure")
            ),
            "instances",
        )
    return instances


def with_spans(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``base`` and ``spans``, both ``array<struct<kind, start, end>>`` in order."""
    rows = marked(docs, text, keep_text)
    seen = rows.select("_row", F.explode("_seen").alias("s")).select("_row", "s.*")
    sure = scored(seen.select("instance", "seed", "patterns"), docs, text).filter(F.col("sure") >= MIN_INSTANCE).select("instance")
    new = (
        seen.filter("NOT seed")
        .join(sure, "instance")
        .groupBy("_row")
        .agg(F.collect_list(F.struct(F.lit("id").alias("kind"), "start", "end")).alias("_new"))
    )
    # Written, its size is known, and a small table does not make the texts move.
    joined = rows.join(written(new, "found"), "_row", "left")
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.transform(
        F.concat("_base", F.coalesce("_new", F.array().cast(f"array<{SPAN}>"))),
        lambda s: F.struct(s["start"].alias("a"), rank(s).alias("r"), s["end"].alias("b"), s.alias("s")),
    )
    spans = F.transform(F.array_sort(keyed), lambda k: k["s"])
    return added(joined, {"base": F.col("_base"), "spans": spans}).drop("_row", "_base", "_seen", "_new")


def listed(spans) -> "F.Column":
    """``kind:start:end``, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets; null stays null."""

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        released()
        out = []
        for t, found in zip(texts, spans):
            if t is not None and found is not None:
                parts, at = [], 0
                for s in found:
                    if s["start"] >= at:
                        parts += [t[at : s["start"]], f"<{s['kind'].upper()}>"]
                    at = max(at, s["end"])
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    columns = docs.columns
    boxed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"), F.col(text).alias("_text")
    )
    found, content = with_spans(boxed, "_text", keep_text=False), F.col(f"_doc.`{text}`")
    found = found.withColumn("_clean", F.when(F.size("spans") > 0, cut(content, "spans")).otherwise(content))
    return found.select(
        *[F.col("_clean" if c == text else f"_doc.`{c}`").alias(c) for c in columns]
    )
