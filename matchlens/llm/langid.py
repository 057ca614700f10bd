"""Language identification by words first, backing off to character n-grams.

A word the model knows adds its log frequency in each language. An unseen word
adds the mean over its character n-grams of the longest size of which the model
knows any. Training counts every word of every labelled text, and every count
has its part in the scores. Tables of up to a fixed number of rows are sent to
the tasks whole. Of a larger table of words they get the most frequent ones of
all languages together, each with its counts in every language, and the totals
of all words; the other words of the documents are looked up once for each in
the written table and joined. A larger table of n-grams is not sent; words no
language has are then looked up by their longest n-grams first, and only those
of which none is known go on to the next shorter ones.

Texts that are null or have no letter are ``und`` with score 0, and so is every
text if there was nothing to learn from. Of equally likely languages the first
by name wins. Repeated rows count each time. Extra columns stay; those named
like a result give way.
"""

import re
import uuid
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import added, at_most, held, released, written

LETTERS = re.compile(r"[^\W\d_]+")
KEPT_WORDS = 1 << 18
KEPT_GRAMS = 1 << 20
# Rejected texts are sent to tasks up to so many keys.
SENT_KEYS = 1 << 21
LONGEST_GRAM = 4
FLUSH = 150_000
ROWS_AT_ONCE = 1 << 16
CACHED_PARTS, CACHED_BYTES = 200_000, 64 << 20
UNKNOWN = "und"
LEAST_SCORE = 0.5


def words_of(text: str) -> list[str]:
    lower = text.lower()
    return [lower] if lower.isalpha() else LETTERS.findall(lower)


def grams_of(word: str, size: int) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


def _rows(lang, counts):
    import pandas as pd

    langs = pd.Series([lang] * len(counts), dtype=object)
    terms = pd.Series(list(counts), dtype=object)
    return pd.DataFrame({"lang": langs, "term": terms, "n": pd.Series(counts.values(), dtype="int64")})


def _words(frames):
    """Words by language, summed as far as one task sees them."""

    def flushed():
        for lang, parts in by_lang.items():
            words = Counter()
            for part, n in parts.items():
                for word in words_of(part):
                    words[word] += n
            yield _rows(lang, words)

    released()
    by_lang = {}
    for frame in frames:
        for lang, text in zip(frame["lang"], frame["text"]):
            # Cut at white space first: far fewer distinct parts than words need the pattern.
            by_lang.setdefault(lang, Counter()).update(text.split())
        if sum(map(len, by_lang.values())) > FLUSH:
            yield from flushed()
            by_lang = {}
    yield from flushed()


def _grams(frames):
    """N-grams of counted words by language, summed as far as one task sees them."""
    released()
    by_lang = {}
    for frame in frames:
        for lang, word, n in zip(frame["lang"], frame["term"], frame["n"].tolist()):
            grams = by_lang.setdefault(lang, Counter())
            padded = f"_{word}_"
            for size in range(1, LONGEST_GRAM + 1):
                for i in range(len(padded) - size + 1):
                    grams[padded[i : i + size]] += n
        if sum(map(len, by_lang.values())) > FLUSH:
            yield from (_rows(lang, grams) for lang, grams in by_lang.items())
            by_lang = {}
    yield from (_rows(lang, grams) for lang, grams in by_lang.items())


class Model:
    """Counts by word and n-gram, compact enough to send; ``tables`` makes log frequencies of them.

    ``whole`` and ``gram_whole`` tell whether all counts, or those of n-grams, are here; if not all, ``left``
    has the tables of words and n-grams.
    """

    def __init__(self, counts: dict, langs: list[str], sizes: dict, whole: bool, gram_whole: bool, left=None):
        """``counts`` has, for "word" and "gram", three equally long lists: languages, terms, numbers.

        ``sizes`` has for 0 (words) and each n-gram size the number of different
        terms and the total of each language, over all counts.
        """
        import numpy as np

        self.key = uuid.uuid4().hex
        self.langs, self.sizes, self.left = langs, sizes, left
        self.whole, self.gram_whole = whole, gram_whole
        column = {lang: i for i, lang in enumerate(self.langs)}
        self.sparse = {}
        for kind, (langs, terms, numbers) in counts.items():
            distinct = sorted(set(terms))
            row = {t: i for i, t in enumerate(distinct)}
            self.sparse[kind] = (
                "\n".join(distinct),  # letters and underscores only
                np.array([row[t] for t in terms], dtype=np.int32),
                np.array([column[lang] for lang in langs], dtype=np.int32),
                np.array(numbers, dtype=np.int64),
            )

    def __getstate__(self):
        return self.__dict__ | {"left": None}

    def logs(self, table, size: int):
        """Log frequencies of rows of counts, among all words (0) or n-grams of one size."""
        import numpy as np

        distinct, totals = self.sizes[size]
        return np.log((table + 0.5) / (np.array(totals) + 0.5 * (distinct + 1)))

    def tables(self) -> dict[str, tuple]:
        """For each kind the row of each term, and a table with a column for each language."""
        import numpy as np

        out = {}
        for kind, (joined, rows, columns, numbers) in self.sparse.items():
            terms = joined.split("\n") if joined else []
            table = np.zeros((len(terms), len(self.langs)))
            table[rows, columns] = numbers
            # Frequencies are taken among n-grams of one size.
            size = np.array([len(t) if kind == "gram" else 0 for t in terms], dtype=np.int64)
            for s in set(size.tolist()):
                places = np.flatnonzero(size == s)
                for at in range(0, len(places), ROWS_AT_ONCE):
                    some = places[at : at + ROWS_AT_ONCE]
                    table[some] = self.logs(table[some], s)
            out[kind] = {t: i for i, t in enumerate(terms)}, table
        return out


class Scorer(dict):
    """Row of each part between white space in one growing table of scores."""

    def __init__(self, model: Model):
        import numpy as np

        self.langs, self.whole, self.array = model.langs, model.whole, np.asarray
        # Of the text at hand: the words to be looked up, and scores beside the table.
        self.asked, self.beside = [], []
        tables = model.tables()
        self.words, self.word_logs = tables["word"]
        # Rows of one table, too: as lists of numbers they would take several times the memory.
        self.grams, self.gram_logs = tables["gram"]
        rows = max(1000, min(CACHED_PARTS, CACHED_BYTES // (8 * max(1, len(self.langs)))))
        self.table = np.zeros((rows, len(self.langs)))

    def unseen(self, word: str):
        """The mean over the word's longest known n-grams; None if none is known."""
        get = self.grams.get
        for size in range(LONGEST_GRAM, 0, -1):
            known = [row for row in map(get, grams_of(word, size)) if row is not None]
            if known:
                n = len(known)
                return [sum(column) / n for column in zip(*self.gram_logs[known].tolist())]
        return None

    def __missing__(self, part: str) -> int:
        found, asked = [], []
        for word in words_of(part):
            row = self.words.get(word)
            if row is None and not self.whole:
                asked.append(word)
                continue
            one = self.unseen(word) if row is None else self.word_logs[row]
            if one is not None:
                found.append(one)
        if asked:
            # Most such parts never come again, so they take no place; the first row is empty.
            self.asked += asked
            self.beside += found
            return 0
        place = len(self) + 1
        if place == len(self.table):
            raise Full
        # Most parts have one word.
        self.table[place] = found[0] if len(found) == 1 else sum(map(self.array, found), 0.0)
        self[part] = place
        return place

    def total(self, parts: list[str]):
        """The sum over the words known here; ``asked`` grows by the others."""
        import numpy as np

        if len(parts) > len(self.table) // 2:
            half = len(parts) // 2
            return self.total(parts[:half]) + self.total(parts[half:])
        before = len(self.asked), len(self.beside)
        try:
            places = list(map(self.__getitem__, parts))
        except Full:
            self.clear()
            del self.asked[before[0] :], self.beside[before[1] :]
            places = list(map(self.__getitem__, parts))
        return self.table[np.array(places, dtype=np.int64)].sum(0)

    def partly(self, text: str | None) -> tuple:
        """The sums as far as known here, and the words to be looked up; None: no language to tell."""
        if not self.langs or not text or not has_letter(text):
            return None, {}
        self.asked, self.beside = [], []
        sums = self.total(text.split())
        return sum(map(self.array, self.beside), sums), Counter(self.asked)

    def predict(self, text: str | None) -> tuple[str, float]:
        return best(self.langs, self.partly(text)[0])


def best(langs: list[str], scores) -> tuple[str, float]:
    import numpy as np

    if scores is None:
        return UNKNOWN, 0.0
    place = int(np.argmax(scores))
    return langs[place], float(1.0 / np.exp(scores - scores[place]).sum())


def has_letter(text: str) -> bool:
    return any(c.isalpha() for m in LETTERS.finditer(text) for c in m.group())


class Full(Exception):
    """The table of scores has no place left."""


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", kept_words: int = KEPT_WORDS, kept_grams: int = KEPT_GRAMS
) -> Model:
    """A model from all rows with a text and a language."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    words = written(_summed(rows, _words), "words")
    by_lang = words.select("term", F.explode("counts").alias("c")).select("c.lang", "term", "c.n")
    grams = written(_summed(by_lang, _grams), "grams")
    size = lambda kind: F.lit(0) if kind == "word" else F.length("term")
    kept, sizes, langs, fits = {}, {}, set(), {}
    for kind, table, limit in (("word", words, kept_words), ("gram", grams, kept_grams)):
        # A row for each n-gram size and language.
        each = table.select(size(kind).alias("size"), F.explode("counts").alias("c"))
        totals = each.groupBy("size", "c.lang").agg(F.sum("c.n").alias("n")).collect()
        terms = table.groupBy(size(kind).alias("size")).count().collect()
        langs |= {r["lang"] for r in totals}
        for r in terms:
            sizes[r["size"]] = r["count"], {t["lang"]: t["n"] for t in totals if t["size"] == r["size"]}
        fits[kind] = sum(r["count"] for r in terms) <= limit
    langs = sorted(langs)
    sizes = {s: (n, [of.get(lang, 0) for lang in langs]) for s, (n, of) in sizes.items()}
    # A word goes or stays with its counts in all languages.
    chosen = {
        "word": words if fits["word"] else at_most(words, "n", kept_words),
        "gram": grams if fits["gram"] else grams.limit(0),
    }
    for kind, some in chosen.items():
        found = some.select("term", F.explode("counts").alias("c")).select("c.lang", "term", "c.n")
        found = found.toArrow()  # the limit's terms at most
        kept[kind] = tuple(found[c].to_pylist() for c in ("lang", "term", "n"))
    whole = fits["word"] and fits["gram"]
    return Model(kept, langs, sizes, whole, fits["gram"], None if whole else (words, grams))


def _summed(rows: DataFrame, count) -> DataFrame:
    """``term, n, counts``: one row for each term, with its count in all languages and in each."""
    found = rows.mapInPandas(count, "lang string, term string, n long")
    # Dealt by the term, both sums stay where they are.
    by_lang = found.repartition("term").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    return by_lang.groupBy("term").agg(F.sum("n").alias("n"), F.collect_list(F.struct("lang", "n")).alias("counts"))


def looked_up(asked: DataFrame, model: Model, shared) -> DataFrame:
    """``word, logs`` (a number for each language, or null) for the distinct words ``asked``; words without a row or
    with null are those the tables cannot tell of."""
    words, grams = model.left
    met = asked.join(words.select(F.col("term").alias("word"), "counts"), "word", "left")
    if not model.gram_whole:
        met = written(met, "asked_words")
        known = met.filter("counts IS NOT NULL").select("word", _logs_of(model, F.col("counts"), 0).alias("logs"))
        return known.unionByName(_by_longest(met.filter("counts IS NULL").select("word"), grams, model))

    @F.pandas_udf("array<double>")
    def unseen(words):
        import pandas as pd

        model = shared.value
        scorer = held(("lang", model.key), lambda: Scorer(model))
        return pd.Series([None if w is None else scorer.unseen(w) for w in words], dtype=object)

    new = unseen(F.when(F.col("counts").isNull(), F.col("word")))
    found = met.select("word", "counts", new.alias("new"))
    logs = F.coalesce("new", F.when(F.col("counts").isNotNull(), _logs_of(model, F.col("counts"), 0)))
    return found.select("word", logs.alias("logs"))


def _logs_of(model: Model, counts: Column, size: int) -> Column:
    """Log frequencies of a term of one size in each language, from its counts."""
    distinct, totals = model.sizes[size]
    langs = F.array(
        *[F.struct(F.lit(lang).alias("lang"), F.lit(n + 0.5 * (distinct + 1)).alias("all")) for lang, n in zip(model.langs, totals)]
    )
    mine = lambda of: F.aggregate(
        F.filter(counts, lambda c: c["lang"] == of["lang"]), F.lit(0.5), lambda n, c: n + c["n"]
    )
    return F.transform(langs, lambda of: F.log(mine(of) / of["all"]))


def _by_longest(new: DataFrame, grams: DataFrame, model: Model) -> DataFrame:
    """``word, logs`` from the longest known n-grams; each size is only asked for the words no longer one tells of."""
    out = []
    left = new.select("word", F.concat(F.lit("_"), F.col("word"), F.lit("_")).alias("p"))
    for size in range(LONGEST_GRAM, 0, -1):
        if size not in model.sizes:
            continue
        places = F.expr(f"transform(sequence(1, length(p) - {size - 1}), i -> substring(p, i, {size}))")
        cut = left.filter(F.length("p") >= size).select("word", F.explode(places).alias("term"))
        known = grams.filter(F.length("term") == size).select("term", _logs_of(model, F.col("counts"), size).alias("logs"))
        # The mean over the places, as one n-gram may stand twice.
        means = F.array(*[F.avg(F.get("logs", F.lit(i))) for i in range(len(model.langs))])
        found = written(cut.join(known, "term").groupBy("word").agg(means.alias("logs")), f"grams_{size}")
        out.append(found)
        left = left.join(found, "word", "left_anti")
    return reduce(DataFrame.unionByName, out, new.select("word", F.lit(None).cast("array<double>").alias("logs")).limit(0))


def identified(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the probability of that language (0 to 1).

    Without the text if so asked, which then is not written.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if not model.whole:
        return _joined(docs, model, shared, text, keep_text)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predicted(texts):
        import pandas as pd

        model = shared.value
        scorer = held(("lang", model.key), lambda: Scorer(model))
        return pd.DataFrame(map(scorer.predict, texts), columns=["lang_pred", "score"])

    found = docs.withColumn("_found", predicted(F.col(text)))
    return added(
        found if keep_text else found.drop(text), {"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")}
    ).drop("_found")


def _joined(docs: DataFrame, model: Model, shared, text: str, keep_text: bool) -> DataFrame:
    langs = model.langs

    @F.pandas_udf("struct<sums:array<double>,asked:array<struct<word:string,tf:long>>>")
    def first(texts):
        import pandas as pd

        model = shared.value
        scorer, rows = held(("lang", model.key), lambda: Scorer(model)), []
        for t in texts:
            sums, asked = scorer.partly(t)
            rows.append((sums, [{"word": w, "tf": k} for w, k in asked.items()]))
        return pd.DataFrame(rows, columns=["sums", "asked"])

    numbered = added(docs, {"_row": F.monotonically_increasing_id()})
    rows = numbered.withColumn("_f", first(F.col(text)))
    rows = written(rows if keep_text else rows.drop(text), "partly")
    left = rows.select("_row", F.explode("_f.asked").alias("a")).select("_row", "a.word", "a.tf")
    # Filtered once written: before, each task would work out the n-grams twice, in two workers with tables of their own.
    logs = written(looked_up(left.select("word").distinct(), model, shared), "looked_up").filter("logs IS NOT NULL")
    # One sum for each language.
    sums = [F.sum(F.col("tf") * F.get("logs", F.lit(i))) for i in range(len(langs))]
    more = left.join(logs, "word").groupBy("_row").agg(F.array(*sums).alias("_more"))

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def summed(sums, more):
        import pandas as pd

        rows = []
        for some, others in zip(sums, more):
            if some is not None and others is not None:
                some = some + others
            rows.append(best(langs, some))
        return pd.DataFrame(rows, columns=["lang_pred", "score"])

    found = rows.join(more, "_row", "left").withColumn("_found", summed("_f.sums", "_more"))
    return added(
        found, {"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")}
    ).drop("_found", "_f", "_row", "_more")


def accepted(docs: DataFrame, model: Model, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose language is told with at least the given probability, with their own columns.

    The verdict depends on the text alone, so it is the keys of rejected texts that are joined, not the texts.
    """
    content = F.col(text)
    key = F.coalesce(F.md5(content.cast("binary")), F.lit(""))  # null is a text of its own
    told = identified(docs.select(key.alias("key"), content.alias("text")), model, keep_text=False)
    sure = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)
    gone = written(told.filter(~sure).select(F.col("key").alias("rejected")).distinct(), "rejected")
    if gone.count() <= SENT_KEYS:
        gone = F.broadcast(gone)
    return docs.join(gone, key == gone["rejected"], "left_anti")
