"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to four long, each with the counts of
the bytes that followed. A byte seen after the longest known context costs its
share there; otherwise an escape is paid (method C: as many as there are
different followers) and the next shorter context is asked, leaving out the
bytes already ruled out. Since followers of a long context also follow its
suffix, what is left out at one order is just the followers of the order above;
all costs can be worked out once for each context. Behind the last escape, the
remaining of the 256 bytes are equally likely. Texts start in a context of zero
bytes.

All training text is counted, and every context counts. A trie of up to
``NODES`` contexts and followers is sent to the tasks whole. Of a larger one
they get the finished costs of its ``NODES`` most frequent five-byte sequences;
those of the others are worked out from the written table, once for each
sequence the documents hold, and joined.

The base score is an add-one unigram over words, with every word counted: the
most frequent ones are sent to the tasks, the others are joined.

Null texts are empty: score 0, and the end token alone in the base score. Rows
without an id belong to training. Repeated rows count each time. Extra columns
stay; those named like a result give way.
"""

import math
import uuid
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import added, at_most, held, written

ORDER = 4
NODES = 1 << 19
LEVEL_BITS = 8 * (ORDER + 1)
SENT_WORDS = 1 << 17
FLUSH_WORDS = 400_000
FLUSH_GRAMS = 1_000_000
CHUNK, SCORED_CHUNK = 1 << 20, 1 << 18
SLOT_BITS = 20
# Rows of the trie that one task takes at a time, as far as two-byte endings of contexts allow.
BUCKET_ROWS, LEAST_BUCKETS = 200_000, 64


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case; bytes know just the letters A to Z and just the white space meant."""
    return text.encode().lower().split() if text else []


def grams_of(data):
    """For each byte: itself and the four before it, as one integer; zeros stand before the text."""
    import numpy as np

    padded = np.zeros(len(data) + ORDER, dtype=np.int64)
    padded[ORDER:] = data
    out = padded[ORDER:].copy()
    for k in range(1, ORDER + 1):
        out |= padded[ORDER - k : -k] << (8 * k)
    return out


def batches(texts, size: int = CHUNK):
    """Byte arrays of whole texts joined with zeros between, in batches of about ``size`` bytes.

    Yields the bytes, the places that belong to texts, and for each text its first place.
    """
    import numpy as np

    gap, parts, starts, ends, at = b"\0" * ORDER, [], [], [], 0

    def batch():
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        return data, np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64)

    for text in texts:
        data = text.encode() if text else b""
        parts += [data, gap]
        starts.append(at)
        ends.append(at + len(data))
        at += len(data) + ORDER
        if at >= size:
            yield batch()
            parts, starts, ends, at = [], [], [], 0
    if starts:
        yield batch()


def _inside(n: int, starts, ends):
    """Which of ``n`` places lie in a text."""
    import numpy as np

    change = np.zeros(n + 1, dtype=np.int8)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]).astype(bool)


def _counted(frames):
    """Words and five-byte sequences of the training texts, summed as far as one task sees them."""
    import numpy as np
    import pandas as pd

    def word_rows(words):
        texts = pd.Series([w.decode() for w in words], dtype=object)
        return pd.DataFrame({"word": texts, "gram": 0, "n": list(words.values())})

    def gram_rows(keys, counts):
        return pd.DataFrame({"word": pd.Series([None] * len(keys), dtype=object), "gram": keys, "n": counts})

    words, grams = Counter(), GramCounts()
    for frame in frames:
        for text in frame["text"]:
            words.update(words_of(text))
        for data, starts, ends in batches(frame["text"]):
            grams.add(grams_of(data)[_inside(len(data), starts, ends)])
        if len(words) > FLUSH_WORDS:
            yield word_rows(words)
            words = Counter()
        if grams.rest_size > FLUSH_GRAMS:
            yield gram_rows(*grams.taken_rest())
    if words:
        yield word_rows(words)
    yield gram_rows(*grams.taken_rest())
    yield gram_rows(*grams.table())


class GramCounts:
    """Counts in a hash table; what meets a taken slot is kept aside and merged."""

    def __init__(self):
        import numpy as np

        self.keys = np.full(1 << SLOT_BITS, -1, dtype=np.int64)
        self.counts = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        self.rest, self.rest_size = [], 0

    def add(self, grams):
        import numpy as np

        slots = slots_of(grams)
        hit = self.keys[slots] == grams
        self.counts += np.bincount(slots[hit], minlength=len(self.counts))
        keys, counts = np.unique(grams[~hit], return_counts=True)
        slots = slots_of(keys)
        free = np.flatnonzero(self.keys[slots] == -1)
        free = free[np.unique(slots[free], return_index=True)[1]]
        self.keys[slots[free]] = keys[free]
        self.counts[slots[free]] += counts[free]
        left = np.ones(len(keys), dtype=bool)
        left[free] = False
        if left.any():
            self.rest.append((keys[left], counts[left]))
            self.rest_size += int(left.sum())

    def taken_rest(self):
        import numpy as np

        if not self.rest:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        keys, counts = (np.concatenate(c) for c in zip(*self.rest))
        self.rest, self.rest_size = [], 0
        keys, place = np.unique(keys, return_inverse=True)
        return keys, np.bincount(place, weights=counts).astype(np.int64)

    def table(self):
        used = self.keys >= 0
        return self.keys[used], self.counts[used]


def slots_of(keys):
    import numpy as np

    mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - SLOT_BITS)).view(np.int64)


class Trie:
    """Costs of all followers and escapes, from counts by order: arrays ``keys`` and ``counts``.

    A key of order k holds the context's k bytes and the follower in its lowest.
    """

    def __init__(self, levels: list):
        import numpy as np

        self.costs, self.escapes = [], []
        for keys, counts in levels:
            sort = np.argsort(keys)
            keys, counts = keys[sort], counts[sort].astype(np.float64)
            contexts, first, sizes = np.unique(keys >> 8, return_index=True, return_counts=True)
            totals = np.add.reduceat(counts, first) if len(keys) else counts
            self.costs.append((keys, counts))
            self.escapes.append((contexts, totals, sizes))
        self._tables = [self._table(order) for order in range(len(levels))]

    def _table(self, order: int):
        """For each context: what remains in its suffix once its followers are ruled out."""
        import numpy as np

        if order == 0:
            return None
        contexts, totals, sizes = self.escapes[order]
        keys, _ = self.costs[order]
        shorter_keys, shorter_counts = self.costs[order - 1]
        mask = (1 << (8 * order)) - 1
        if not len(keys):
            return totals, sizes
        place = np.searchsorted(shorter_keys, keys & mask)
        ruled_out = np.add.reduceat(shorter_counts[place], np.searchsorted(keys >> 8, contexts))
        short_contexts, short_totals, short_sizes = self.escapes[order - 1]
        suffix = np.searchsorted(short_contexts, contexts & (mask >> 8))
        return short_totals[suffix] - ruled_out, short_sizes[suffix] - sizes

    def logs(self, grams):
        """Log10 probability of the last byte of each gram after the ones before it."""
        import numpy as np

        out = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        # The order above, once a context was known there: its place, else -1.
        above = np.full(len(grams), -1, dtype=np.int64)
        for order in range(ORDER, -1, -1):
            if not len(open_):
                return out
            mask = (1 << (8 * (order + 1))) - 1
            some = grams[open_] & mask
            contexts, totals, sizes = self.escapes[order]
            place = _find(contexts, some >> 8)
            known = place >= 0
            n, d = np.zeros(len(some)), np.zeros(len(some))
            n[known], d[known] = totals[place[known]], sizes[place[known]]
            ruled = above >= 0
            if ruled.any():
                left, others = self._tables[order + 1]
                n[ruled], d[ruled] = left[above[ruled]], others[above[ruled]]
            keys, counts = self.costs[order]
            at = _find(keys, some)
            hit = at >= 0
            out[open_[hit]] += np.log10(counts[at[hit]] / (n[hit] + d[hit]))
            miss = ~hit
            # Where nothing is left to choose from, the escape is certain and free.
            paid = miss & (d > 0)
            out[open_[paid]] += np.log10(d[paid] / (n[paid] + d[paid]))
            open_, above = open_[miss], place[miss]
        seen = len(self.costs[0][0])
        out[open_] -= np.log10(256 - seen)
        return out


def _find(keys, wanted):
    """Places of ``wanted`` in sorted ``keys``, -1 where absent."""
    import numpy as np

    if not len(keys):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


class Scorer:
    """A hash table of finished costs of five-byte sequences, and a longer way for the others.

    ``logs`` gives the costs of sequences without a place in the table; NaN: unknown here.
    """

    def __init__(self, keys, values, logs):
        import numpy as np

        # Of keys that meet in a slot the last stays; the others take the long way.
        self.keys = np.full(1 << SLOT_BITS, -1, dtype=np.int64)
        self.values = np.zeros(1 << SLOT_BITS)
        slots = slots_of(keys)
        self.keys[slots] = keys
        self.values[slots] = values
        self.logs = logs

    def scores(self, texts) -> tuple[list[float], list[list]]:
        """Log10 probability of each text as far as known here, and its unknown sequences with counts."""
        import numpy as np

        out, rest = [], []
        for data, starts, ends in batches(texts, SCORED_CHUNK):
            grams = grams_of(data)
            slots = slots_of(grams)
            logs = self.values[slots]
            inside = _inside(len(data), starts, ends)
            logs[~inside] = 0.0
            left = [[] for _ in starts]
            slow = np.flatnonzero((self.keys[slots] != grams) & inside)
            if len(slow):
                distinct, back = np.unique(grams[slow], return_inverse=True)
                found = self.logs(distinct)[back]
                unknown = slow[np.isnan(found)]
                logs[slow] = np.nan_to_num(found)
                cuts = np.searchsorted(unknown, starts).tolist()
                for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(unknown)])):
                    if b > a:
                        pairs = np.unique(grams[unknown[a:b]], return_counts=True)
                        left[i] = [{"gram": g, "tf": k} for g, k in zip(*(x.tolist() for x in pairs))]
            sums = np.add.reduceat(logs, starts)
            out += np.where(ends > starts, sums, 0.0).tolist()
            rest += left
        return out, rest


class Model:
    """What the tasks need: the trie or its most frequent costs, the most frequent words, the sums over all words."""

    def __init__(self, levels, costs, words: tuple, texts: int, tokens: int, distinct: int):
        self.key = uuid.uuid4().hex
        self.levels, self.costs, self.words = levels, costs, words
        self.texts, self.tokens, self.distinct = texts, tokens, distinct


class Tables(NamedTuple):
    """``word, n`` of all words, and ``level, gram, n`` of the trie if it is not sent whole."""

    words: DataFrame
    trie: DataFrame | None


def counts(training: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``word, n`` of all words and ``gram, n`` of all five-byte sequences, written."""
    parts = training.select(F.col(text).alias("text")).mapInPandas(
        _counted, "word string, gram long, n long"
    )
    both = written(parts.groupBy("word", "gram").agg(F.sum("n").alias("n")), "corpus_counts")
    words = both.filter("word IS NOT NULL").select("word", "n")
    return words, both.filter("word IS NULL").select("gram", "n")


def _by_level(rows) -> list:
    """Keys and counts by order, of an Arrow table ``level, gram, n``."""
    level, grams, numbers = (rows[c].to_numpy() for c in ("level", "gram", "n"))
    return [(grams[level == k], numbers[level == k]) for k in range(ORDER + 1)]


def costs_of(trie: DataFrame, grams: DataFrame, size: int) -> DataFrame:
    """``gram, cost`` for distinct ``grams`` by the whole ``trie`` of ``size`` rows.

    All that decides on a sequence lies under the last two bytes of its context,
    apart from the orders 0 and 1, which have 65,792 rows at most and are sent.
    """
    short = trie.filter("level < 2").select("level", "gram", "n").toArrow()
    shared = trie.sparkSession.sparkContext.broadcast(_by_level(short))

    def costed(frame):
        import pandas as pd

        levels = list(shared.value)
        for k in range(2, ORDER + 1):
            some = frame[frame["level"] == k]
            levels[k] = some["gram"].to_numpy(), some["n"].to_numpy()
        asked = frame.loc[frame["level"] < 0, "gram"].to_numpy()
        return pd.DataFrame({"gram": asked, "cost": Trie(levels).logs(asked) if len(asked) else []})

    long_ = trie.filter("level >= 2").select("level", "gram", "n")
    asked = grams.select(F.lit(-1).alias("level"), "gram", F.lit(0).cast("long").alias("n"))
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_ROWS))
    ending = F.expr("(gram >> 8) & 65535")
    rows = long_.unionByName(asked).withColumn("bucket", F.pmod(F.xxhash64(ending), F.lit(buckets)))
    return rows.groupBy("bucket").applyInPandas(costed, "gram long, cost double")


def fit(training: DataFrame, text: str = "text", nodes: int = NODES) -> tuple[Model, Tables]:
    """The model, and the tables for what it leaves out."""
    words, grams = counts(training, text)
    order = F.explode(F.sequence(F.lit(0), F.lit(ORDER)))
    by_order = grams.select("gram", "n", order.alias("level")).select(
        "level", F.expr("gram & ((1L << (8 * (level + 1))) - 1)").alias("gram"), "n"
    )
    trie = written(by_order.groupBy("level", "gram").agg(F.sum("n").alias("n")), "trie")
    size, levels, costs = trie.count(), None, None
    if size <= nodes:
        levels = _by_level(trie.toArrow())  # nodes rows at most
    else:
        frequent = at_most(trie.filter(F.col("level") == ORDER), "n", nodes)
        found = costs_of(trie, frequent, size).toArrow()  # nodes rows at most
        costs = found["gram"].to_numpy(), found["cost"].to_numpy()
    texts, total, distinct = training.count(), *words.agg(F.sum("n"), F.count("*")).first()
    frequent = at_most(words, "n", SENT_WORDS).toArrow()  # SENT_WORDS rows at most
    # Words hold no line ends, so one string carries them all.
    sent = "\n".join(frequent["word"].to_pylist()), frequent["n"].to_numpy()
    # The end of each text is one more token, and one more kind of it.
    model = Model(levels, costs, sent, texts, (total or 0) + texts, (distinct or 0) + (texts > 0))
    return model, Tables(words, None if costs is None else trie)


def scored(docs: DataFrame, model: Model, tables: Tables, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_tokens, n_known, train_tokens, base_score, score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    below = math.log10(model.tokens + model.distinct + 1)
    end_cost = math.log10(model.texts + 1) - below
    rare, grams = "array<struct<word:string,tf:long>>", "array<struct<gram:long,tf:long>>"

    @F.pandas_udf(f"struct<tokens:long,known:long,base:double,score:double,rare:{rare},grams:{grams}>")
    def first(texts):
        import numpy as np
        import pandas as pd

        model_ = shared.value
        costs, scorer = held(("lm", model_.key), lambda: _loaded(model_))
        rows = []
        for t in texts:
            words = words_of(t)
            logs = list(map(costs.get, words))
            rest = Counter(w for w, cost in zip(words, logs) if cost is None) if None in logs else {}
            left = [{"word": w.decode(), "tf": k} for w, k in rest.items()]
            # A cost is never zero, as no word is the whole corpus.
            known = len(words) - sum(rest.values())
            rows.append((len(words) + 1, known, math.fsum(filter(None, logs)), left))
        frame = pd.DataFrame(rows, columns=["tokens", "known", "base", "rare"])
        scores, grams = scorer.scores(texts)
        frame["score"] = np.array(scores, dtype=np.float64)
        frame["grams"] = pd.Series(grams, dtype=object)
        return frame[["tokens", "known", "base", "score", "rare", "grams"]]

    found = docs.withColumn("_f", first(F.col(text))).drop(text)
    rows = written(added(found, {"_row": F.monotonically_increasing_id()}), "scored")
    left = rows.select("_row", F.explode("_f.rare").alias("r")).select("_row", "r.word", "r.tf")
    # Words in the model never come here; the others are few in any one text.
    cost = F.col("tf") * (F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0)) - F.lit(below))
    sums = (
        left.join(tables.words, "word", "left")
        .groupBy("_row")
        .agg(
            F.sum(cost).alias("_base"),
            F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("_known"),
        )
    )
    joined, score = rows.join(sums, "_row", "left"), F.col("_f.score")
    if tables.trie is not None:
        left = rows.select("_row", F.explode("_f.grams").alias("g")).select("_row", "g.gram", "g.tf")
        costs = written(costs_of(tables.trie, left.select("gram").distinct(), tables.trie.count()), "costs")
        more = left.join(costs, "gram").groupBy("_row").agg(F.sum(F.col("tf") * F.col("cost")).alias("_more"))
        joined, score = joined.join(more, "_row", "left"), score + F.coalesce("_more", F.lit(0.0))
    return added(
        joined,
        {
            "n_tokens": F.col("_f.tokens"),
            "n_known": F.col("_f.known") + F.coalesce("_known", F.lit(0)) + F.lit(int(model.texts > 0)),
            "train_tokens": F.lit(model.tokens).cast("long"),
            "base_score": F.col("_f.base") + F.coalesce("_base", F.lit(0.0)) + F.lit(end_cost),
            "score": score,
        },
    ).drop("_f", "_row", "_base", "_known", "_more")


def _loaded(model: Model) -> tuple[dict, Scorer]:
    """Word costs, and the scorer of bytes."""
    import numpy as np

    below = math.log10(model.tokens + model.distinct + 1)
    words, counts_ = model.words
    pairs = zip(words.split("\n"), counts_.tolist())
    logs = {w.encode(): math.log10(n + 1) - below for w, n in pairs}
    if model.costs is None:
        trie = Trie(model.levels)
        keys, numbers = trie.costs[ORDER]
        keys = keys[np.argsort(numbers, kind="stable")]
        return logs, Scorer(keys, trie.logs(keys), trie.logs)
    keys, values = model.costs
    sort = np.argsort(keys)
    keys, values = keys[sort], values[sort]

    def sent(grams):
        at = _find(keys, grams)
        return np.where(at >= 0, values[at], np.nan) if len(keys) else np.full(len(grams), np.nan)

    return logs, Scorer(keys, values, sent)
