"""Periodic runs of words, found with an enhanced suffix array.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are identical) that no neighbouring word extends; it is reported if it
has ``max(min_words, min_exponent * q)`` words or more.

Every document gets a suffix array with its inverse (ISA) and longest common
prefixes; the arrays of many documents are built together, in numpy, inside one
task. Each LCP interval of depth ``d`` is split into its children, and the
suffixes ``i`` of all children but the largest ask whether ``ISA[i + d]`` or
``ISA[i - d]`` lies in the interval under another child. If so, two copies of
``d`` words stand side by side and cannot move one word to the right: a
branching tandem repeat. Rotating it to the left as far as it goes gives the
run. No tree is built; intervals are pairs of places found by pointer jumping.

Null texts have no words; empty and wordless texts have no runs and an empty
collapsed text. Long texts are worked on whole, in memory that grows with the
text. Repeated rows stay. Extra columns stay; those named like a result give way.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import added, fresh

MIN_WORDS, MIN_EXPONENT = 6, 4
# Documents are put together up to so many words; a longer one is taken alone.
WORDS_AT_ONCE = 1 << 18
CELLS_AT_ONCE = 1 << 20
FOUND = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def suffix_arrays(symbols):
    """Suffix array, inverse and neighbours' common prefixes of ``symbols``.

    Prefix doubling: only groups of suffixes that are still equal are sorted
    again. No symbol may stand at the end and elsewhere, so no comparison leaves
    the array. ``lcp[k]`` belongs to the suffixes ``k - 1`` and ``k``; both ends are -1.
    """
    import numpy as np

    n = len(symbols)
    sa = np.argsort(symbols, kind="stable").astype(np.int32)

    def ranked(places, keys, rank):
        """Ranks are the first place of a group; returns the places of groups of two or more."""
        new = np.ones(len(places), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (places[1:] != places[:-1] + 1)
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(places)))
        rank[sa[places]] = np.repeat(places[heads], sizes)
        return places[np.repeat(sizes > 1, sizes)]

    rank = np.empty(n, dtype=np.int32)
    places = ranked(np.arange(n), symbols[sa], rank)
    levels, width = [rank], 1
    while len(places):
        some = sa[places]
        keys = rank[some].astype(np.int64) * (n + 1) + rank[some + width]
        order = np.argsort(keys, kind="stable")
        sa[places] = some[order]
        rank = rank.copy()
        places = ranked(places, keys[order], rank)
        levels.append(rank)
        width *= 2
    lcp = np.full(n + 1, -1, dtype=np.int32)
    lcp[1:n] = 0
    met = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    a, b, long = sa[met - 1].astype(np.int64), sa[met].astype(np.int64), np.zeros(len(met), dtype=np.int32)
    for k in range(len(levels) - 1, -1, -1):
        step = (levels[k][a] == levels[k][b]).astype(np.int32) << k
        a, b, long = a + step, b + step, long + step
    lcp[met] = long
    return sa, levels[-1], lcp


def _smaller(lcp, asked, by: int):
    """For each place in ``asked`` the nearest one before (``by`` -1) or after (1) with a smaller value."""
    import numpy as np

    # Places between a place and its pointer are never smaller, so pointers may be followed by pointers.
    to = np.arange(len(lcp), dtype=np.int64) + by
    left = asked
    while len(left):
        left = left[lcp[to[left]] >= lcp[left]]
        to[left] = to[to[left]]
    return to[asked]


def branching_squares(sa, isa, lcp):
    """``start, period`` of the branching tandem repeats, each once."""
    import numpy as np

    splits = np.flatnonzero(lcp > 0)
    if not len(splits):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    low, high = _smaller(lcp, splits, -1), _smaller(lcp, splits, 1)
    order = np.lexsort((splits, high, low))
    splits, low, high = splits[order], low[order], high[order]
    new = np.ones(len(splits), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    first = np.flatnonzero(new)
    interval = np.cumsum(new) - 1
    # Children: one from the left border, one from each split; each ends where the next one starts.
    starts = np.empty(len(splits) + len(first), dtype=np.int64)
    heads = first + np.arange(len(first))
    starts[np.arange(len(splits)) + interval + 1] = splits
    starts[heads] = low[first]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:]
    ends[np.append(heads[1:], len(starts)) - 1] = high[first]
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(heads, len(starts))))
    sizes = ends - starts
    largest = np.flatnonzero(sizes == np.maximum.reduceat(sizes, heads)[owner])
    spared = np.ones(len(starts), dtype=bool)
    spared[largest[np.unique(owner[largest], return_index=True)[1]]] = False
    child = np.flatnonzero(spared)
    found = []
    # The suffixes of the smaller children are n log n at most; they are asked in portions.
    upto = np.cumsum(sizes[child])
    cuts = np.searchsorted(upto, np.arange(CELLS_AT_ONCE, upto[-1], CELLS_AT_ONCE))
    for part in np.split(child, cuts):
        each = np.repeat(part, sizes[part])
        if not len(each):
            continue
        before = np.cumsum(sizes[part]) - sizes[part]
        place = np.arange(len(each)) + np.repeat(starts[part] - before, sizes[part])
        suffix, at = sa[place].astype(np.int64), first[owner[each]]
        depth = lcp[splits[at]].astype(np.int64)
        for other, start in ((suffix + depth, suffix), (suffix - depth, suffix - depth)):
            seat = isa[np.maximum(other, 0)]
            near = (other >= 0) & (seat >= low[at]) & (seat < high[at])
            near &= (seat < starts[each]) | (seat >= ends[each])
            found.append(np.stack([start[near], depth[near]], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _rotations(symbols, start, period):
    """How far each tandem repeat can be moved to the left."""
    import numpy as np

    moved, left, width = np.zeros(len(start), dtype=np.int64), np.arange(len(start)), 8
    while len(left):
        again = []
        for some in np.split(left, np.arange(max(1, CELLS_AT_ONCE // width), len(left), max(1, CELLS_AT_ONCE // width))):
            at = (start[some] - moved[some] - 1)[:, None] - np.arange(width)
            seat = np.maximum(at, 0)
            same = (at >= 0) & (symbols[seat] == symbols[seat + period[some][:, None]])
            n = np.where(same.all(axis=1), width, same.argmin(axis=1))
            moved[some] += n
            again.append(some[n == width])
        left, width = np.concatenate(again), min(4 * width, CELLS_AT_ONCE)
    return moved


def runs(symbols, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT):
    """``start, length, period`` of the runs in ``symbols``, by start, then period.

    ``symbols`` are integers; documents in it share none and each ends with one of its own.
    """
    import numpy as np

    none = np.empty((0, 3), dtype=np.int64)
    start, period = branching_squares(*suffix_arrays(symbols))
    # A run of more than two periods can be moved at least once.
    if min_exponent > 2:
        can = start > 0
        can[can] = symbols[start[can] - 1] == symbols[start[can] - 1 + period[can]]
        start, period = start[can], period[can]
    out = []
    while len(start):
        # Of the repeats that end at one place, the one with the smallest period speaks first.
        end = start + 2 * period
        order = np.lexsort((period, end))
        start, period, end = start[order], period[order], end[order]
        lead = np.ones(len(end), dtype=bool)
        lead[1:] = end[1:] != end[:-1]
        length = 2 * period[lead] + _rotations(symbols, start[lead], period[lead])
        out.append(np.stack([end[lead] - length, length, period[lead]], axis=1))
        # Its multiples inside the same run are not smallest periods.
        by = np.cumsum(lead) - 1
        inside = (period % period[lead][by] == 0) & (2 * period <= length[by])
        rest = ~(lead | inside)
        start, period = start[rest], period[rest]
    found = np.concatenate(out) if out else none
    found = found[found[:, 1] >= np.maximum(min_words, min_exponent * found[:, 2])]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _portions(texts):
    """Lists of the words of some texts, put together up to WORDS_AT_ONCE."""
    some, n = [], 0
    for text in texts:
        # Bytes know just this white space.
        words = (text or "").encode().split()
        if some and n + len(words) > WORDS_AT_ONCE:
            yield some
            some, n = [], 0
        some.append(words)
        n += len(words)
    if some:
        yield some


def found_in(documents: list, min_words: int, min_exponent: int):
    """Runs of some documents, given as lists of words: for each its runs and the words it keeps."""
    import numpy as np

    sizes = np.array(list(map(len, documents)), dtype=np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.empty(int(sizes.sum()) + len(sizes), dtype=np.int64)
    for at, words in zip(first.tolist(), documents):
        ids: dict = {}
        symbols[at : at + len(words)] = [ids.setdefault(w, len(ids)) for w in words]
        symbols[at + len(words)] = len(ids)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    # Documents share no symbol, so no suffix of one is like a suffix of another.
    found = runs(symbols + owner * (int(symbols.max()) + 1), min_words, min_exponent)
    holder = owner[found[:, 0]]
    # Words after the first period of a run go.
    change = np.zeros(len(symbols) + 1, dtype=np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    stays = np.cumsum(change)[:-1] == 0
    found[:, 0] -= first[holder]
    per = np.bincount(holder, minlength=len(sizes))
    kept = []
    for i, words in enumerate(documents):
        if per[i]:
            words = [w for w, s in zip(words, stays[first[i] : first[i] + len(words)].tolist()) if s]
        kept.append(b" ".join(words).decode())
    return found, per, kept


def with_runs(
    docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT
) -> DataFrame:
    """Adds ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    Words are numbered from 0. ``collapsed`` holds the words that no run repeats:
    those after a run's first period go, the others are joined by one space.
    """

    @F.arrow_udf(FOUND)
    def find(texts):
        import numpy as np
        import pyarrow as pa

        rows, counts, kept = [np.empty((0, 3), dtype=np.int64)], [], []
        for some in _portions(texts.to_pylist()):
            found, per, words = found_in(some, min_words, min_exponent)
            rows.append(found)
            counts.append(per)
            kept += words
        cells = np.concatenate(rows)
        offsets = np.concatenate([[0], *counts]).cumsum().astype(np.int32)
        run = pa.StructArray.from_arrays([pa.array(c) for c in cells.T], ["start", "length", "period"])
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(pa.array(offsets), run), pa.array(kept, pa.string())], ["runs", "collapsed"]
        )

    both = fresh(docs, "found")
    rows = docs.withColumn(both, find(F.col(text)))
    return added(rows, {"runs": F.col(f"{both}.runs"), "collapsed": F.col(f"{both}.collapsed")}).drop(both)


def strongest(found: Column) -> Column:
    """The run with the greatest exact ``length / period``, the first of equal ones; null without runs."""
    more = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.reduce(found, F.get(found, F.lit(0)), lambda best, r: F.when(more(best, r), r).otherwise(best))
