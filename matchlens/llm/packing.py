"""Best-fit packing of token sequences by minimum bin slack.

Lengths are whole numbers up to the capacity, so all that planning needs is how
many pieces of each length there are: a table of at most ``capacity`` rows,
whatever the corpus. For one bin after another the plan takes the longest
length left and, by subset-sum dynamic programming on a bit set, the fullest
feasible combination with it; the combination is used as often as the counts
allow and removed. Pieces are numbered within their length where they lie, and
their number leads to a bin and a place in it.

Null texts count as empty and become the end token alone. Repeated rows are
packed like any other. Extra columns stay; those named like a result give way.
"""

import bisect
import functools
import operator
import struct
import unicodedata
import zlib
from dataclasses import dataclass
from itertools import chain, filterfalse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import added, held, ranked, written

CAPACITY = 4096
END_ID = 1
CACHED_WORDS = 700_000
AT_ONCE = 200_000


class WordIds(dict):
    """Ids of the parts between spaces, packed.

    The tokenizer drops white space, so parts are free of context. It also cuts
    between letters and full stops or commas, and lowers case letter by letter,
    so one entry for the bare word serves the others.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True

    def _split(self, parts: list[str]) -> tuple[list[str], list[str]]:
        """Lower-case cores of the parts, and the full stops and commas behind them."""
        joined = "\n".join(parts)
        lowered = joined.lower().split("\n")
        # Greek sigma alone has a lower form that depends on its place.
        if "\u03a3" in joined:
            lowered = [p if "\u03a3" in p else low for p, low in zip(parts, lowered)]
        cores, ends = [], []
        for part in lowered:
            core = part.rstrip(".,")
            if len(core) < len(part) and not core[-1:].isalpha():
                core = part
            cores.append(core)
            ends.append(part[len(core) :])
        return cores, ends

    def _encoded(self, parts: list[str]) -> dict[str, bytes]:
        """A composed word of lower-case letters is a piece of its own and goes straight to the merges."""
        import numpy as np

        plain = [p for p in parts if p.isalpha() and "\u03a3" not in p]
        if not unicodedata.is_normalized("NFC", "\n".join(plain)):
            plain = [p for p in plain if unicodedata.is_normalized("NFC", p)]
        out = {}
        if plain:
            table = _byte_letters()
            data = np.frombuffer("\n".join(plain).encode(), dtype=np.uint8)
            letters = table[data].tobytes().decode("utf-16-le").split(chr(table[ord("\n")]))
            merge, number, ids, ends = self.tokenizer.model.tokenize, operator.attrgetter("id"), [], []
            for word in letters:
                ids.extend(map(number, merge(word)))
                ends.append(4 * len(ids))
            ids = np.array(ids, dtype="<u4").tobytes()
            out = {p: ids[i:j] for p, i, j in zip(plain, [0, *ends], ends)}
        other = [p for p in parts if p not in out]
        more = self.tokenizer.encode_batch_fast(other, add_special_tokens=False)
        out.update((p, struct.pack(f"<{len(e.ids)}I", *e.ids)) for p, e in zip(other, more))
        return out

    def learn(self, new: list[str]) -> None:
        """Takes in parts that are not known yet; a bare core is a part as well."""
        cores, ends = self._split(new)
        missing = list(filterfalse(self.__contains__, {*cores, *ends}))
        if missing:
            self.update(self._encoded(missing))
        for part, core, end in zip(new, cores, ends):
            if part != core:
                self[part] = self[core] + self[end]

    def ids(self, texts) -> list[bytes]:
        """Packed ids of whole texts; null texts have none."""
        out, some, size = [], [], 0
        for text in texts:
            parts = text.replace("\n", " ").split(" ") if text else []
            some.append(parts)
            size += len(parts)
            if size > AT_ONCE:
                out += self._joined(some)
                some, size = [], 0
        return out + self._joined(some)

    def _joined(self, texts: list[list[str]]) -> list[bytes]:
        new = self._unknown(texts)
        if len(self) + len(new) > CACHED_WORDS:
            self.clear()
            new = self._unknown(texts)
        if new:
            self.learn(new)
        get = self.__getitem__
        return [b"".join(map(get, parts)) for parts in texts]

    def _unknown(self, texts: list[list[str]]) -> list[str]:
        return list(set(filterfalse(self.__contains__, chain.from_iterable(texts))))


@functools.lru_cache(maxsize=1)
def _byte_letters():
    """The public byte-level alphabet: printable bytes stand for themselves, others follow from 256."""
    import numpy as np

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    table = np.arange(256, dtype="<u2")
    table[others] = 256 + np.arange(len(others))
    return table


def word_ids(path: str) -> WordIds:
    return held(("words", path), lambda: WordIds(path))


def pieces(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """One row for each piece: ``piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    The text column is dropped. Only documents longer than ``capacity`` are cut.
    """
    fields = "piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    @F.pandas_udf(f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")
    def cut(texts):
        end, step = struct.pack("<I", end_id), 4 * capacity

        def one(ids):
            ids, out = ids + end, []
            for k, at in enumerate(range(0, len(ids), step)):
                part = ids[at : at + step]
                row = {"piece": k, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
                out.append(row | {"ids": part} if keep_ids else row)
            return out

        import pandas as pd

        return pd.Series([one(ids) for ids in word_ids(tokenizer).ids(texts)], dtype=object)

    names = [f.split()[0] for f in fields.split(", ")]
    rows = docs.withColumn("_pieces", F.explode(cut(F.col(text)))).drop(text)
    return added(rows, {n: F.col(f"_pieces.{n}") for n in names}).drop("_pieces")


@dataclass
class Plan:
    """For each length, in order of use: from which number on, which bin, how many a bin, where."""

    length: list[int]
    number: list[int]
    bin: list[int]
    each: list[int]
    offset: list[int]
    bins: int


def _fullest(gap: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """The combination of at most ``counts`` of each length with the largest sum up to ``gap``.

    ``lengths`` ascend. Long ones are tried first, so short ones remain for later gaps.
    """
    reach, steps, full, mask = 1, [], 1 << gap, (1 << (gap + 1)) - 1
    for k in range(bisect.bisect_right(lengths, gap) - 1, -1, -1):
        length, left, some = lengths[k], min(counts[lengths[k]], gap // lengths[k]), 1
        while left:
            some = min(some, left)
            steps.append((reach, length, some))
            reach |= (reach << (length * some)) & mask
            if reach & full:
                break
            left, some = left - some, some * 2
        if reach & full:
            break
    at, taken = reach.bit_length() - 1, {}
    for before, length, some in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + some
            at -= length * some
    return taken


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Bins for ``counts`` of pieces by length. Each step uses up a length or nearly so."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths, used = sorted(left), dict.fromkeys(left, 0)
    out = Plan([], [], [], [], [], 0)
    while lengths:
        longest = lengths[-1]
        left[longest] -= 1
        taken = _fullest(capacity - longest, lengths, left)
        left[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times, offset = min(left[n] // k for n, k in taken.items()), 0
        for n in sorted(taken, reverse=True):
            out.length.append(n)
            out.number.append(used[n])
            out.bin.append(out.bins)
            out.each.append(taken[n])
            out.offset.append(offset)
            offset += n * taken[n]
            used[n] += times * taken[n]
            left[n] -= times * taken[n]
            if not left[n]:
                lengths.pop(bisect.bisect_left(lengths, n))
        out.bins += times
    return out


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` of ``pieces`` with ``sequence_id`` and ``offset``: where each piece goes."""
    # Written first, tokens and numbers come from different tasks: half as many workers, each with its own words.
    placed = ranked(written(rows, "pieces"), "length", "_number")
    counts = placed.groupBy("length").agg(F.count("*").alias("n")).collect()  # capacity rows at most
    made = plan({r["length"]: r["n"] for r in counts}, capacity)
    shared = rows.sparkSession.sparkContext.broadcast(made)

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(lengths, numbers):
        import numpy as np
        import pandas as pd

        p = shared.value
        keys = (np.array(p.length, dtype=np.int64) << 48) | np.array(p.number, dtype=np.int64)
        order = np.argsort(keys)
        length, number = lengths.to_numpy(), numbers.to_numpy()
        at = order[np.searchsorted(keys[order], (length << 48) | number, side="right") - 1]
        nth = number - np.array(p.number, dtype=np.int64)[at]
        each = np.array(p.each, dtype=np.int64)[at]
        return pd.DataFrame(
            {
                "sequence_id": np.array(p.bin, dtype=np.int64)[at] + nth // each,
                "offset": np.array(p.offset, dtype=np.int64)[at] + nth % each * length,
            }
        )

    found = placed.withColumn("_place", place("length", "_number"))
    return added(
        found, {"sequence_id": F.col("_place.sequence_id"), "offset": F.col("_place.offset")}
    ).drop("_place", "_number")


def sequences(rows: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids`` from pieces with their ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return rows.groupBy("sequence_id").agg(joined.alias("ids"))
