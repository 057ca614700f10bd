"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece has exactly one encoding, and dropping the last token of
an encoding leaves the encoding of the shorter prefix. So one token per prefix,
the last one, holds all encodings: it is the token ending there that may follow
the last token of the prefix before it. Two tokens may follow each other when
merging their joined bytes gives just these two. New bytes only add prefixes;
after an edit, pieces are encoded anew only until the old borders return.

Null texts count as empty and have no tokens; repeated rows get equal results;
extra columns stay, those named like a result give way.
"""

import base64
import functools
import re
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import added, held

CACHED_STRINGS = 500_000
CACHED_LENGTH = 64
NEVER = 1 << 40
SPACE_RUN = re.compile(r" \s")
# Fixed value: the public pattern whose pieces always start at a single space.
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Encodes single pieces; ``ranks`` maps token bytes to ids, all single bytes included."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[tuple[int | None, int], bool] = {}
        self._splits: dict[int, tuple[int, int] | None] = {}
        self._borders: tuple[dict, dict] = ({}, {})
        self._found = ahocorasick.Automaton()
        for token, i in ranks.items():
            self._found.add_word(token.decode("latin-1"), (len(token), i))
        self._found.make_automaton()

    def merged(self, data: bytes, stop: int = 1) -> list[int]:
        """The definition: merge the neighbours of lowest rank until none or ``stop`` are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > stop:
            joined = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            lowest = min(joined)
            if lowest == NEVER:
                break
            at = joined.index(lowest)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None where merging does not lead to it."""
        known = self._splits.get(token, False)
        if known is False:
            data = self.bytes_of[token]
            parts = self.merged(data, stop=2)
            known = tuple(parts) if len(parts) == 2 and self.merged(data) == [token] else None
            self._splits[token] = known
        return known

    def _border(self, token: int, side: int) -> list[int]:
        """The tokens that stand at one end of ``token`` while it is being merged, bytes first."""
        chain = self._borders[side].get(token)
        if chain is None:
            chain, at = [token], token
            while len(self.bytes_of[at]) > 1:
                at = self._split(at)[side]
                chain.append(at)
            chain.reverse()
            self._borders[side][token] = chain
        return chain

    def _reachable(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self._split(token) is not None

    def _fits(self, before: int | None, token: int) -> bool:
        """Whether ``token`` may follow ``before`` (None: stand first).

        Replays the merges on both sides of the border in the order of their
        ranks; the pair stands unless a merge across the border comes first.
        """
        if len(self._pairs) > 1_000_000:
            self._pairs.clear()
        ok = self._reachable(token) and (before is None or self._stands(before, token))
        self._pairs[before, token] = ok
        return ok

    def _stands(self, before: int, token: int) -> bool:
        lefts, rights = self._border(before, 1), self._border(token, 0)
        i = j = 0
        while True:
            across = self.ranks.get(self.bytes_of[lefts[i]] + self.bytes_of[rights[j]])
            left = lefts[i + 1] if i + 1 < len(lefts) else NEVER
            right = rights[j + 1] if j + 1 < len(rights) else NEVER
            # Of equal ranks, the leftmost pair merges first.
            if across is not None and across < left and across <= right:
                return False
            if left == right == NEVER:
                return True
            if left <= right:
                i += 1
            else:
                j += 1

    def grow(self, data: bytes, last: list) -> list:
        """Extends ``last`` (the last token of each prefix, None first) to all of ``data``."""
        done = here = len(last) - 1
        begin = max(0, done - self.longest)
        last.extend([None] * (len(data) - done))
        known, fits = self._pairs.get, self._fits
        for end, (size, token) in self._found.iter(data[begin:].decode("latin-1")):
            end += begin + 1
            # Longest tokens come first; the first that fits is the only one.
            if end <= here or end - size < begin:
                continue
            pair = (last[end - size], token)
            ok = known(pair)
            if fits(*pair) if ok is None else ok:
                last[end], here = token, end
        return last

    def read(self, last: list) -> list[int]:
        ids, at = [], len(last) - 1
        while at > 0:
            ids.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return ids[::-1]

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.read(self.grow(data, [None]))


class _Kept(dict):
    """Packed ids by string; long strings are not kept, and too many are forgotten at once."""

    def __init__(self, compute):
        self.compute = compute

    def __missing__(self, key: str) -> bytes:
        packed = self.compute(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= CACHED_STRINGS:
                self.clear()
            self[key] = packed
        return packed


class Packer:
    """Packed ids of whole texts.

    A space between two characters that are no white space always starts a
    piece, so most texts can be cut at their spaces and the ids of the parts
    be kept. Texts with longer runs of white space go through the pattern.
    """

    def __init__(self, encoder: Encoder, pattern: str, cut_at_spaces: bool):
        self.split = compiled(pattern).findall
        self.cut_at_spaces = cut_at_spaces
        self.pieces = _Kept(lambda piece: pack(encoder.encode(piece.encode())))
        self.spaced = _Kept(lambda part: self.by_pattern(" " + part))

    def by_pattern(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def __call__(self, text: str) -> bytes:
        ends_in_run = text[-1:] == " " and text[-2:-1].isspace()
        if not self.cut_at_spaces or ends_in_run or SPACE_RUN.search(text):
            return self.by_pattern(text)
        head, *parts = text.split(" ")
        return self.by_pattern(head) + b"".join(map(self.spaced.__getitem__, parts))


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _tools(path: str) -> dict:
    return held(("ranks", path), lambda: {"encoder": Encoder(read_ranks(path))})


def loaded(path: str) -> Encoder:
    """One encoder for each process and file."""
    return _tools(path)["encoder"]


def packer(path: str, pattern: str) -> Packer:
    tools = _tools(path)
    if pattern not in tools:
        tools[pattern] = Packer(tools["encoder"], pattern, cut_at_spaces=pattern == SPACED_PATTERN)
    return tools[pattern]


@functools.lru_cache(maxsize=4)
def compiled(pattern: str):
    import regex

    return regex.compile(pattern)


class Text:
    """An encoded text that can be appended to and edited.

    Only pieces from the one before the change up to the first old border behind
    it are encoded again.
    """

    def __init__(self, encoder: Encoder, pattern: str, text: str = ""):
        self.encoder, self.pattern, self.text = encoder, compiled(pattern), ""
        self.starts: list[int] = []
        self.pieces: list[list[int]] = []
        self.edit(0, 0, text)

    def ids(self) -> list[int]:
        return [i for piece in self.pieces for i in piece]

    def append(self, more: str) -> "Text":
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, replacement: str) -> "Text":
        """Replaces the characters from ``start`` to ``end``."""
        import bisect

        text = self.text[:start] + replacement + self.text[end:]
        moved = len(replacement) - (end - start)
        # White space is cut by what follows the whole run, so two pieces before the change count.
        first = max(0, bisect.bisect_right(self.starts, start) - 3)
        old = {s + moved: k for k, s in enumerate(self.starts) if s >= end}
        at = self.starts[first] if self.starts else 0
        starts, pieces, rest = self.starts[:first], self.pieces[:first], len(self.starts)
        for match in self.pattern.finditer(text, at):
            if match.start() >= start + len(replacement) and match.start() in old:
                rest = old[match.start()]
                break
            starts.append(match.start())
            pieces.append(self._piece(match.group(), len(starts) - 1, match.start()))
        self.starts = starts + [s + moved for s in self.starts[rest:]]
        self.pieces = pieces + self.pieces[rest:]
        self.text = text
        return self

    def _piece(self, piece: str, k: int, start: int) -> list[int]:
        data = piece.encode()
        if data in self.encoder.ranks:
            return [self.encoder.ranks[data]]
        if k < len(self.pieces) and self.starts[k] == start and self.pieces[k]:
            # The old last tokens stay valid for the prefix that both share.
            old = b"".join(map(self.encoder.bytes_of.__getitem__, self.pieces[k]))
            if data.startswith(old) and old not in self.encoder.ranks:
                return self.encoder.read(self.encoder.grow(data, self.encoder.grow(old, [None])))
        return self.encoder.encode(data)


def with_ids(docs: DataFrame, ranks: str, pattern: str, text: str = "text", out: str = "ids"):
    """Adds the ids of each whole text as little-endian unsigned 32-bit integers.

    ``ranks`` is the path of a rank file present on every executor.
    """

    @F.pandas_udf("binary")
    def encoded(texts):
        encode = packer(ranks, pattern)
        return texts.map(lambda t: encode(t) if t else b"")

    return added(docs, {out: encoded(F.col(text))})


def with_decoded(df: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded"):
    """Adds the bytes that the ids stand for; null ids give no bytes."""

    @F.pandas_udf("binary")
    def decoded(column):
        import numpy as np

        get = loaded(ranks).bytes_of.__getitem__
        return column.map(lambda b: b"".join(map(get, np.frombuffer(b, "<u4").tolist())) if b else b"")

    return added(df, {out: decoded(F.col(ids))})


def with_edited_ids(df: DataFrame, ranks: str, pattern: str, before: str, after: str, out: str = "ids"):
    """Ids of ``after``, encoded anew only around where it differs from ``before``."""

    @F.pandas_udf("binary")
    def edited(olds, news):
        import os

        import pandas as pd

        encoder, results = loaded(ranks), []
        for old, new in zip(olds, news):
            old, new = old or "", new or ""
            head = len(os.path.commonprefix([old, new]))
            tail = len(os.path.commonprefix([old[head:][::-1], new[head:][::-1]]))
            text = Text(encoder, pattern, old)
            ids = text.edit(head, len(old) - tail, new[head : len(new) - tail]).ids()
            results.append(pack(ids))
        return pd.Series(results, dtype=object)

    return added(df, {out: edited(F.col(before), F.col(after))})
