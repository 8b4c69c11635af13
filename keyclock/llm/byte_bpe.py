"""Byte-level BPE as a tree: halves are encoded on their own, and neighbours are joined.

A text is halved until a piece has at most ``LEAF`` characters, and those are encoded. Two neighbours are joined by encoding a window
around the seam anew; the window grows until what is outside of it cannot change, on two grounds:

* The pattern's matches never go from something else into white space. So where white space follows something else, a match ends and the
  next one begins whatever stands further left or right, and all tokens up to there, and from there on, are those of the whole text. A
  window that begins and ends at such places is enough. (Pass ``breaks=None`` for a pattern that has no such places.)
* Within one match without end (no white space), tokens are those of the whole match as soon as every two neighbours are: a merge over
  the seam of two tokens that is done in the whole would be done in the two alone, as merges of lower rank inside each of them are the
  same, and of several merges of one rank the leftmost comes first in both. So a window of tokens is enough whose first and last tokens
  stand the test with their neighbours outside. That needs every token to be the encoding of its own bytes, which a test holds for the
  vocabulary.

Decoding concatenates: the bytes of the halves, one after the other.

Nulls: a null text is empty, has no ids and decodes to no bytes; null document ids are kept. Repeated rows are encoded each. Texts of any
length are encoded whole. An empty table gives an empty one. Only the two named columns are read."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyclock.llm.shared import once, slices

LEAF = 512  # characters
WINDOW = 48  # characters to each side of a seam, at first
LONG = 32  # bytes of a match that is halved, too
#: White space after something else. Every character that either side may take for white space counts as such on the left.
BREAKS = r"(?<=\S)[ \t\n\r]"


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class TreeEncoder:
    """Encodes and decodes whole texts with the ranks and the pattern of a tiktoken vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, breaks: str | None = BREAKS, leaf: int = LEAF) -> None:
        import tiktoken

        self.ranks, self.leaf = ranks, leaf
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.lengths = array("I", [0]) * (max(self.bytes) + 1)
        for rank, token in self.bytes.items():
            self.lengths[rank] = len(token)
        # the library splits and encodes pieces of text that are short
        self.short = tiktoken.Encoding("short", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.breaks = re.compile(breaks) if breaks else None
        self.pattern = pattern
        self.fit: dict[tuple[int, int], bool] = {}

    # ---- texts

    def encode(self, text: str) -> array:
        return self._text(text, 0, len(text))

    def _text(self, text: str, start: int, end: int) -> array:
        if end - start <= self.leaf:
            return array("I", self.short(text[start:end]))
        if self.breaks is None or not self.breaks.search(text, start + 1, end):
            return self._matches(text[start:end])
        middle = (start + end) // 2
        return self._join(self._text(text, start, middle), self._text(text, middle, end), text, start, middle, end)

    def _join(self, left: array, right: array, text: str, start: int, middle: int, end: int) -> array:
        """The ids of text[start:end] from those of its two parts."""
        a = b = middle
        if not (start < middle < end and text[middle] in " \t\n\r" and not text[middle - 1].isspace()):
            width = WINDOW
            while True:  # the last break before the seam, the first one after it
                a = max((m.start() for m in self.breaks.finditer(text, max(start + 1, middle - width), middle)), default=start)
                if a > start or middle - width <= start:
                    break
                width *= 4
            found = self.breaks.search(text, middle + 1, end)
            b = found.start() if found else end
        keep, drop = self._count(reversed(left), text[a:middle]), self._count(right, text[middle:b])
        window = text[a:b]
        between = self._matches(window) if len(window) > self.leaf else array("I", self.short(window))
        return left[: len(left) - keep] + between + right[drop:]

    def _count(self, ids, text: str) -> int:
        """How many of the ids stand for the text, which ends where one of them does."""
        length, count, lengths = len(text.encode()), 0, self.lengths
        if length:
            for i in ids:
                length -= lengths[i]
                count += 1
                if length <= 0:
                    break
        return count

    # ---- matches of the pattern

    def _matches(self, text: str) -> array:
        """Ids of a text that may hold very long matches."""
        import regex

        out = array("I")
        for m in regex.finditer(self.pattern, text):
            # a match on its own is one match again, a run of them need not be the same at its end
            out.extend(self._bytes(m.group().encode()) if m.end() - m.start() > LONG else self.short(m.group()))
        return out

    def _bytes(self, piece: bytes) -> list[int]:
        """Ids of one match: its halves', joined."""
        if len(piece) <= LONG:
            return self.merged(piece)
        middle = len(piece) // 2
        return self._seam(self._bytes(piece[:middle]), self._bytes(piece[middle:]))

    def _seam(self, left: list[int], right: list[int]) -> list[int]:
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = self.merged(self.decode(left[a:] + right[:b]))
            if (a == 0 or self.fits(left[a - 1], window[0])) and (b == len(right) or self.fits(window[-1], right[b])):
                return left[:a] + window + right[b:]
            width *= 2

    def fits(self, a: int, b: int) -> bool:
        """Whether the two tokens are the encoding of their bytes."""
        if (a, b) not in self.fit:
            if len(self.fit) > 1 << 20:
                self.fit.clear()
            self.fit[a, b] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return self.fit[a, b]

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a short piece: the two neighbours of the lowest rank become one, the leftmost of equal ones, until no two have a rank."""
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > 1:
            found = [ranks.get(x + y, -1) for x, y in zip(parts, parts[1:])]
            least = min((r for r in found if r >= 0), default=None)
            if least is None:
                break
            i = found.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    # ---- back

    def decode(self, ids) -> bytes:
        if len(ids) <= 1024:
            return b"".join(map(self.bytes.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def _encoder(ranks_path: str, pattern: str, breaks: str | None) -> TreeEncoder:
    return once(("byte_bpe", ranks_path, pattern, breaks), lambda: TreeEncoder(read_ranks(ranks_path), pattern, breaks))


def encoded(docs: DataFrame, ranks_path: str, pattern: str, breaks: str | None = BREAKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids`` (unsigned 32-bit integers, little-endian, one after the other) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern, breaks)
        for batch in batches:
            for rows in slices(batch, 1):
                ids = [encoder.encode(t or "") for t in rows.column(1).to_pylist()]
                yield pa.record_batch([rows.column(0), pa.array([_little(i) for i in ids], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, ids binary")


def decoded(ids: DataFrame, ranks_path: str, pattern: str, breaks: str | None = BREAKS) -> DataFrame:
    """The rows of :func:`encoded`, with the ``bytes`` that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern, breaks)
        for batch in batches:
            for rows in slices(batch, 1):
                texts = [encoder.decode(_from_little(i)) for i in rows.column(1).to_pylist()]
                yield pa.record_batch([*rows.columns, pa.array(texts, pa.binary())], ["doc_id", "ids", "bytes"])

    return ids.mapInArrow(run, "doc_id long, ids binary, bytes binary")


def _little(ids: array) -> bytes:
    import sys

    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def _from_little(raw: bytes) -> array:
    import sys

    ids = array("I")
    ids.frombytes(raw)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


def round_trips(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the bytes they decode to."""
    rows = decoded(encoded(docs, ranks_path, pattern, BREAKS, id_col, text_col), ranks_path, pattern)
    return rows.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
