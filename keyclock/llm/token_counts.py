"""Exact token counts of a byte-level BPE vocabulary by two compiled finite-state transducers.

``Splitter`` is a deterministic transducer over classes of characters that marks where the vocabulary's pattern cuts a text into pieces.
Texts are cut in chunks; for every chunk the map from the state before it to the state after it is found (most chunks forget their start
within a few characters), the maps of a text are composed by a parallel prefix scan, and then all chunks mark their cuts side by side.

``Merger`` is a transducer over the bytes of a piece. A state holds the longest token prefix that ends the bytes read and, for each place
inside it, the last token of the encoding up to there; a transition carries by how much the token count changes. States and transitions
are compiled when first met and forgotten when there are too many, which changes no result.

Nulls: a null text counts as empty (0 bytes, 0 tokens); ids may be null or repeated. Special strings in a text are single tokens, as by
the library's default. Columns other than the two named are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyclock.llm.shared import Memo, byte_letters, once, slices

CHUNK = 512
MOST_STATES = 500_000
MOST_PIECES = 300_000

# classes of characters
_OTHER, _APOSTROPHE, _LETTER, _NUMBER, _SPACE, _WHITE, _STMD, _R, _V, _L, _E, _PAD = range(12)


def character_classes(tokenizer_path: str) -> np.ndarray:
    """The class of every code point, asked of the library's own pattern: which characters it joins with a letter, a digit or a mark."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(tokenizer_path).pre_tokenizer.pre_tokenize_str
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    classes = np.full(0x110000, _WHITE, dtype=np.uint8)
    # all characters in a row: each piece is a run of one class, of which the first is asked about
    runs = [(codes[a], codes[b - 1] + 1) for _, (a, b) in split("".join(map(chr, codes)))]
    runs = [(c, c + 1) for c in range(0x80)] + [(max(a, 0x80), b) for a, b in runs if b > 0x80]
    for mark, kind in (("!", _OTHER), ("1", _NUMBER), ("a", _LETTER)):
        ends = {a: b for _, (a, b) in split("".join(f"{mark}{chr(a)}\n" for a, _ in runs))}
        for i, (a, b) in enumerate(runs):
            if ends.get(3 * i) == 3 * i + 2:
                classes[a:b] = kind
    for text, kind in ((" ", _SPACE), ("'", _APOSTROPHE), ("stmd", _STMD), ("r", _R), ("v", _V), ("l", _L), ("e", _E)):
        classes[[ord(c) for c in text]] = kind
    return classes


class Splitter:
    """Cuts as the pattern 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white(?!non-white)|white does."""

    # in: the start, runs, an apostrophe that begins a piece, the same and r, v, l, a whole contraction, one or more white characters
    START, LETTERS, NUMBERS, OTHERS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, DONE, SPACE, WHITE, SPACES, WHITES = range(13)
    STATES = 13
    HERE, BACK = 1, 2  # a cut before this character, before the one before it

    def __init__(self, classes: np.ndarray) -> None:
        self.classes = classes
        table = [[self._step(s, c) for c in range(_PAD + 1)] for s in range(self.STATES)]
        self.next = np.array([[n for n, _ in row] for row in table], dtype=np.uint8).ravel()
        self.emit = np.array([[e for _, e in row] for row in table], dtype=np.uint8).ravel()

    def _fresh(self, c: int) -> int:
        return {_OTHER: self.OTHERS, _APOSTROPHE: self.QUOTE, _NUMBER: self.NUMBERS, _SPACE: self.SPACE, _WHITE: self.WHITE}.get(c, self.LETTERS)

    def _joined(self, c: int) -> int:
        """After a space that belongs to the piece."""
        return self.OTHERS if c == _APOSTROPHE else self._fresh(c)

    def _step(self, s: int, c: int) -> tuple[int, int]:
        here, back, letters = self.HERE, self.BACK, (_LETTER, _STMD, _R, _V, _L, _E)
        if c == _PAD:
            return s, 0
        if s == self.START:
            return self._fresh(c), 0
        if s in (self.SPACE, self.WHITE, self.SPACES, self.WHITES):
            if c in (_SPACE, _WHITE):
                return self.SPACES if c == _SPACE else self.WHITES, 0
            # the last white character of a run stays with what follows if it is a space, and stands alone otherwise
            return {
                self.SPACE: (self._joined(c), 0),
                self.WHITE: (self._fresh(c), here),
                self.SPACES: (self._joined(c), back),
                self.WHITES: (self._fresh(c), here | back),
            }[s]
        if s == self.LETTERS and c in letters or s == self.NUMBERS and c == _NUMBER or s == self.OTHERS and c in (_OTHER, _APOSTROPHE):
            return s, 0
        if s == self.QUOTE:
            if c in (_OTHER, _APOSTROPHE):
                return self.OTHERS, 0
            if c in (_STMD, _R, _V, _L):
                return {_STMD: self.DONE, _R: self.QUOTE_R, _V: self.QUOTE_V, _L: self.QUOTE_L}[c], 0
        if s in (self.QUOTE_R, self.QUOTE_V, self.QUOTE_L):
            if c == (_L if s == self.QUOTE_L else _E):
                return self.DONE, 0
            return (self.LETTERS, back) if c in letters else (self._fresh(c), back | here)
        return self._fresh(c), here

    def maps(self, codes: np.ndarray) -> np.ndarray:
        """Of each chunk (a row of classes) the state after it for each state before it."""
        lanes, length = codes.shape
        out = np.tile(np.arange(self.STATES, dtype=np.uint8), (lanes, 1))
        left = np.arange(lanes)  # rows whose start still matters
        for begin in range(0, length, 32):
            if not len(left):
                break
            some = out[left]
            for j in range(begin, min(begin + 32, length)):
                some = self.next[some * np.intp(_PAD + 1) + codes[left, j][:, None]]
            out[left] = some
            same = (some == some[:, :1]).all(axis=1)
            if same.any():  # from here on one state stands for all
                rows, state = left[same], some[same, 0]
                for j in range(begin + 32, length):
                    state = self.next[state * np.intp(_PAD + 1) + codes[rows, j]]
                out[rows] = state[:, None]
                left = left[~same]
        return out

    def entries(self, maps: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The state before each chunk: an inclusive scan of the maps that starts anew where ``first`` is set."""
        done, flag, lanes, k = maps.copy(), first.copy(), len(maps), 1
        while k < lanes:
            mine = np.flatnonzero(~flag[k:]) + k
            if not len(mine):
                break
            done[mine], flag[mine] = np.take_along_axis(done[mine], done[mine - k].astype(np.intp), axis=1), flag[mine - k]
            k *= 2
        return np.where(first, np.uint8(self.START), np.roll(done[:, self.START], 1))

    def cuts(self, texts: list[str]) -> list[list[int]]:
        """Of each text the places where its pieces begin, and its length; of an empty text none."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        chunks = -(-lengths // CHUNK)
        lanes = int(chunks.sum())
        if not lanes:
            return [[] for _ in texts]
        codes = np.full(lanes * CHUNK, _PAD, dtype=np.uint8)
        base = np.cumsum(chunks) - chunks
        place = np.repeat(base * CHUNK - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        codes[place] = self.classes[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")]
        grid = np.ascontiguousarray(codes.reshape(lanes, CHUNK))
        first = np.zeros(lanes, dtype=bool)
        first[base[chunks > 0]] = True
        state = self.entries(self.maps(grid), first)
        marks = np.zeros(lanes * CHUNK + 1, dtype=bool)
        turned, rows = np.ascontiguousarray(grid.T), np.arange(lanes) * CHUNK
        for j in range(CHUNK):
            key = state * np.intp(_PAD + 1) + turned[j]
            emitted = self.emit[key]
            state = self.next[key]
            marks[rows[(emitted & self.HERE) > 0] + j] = True
            marks[rows[(emitted & self.BACK) > 0] + j - 1] = True
        some = chunks > 0
        last = base[some] + chunks[some] - 1
        pending = np.isin(state[last], (self.QUOTE_R, self.QUOTE_V, self.QUOTE_L))  # a text that ends in half a contraction
        marks[(base[some] * CHUNK + lengths[some])[pending] - 1] = True
        marks[base[some] * CHUNK] = True
        at = np.flatnonzero(marks)
        split = np.split(at, np.searchsorted(at, base[1:] * CHUNK)) if len(texts) > 1 else [at]
        return [[*(x - b * CHUNK).tolist(), n] if n else [] for x, b, n in zip(split, base.tolist(), lengths.tolist())]


class Merger:
    """Token counts of pieces, by states that are compiled when first met."""

    def __init__(self, vocabulary: dict[str, int], merges: list) -> None:
        letters = byte_letters()
        #: Tokens by their bytes, numbered from 1; 0 is the begin of a piece.
        self.numbers = {bytes(letters[c] for c in t): i for i, t in enumerate((t for t in vocabulary if all(c in letters for c in t)), start=1)}
        self.tokens = [b"", *self.numbers]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.ranks = {(bytes(letters[c] for c in a), bytes(letters[c] for c in b)): i for i, (a, b) in enumerate(pairs)}
        self.prefixes = {t[:k] for t in self.numbers for k in range(1, len(t) + 1)}
        self._forget()

    def _forget(self) -> None:
        #: A state: the longest token prefix that ends what was read; for each place from its begin to its end, the last token of the
        #: encoding up to there, and in the low ten bits 512 plus the count there less the count at the end.
        self.states: list[tuple[bytes, tuple[int, ...]]] = [(b"", (512,))]
        self.known = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, int]] = {}
        self.beside: dict[int, bool] = {}

    def encode(self, piece: bytes) -> list[bytes]:
        """The definition itself: the pair of least rank, leftmost first, merges until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, len(self.ranks)), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when encoded together. Tokens of which all neighbours do are the encoding of the whole."""
        if not left:
            return True
        fit = self.beside.get(left << 32 | right)
        if fit is None:
            pair = [self.tokens[left], self.tokens[right]]
            fit = self.beside[left << 32 | right] = self.encode(b"".join(pair)) == pair
        return fit

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        held, lasts = self.states[state]
        grown = held + bytes((byte,))
        for start, last in enumerate(lasts):  # the last token after this byte: the longest that fits what comes before it
            token = self.numbers.get(grown[start:])
            if token and self._fit(last >> 10, token):
                break
        change = (last & 1023) - 512 + 1
        after = (*lasts, token << 10 | 512 + change)
        keep = next(i for i in range(len(grown) + 1) if i == len(grown) or grown[i:] in self.prefixes)
        key = (grown[keep:], tuple(x - change for x in after[keep:]))
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
        return self.known[key], change

    def count(self, piece: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self._forget()
        state = total = 0
        steps = self.steps
        for byte in piece:
            step = steps.get(state << 8 | byte)
            if step is None:
                step = steps[state << 8 | byte] = self._compile(state, byte)
            state = step[0]
            total += step[1]
        return total


def counter(tokenizer_path: str, classes: np.ndarray | None = None):
    """A function from texts to their token counts."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shape = json.load(f)
    pre, model = shape.get("pre_tokenizer") or {}, shape["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not shape.get("normalizer")
    if not plain or model.get("type", "BPE") != "BPE" or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError("only a plain byte-level BPE vocabulary can be compiled")
    added = shape.get("added_tokens") or []
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("special strings that take their neighbours with them cannot be compiled")
    specials = sorted((t["content"] for t in added), key=len, reverse=True)
    special = re.compile("|".join(map(re.escape, specials))) if specials else None
    splitter, merger = Splitter(character_classes(tokenizer_path) if classes is None else classes), Merger(model["vocab"], model["merges"])
    memo = Memo(MOST_PIECES)

    def learn(pieces: list[str]) -> dict[str, int]:
        return {p: merger.count(p.encode("utf-8")) for p in pieces}

    def count(texts: list[str]) -> list[int]:
        parts, owner, totals = [], [], [0] * len(texts)
        for i, text in enumerate(texts):
            own = special.split(text) if special else [text]
            totals[i] += len(own) - 1
            parts += own
            owner += [i] * len(own)
        cut = [[text[a:b] for a, b in zip(at, at[1:])] for text, at in zip(parts, splitter.cuts(parts))]
        known = memo.of(set().union(*cut), learn)
        for i, pieces in zip(owner, cut):
            totals[i] += sum(map(known.__getitem__, pieces))
        return totals

    return count


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit."""

    classes = zlib.compress(character_classes(tokenizer_path).tobytes())  # a few kilobytes, whatever the input

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = once(("counter", tokenizer_path), lambda: counter(tokenizer_path, np.frombuffer(zlib.decompress(classes), np.uint8)))
        for batch in batches:
            for rows in slices(batch, 2, 1 << 20):
                yield pa.record_batch([rows.column(0), rows.column(1), pa.array(count(rows.column(2).to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(counts, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
