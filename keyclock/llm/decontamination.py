"""Benchmark decontamination by latent semantic retrieval: passages that quote or paraphrase a benchmark item.

1. Words of the benchmark get their inverse document frequency from all documents.
2. The TF-IDF matrix of the benchmark's passages is factored by a randomised SVD whose passes over the rows run on Spark; only matrices of
   (terms x rank) size, bounded by ``TERMS`` and ``RANK``, meet on the driver.
3. Every document is cut in half-overlapping windows of ``2 * STRIDE`` words; windows are folded into the latent space and searched for
   items by cosine, between what the space holds of the window and of the item. So a small space, or many items in it, does not lower the
   cosine of a passage with its item. An index of the items' rarest words is searched as well: a window is a candidate for every item of
   which enough of these words stand around it.
4. Candidates are checked by the longest common subsequence of words with what stands around the window, and by answer words, the
   rarest quarter of the item's words. A quotation must have ``lcs`` of the item and ``answer`` of these words. A rewording (a candidate of the
   latent search) may have lost more of them, ``PARAPHRASE`` says how many, but must have more of the item in order. The index finds all
   quotations, whatever the rank; rewordings of rare words only the latent search finds. Items of very few words are found wherever
   these stand.

The benchmark is the stated query set, searched in blocks of ``ITEMS`` items against all windows of all documents; per block the broadcast
is bounded by ``ITEMS``, ``TERMS`` and ``RANK``. The documents are read twice for every ``PASS`` blocks (frequencies, search), and not shuffled.
Above ``TERMS`` words in a block, its rarer words share columns of the latent space, which moves cosines a little. Nulls: null or wordless texts and items match nothing, null ids
are carried along. Repeated rows give repeated results; of one document and item the best place is told. Empty tables give an empty
result. Very long texts are worked off in full, window by window. Only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyclock.llm.shared import slices

STRIDE = 16
RANK = 128
TERMS = 1 << 15
ITEMS = 4096
COSINE = 0.5
LCS = 0.6
ANSWER = 0.5
#: least shares of the item's words in order, and of its rarest words, of a rewording
PARAPHRASE = (0.75, 0.25)
#: blocks of items that are searched for in one pass over the documents
PASS = 16
#: Most places of rare words that are looked at together.
PLACES = 1 << 20
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Items:
    """A block of benchmark items ready to be searched for."""

    ids: list[int | None]
    words: list[list[str]]
    place: dict[str, int]  # of a word in the tables below
    idf: np.ndarray
    folded: np.ndarray  # per word its idf times its row of the latent basis; float32
    latent: np.ndarray  # per item, of unit length; float32

    def searcher(self, cosine: float, lcs: float, answer: float, paraphrase: tuple[float, float] | None = None) -> Callable[[list[str]], list[list[tuple]]]:
        """A function from texts to their matches (item id, cosine, share of the LCS, share of rare words, first word of the window)."""
        loose = min(lcs, paraphrase[0]) if paraphrase else lcs
        fewest = min(answer, paraphrase[1]) if paraphrase else answer
        masks, rare = [], []
        for words in self.words:
            own: dict[str, int] = {}
            for i, w in enumerate(words):
                own[w] = own.get(w, 0) | 1 << i
            masks.append(own)
            distinct = sorted(set(words), key=lambda w: (-self.idf[self.place[w]], w))
            rare.append(set(distinct[: max(1, len(distinct) // 4)]))
        size = np.array([len(w) for w in self.words], dtype=np.int64)
        # places of which words count as sharing, and how many of them must be around a window; without an answer, as many as the LCS has
        sharing = rare if answer > 0 else [set(w) for w in self.words]
        need = np.array([max(1, int(np.ceil((answer * len(r) if answer > 0 else lcs * n) - 1e-9))) for r, n in zip(rare, size.tolist())], dtype=np.int64)
        shared_items = np.repeat(np.arange(len(sharing)), [len(r) for r in sharing])
        shared_words = np.array([self.place[w] for r in sharing for w in r], dtype=np.int64)

        def by_words(place: np.ndarray, spot: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """All windows and items of which ``need`` shared words are around the window; ``spot`` is a word's place in the grid."""
            known = np.flatnonzero(place >= 0)
            known = known[np.argsort(place[known], kind="stable")]
            often = np.bincount(place[known], minlength=len(self.idf))
            begin, spots, top = np.cumsum(often) - often, spot[known], int(base[-1]) * STRIDE
            group = (np.cumsum(often[shared_words]) - 1) // PLACES
            group = np.maximum.accumulate(group[np.searchsorted(shared_items, shared_items)])  # an item stays whole
            pairs = [np.zeros(0, np.int64)]
            for g in np.unique(group).tolist():
                items, words = shared_items[group == g], shared_words[group == g]
                count = often[words]
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[words], count)
                keys = np.sort(np.repeat(items, count) * top + spots[at])
                item, first = keys // top, keys % top
                last = np.arange(len(keys)) + need[item] - 1
                ok = np.flatnonzero(last < len(keys))
                ok = ok[item[last[ok]] == item[ok]]
                item, first, last = item[ok], first[ok], first[last[ok]]
                owner = np.searchsorted(base, first // STRIDE, side="right") - 1
                ok = (last - first < 2 * STRIDE + 2 * size[item]) & (last // STRIDE < base[owner + 1])
                item, first, last, owner = item[ok], first[ok], last[ok], owner[ok]
                low = np.maximum(-((size[item] + 2 * STRIDE - last - 1) // STRIDE), base[owner])
                high = np.minimum((first + size[item]) // STRIDE, base[owner + 1] - 1)
                count = np.maximum(high - low + 1, 0)
                window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
                pairs.append(np.unique(window * len(size) + np.repeat(item, count)))
            return np.divmod(np.concatenate(pairs), max(1, len(size)))

        # words that no item has are the last row, which is zero
        folded, ones = np.vstack((self.folded, np.zeros((1, self.folded.shape[1]), np.float32))), np.ones((1, STRIDE), np.float32)

        def check(words: list[str], window: int, item: int) -> tuple[float, float]:
            size, own = len(self.words[item]), masks[item]
            around = words[max(0, window * STRIDE - size) : (window + 2) * STRIDE + size]
            told = len(rare[item].intersection(around)) / len(rare[item])
            if told < fewest or sum(map(own.__contains__, around)) / size < loose:
                return 0.0, told
            # bit-parallel longest common subsequence: a zero bit for every word of the item that is in it
            full = (1 << size) - 1
            row = full
            for w in around:
                hit = row & own.get(w, 0)
                if hit:
                    row = (row + hit | row - hit) & full
            return (size - row.bit_count()) / size, told

        def search(texts: list[str]) -> list[list[tuple]]:
            get, out = self.place.get, [[] for _ in texts]
            lists = [words_of(t) for t in texts]
            blocks = [-(-len(x) // STRIDE) for x in lists]
            base = np.cumsum([0, *blocks])
            if not base[-1] or not self.ids:
                return out
            place = np.array(list(map(get, chain.from_iterable(lists), repeat(-1))), dtype=np.int64)
            lengths = np.array([len(x) for x in lists])
            inside = np.arange(len(place)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            grid = np.full(base[-1] * STRIDE, -1, dtype=np.int64)
            spot = np.repeat(base[:-1] * STRIDE, lengths) + inside
            grid[spot] = place
            grid, sums = grid.reshape(-1, STRIDE), np.zeros((base[-1] + 1, folded.shape[1]), dtype=np.float32)
            for i in range(0, len(grid), 256):
                sums[i : min(i + 256, len(grid))] = np.matmul(ones, folded[grid[i : i + 256]])[:, 0]
            # a window is a block and the next one of the same document
            follows = np.ones(base[-1], dtype=bool)
            follows[base[1:][np.array(blocks) > 0] - 1] = False
            vectors = sums[:-1] + np.where(follows[:, None], sums[1:], np.float32(0))
            norms = np.maximum(np.linalg.norm(vectors, axis=1), np.float32(1e-12))
            near = vectors @ self.latent.T
            close = np.flatnonzero(near >= (cosine * norms)[:, None].astype(np.float32))
            shared, having = by_words(place, spot, base)
            every = np.union1d(close, shared * len(size) + having)
            latent = np.isin(every, close, assume_unique=True)
            windows, items = np.divmod(every, len(size))
            owner = np.searchsorted(base, windows, side="right") - 1
            best: dict[tuple[int, int], tuple] = {}
            for w, i, d, folds in zip(windows.tolist(), items.tolist(), owner.tolist(), latent.tolist()):
                window = w - int(base[d])
                share, told = check(lists[d], window, i)
                reworded = paraphrase and folds and share >= paraphrase[0] and told >= paraphrase[1]
                if reworded or (share >= lcs and told >= answer):
                    found = (share, told, float(near[w, i] / norms[w]), -window)
                    if (d, i) not in best or found > best[d, i]:
                        best[d, i] = found
            for (d, i), (share, told, cos, window) in sorted(best.items()):
                out[d].append((self.ids[i], cos, share, told, -window * STRIDE))
            return out

        return search


def frequencies(docs: DataFrame, vocabulary: set[str], text_col: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents each word of the vocabulary is, and the number of documents; over all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = Counter(), 0
        for batch in batches:
            for rows in slices(batch, 0):
                for text in rows.column(0).to_pylist():
                    counts.update(vocabulary.intersection(words_of(text)))
                n += rows.num_rows
        counts[""] = n  # no word is empty
        yield pa.record_batch([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(counted, "word string, n long")
    # one row per word of a block of items
    found = {r.word: r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = found.pop("", 0)
    return found, total


def factored(rows: DataFrame, terms: int, rank: int, rounds: int = 2, seed: int = 11) -> np.ndarray:
    """An orthonormal basis (terms x rank) of the strongest right singular vectors of a sparse matrix.

    ``rows`` has ``place array<int>`` and ``weight array<float>``. A randomised range finder with subspace iteration: each pass sends a thin
    matrix to the rows and adds up, partition by partition, what comes back; the matrix itself stays where it is."""
    spark = rows.sparkSession

    def times(thin: np.ndarray, inner: bool) -> np.ndarray:
        shared = spark.sparkContext.broadcast(thin.astype(np.float32))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, out = shared.value, None
            for batch in batches:
                for place, weight in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    i, x = np.array(place, np.int64), np.array(weight, np.float32)
                    y = x @ m[i]
                    if inner:
                        out = np.zeros((m.shape[1],) * 2) if out is None else out
                        out += np.outer(y, y)
                    else:
                        out = np.zeros(m.shape) if out is None else out
                        np.add.at(out, i, np.outer(x, y))
            if out is not None:
                yield pa.record_batch([pa.array([out.astype("<f4").tobytes()], pa.binary())], ["sum"])

        shape = (thin.shape[1],) * 2 if inner else thin.shape
        total = np.zeros(shape)
        for r in rows.mapInArrow(partial, "sum binary").toLocalIterator():
            total += np.frombuffer(r["sum"], "<f4").reshape(shape)
        shared.destroy()
        return total

    width = min(rank + 10, terms)
    basis = np.random.default_rng(seed).standard_normal((terms, width))
    for _ in range(rounds + 1):
        basis, _ = np.linalg.qr(times(basis, inner=False))
    values, vectors = np.linalg.eigh(times(basis, inner=True))
    strong = np.argsort(-values)[: min(rank, width)]
    return basis @ vectors[:, strong[values[strong] > 1e-9 * max(values.max(), 1e-30)]]


def prepared(docs: DataFrame, items: list[tuple[int | None, str]], rank: int = RANK, text_col: str = "text", counted: tuple[dict[str, int], int] | None = None) -> Items:
    """The block of items with frequencies from all documents (those ``counted``, or counted now) and their latent space."""
    spark = docs.sparkSession
    kept = [(i, words_of(t or "")) for i, t in items]
    kept = [(i, w) for i, w in kept if w]
    vocabulary = sorted({w for _, words in kept for w in words})
    place = {w: k for k, w in enumerate(vocabulary)}
    found, total = counted or (frequencies(docs, set(vocabulary), text_col) if kept else ({}, 0))
    idf = np.array([np.log((total + 1) / (found.get(w, 0) + 1)) + 0.05 for w in vocabulary])
    # the most frequent words have columns of their own
    rank_of = np.argsort(np.argsort(idf, kind="stable"), kind="stable") if len(vocabulary) > TERMS else None
    own = TERMS // 2
    term = np.array([k if rank_of is None else int(rank_of[k]) if rank_of[k] < own else own + zlib.crc32(w.encode("utf-8")) % (TERMS - own) for k, w in enumerate(vocabulary)], dtype=np.int64)
    terms = min(len(vocabulary), TERMS)
    if not kept:
        return Items([], [], {}, idf, np.zeros((0, 1), np.float32), np.zeros((0, 1), np.float32))

    def vector(words: list[str]) -> tuple[list[int], list[float]]:
        weights: dict[int, float] = {}
        for w in words:
            weights[int(term[place[w]])] = weights.get(int(term[place[w]]), 0.0) + float(idf[place[w]])
        norm = float(np.sqrt(sum(x * x for x in weights.values())))
        return list(weights), [x / norm for x in weights.values()]

    vectors = [vector(words) for _, words in kept]
    rows = spark.createDataFrame(vectors, "place array<int>, weight array<float>").repartition(-(-len(vectors) // 1024))
    basis = factored(rows, terms, rank)
    latent = np.stack([np.array(x) @ basis[p] for p, x in vectors])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    folded = basis[term] * idf[:, None]
    return Items([i for i, _ in kept], [w for _, w in kept], place, idf, folded.astype(np.float32), latent.astype(np.float32))


def passes(docs: DataFrame, benchmark: DataFrame, rank: int, text_col: str = "text") -> Iterator[list]:
    """For every pass over the documents its blocks of items, broadcast as plain values: workers need no class to read them."""
    context, every = docs.sparkSession.sparkContext, blocks(benchmark)
    while True:
        some = list(islice(every, PASS))
        if not some:
            return
        vocabulary = {w for block in some for _, t in block for w in words_of(t or "")}
        counted = frequencies(docs, vocabulary, text_col) if vocabulary else ({}, 0)
        yield [context.broadcast(list(vars(prepared(docs, block, rank, text_col, counted)).values())) for block in some]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = ITEMS) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's items, at most ``size`` at a time on the driver."""
    held = []
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        held.append((r.i, r.t))
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, lcs: float = LCS, answer: float = ANSWER, rank: int = RANK, paraphrase: tuple[float, float] | None = PARAPHRASE) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share and first_word (of the window) of every document and item that it contains."""
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, first_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    for number, shared in enumerate(passes(docs, benchmark, rank)):

        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searches = [Items(*s.value).searcher(cosine, lcs, answer, paraphrase) for s in shared]
            for batch in batches:
                for part in slices(batch, 1, 1 << 20):
                    texts = part.column(1).to_pylist()
                    got = [(d, *m) for search in searches for d, own in zip(part.column(0).to_pylist(), search(texts)) for m in own]
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                    columns = [pa.array([g[i] for g in got], t) for i, t in enumerate(kinds)]
                    yield pa.record_batch(columns, ["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "first_word"])

        hits = rows.mapInArrow(found, schema)
        out = hits if number == 0 else out.unionAll(hits)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, text: Column, cosine: float = COSINE, lcs: float = LCS, answer: float = ANSWER, rank: int = RANK, paraphrase: tuple[float, float] | None = PARAPHRASE) -> Column:
    """Whether the text contains an item of the benchmark, as a column of ``docs``."""
    def hit(shared) -> Column:
        @F.pandas_udf("boolean")
        def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            searches = [Items(*s.value).searcher(cosine, lcs, answer, paraphrase) for s in shared]
            for texts in batches:
                out = np.zeros(len(texts), dtype=bool)
                for i in range(0, len(texts), 200):
                    some = texts.iloc[i : i + 200].tolist()
                    for search in searches:
                        out[i : i + 200] |= np.array([bool(m) for m in search(some)], dtype=bool)
                yield pd.Series(out)

        return found(F.coalesce(text, F.lit("")))

    any_ = F.lit(False)
    for shared in passes(docs, benchmark, rank):
        any_ = any_ | hit(shared)
    return any_
