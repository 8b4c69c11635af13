"""SimHash fingerprints and all links between them, by vantage-point trees over parts of the fingerprint.

Two fingerprints that differ in at most ``radius`` bits differ, in at least one of ``bands`` bands of bits, in no more bits than that
band's share of the radius (the shares plus one add up to the radius plus one). The number of differing bits of a band obeys the triangle
inequality, so each band has a vantage-point tree of its own: a node holds a vantage value and a distance, and parts the values within
that distance from the others. A fingerprint lives in one leaf of each tree, and is shown to every other leaf that its ball of the
band's share reaches: a branch is pruned when the triangle bound rules it out. Leaves are the shards of a Spark job; in each, what lives
there is compared in all 64 bits with all that is there. Shares are small (1 and 0 of 16 bits by default), so few shards overlap, where a
tree over all 64 bits would show nearly every fingerprint to most of them.

Trees are fitted to a sample of at most ``SAMPLE`` distinct fingerprints (their vantage values only; every fingerprint is indexed and
searched). A leaf that cannot be split is dealt in parts of about ``4 * LEAF``, and every two parts meet in a tile of their own, so no task
holds more than two parts; such a group's comparisons, not its memory, grow with its square. Equal fingerprints are one, with
its documents beside it, so copies make no pairs; a shard tells which of its fingerprints hang together, not all their pairs.

Nulls: a null text is empty and has fingerprint zero; fingerprint zero is linked like any other. Null ids are no component's least id
unless it has no other. Repeated rows each get a result. An empty table gives an empty one. Only the two named columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyclock.llm.components import components
from keyclock.llm.shared import hash_sample, slices, written

SAMPLE = 1 << 16
LEAF = 1024
SHINGLE = 4


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """XXH64 of the text's word shingles, A-Z in lower case, as rows of eight bytes, the highest first."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return np.zeros((0, 8), dtype=np.uint8)
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = np.concatenate(([0], ends[:-1]))
    marks = zip(begins[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist())
    return np.frombuffer(b"".join([xxh64_digest(joined[i:j], seed) for i, j in marks]), np.uint8).reshape(-1, 8)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits of which each is set in more than half the rows; zero where there are none."""
    # sums of bytes would overflow, so rows are counted in runs of 255
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 255):
        counts += np.add.reduce(np.unpackbits(hashes[i : i + 255], axis=1), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = 42) -> int:
    """Bits that are set in more than half the XXH64 hashes of the text's word shingles, A-Z in lower case."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and text_hash of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, 1):
                got = np.array([fingerprint(t, shingle) for t in rows.column(1).to_pylist()], dtype=np.uint64)
                yield pa.record_batch([rows.column(0), pa.array(got.view(np.int64)), rows.column(2)], ["doc_id", "fp", "text_hash"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(hashed, "doc_id long, fp long, text_hash long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b))


@dataclass
class Tree:
    """A vantage-point tree over the bits of ``mask``. Children of node i are in ``inner[i]`` and ``outer[i]``; a leaf l is -1 - l."""

    mask: int
    share: int
    vantage: np.ndarray
    within: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    tasks: np.ndarray  # parts of each leaf

    def leaves(self, values: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``values`` and the leaves that a ball of radius ``share`` around them reaches."""
        rows, nodes, found = np.arange(len(values)), np.zeros(len(values), dtype=np.int64), []
        if not len(self.vantage):
            return rows, nodes
        while len(rows):
            d = distance(values[rows] & np.uint64(self.mask), self.vantage[nodes]).astype(np.int64)
            near, far = d - share <= self.within[nodes], d + share > self.within[nodes]
            rows, nodes = np.concatenate((rows[near], rows[far])), np.concatenate((self.inner[nodes[near]], self.outer[nodes[far]]))
            done = nodes < 0
            found.append((rows[done], -1 - nodes[done]))
            rows, nodes = rows[~done], nodes[~done]
        return np.concatenate([r for r, _ in found]), np.concatenate([n for _, n in found])


def grow(sample: np.ndarray, mask: int, share: int, scale: float, leaf: int = LEAF, seed: int = 7) -> Tree:
    """Splits until a leaf stands for at most ``leaf`` fingerprints, ``scale`` for each of the sample, or cannot be split."""
    rng = np.random.default_rng(seed)
    vantage, within, inner, outer, tasks = [], [], [], [], []

    def node(values: np.ndarray) -> int:
        best = None
        if len(values) * scale > leaf:
            for v in rng.choice(values, size=min(5, len(values)), replace=False):
                d = distance(values, v)
                counts = np.cumsum(np.bincount(d, minlength=65))
                for cut in {int(np.searchsorted(counts, len(values) * q)) for q in (0.35, 0.5, 0.65)}:
                    left = counts[cut]
                    if 0 < left < len(values):
                        overlap = counts[min(cut + share, 64)] - (counts[cut - share] if cut >= share else 0)
                        cost = (overlap + abs(2 * left - len(values)) / 4) / len(values)
                        if best is None or cost < best[0]:
                            best = (cost, v, cut, d <= cut)
        if best is None:
            tasks.append(max(1, round(len(values) * scale / (4 * leaf))))
            return -len(tasks)
        i = len(vantage)
        for part, x in ((vantage, best[1]), (within, best[2]), (inner, 0), (outer, 0)):
            part.append(x)
        inner[i] = node(values[best[3]])
        outer[i] = node(values[~best[3]])
        return i

    node(sample & np.uint64(mask))
    ints = [np.array(x, dtype=np.int64) for x in (within, inner, outer, tasks)]
    return Tree(mask, share, np.array(vantage, dtype=np.uint64), *ints)


def bands_of(radius: int, bands: int) -> list[tuple[int, int]]:
    """Mask and share of each band: shares plus one add up to the radius plus one; a band without a share is not needed."""
    edges = [64 * i // bands for i in range(bands + 1)]
    shares = [(radius + 1) // bands + (i < (radius + 1) % bands) - 1 for i in range(bands)]
    return [(((1 << (b - a)) - 1) << a, s) for a, b, s in zip(edges, edges[1:], shares) if s >= 0]


def forest(fps: DataFrame, radius: int = 4, bands: int = 4, leaf: int = LEAF, sample: int = SAMPLE) -> list[Tree]:
    """Trees fitted to a bounded sample of distinct fingerprints (column ``fp``)."""
    total = fps.count()
    some = hash_sample(fps.select("fp"), "fp", sample).toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    return [grow(some, mask, share, max(1.0, total / max(1, len(some))), leaf) for mask, share in bands_of(radius, bands)]


def linked(every: np.ndarray, meetings: list[tuple[np.ndarray, np.ndarray]], radius: int) -> np.ndarray:
    """For each row of ``every`` the place of one that stands for all it hangs together with, comparing the places of each meeting: all of
    the first with all of the second."""
    label = np.arange(len(every))
    for these, those in meetings:
        step = max(1, (1 << 20) // max(1, len(those)))
        for i in range(0, len(these), step):
            some = these[i : i + step]
            rows, cols = np.nonzero(distance(every[some, None], every[None, those]) <= radius)
            cut = np.flatnonzero(np.diff(rows)) + 1
            for row, near in zip(rows[np.append(0, cut)] if len(rows) else (), np.split(cols, cut)):
                labels = label[np.append(those[near], some[row])]
                least = labels.min()
                if (labels != least).any():
                    label[np.isin(label, labels)] = least
    return label


def links(fps: DataFrame, radius: int = 4, bands: int = 4, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """Links ``a``, ``b`` that connect all of the distinct fingerprints ``fp`` that lie within ``radius`` bits of one another."""
    trees = forest(fps, radius, bands, leaf, sample)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).to_numpy(zero_copy_only=False)
            values = column.view(np.uint64)
            for band, tree in enumerate(trees):
                own = np.zeros(len(values), dtype=np.int64)
                rows, leaves = tree.leaves(values, 0)
                own[rows] = leaves
                rows, leaves = tree.leaves(values, tree.share)
                count = tree.tasks[leaves]
                # a row meets its own part of the leaf and each of the others, in a tile of the two
                other = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                rows, leaves, count = np.repeat(rows, count), np.repeat(leaves, count), np.repeat(count, count)
                mixed = (values[rows] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                part = (mixed % count.astype(np.uint64)).astype(np.int64)
                tile = np.minimum(part, other) * count + np.maximum(part, other)
                made = [np.full(len(rows), band, np.int32), leaves.astype(np.int32), tile, part.astype(np.int32), leaves == own[rows], column[rows]]
                yield pa.record_batch([pa.array(c) for c in made], ["band", "leaf", "tile", "part", "home", "fp"])

    def shard(table: pa.Table) -> pa.Table:
        keys, part, home = (table.column(c).to_numpy() for c in ("fp", "part", "home"))
        low, high = (np.flatnonzero(part == p) for p in (part.min(), part.max()))
        meetings = [(low[home[low]], high)]
        if part.min() < part.max():
            meetings.append((high[home[high]], low))
        label = linked(keys.view(np.uint64), meetings, radius)
        other = np.flatnonzero(label != np.arange(len(keys)))
        return pa.table({"a": pa.array(keys[other]), "b": pa.array(keys[label[other]])})

    rows = fps.select("fp").mapInArrow(dealt, "band int, leaf int, tile long, part int, home boolean, fp long")
    return rows.groupBy("band", "leaf", "tile").applyInArrow(shard, "a long, b long")


def _rooted(marked: DataFrame, radius: int) -> DataFrame:
    """``fp``, its ``root`` and the ``least`` id that has it."""
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct, radius))
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")


def groups(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least id that can be reached over links, of every row."""
    marked = written(fingerprints(docs, id_col, text_col, shingle))
    named = _rooted(marked, radius)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(ids, "root").select("fp", "component_id")
    return marked.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` of every component of fingerprints that :func:`groups` finds, with all its columns: that of the least id, rows
    without an id last; of several rows with that id the one whose text has the least hash."""
    marked = written(fingerprints(docs, id_col, text_col, shingle))
    named = marked.join(_rooted(marked, radius).select("fp", "root"), "fp")
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("m"))
    keys = [f"{name}_{uuid.uuid4().hex}" for name in ("id", "hash")]
    rows = docs.withColumns({keys[0]: F.col(id_col).cast("long"), keys[1]: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    first = first.select(F.col("m.doc_id").alias("i"), F.col("m.text_hash").alias("h"))
    kept = rows.join(first, rows[keys[0]].eqNullSafe(first.i) & (rows[keys[1]] == first.h), "left_semi")
    return kept.dropDuplicates(keys).drop(*keys)
