"""Token-id files: whole texts encoded, ids packed with Simple-8b, in ascending document order, and read back.

The file is a table of parts, written by Spark so that lost tasks and executors leave no half files: ``shard`` (in document order),
``part`` inside it, ``first_id`` (ids of the shard before the part), ``n_ids`` and ``body``. A body is little-endian:

    magic "KCS8" | uint32 documents, blocks, words, exceptions | int64 document ids | uint8 id-is-null | uint64 ids per document
    | uint32 first word of each block | uint64 words | uint64 exceptions

A part holds whole documents: as many as fit in ``PART_IDS`` ids, or one longer one. Nulls: a null text is an empty one, documents
without an id come last. Repeated rows and equal ids each keep their own place, ordered by a hash of the text. An empty table gives
an empty file. Columns other than the two named are not read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyclock.llm.shared import once, shared_folder, slices

PART_IDS = 1 << 17
#: Bytes of the words a worker holds and of their ids, without those of the batch that passes it; about 200,000 words of ten letters.
MEMO = 8 << 20
_MAGIC = b"KCS8"
_PARTS = "shard int, part int, first_id long, n_ids long, body binary"


def _bounds(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each string of a large_string array begins and ends, and the bytes, with two more at the end so that empty strings have some, too."""
    at = np.frombuffer(strings.buffers()[1], "<i8", len(strings) + 1, 8 * strings.offset) if len(strings) else np.zeros(1, np.int64)
    data = strings.buffers()[2]
    return at[:-1], at[1:], np.append(np.frombuffer(data or b"", np.uint8), np.zeros(2, np.uint8))


class _Words:
    """The ids of words as one array, and where each word's begin and how many there are."""

    def __init__(self) -> None:
        self.names, self.ids = pa.array([], pa.large_string()), np.zeros(0, "<u4")
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, counts: np.ndarray, names: pa.Array | None = None) -> None:
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(counts) - counts)
        self.counts, self.ids = np.append(self.counts, counts), np.append(self.ids, ids)
        if names is not None:
            self.names = pa.concat_arrays([self.names, names])

    def of(self, places: np.ndarray) -> np.ndarray:
        """All ids of the words at these places, in order; a place of -1 has none."""
        out = []
        for i in range(0, len(places), 1 << 18):
            some = places[i : i + (1 << 18)]
            some = some[some >= 0]
            n = self.counts[some]
            ends = np.cumsum(n)
            out.append(self.ids[np.repeat(self.starts[some] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)])
        return np.concatenate(out) if out else np.zeros(0, "<u4")


def encoder(tokenizer_path: str) -> Callable[[list[str] | pa.Array], list[bytes]]:
    """A function from texts to their ids (uint32, little-endian) as the tokenizers library gives them.

    A plain byte-level vocabulary never joins what stands before a single space or line break between words with it, nor a Latin letter or
    digit with the marks after it, so texts are cut there and every distinct word goes to the library once, many in one text: their first
    tokens tell them apart. Texts with odd spacing, and all texts of any other vocabulary, are encoded whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import pyarrow.compute as pc
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    shape = json.loads(tokenizer.to_str())
    pre, model = shape.get("pre_tokenizer") or {}, shape["model"]
    strict = any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or t["content"].isalpha() or " " in t["content"] for t in shape["added_tokens"])
    plain = model["type"] == "BPE" and not model.get("dropout") and not shape.get("normalizer") and not strict
    separable = plain and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    marks = "".join(m for m in ".,;:!?$%&*#" if not any(m in t["content"] for t in shape["added_tokens"]))
    # tokens that begin with a space or a line break: in words with one of them in front, the first
    firsts = np.zeros(1 + max(tokenizer.get_vocab().values(), default=0), dtype=bool)
    firsts[[i for t, i in tokenizer.get_vocab().items() if t[0] in "\u0120\u010a"]] = True
    seen = _Words()

    def raw(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(texts: list[str]) -> list[bytes]:
        return [ids.tobytes() for ids in raw(texts)]

    def learn(new: pa.Array) -> None:
        """Adds words. A line break belongs to the word after it; all others have a space in front."""
        words = pc.if_else(pc.starts_with(new, "\n"), new, pc.binary_join_element_wise(pa.scalar(" ", new.type), new, pa.scalar("", new.type)))
        found, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 1 << 12):
            some = words[i : i + (1 << 12)]
            lots = pa.array([*range(0, len(some), 64), len(some)], pa.int32())
            ids = np.concatenate(raw(pc.binary_join(pa.ListArray.from_arrays(lots, some), pa.scalar("", new.type)).to_pylist()))
            begin = np.flatnonzero(firsts[ids])
            if len(begin) != len(some):
                apart = raw(some.to_pylist())
                ids, begin = np.concatenate(apart), np.cumsum([0, *map(len, apart[:-1])])
            found.append(ids)
            counts.append(np.diff(np.append(begin, len(ids))))
        seen.add(np.concatenate(found), np.concatenate(counts), new)

    def cut(words: pa.Array) -> tuple[pa.Array, np.ndarray, list[str]]:
        """The words without the marks after their last letter or digit, and for each word which marks these are: a place in a list, or -1."""
        short = pc.ascii_rtrim(words, characters=marks)
        (_, end, data), (start, stop, kept) = _bounds(words), _bounds(short)
        n = end - _bounds(words)[0] - (stop - start)
        last, before = kept[stop - 1], kept[stop - 2]
        plain_end = (last - 48 < 10) | ((last | 32) - 97 < 26)  # unsigned: what is less wraps around
        latin = (before >= 0xC3) & (before <= 0xC9) & (last >= 0x80) & (last <= 0xBF) & ~((before == 0xC3) & ((last == 0x97) | (last == 0xB7)))
        mine = (n > 0) & (n <= 8) & (stop > start) & (plain_end | latin & (stop - start > 1))
        at, code = np.flatnonzero(mine), np.zeros(int(mine.sum()), np.uint64)
        for k in range(8):  # up to eight marks are the bytes of a number
            code |= np.where(k < n[at], data[np.maximum(end[at] - 1 - k, 0)].astype(np.uint64) << np.uint64(8 * k), np.uint64(0))
        kinds, place = np.unique(code, return_inverse=True)
        tail = np.full(len(words), -1)
        tail[at] = place
        return pc.if_else(pa.array(mine), short, words), tail, [int(c).to_bytes(8, "big").lstrip(b"\0").decode() for c in kinds]

    def odd(words: pa.Array) -> np.ndarray:
        """Which words are empty, or have more white space at an end than the line break in front."""
        start, end, data = _bounds(words)
        start = start + ((end > start) & (data[start] == 10))
        first, last, before = data[start], data[end - 1], data[end - 2]
        # printable ASCII and letters of two bytes are sure to be none
        sure = (end > start) & ((first > 32) & (first < 127) | (first >= 0xC3) & (first <= 0xDF))
        sure &= (last > 32) & (last < 127) | (last >= 0x80) & (last <= 0xBF) & (before >= 0xC3) & (before <= 0xDF)
        out = ~sure
        for i in np.flatnonzero(out).tolist():
            body = words[i].as_py().removeprefix("\n")
            out[i] = not body or body[0].isspace() or body[-1].isspace()
        return out

    def places(words: pa.Array) -> np.ndarray:
        """Where ``seen`` has each of some distinct words, new ones learned; -1 for odd ones."""
        if seen.names.nbytes + seen.ids.nbytes > MEMO:
            seen.__init__()
        at = pc.fill_null(pc.index_in(words, value_set=seen.names), -1).to_numpy().astype(np.int64)
        new = at < 0
        new[new] = ~odd(words.filter(pa.array(new)))
        known = len(seen.names)
        learn(words.filter(pa.array(new)))
        at[new] = known + np.arange(int(new.sum()))
        return at

    def encode(texts: list[str] | pa.Array) -> list[bytes]:
        if not separable:
            return whole(texts if isinstance(texts, list) else texts.to_pylist())
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if not len(texts):
            return []
        # a break belongs to the word after it, as a space does
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds, coded = parts.offsets.to_numpy(), parts.flatten().dictionary_encode()
        bounds, which, words = bounds - bounds[0], coded.indices.to_numpy(), coded.dictionary
        heads = words.take(pa.array(which[bounds[:-1]])).to_pylist()
        kinds = {h: i for i, h in enumerate(dict.fromkeys(heads))}
        # what only begins texts is no word to learn
        inner, used = np.ones(len(which), dtype=bool), np.zeros(len(words), dtype=bool)
        inner[bounds[:-1]] = False
        used[which[inner]] = True
        words = words.filter(pa.array(used))
        bases, tail, tails = cut(words)
        coded = bases.dictionary_encode()
        base = places(coded.dictionary)[coded.indices.to_numpy()]
        # words of this batch, then its heads, each from what was learned and the marks after it
        extra, batch = raw([*tails, *kinds]), _Words()
        held = len(seen.counts)
        both = _Words()
        both.ids, both.starts, both.counts = seen.ids, seen.starts, seen.counts
        both.add(np.concatenate(extra), np.array([len(x) for x in extra]))
        pairs = np.column_stack([base, np.where((tail >= 0) & (base >= 0), held + tail, -1)])
        pairs = np.concatenate([pairs, np.column_stack([held + len(tails) + np.arange(len(kinds)), np.full(len(kinds), -1)])])
        batch.add(both.of(pairs.ravel()), np.where(pairs >= 0, both.counts[pairs], 0).sum(axis=1))
        which = (np.cumsum(used) - 1)[which]
        which[bounds[:-1]] = len(words) + np.array([kinds[h] for h in heads])
        ids = batch.of(which).tobytes()
        ends = 4 * np.append(0, np.cumsum(batch.counts[which]))[bounds]
        out = [ids[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
        bad = np.append(0, np.cumsum(pairs[:, 0][which] < 0))[bounds]
        blank = np.array([not h or h[-1].isspace() for h in heads]) & (np.diff(bounds) > 1)
        again = np.flatnonzero(blank | (np.diff(bad) > 0))
        for i, x in zip(again.tolist(), whole(texts.take(pa.array(again)).to_pylist())):
            out[i] = x
        return out

    return encode


def pack_part(docs: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    from keyclock.llm import simple8b

    words, offsets, exceptions = simple8b.pack(ids)
    head = _MAGIC + struct.pack("<4I", len(docs), len(offsets), len(words), len(exceptions))
    nulls = np.array([d is None for d in docs], dtype=np.uint8)
    columns = (np.array([d or 0 for d in docs], "<i8"), nulls, np.array(lengths, "<u8"), offsets.astype("<u4"), words.astype("<u8"), exceptions.astype("<u8"))
    return head + b"".join(c.tobytes() for c in columns)


def unpack_part(body: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids per document, and all ids."""
    from keyclock.llm import simple8b

    if body[:4] != _MAGIC:
        raise ValueError("not a part of a token-id file")
    n, blocks, words, exceptions = struct.unpack_from("<4I", body, 4)
    at, got = 20, []
    for kind, count in (("<i8", n), ("<u1", n), ("<u8", n), ("<u4", blocks), ("<u8", words), ("<u8", exceptions)):
        got.append(np.frombuffer(body, kind, count, at))
        at += got[-1].nbytes
    docs = [None if null else int(d) for d, null in zip(got[0], got[1])]
    return docs, got[2].astype(np.int64), simple8b.unpack(got[4], got[5], got[3])


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text and writes the file at ``path``."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = once(("encoder", tokenizer_path), lambda: encoder(tokenizer_path)), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        part, first, docs_, lengths, held, size = 0, 0, [], [], [], 0

        def flush():
            nonlocal part, first, docs_, lengths, held, size
            ids = np.frombuffer(b"".join(held), "<u4")
            rows = [[shard], [part], [first], [len(ids)], [pack_part(docs_, lengths, ids)]]
            part, first, docs_, lengths, held, size = part + 1, first + len(ids), [], [], [], 0
            return pa.record_batch([pa.array(r, t) for r, t in zip(rows, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["shard", "part", "first_id", "n_ids", "body"])

        for batch in batches:
            for rows in slices(batch, 1, 2 << 20):
                for doc, got in zip(rows.column(0).to_pylist(), encode(rows.column(1))):
                    got += end
                    if size and size + len(got) // 4 > PART_IDS:
                        yield flush()
                    docs_.append(doc)
                    lengths.append(len(got) // 4)
                    held.append(got)
                    size += len(got) // 4
        if docs_:
            yield flush()

    order = (F.col("d").asc_nulls_last(), F.col("h"))
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("d", "t")
    rows.mapInArrow(parts, _PARTS).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, check: str = "ids") -> DataFrame:
    """Per document of the file, ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (array), or their
    ``ids_crc32`` with ``check="crc32"``."""
    table = spark.read.schema(_PARTS).parquet(path)
    totals = table.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row per shard: as many as the writing job had tasks, whatever they hold
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select(F.col("shard"), F.coalesce(before, F.lit(0)).alias("base"))
    crc = check == "crc32"
    kind = pa.int64() if crc else pa.list_(pa.int64())

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs, lengths, ids = unpack_part(body.as_py())
                ends = np.cumsum(lengths)
                if crc:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    told = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                else:
                    told = [ids[e - n : e].astype(np.int64) for e, n in zip(ends.tolist(), lengths.tolist())]
                columns = [pa.array(docs, pa.int64()), pa.array(ends - lengths + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(told, kind)]
                yield pa.record_batch(columns, ["doc_id", "start", "n_tokens", "told"])

    rows = table.join(F.broadcast(bases), "shard").select((F.col("base") + F.col("first_id")).alias("start"), "body")
    out = rows.mapInArrow(documents, f"doc_id long, start long, n_tokens long, told {'long' if crc else 'array<long>'}")
    return out.withColumnRenamed("told", "ids_crc32" if crc else "ids")


def encode_and_check(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the file in the shared folder and returns what reading it back gives: doc_id, start, n_tokens, ids_crc32."""
    path = shared_folder(docs.sparkSession)
    write(docs, path, tokenizer_path, end_id, id_col, text_col)
    return read(docs.sparkSession, path, "crc32")
