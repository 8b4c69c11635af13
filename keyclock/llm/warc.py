"""WARC records as a chunked table: a record is a header and rows of (record, chunk number), never one value as large as its payload.

Table columns: ``record_id`` (of this archive), ``chunk_no``, ``header`` (WARC header lines, on chunk 0 only), ``data`` (the chunk as a gzip
member; members in order make up the payload), ``n_bytes`` (of the payload up to the chunk's end) and ``digest`` (SHA-256 of the same
bytes, carried on from chunk to chunk). Revisit records are one row without data. Payloads are cut, hashed and packed chunk by chunk in a
stream of rows, and read back the same way, so that no Python process holds more of a record than a chunk.

Of records with equal payloads of at least ``least`` bytes, that with the smallest id is the response and the others revisit it. Nulls: a
null payload is empty; a record without an id revisits the smallest id there is, and with no id at all every record is a response. Rows
that repeat the smallest id with the same payload are all responses. An empty table makes an empty archive. Line breaks in addresses are
dropped. Columns other than the three named are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyclock.llm.shared import shared_folder, written

CHUNK = 32 << 10
LEAST = 100
_TABLE = "record_id long, chunk_no int, header string, data binary, n_bytes long, digest string"
_OUT = [("record_id", pa.int64()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("n_bytes", pa.int64()), ("digest", pa.string())]
_READ = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def packed(chunk: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(chunk) + c.flush()


def _sealed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds digest and count so far to chunk rows in order, and packs each chunk. Columns: record_id, chunk_no, chunk, then what is kept."""
    record, running, count = None, None, 0
    for batch in batches:
        counts, digests, data = [], [], []
        for rid, no, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            chunk = chunk.as_py()
            if rid != record or no == 0:
                record, running, count = rid, hashlib.sha256(), 0
            running.update(chunk)
            count += len(chunk)
            counts.append(count)
            digests.append(running.hexdigest())
            data.append(packed(chunk))
        own = [batch.column(0), batch.column(1), pa.array(data, pa.binary()), pa.array(counts, pa.int64()), pa.array(digests)]
        yield pa.record_batch([*own, *batch.columns[3:]], [*(n for n, _ in _OUT), *batch.schema.names[3:]])


def write(pages: DataFrame, path: str, least: int = LEAST, chunk: int = CHUNK, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    keyed = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("p"))
    keyed = keyed.withColumns({"n": F.octet_length("p").cast("long"), "key": F.sha2("p", 256)})
    # two narrow columns of the records that can be equal; a payload of very many copies is summed up before it is shuffled
    firsts = keyed.where(F.col("n") >= least).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    # where few pages repeat, Spark sees that this table is small before it plans the join, and no chunk is shuffled for it
    firsts = written(firsts.select("key", "first"))
    records = keyed.withColumn("record_id", F.monotonically_increasing_id())
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / chunk)).cast("int"))
    rows = records.select("record_id", F.explode(numbers).alias("chunk_no"), "p", "page_id", "url", "n", "key")
    rows = rows.select("record_id", "chunk_no", F.substring("p", F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("chunk"), "page_id", "url", "n", "key")
    rows = rows.mapInArrow(_sealed, "record_id long, chunk_no int, data binary, n_bytes long, digest string, page_id long, url string, n long, key string")
    rows = rows.join(firsts, "key", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))), F.lit("")),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")), F.lit("")),
        F.when(again, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("key"))),
        line("X-Payload-Length", F.col("n").cast("string")),
        line("Content-Length", F.when(again, "0").otherwise(F.col("n").cast("string"))),
        F.lit("\r\n"),
    )
    rows = rows.where(~again | (F.col("chunk_no") == 0)).select(
        "record_id",
        "chunk_no",
        F.when(F.col("chunk_no") == 0, header).alias("header"),
        F.when(~again, F.col("data")).alias("data"),
        F.when(again, 0).otherwise(F.col("n_bytes")).cast("long").alias("n_bytes"),
        F.when(~again, F.col("digest")).alias("digest"),
    )
    rows.write.option("compression", "none").parquet(path)  # chunks are packed already


def fields(header: str) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in header.split("\r\n")[1:] if x)


def _page(value: str | None) -> int | None:
    return int(value[len("<urn:page:") : -1]) if value else None


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per record from its chunk rows in order. What was carried on must come out again at every chunk."""
    head, running, count = None, None, 0

    def record():
        # a revisit has no payload of its own: its header tells the one it stands for
        own = head["WARC-Type"] == "response"
        digest, n = (running.hexdigest(), count) if own else (head["WARC-Payload-Digest"][7:], int(head["X-Payload-Length"]))
        if f"sha256:{digest}" != head["WARC-Payload-Digest"] or n != int(head["X-Payload-Length"]):
            raise ValueError(f"record {head.get('WARC-Record-ID')} is not whole")
        return _page(head.get("WARC-Record-ID")), n, digest, head["WARC-Type"], _page(head.get("WARC-Refers-To"))

    for batch in batches:
        done = []
        for no, header, data, n, digest in zip(*(batch.column(i) for i in range(1, 6))):
            if no.as_py() == 0:
                if head:
                    done.append(record())
                head, running, count = fields(header.as_py()), hashlib.sha256(), 0
            if data.is_valid:
                part = zlib.decompress(data.as_py(), 31)
                running.update(part)
                count += len(part)
                if running.hexdigest() != digest.as_py() or count != n.as_py():
                    raise ValueError("a chunk is missing or altered")
        yield _rows(done)
    if head:
        yield _rows([record()])


def _rows(done: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([d[i] for d in done], t) for i, (_, t) in enumerate(_READ)], [n for n, _ in _READ])


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record, its payload hashed anew."""
    rows = spark.read.schema(_TABLE).parquet(path)
    rows = rows.repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return rows.mapInArrow(_checked, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def record_bytes(rows: list) -> bytes:
    """The record as it stands in a WARC file, from its rows in order (for export and tests; holds one record)."""
    return rows[0].header.encode("utf-8") + b"".join(zlib.decompress(bytes(r.data), 31) for r in rows if r.data is not None) + b"\r\n\r\n"


def archived(pages: DataFrame, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """Writes the pages to an archive in the shared folder and reads it back."""
    path = shared_folder(pages.sparkSession)
    write(pages, path, least, chunk)
    return read(pages.sparkSession, path)
