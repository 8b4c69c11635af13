import hashlib
import random

import pytest

from keyclock.llm import warc
from keyclock.llm.shared import shared_folder

SCHEMA = "page_id long, url string, html string, digest string, n_bytes int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], SCHEMA)


def expected(rows):
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        payload = (h or "").encode()
        again = h in first and first[h] != i
        out.append((str(i), len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=str)


def told(df):
    return sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_records_read_back(spark):
    rnd = random.Random(3)
    body = ["é" * 60, "x" * 99, "y" * 100, "".join(rnd.choice("abcü \n") for _ in range(5000)), "", None, "z" * 64, "long " * 40_000]
    rows = [(i, f"http://h/{i}\r\nX: y", rnd.choice(body)) for i in range(200)] + [(None, None, body[3]), (900, None, body[7])]
    docs = pages(spark, rows).repartition(7)
    assert told(warc.archived(docs, chunk=64)) == expected(rows)
    assert told(warc.archived(docs)) == expected(rows)
    assert warc.archived(docs.limit(0)).collect() == []


def test_chunks_are_shuffled_for_copies_only_where_these_are_many(spark):
    rows = [(i, "u", f"{i % 90} " * 80) for i in range(100)]
    docs = pages(spark, rows).repartition(5)
    path = shared_folder(spark)
    warc.write(docs, path)
    assert told(warc.read(spark, path)) == expected(rows)
    assert len(spark.read.parquet(path).inputFiles()) == 5  # as many as read the pages
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert told(warc.archived(docs, chunk=64)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_only_rows_without_ids_and_repeated_rows(spark):
    rows = [(None, "u", "q" * 200)] * 2 + [(4, "u", "w" * 200)] * 2
    got = told(warc.archived(pages(spark, rows)))
    assert [(r[0], r[3], r[4]) for r in got] == [("4", "response", None)] * 2 + [("None", "response", None)] * 2


def test_chunks_make_up_records_and_damage_is_noticed(spark):
    text = "".join(random.Random(5).choice("abc") for _ in range(1000))
    path = shared_folder(spark)
    warc.write(pages(spark, [(1, "http://a", text), (2, "http://b", text)]), path, chunk=256)
    rows = spark.read.parquet(path).orderBy("record_id", "chunk_no").collect()
    own = [[r for r in rows if r.record_id == k] for k in sorted({r.record_id for r in rows})]
    assert sorted(len(x) for x in own) == [1, 4]
    records = [warc.record_bytes(x) for x in own]
    assert any(b"WARC-Type: response" in r and r.endswith(text.encode() + b"\r\n\r\n") and b"Content-Length: 1000\r\n" in r for r in records)
    assert any(b"WARC-Type: revisit" in r and b"WARC-Refers-To: <urn:page:1>" in r for r in records)
    assert [r.n_bytes for r in max(own, key=len)] == [256, 512, 768, 1000]
    broken = shared_folder(spark)
    spark.read.parquet(path).where("chunk_no <> 1").write.parquet(broken)
    with pytest.raises(Exception, match="missing or altered"):
        warc.read(spark, broken).collect()
