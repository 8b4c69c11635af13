"""Log directories, report files, sinks."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from keyclock.plans import reports
from keyclock.sources import logs
from keyclock.sources.replay import read_replay, write_table


@pytest.fixture()
def latency_dir(tmp_path):
    files = {
        "keyed_50median_start_4c.csv": "START,10,1,1000000000\nSTART,10,1,500000000\nSTART,20,1,2000000000\n",
        "keyed_50median_end_4c.csv": "END,10,1,3000000000\nEND,20,1,2500000000\n",
        "keyed_ordered_start_2c.csv": "START,10,2,0\n",
        "keyed_ordered_end_2c.csv": "END,10,2,4000000000\nEND,99,2,1\n",
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    return str(tmp_path)


def test_keyed_latency_from_files(spark, latency_dir):
    log = logs.label_experiments(logs.read_logs(spark, latency_dir, logs.KEYED_LATENCY))
    parts = {(r["role"], r["experiment"], r["clock"], r["scenario"], r["cores"]) for r in log.collect()}
    assert parts == {
        ("start", "keyed_50median_4c", "keyed", "50median", 4), ("end", "keyed_50median_4c", "keyed", "50median", 4),
        ("start", "keyed_ordered_2c", "keyed", "ordered", 2), ("end", "keyed_ordered_2c", "keyed", "ordered", 2)}
    got = reports.latency_keyed(log.where("role = 'start'"), log.where("role = 'end'"), "experiment")
    assert {tuple(r) for r in got.collect()} == {
        ("keyed_50median_4c", 10, 1, 2.5), ("keyed_50median_4c", 20, 1, 0.5), ("keyed_ordered_2c", 10, 2, 4.0)}
    stamped = logs.with_system_timestamp(log).where("watermark = 20 and role = 'end'").first()
    assert stamped["system_timestamp"].microsecond == 500000


def test_stream_names(spark, tmp_path):
    (tmp_path / "base_50random_8c_start_latency.csv").write_text("START,1,5\n")
    (tmp_path / "base_50random_8c_end_latency.csv").write_text("END,1,9\n")
    log = logs.label_experiments(logs.read_logs(spark, str(tmp_path), logs.STREAM_LATENCY))
    assert {(r["role"], r["experiment"], r["scenario"], r["cores"]) for r in log.collect()} == {
        ("start", "base_50random_8c", "50random", 8), ("end", "base_50random_8c", "50random", 8)}


def test_header_is_a_choice(spark, tmp_path):
    (tmp_path / "keyed_a_state.csv").write_text("1,100,5\n2,100,6\n1,200,1\n")
    size = reports.state_size(logs.read_logs(spark, str(tmp_path), logs.STATE_LOG), "name")
    assert {tuple(r) for r in size.collect()} == {("keyed_a_state", 100, 11), ("keyed_a_state", 200, 1)}
    assert logs.read_logs(spark, str(tmp_path), logs.STATE_LOG, header=True).count() == 2


def test_state_difference_with_exemption(spark, tmp_path):
    (tmp_path / "debs.csv").write_text("TS,A,B\n900000,5,2\n")
    (tmp_path / "ordered.csv").write_text("TS,A,B\n1,5,2\n900000,1,1\n")
    pairs = logs.read_logs(spark, str(tmp_path), logs.STATE_PAIR, header=True)
    got = reports.state_pair_diff(pairs, "name", limit=700000, exempt=("name", "debs"))
    assert {tuple(r) for r in got.collect()} == {("debs", 900000, 5, 2, 3), ("ordered", 1, 5, 2, 3)}


def test_accuracy_from_files(spark, tmp_path):
    (tmp_path / "keyed_x.csv").write_text("0,5,1,10,3\n10,15,1,20,4\n")
    (tmp_path / "base_x.v2.csv").write_text("0,5,1,10,1\n")
    got = reports.accuracy_report(logs.read_logs(spark, str(tmp_path), logs.WINDOW_RESULT), "name")
    assert {tuple(r) for r in got.collect()} == {("keyed_x", 7), ("base_x", 1)}


@pytest.mark.parametrize("by", [(), ("g",)])
def test_summary_equals_pandas(spark, by):
    values = [((i * 7919) % 1000) / 8 - 20 for i in range(300)] + [5000.0, -3000.0, 0.0, 0.0]
    pdf = pd.DataFrame({"g": ["ab"[i % 2] for i in range(len(values))], "latency": values})
    df = spark.createDataFrame(pdf)
    got = reports.latency_summary_full(df, "latency", *by).collect()
    for row in got:
        s = pdf.latency if not by else pdf[pdf.g == row["g"]].latency
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        out = sorted(s[(s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))])
        want = [s.max(), s.min(), s.mean(), *s.quantile([0.9, 0.95, 0.99])]
        assert [row[c] for c in ("max", "min", "avg", "p90", "p95", "p99")] == pytest.approx(want, abs=1e-6)
        assert row["outliers"] == out
    assert len(got) == (2 if by else 1)


def test_write_and_read_back(spark, tmp_path):
    df = spark.range(5).select("id", (F.col("id") % 2).alias("p"))
    write_table(df, str(tmp_path / "csv"), "csv", header=True)
    assert read_replay(spark, str(tmp_path / "csv"), "csv", "id long, p long", header=True).count() == 5
    write_table(df, str(tmp_path / "pq"), partition_by=("p",))
    assert sorted(d for d in os.listdir(tmp_path / "pq") if d.startswith("p=")) == ["p=0", "p=1"]
    with pytest.raises(ValueError):
        read_replay(spark, str(tmp_path / "pq"), streaming=True)
