import collections

import corpus_pipeline
from keyclock.llm import decontamination, queries, toxicity
from keyclock.llm.shared import written
from tests.llm.test_simhash import brute, plain


def test_every_stage_on_what_its_predecessor_kept(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        seen[name] = (before, docs)
        if name != "token_ids":
            assert docs.columns == columns
    ids = {n: ([r.doc_id for r in a.select("doc_id").collect()], [r.doc_id for r in b.select("doc_id").collect()]) for n, (a, b) in seen.items()}
    for name in ("toxicity", "near_duplicates", "decontamination"):
        assert set(ids[name][1]) <= set(ids[name][0]) and len(ids[name][1]) == len(set(ids[name][1]))
    labels = queries.table(spark, sf_dir, "labels")
    model = toxicity.fit(docs=seen["toxicity"][0], labels=labels.where(~toxicity.held_out()))
    texts = {r.doc_id: r.text for r in seen["toxicity"][0].collect()}
    scores = dict(zip(texts, model.scorer()(list(texts.values()))))
    assert set(ids["toxicity"][1]) == {i for i, s in scores.items() if s < 0.3}
    before = {r.doc_id: plain(r.text) for r in seen["near_duplicates"][0].collect()}
    assert set(ids["near_duplicates"][1]) == set(brute(before).values())
    leaks = {r.doc_id for r in decontamination.matches(seen["decontamination"][0], queries.table(spark, sf_dir, "benchmark")).collect()}
    assert set(ids["decontamination"][1]) == set(ids["decontamination"][0]) - leaks
    taken = collections.Counter(ids["mixing"][1])
    assert set(taken) <= set(ids["mixing"][0]) and max(taken.values()) <= 2
    assert collections.Counter(ids["token_ids"][1]) == taken


def test_repeated_rows_nulls_and_an_empty_table(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, copies int"
    rows = [(1, "some words that are here today for all", "en", "a", 3, 0, 0)] * 3 + [(None, None, None, None, None, None, None), (2, "", "en", None, 0, 1, 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, sf_dir))
            if name == "near_duplicates" and data:
                assert sorted((r.doc_id or 0) for r in docs.collect()) == [1, 2]
    assert docs.collect() == []
