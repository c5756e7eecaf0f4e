import pytest

import corpus_pipeline
from touchline.llm import knnvote, mixing, secrets, similar
from touchline.llm.common import table

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, DIR, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, DIR).cache()
        out.append((docs, after))
        docs = after
    return out


def test_columns_stay_but_for_the_last(spark, stages):
    want = table(spark, DIR, "documents").columns
    assert all(after.columns == want for _, after in stages[:-1])
    assert {"doc_id", "token_ids", "n_tokens"} <= set(stages[-1][1].columns)


def test_each_stage_does_what_its_operator_decides(spark, stages):
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    before, after = stages[0]
    scores = knnvote.score_quality(before, table(spark, DIR, "labels"))
    assert ids(after) == ids(scores.filter("predicted = 1"))
    before, after = stages[1]
    assert ids(after) == ids(similar.near_duplicates(before).filter("doc_id = component_id"))
    before, after = stages[2]
    texts = {r["doc_id"]: r["text"] for r in after.collect()}
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(before).collect()}
    for r in before.collect():
        assert texts[r["doc_id"]] == secrets._redact(r["text"] or "", [(s["kind"], s["start"], s["stop"]) for s in spans[r["doc_id"]]])
    before, after = stages[3]
    assert after.count() == sum(r["taken"] // r["size"] for r in mixing.mix(before).collect() if r["size"])
    before, after = stages[4]
    assert after.count() == before.count()


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, DIR).collect()) == sorted(r["doc_id"] for r in stages[-1][1].collect())


def test_all_stages_on_odd_tables(spark, odd, none, tmp_path):
    """Null and repeated ids, null texts and sources, repeated rows, long texts and clashing names pass all stages, and so does a table without rows."""
    for name, docs in (("odd", odd), ("none", none)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        table(spark, DIR, "labels").write.parquet(f"{folder}/labels.parquet")
        rows = table(spark, folder, "documents")
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before, rows = rows, stage(spark, rows, folder).cache()
            n = rows.count()
            assert rows.columns == docs.columns or i == len(corpus_pipeline.STAGES) - 1
            assert n <= before.count() or i == 3
        assert corpus_pipeline.run(spark, folder).count() == n
