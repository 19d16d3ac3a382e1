from __future__ import annotations

import corpus_pipeline as pipeline
import pytest
from test_native import contamination
from helpers import frame
from test_near_dedup import brute


def test_stages_against_brute_force(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        kept[name, "in"] = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == pipeline.COLUMNS
            kept[name, "out"] = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    gone = set(kept["toxicity", "in"]) - set(kept["toxicity", "out"])
    assert gone and all(toxic.get(i, 1) for i in gone)
    assert set(kept["line_dedup", "out"]) == set(kept["line_dedup", "in"])
    alike = brute(list(kept["near_dedup", "in"].items()), 5, 80) if len(kept["near_dedup", "in"]) <= 1000 else {}
    assert set(kept["near_dedup", "out"]) == {i for i, (_, _, first) in alike.items() if first}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    judged = contamination(list(kept["decontamination", "in"].items()), items)
    assert set(kept["decontamination", "out"]) == {i for i, j in judged.items() if not j[3]}
    assert {r.doc_id for r in docs.collect()} == set(kept["decontamination", "out"])


def test_run_is_the_stages(spark):
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_take_odd_rows(name, spark, data):
    """Nulls, empty texts, repeated ids and rows, and further columns; and a table without rows."""
    stage = dict(pipeline.STAGES)[name]
    item = spark.read.parquet(f"{data}/benchmark.parquet").orderBy("item_id").first().text
    long = "an idiot wrote this stupid worthless trash, you pathetic moron"
    docs = [(1, None), (2, ""), (None, "no id here"), (3, "one of two rows"), (3, "the other row"), (4, "same row"), (4, "same row"), (5, long), (6, item), (7, " ".join(f"w{k}" for k in range(3000))), (8, " ".join(f"w{k}" for k in range(3000)))]
    docs = [(i and i + 10**6, t) for i, t in docs]  # ids that no label speaks of
    out = stage(spark, frame(spark, docs), data).collect()
    gone = {"toxicity": {10**6 + 5}, "near_dedup": {10**6 + 8}, "decontamination": {10**6 + 6}}.get(name, set())
    if name == "packing":
        assert {r.doc_id for r in out} == {i for i, _ in docs}
    else:
        assert sorted((r.doc_id or 0, r.text or "") for r in out) == sorted((i or 0, t or "") for i, t in docs if i not in gone)
    assert stage(spark, frame(spark, []), data).count() == 0
