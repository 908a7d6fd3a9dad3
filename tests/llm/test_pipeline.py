"""The chain of stages on the smallest tables, against each stage's own operator."""

import corpus_pipeline as pipeline
from tidelog.llm import registry

SF = "/root/testdata/sf0.001"


def test_stages_run_and_their_decisions_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "minhash", "mixing", "bpe"]
    counts = [docs.count()]
    for i, (name, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if name != "bpe":
            assert docs.columns == columns
        if name == "line_dedup":
            assert docs.where("n_chars <> length(text)").count() == 0
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2]
    assert docs.where("size(ids) <> n_tokens").count() == 0
    assert pipeline.run(spark, SF).count() == counts[-1]


def test_every_operator_is_registered():
    names = registry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))
    assert "pipeline" in names
    assert set(registry.oracle_sql()) <= set(names)
