import corpus_pipeline
from conftest import SF
from linkloom.llm import queries


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0 < docs.count() <= before, name
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "benchmark decontamination", "best-fit packing"]
    assert len(queries.QUERIES) == 10 and all(n.startswith(f"op{i}_") for i, n in enumerate(queries.QUERIES, 1))


EDGES = [
    (1, "", 0), (2, None, 1), (None, "a text without an id", 2), (3, "same words here", 3), (3, "same words here", 3), (4, "same  words here", 4), (5, "Same, words here", 5), (6, "x " * 40_000, 6), (7, "é 🙂", 7), (None, None, 8),
]


def test_stages_on_edges(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    clash = [f"{n} string" for n in ("row", "spans", "class_id", "score", "kept", "_n", "_key", "rid", "n", "h1")]
    df = spark.createDataFrame([(i, t, *[f"{k}"] * len(clash)) for i, t, k in EDGES], "doc_id long, text string, " + ", ".join(clash))
    kept = {}
    for table in (df, df.limit(0)):
        docs = table
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = str(tmp_path / f"{name}-{table is df}")
            stage(spark, docs, str(tmp_path)).write.parquet(out)
            docs = spark.read.parquet(out)
            if i < 4:
                assert docs.columns == df.columns
                kept.setdefault(name, sorted(r["row"] for r in docs.collect()))
        assert docs.count() == (0 if table is not df else 24)  # the 40,000 words are 20 pieces
    assert kept["toxicity"] == sorted(str(k) for *_, k in EDGES)
    assert kept["exact dedup"] == ["0", "2", "4", "5", "6", "7"]  # of the equal texts the longest, of the empty ones the first id
    assert kept["near dedup"] == kept["benchmark decontamination"] == ["0", "2", "4", "6", "7"]
