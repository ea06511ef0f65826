from pyspark.sql import functions as F

from linkloom.functions import normalize as N
from linkloom.operators import blocking
from linkloom.sources import package, tables
from linkloom.streaming import incremental


def test_tsv_round_trip(spark, tmp_path):
    path = tmp_path / "in.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA "quoted\t\tUS\nS2-2\tB\n')
    rows = [tuple(r) for r in tables.read_tsv(spark, str(path)).collect()]
    assert rows == [("S1-1", 'A "quoted', "", "US"), ("S2-2", "B", "", "")]
    lines = tables.read_lines(spark, str(path), tables.RECORD).orderBy("row_pos").collect()
    assert [r.entity_id for r in lines] == ["entity_id", "S1-1", "S2-2"]
    out = tmp_path / "out"
    tables.write_tsv(spark.createDataFrame([(2, "b", ""), (1, "a", "x,y")], "row_pos long, id string, ids string"), str(out))
    text = next(out.glob("part-*")).read_text()
    assert text == "id\tids\na\tx,y\nb\t\n"


def test_spaces_at_the_ends_of_fields_stay(spark, tmp_path):
    rows = [("S3-548", " This  Inc", "15 This St ", "US")]
    tables.write_tsv(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in tables.RECORD)), str(tmp_path / "out"))
    assert [tuple(r) for r in tables.read_tsv(spark, str(tmp_path / "out")).collect()] == rows


def test_lists_and_stitch(spark):
    pairs = spark.createDataFrame([("a", "y", 2), ("a", "x", 1)], "s1 string, cand string, rank int")
    s1 = spark.createDataFrame([("b", 0), ("a", 1)], "entity_id string, row_pos long")
    got = [tuple(r) for r in tables.stitch(s1, tables.id_lists(pairs), ["ids"]).orderBy("row_pos").collect()]
    assert got == [(0, "b", ""), (1, "a", "x,y")]
    e = tables.edges(spark.createDataFrame([("a", " x, ,y")], "source1_entity_id string, matched_entity_ids string"))
    assert sorted((r.cand, r.pos) for r in e.collect()) == [("x", 0), ("y", 1)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.5)], "s1 string, cand string, p double")
    tables.write_thresholds(df, str(tmp_path / "t"), [0.4, 0.8])
    assert sorted((r.tau, r.cand) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(0.4, "x"), (0.4, "y"), (0.8, "x")]
    assert tables.content_hash(df).first() == tables.content_hash(df.orderBy(F.desc("p"))).first()
    assert tables.same_rows(df, df.repartition(3)) and not tables.same_rows(df, df.limit(1))
    tables.write_report(df, str(tmp_path / "r"), "%s -> %s", ["s1", "cand"])
    assert spark.read.text(str(tmp_path / "r")).count() == 2


def test_package(tmp_path):
    f = tmp_path / "a.tsv"
    f.write_text("x")
    assert package.build({"a.tsv": f}, tmp_path / "o.zip", ("a.tsv",)) == []
    assert package.verify(tmp_path / "o.zip", ("b.tsv",)) == ["missing: b.tsv"]


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    rows = [("S1-1", "acme foods", "1 Main", "US"), ("S2-1", "acme foods", "1 Main", "US"), ("S2-2", "other thing", "2 Main", "US")]
    schema = "entity_id string, business_name string, business_address string, country string"
    raw = spark.createDataFrame(rows, schema)
    s1 = N.normalize(raw.filter("entity_id like 'S1%'"))
    raw.filter("entity_id like 'S2%'").write.parquet(str(tmp_path / "in"))
    q = incremental.stream_votes(s1, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("s1", "cand", "votes")
    want = blocking.votes(s1, N.normalize(raw.filter("entity_id like 'S2%'")))
    assert tables.same_rows(got, want.select("s1", "cand", "votes")) and got.count() == 1
