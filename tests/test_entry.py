import __spark_entry__ as entry
from conftest import SF


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 90
    out = entry.entry(spark)
    assert out.columns == ["s1", "cand", "rule", "p", "rank"] and out.count() >= 0


def test_matches_do_not_depend_on_the_shuffle(spark):
    f = entry.queries()["flagship_matches"]
    a = f(spark, SF).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        b = f(spark, SF).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert len({r.cand for r in a}) == len(a)
