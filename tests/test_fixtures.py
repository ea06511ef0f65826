"""Literal rows with the values they must give."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions import normalize as N
from linkloom.functions import similarity as S
from linkloom.operators import evaluate, filters, guards
from linkloom.sources import tables


def values(spark, rows, column, *names):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names))
    return [r[0] for r in df.orderBy("i").select(column).collect()]


STREETS = [
    ("Memphis, 3365 Winchester Place, TN", "003365 WINCHESTER PL, TN, MEMPHIS", False),
    ("26 Rue Albert Sauvage, Dunkerque", "N° 26 RUE ALBERT SAUVAGE, DUNKERQUE", False),
    ("982 Electric Avenue, Bigfork, MT", "BIGFORK, 982-A ELECTRIC AVE, MT", False),
    ("8 Rue des Pommiers, Pornic", "R. DES POMMIERS, PORNIC", False),
    ("1500 7th Street, Unit APT 4O, Sacramento, CA", "1500 7th Street, APT 40, Sacramento, CA", False),
    ("OH, Dayton, 1828 Fauver Avenue", "1831 Fauver Ave, Dayton, Ohio", True),
    ("Memphis, 3365 Winchester Place, TN", "3378-3380 WINCHESTER PL, MEMPHIS, TN", True),
    ("253 Rue de Gand, Tourcoing", "# 56 R. DE BAPAUME, TOURCOING", True),
]
DOORS = [("12-3/4 MG Road", "12/3/4 M.G. Rd", False), ("012-03 Anna Salai", "12-3 Anna Salai", False), ("12-3 Anna Salai", "12-4 Anna Salai", True), ("no number", "1-2 x", False), ("Door No. 5/11, 7-8", "7/8 y", False)]
VARIANTS = [("1/5448 MG Road 110001", "1/5459 MG Road 110001", (0, 0, 1)), ("MG Road 110001", "MG Road 560001", (1, 1, 1)), ("12 MG Road", "12-A M G Rd", (0, 0, 0)), ("MG Road", "MG Rd 560001", (0, 0, 0)), ("5 A St", "6 A St", (1, 1, 1))]


def test_street_guards(spark):
    pair = lambda f: guards.disjoint(f(F.col("a")), f(F.col("b")))
    assert values(spark, [r[:2] for r in STREETS], pair(N.street_numbers), "a", "b") == [r[2] for r in STREETS]
    assert values(spark, [r[:2] for r in DOORS], pair(N.compound_doors), "a", "b") == [r[2] for r in DOORS]
    for v in (1, 2, 3):
        got = values(spark, [r[:2] for r in VARIANTS], filters.street_mismatch(F.col("a"), F.col("b"), v), "a", "b")
        assert got == [bool(r[2][v - 1]) for r in VARIANTS]


@pytest.mark.parametrize(
    "make, rows",
    [
        (N.last_pincode, [("560001 MG Road 110001", "110001"), ("Plot 012345, 400001", "400001"), ("none here 1234567", ""), ("", "")]),
        (N.is_placeholder, [(" N/A ", True), ("Unknown", True), ("", True), ("-", True), ("Acme", False), ("no name", True), ("nano", False)]),
        (N.has_landmark, [("12 Main St near City Mall", 1), ("Plot 7, next  to Temple", 1), ("8 rue Neuve, 75001 Paris", 0), ("", 0), ("Linear Park 9-11", 0), ("4 Old Rd, behind bank", 1)]),
        (N.transliterate, [("राम", "ram"), ("शर्मा", "shrma"), ("abc", "abc"), ("फल", "phl"), ("", "")]),
        (N.is_latin, [("Acme", True), ("राम", False), ("12", True), ("Acme राम", False)]),
    ],
)
def test_record_functions(spark, make, rows):
    assert values(spark, [(a,) for a, _ in rows], make(F.col("x")), "x") == [b for _, b in rows]


def test_acronyms(spark):
    rows = [("zander blue", "zb", True), ("zb", "zander blue", True), ("zander blue", "zander", False), ("one", "o", False), ("a b c d e", "abcde", True), ("", "", False)]
    words = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    assert values(spark, [r[:2] for r in rows], S.acronym_match(words("a"), words("b")), "a", "b") == [r[2] for r in rows]


def test_entity_scores(spark):
    rows = [("", "", (1, 1, 1)), ("", "a", (0, 0, 1)), ("a", "", (0, 0, 0)), ("a", "b", (0, 0, 0)), ("a,c", "a,b,c", (0.714286, 0.666667, 1))]
    s = evaluate.set_f05(tables.parse_ids(F.col("t")), tables.parse_ids(F.col("p")))
    got = values(spark, [r[:2] for r in rows], s, "t", "p")
    assert [tuple(round(x, 6) for x in g) for g in got] == [tuple(map(float, r[2])) for r in rows]
