from pyspark.sql import functions as F

from linkloom.functions import normalize as N


def one(spark, expr, **values):
    cols = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], cols).select(expr.alias("x")).first().x


def test_names(spark):
    rows = [("Société Générale & Co.", "US"), ("Acme Pvt. Ltd.", "India"), ("LLC", "US"), ("", "US"), (None, "US"), ("शर्मा प्राइवेट लिमिटेड", "India")]
    df = spark.createDataFrame(rows, "business_name string, country string")
    got = [(r.name_norm, r.legal_suffix) for r in N.add_name(df).collect()]
    assert got == [("societe generale and", "co"), ("acme", "pvt_ltd"), ("llc", "llc"), ("", ""), ("", ""), ("शर्मा", "pvt_ltd")]


def test_addresses(spark):
    df = spark.createDataFrame([("e", "n", "12B Main St., Springfield, IL 62704-1234", "US"), ("e", "n", None, None), ("e", "n", "Plot 5, near Park Rd, Pune, 411001", "india")], "entity_id string, business_name string, business_address string, country string")
    a, b, c = N.normalize(df).collect()
    assert (a.addr_norm, a.pin_extracted, a.city_extracted, a.street_number, a.has_landmark) == ("12b main street springfield il 62704 1234", "62704", "springfield", "12B", 0)
    assert (b.addr_norm, b.pin_extracted, b.city_extracted, b.street_number, b.has_landmark) == ("", "", "", "", 0)
    assert (c.pin_extracted, c.city_extracted, c.has_landmark) == ("411001", "pune", 1)


def test_open_countries(spark):
    assert one(spark, N.postal_code(F.col("a"), F.col("c")), a="x 560001 12345", c="Atlantis") == "560001"
    assert one(spark, N.postal_code(F.col("a"), F.col("c")), a="x 12345-6789", c=None) == "12345"


def test_numbers(spark):
    assert sorted(one(spark, N.street_numbers(F.col("a")), a="N° 0026-28 Rue 4O, 12345678")) == [26, 28, 40]
    assert sorted(one(spark, N.compound_doors(F.col("a")), a="12-03/4 and 5/6")) == ["12/3/4", "5/6"]
    assert one(spark, N.last_pincode(F.col("a")), a="110001 then 560001") == "560001"
    assert one(spark, N.street_numbers(F.col("a")), a=None) == []


def test_latin_placeholder_suite(spark):
    assert one(spark, N.is_latin(F.col("a")), a="Acme 12") and not one(spark, N.is_latin(F.col("a")), a="राम")
    assert one(spark, N.is_placeholder(F.col("a")), a=None)
    assert one(spark, N.suite(F.col("a")), a="1 Main, Suite #12B") == "12b"
    assert one(spark, N.similarity_bucket(F.lit(0.85)), a="") == "0.80-0.90"


def test_audit_text(spark):
    assert one(spark, N.audit_clean(F.col("a")), a="12 Main ST., NY") == "12 main street new york"
    assert one(spark, N.audit_core(F.col("a")), a="Acme Services SAS") == "acme"


def test_suite_after_letters_beyond_ascii(spark):
    address = "12 \u00e9flin St, Suite 31B"
    assert one(spark, N.suite(F.col("a")), a=address) == "31b"
    assert one(spark, N.suite(F.col("a"), ascii=True), a=address) == "in"
