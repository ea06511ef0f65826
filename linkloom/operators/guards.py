"""Guards: accepted pairs that are rejected for a reason, the first that holds.

Guards look at raw text.  Numbers, doors and codes are taken once per record;
the two similarities are computed only for pairs that the cheap guards leave.
Which guards a country has is a table, with a row for all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import normalize as N
from linkloom.functions import similarity as S

#: Country: whether doors and codes are compared, and (name below, address above, least name length, Latin names only).
TABLE = {
    "India": (True, 40.0, 75.0, 0, True),
    "France": (False, 45.0, 70.0, 0, False),
    "US": (False, 40.0, 75.0, 5, False),
}
REASON = {"India": "INDIA_MULTI_TENANT_COLLISION", "France": "FRANCE_GUARD_D", "US": "US_MULTI_TENANT_COLLISION"}


def prepare(records: DataFrame, name: str = "business_name", addr: str = "business_address") -> DataFrame:
    """entity_id and what guards need of a record."""
    a = F.col(addr)
    return records.select("entity_id", F.struct(
        N.text(F.col(name)).alias("name"), N.text(a).alias("addr"), N.street_numbers(a).alias("numbers"), N.compound_doors(a).alias("doors"),
        N.last_pincode(a).alias("pin"), N.is_latin(N.text(F.col(name))).alias("latin"), N.is_placeholder(F.col(name)).alias("placeholder"),
    ).alias("g"))


def disjoint(a: Column, b: Column) -> Column:
    """Both have members and share none."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def apply(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """``pairs`` (s1, cand, country, ...) with ``reason``, ACCEPT for those that stay.

    A pair whose records aren't known is left alone, as nothing speaks against it.
    """
    side = lambda who, g: prepare(records).select(F.col("entity_id").alias(who), F.col("g").alias(g))
    df = pairs.join(side("s1", "a"), "s1", "left").join(side("cand", "b"), "cand", "left")
    return with_reason(df).drop("a", "b")


def with_reason(df: DataFrame) -> DataFrame:
    """The chain over record structs ``a`` and ``b``; null structs are unknown records."""
    known = F.col("a").isNotNull() & F.col("b").isNotNull()
    flag = lambda i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for c, v in TABLE.items() for x in (c, v[i])]), F.col("country")), F.lit(None))
    street = known & disjoint(F.col("a.numbers"), F.col("b.numbers"))
    local = F.coalesce(flag(0), F.lit(False)) & known
    door = local & disjoint(F.col("a.doors"), F.col("b.doors"))
    pin = local & (F.col("a.pin") != "") & (F.col("b.pin") != "") & (F.col("a.pin") != F.col("b.pin"))
    long = (F.length("a.name") >= flag(3)) & (F.length("b.name") >= flag(3)) & (~flag(4) | (F.col("a.latin") & F.col("b.latin")))
    needs = known & (F.col("b.placeholder") | (~street & ~door & ~pin & F.coalesce(long, F.lit(False))))
    # pairs that need no similarity go to the kernel as empty texts, which cost nothing
    text = lambda r, f: F.when(needs, F.lower(F.col(f"{r}.{f}"))).otherwise("")
    df = df.withColumns({"_n": S.similarities(text("a", "name"), text("b", "name"), "token_sort")["token_sort"], "_a": S.similarities(text("a", "addr"), text("b", "addr"), "token_sort")["token_sort"]})
    tenants = long & (F.col("_n") < flag(1)) & (F.col("_a") > flag(2))
    names = F.create_map(*[F.lit(x) for pair in REASON.items() for x in pair])
    reason = (
        F.when(~known, "ACCEPT")
        .when(F.col("b.placeholder") & (F.col("_a") < 85.0), "PLACEHOLDER_LOW_ADDR_SIM")
        .when(street, "STREET_NUMBER_MISMATCH")
        .when(door, "COMPOUND_DOOR_MISMATCH")
        .when(pin, "PIN_MISMATCH")
        .when(F.coalesce(tenants, F.lit(False)), F.try_element_at(names, F.col("country")))
        .otherwise("ACCEPT")
    )
    return df.withColumn("reason", reason).drop("_n", "_a")


def counts(guarded: DataFrame) -> DataFrame:
    return guarded.groupBy("country", "reason").agg(F.count(F.lit(1)).alias("pairs"))


def city_conflict(a: Column, b: Column, similarity: Column) -> Column:
    return (a != "") & (b != "") & (a != b) & (similarity < 70)


def pin_conflict(a: Column, b: Column) -> Column:
    """Both set, different, and already so in the first three digits."""
    return (a != "") & (b != "") & (a != b) & (F.left(a, F.lit(3)) != F.left(b, F.lit(3)))
