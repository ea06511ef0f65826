"""Personal data by generated candidates and boosted trees, in SQL functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; what
passes their checks is always kept.  High-recall generators propose further,
possibly overlapping spans: local phone numbers, national ids, account numbers
and spelled-out e-mail addresses.  Boosted trees over format and context
features of a candidate, trained in numpy on a seeded sample of made-up
candidates, become one SQL expression, and a threshold per kind, calibrated on
a held-out part of the sample, selects the redactions.

Spark's pattern functions give no positions, so matches are wrapped in U+0001
and the text is split there; U+0001 in a text becomes U+0002 first, which no
pattern tells apart and which moves nothing.  The patterns are linear: runs
are possessive and start where a run starts or the last match ended.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm import boosting

_LOCAL = "A-Za-z0-9._%+-"
#: The base kinds in their order, as linear equivalents of the patterns that are asked for.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before a pattern is tried.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: The generators' kinds, after the base kinds.
MORE = {
    "local_phone": r"(?<![0-9+.])\(?[0-9]{3}\)?[\x20.-]{0,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    "spelled_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{2,63}\x20?[\[(.]\x20?(?:dot\x20?[\])]\x20?)?[A-Za-z]{2,24}",
}
KINDS = (*BASE, *MORE)
#: Code points of context before a candidate.
CONTEXT = 24
FEATURES = ("n", "digits", "letters", "gaps", "brackets", "kind", "cue", "anti", "before_alnum")
#: Words that speak for and against a candidate when they stand before it.
CUES = r"(?i)(?:tel|phone|call|fax|mobile|cell|ssn|social|passport|insurance|iban|account|acct|bank|mail|contact|write|reach)"
ANTI = r"(?i)(?:order|invoice|version|ver|page|ref|part|isbn|serial|model|no\.|#|\$|figure|table|line|build)"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    parts = F.split(F.reverse(digits), "")

    def value(d: Column, i: Column) -> Column:
        x = F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0)) * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.transform(parts, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        def small(p: Column) -> Column:
            bare = F.ltrim(p, F.lit("0"))
            return (F.length(bare) <= 3) & (F.coalesce(F.expr("0") + F.try_to_number(F.concat(F.lit("0"), F.left(bare, F.lit(3))), F.lit("9999")).cast("int"), F.lit(0)) <= 255)

        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        d = _digits(m)
        return (F.length(d) <= 19) & _luhn(F.left(d, F.lit(19)))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


_SPAN = "array<struct<s:int,k:int,e:int,m:string,c:string>>"


def _spans(clean: Column, kind: str, pattern: str) -> Column:
    """The matches of a pattern: start, kind, end, text, and the text before."""
    marked = F.regexp_replace(clean, pattern, "\u0001$0\u0001")
    none = F.array().cast(_SPAN)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), F.lit("").alias("last"), none.alias("out"))
    k = KINDS.index(kind)

    def add(acc: Column, seg: Column) -> Column:
        end = acc["at"] + F.length(seg)
        span = F.struct(acc["at"].alias("s"), F.lit(k).alias("k"), end.alias("e"), seg.alias("m"), F.right(acc["last"], F.lit(CONTEXT)).alias("c"))
        return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), seg.alias("last"), F.when(acc["odd"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(F.split(marked, "\u0001"), start, add, lambda acc: acc["out"])
    return F.when(F.instr(marked, "\u0001") > 0, F.filter(found, lambda x: _passes(kind, x["m"]))).otherwise(none)


def features(kind: int, m: str, c: str) -> list[float]:
    """What the SQL computes for a candidate, for training and tests."""
    count = lambda p: float(len(re.findall(p, m)))
    return [
        float(len(m)), count("[0-9]"), count("[A-Za-z]"), count("[ -]"), count(r"[(\[]"), float(kind),
        float(bool(re.search(CUES, c))), float(bool(re.search(ANTI, c))), float(bool(re.search("[A-Za-z0-9]$", c))),
    ]


def _feature_sql(name: str) -> str:
    return {
        "n": "length(x.m)", "digits": "regexp_count(x.m, '[0-9]')", "letters": "regexp_count(x.m, '[A-Za-z]')", "gaps": "regexp_count(x.m, '[ -]')",
        "brackets": r"regexp_count(x.m, '[(\\[]')", "kind": "x.k", "cue": f"int(x.c rlike '{_quoted(CUES)}')", "anti": f"int(x.c rlike '{_quoted(ANTI)}')", "before_alnum": "int(x.c rlike '[A-Za-z0-9]$')",
    }[name]


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


def sample(n: int = 240, seed: int = 3) -> list[tuple[int, str, str, int]]:
    """(kind, candidate, context, whether personal): made-up candidates, n of each kind."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    for_, against = ("call ", "phone: ", "tel. ", "fax ", "contact ", "mobile "), ("order ", "invoice no. ", "part # ", "version ", "ref ", "serial ")
    out = []
    for i in range(n):
        yes = i % 2 == 0
        filler = f"{word()} {word()} "
        a, b, c = digits(3), digits(3), digits(4)
        if yes:
            phone = rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}", f"{a}.{b}.{c}"))
            out.append((4, phone, filler + rng.choice((*for_, "", "")), 1))
        else:
            phone = rng.choice((f"{a} {b} {c}", f"{a}{b}-{c}", f"{a}-{b}-{c}"))
            out.append((4, phone, filler + rng.choice(against), 0))
        ident = f"{a}-{digits(2)}-{c}" if yes or rng.random() < 0.5 else f"{a} {digits(2)} {c}"
        out.append((5, ident, filler + (rng.choice(("ssn ", "social security ", "passport ", "insurance no ", "")) if yes else rng.choice((*against, "page "))), int(yes)))
        blocks = rng.randint(3, 6)
        iban = rng.choice(("DE", "FR", "ES", "GB")) + digits(2) + "".join(" " * (i % 4 < 2) + digits(4) for _ in range(blocks))
        code = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(2)) + digits(2) + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(4 * blocks))
        out.append((6, iban, filler + rng.choice(("iban ", "account ", "bank ", "")), 1) if yes else (6, code, filler + rng.choice((*against, "", "model ")), 0))
        mail = f"{word()}.{word()} (at) {word()} (dot) {rng.choice(('com', 'org', 'net'))}" if i % 4 < 2 else f"{word()}[at]{word()}.{rng.choice(('com', 'org'))}"
        vague = f"{word()} (at) {word()} .{word()}"
        out.append((7, mail, filler + rng.choice(("mail ", "write to ", "contact ", "")), 1) if yes else (7, vague, filler, 0))
    return out


@dataclass
class Selector:
    trees: list
    thresholds: dict[int, float]

    def sql(self) -> str:
        """Whether candidate x is selected."""
        score = boosting.to_sql(self.trees, [f"f.{n}" for n in FEATURES])
        cut = " ".join(f"WHEN {k} THEN {t:.9f}D" for k, t in self.thresholds.items())
        fs = ", ".join(f"'{n}', double({_feature_sql(n)})" for n in FEATURES)
        return f"exists(array(named_struct({fs})), f -> {score} >= CASE x.k {cut} END)"


@lru_cache(1)
def selector(precision: float = 0.95) -> Selector:
    """Trees from two thirds of the sample; on the rest, the least threshold of each kind that keeps the precision."""
    rows = sample()
    x = np.array([features(k, m, c) for k, m, c, _ in rows])
    y = np.array([float(r[3]) for r in rows])
    kinds = np.array([r[0] for r in rows])
    fit = np.arange(len(rows)) // len(MORE) % 3 > 0
    trees = boosting.fit(x[fit], y[fit])
    held = boosting.predict(trees, x[~fit])
    cuts = {}
    for k in sorted(set(kinds)):
        s, t = held[kinds[~fit] == k], y[~fit][kinds[~fit] == k]
        good = [c for c in np.unique(s) if t[s >= c].mean() >= precision]
        cuts[int(k)] = max(float(min(good)) if good else np.inf, 0.0)
    return Selector(trees, {k: min(c, 1e9) for k, c in cuts.items()})


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, text, base and more: sorted (s, k, e) spans in code points, end exclusive.

    Candidates that overlap a base span add nothing and are left out.  Null
    texts are empty; repeated rows each get a row; other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("clean", F.replace("text", F.lit("\u0001"), F.lit("\u0002")))
    none = F.array().cast(_SPAN)
    # the base patterns may have single digits, with something between any two; the generators' patterns have two in a row
    rows = rows.withColumn("digit", F.col("clean").rlike("[0-9]")).withColumn("digits", F.col("digit") & F.col("clean").rlike("[0-9]{2}"))
    for kind, pattern in BASE.items():
        need = F.contains("clean", F.lit(_NEEDS[kind])) if kind in _NEEDS else F.lit(True)
        need = need if kind == "email" else need & F.col("digit")
        rows = rows.withColumn(kind, F.when(need, _spans(F.col("clean"), kind, pattern)).otherwise(none))
    for kind, pattern in MORE.items():
        need = F.contains("clean", F.lit("at")) & F.col("clean").rlike(r"[\[(]\x20?at\x20?[\])]") if kind == "spelled_email" else F.col("digits")
        rows = rows.withColumn(kind, F.when(need, _spans(F.col("clean"), kind, pattern)).otherwise(none))
    rows = rows.withColumn("base", F.concat(*BASE)).withColumn("proposed", F.concat(*MORE))
    chosen = F.expr(f"filter(proposed, x -> NOT exists(base, b -> b.s < x.e AND x.s < b.e) AND {selector().sql()})")
    return rows.select("doc_id", "text", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], _bare("base"), F.when(F.size("proposed") > 0, chosen).otherwise(none).alias("more")).withColumn("more", _bare("more"))


def _bare(name: str) -> Column:
    return F.array_sort(F.transform(name, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))).alias(name)


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans for each row of ``docs``."""
    found = find(docs)
    return found.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.array_sort(F.concat("base", "more"))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and text, where spans are replaced by [kind]; of overlapping spans the first stays."""
    found = find(docs).withColumn("spans", F.array_sort(F.concat("base", "more")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    names = F.array(*map(F.lit, KINDS))

    def cut(acc: Column, x: Column) -> Column:
        new = F.concat(acc["out"], F.substr("text", acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.get(names, x["k"]), F.lit("]"))
        return F.when(x["s"] >= acc["at"], F.struct(x["e"].alias("at"), new.alias("out"))).otherwise(acc)

    done = F.aggregate("spans", start, cut)
    return found.withColumn("d", done).select("doc_id", F.concat("d.out", F.substr("text", F.col("d.at") + 1)).alias("text"))
