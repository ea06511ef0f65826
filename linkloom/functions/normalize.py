"""Text normalisation as Column expressions; every function takes and gives Columns, and null means empty."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import constants as C


@lru_cache(64)
def literals(words: tuple[str, ...]) -> list[Column]:
    """Literal columns of a fixed list, made once: each is a call into the JVM."""
    return [F.lit(w) for w in words]


def among(c: Column, words: list[str]) -> Column:
    """Whether a value is in a fixed list; Spark makes a hash set of it."""
    return c.isin(*literals(tuple(words)))


@lru_cache(8)
def _map(pairs: tuple[tuple[str, str], ...]) -> Column:
    return F.create_map(*literals(tuple(x for pair in pairs for x in pair)))


@lru_cache(1)
def _forms() -> Column:
    """The legal forms as an array of (p, label) structs."""
    return F.array(*[F.struct(F.lit(f"(?U){p}").alias("p"), F.lit(label).alias("label")) for p, label in C.LEGAL_SUFFIXES])


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


@lru_cache(1)
def latin_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by Unicode decomposition."""
    pairs = []
    for ranges in (range(0x00C0, 0x0250), range(0x1E00, 0x1F00)):
        for code in ranges:
            parts = unicodedata.normalize("NFKD", chr(code))
            base = "".join(p for p in parts if not 0x0300 <= ord(p) <= 0x036F)
            if len(base) == 1 and base != chr(code):
                pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(c: Column) -> Column:
    """Latin letters without their accents; marks of other scripts stay."""
    return F.regexp_replace(F.translate(text(c), *latin_table()), "[̀-ͯ]", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean(c: Column) -> Column:
    """Lower case without accents; symbols spelled out; letters, marks and digits kept, all else a space."""
    c = F.lower(strip_accents(c))
    c = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit(" and ")), F.lit("@"), F.lit(" at ")), F.lit("+"), F.lit(" plus "))
    return squeeze(F.regexp_replace(c, r"[^\p{L}\p{N}\p{M}]", " "))


def add_name(df: DataFrame, name: str = "business_name") -> DataFrame:
    """name_norm and legal_suffix: the first form that is found names the suffix, every form is removed."""
    anyone = "(?U)" + "|".join(f"(?:{p})" for p, _ in C.LEGAL_SUFFIXES)
    df = df.withColumn("_clean", clean(F.col(name)))
    fold = F.aggregate(
        _forms(),
        F.struct(F.col("_clean").alias("core"), F.lit("").alias("suffix")),
        lambda acc, x: F.struct(
            F.regexp_replace(acc["core"], x["p"], F.lit(" ")).alias("core"),
            F.when((acc["suffix"] == "") & F.rlike(acc["core"], x["p"]), x["label"]).otherwise(acc["suffix"]).alias("suffix"),
        ),
    )
    plain = F.struct(F.col("_clean").alias("core"), F.lit("").alias("suffix"))
    df = df.withColumn("_fold", F.when(F.col("_clean").rlike(anyone), fold).otherwise(plain))
    core = squeeze(F.col("_fold.core"))
    return df.withColumn("name_norm", F.when(core == "", F.col("_clean")).otherwise(core)).withColumn("legal_suffix", F.col("_fold.suffix")).drop("_clean", "_fold")


def postal_code(address: Column, country: Column) -> Column:
    """The first postal code by the country's pattern; countries without one try six digits, then five."""
    found = [F.regexp_extract(text(address), p, 1) for p in (C.PIN6, C.ZIP5)]
    out = F.when(found[0] != "", found[0]).otherwise(found[1])
    for name, (pattern,) in C.POSTAL.items():
        out = F.when(F.upper(F.trim(text(country))) == name, F.regexp_extract(text(address), pattern, 1)).otherwise(out)
    return out


def street_number(address: Column) -> Column:
    return F.regexp_extract(text(address), f"(?U){C.STREET_NUMBER}", 1)


def city(address: Column) -> Column:
    """The second last of three or more comma parts, the last of two; without digits, over two characters."""
    parts = F.filter(F.transform(F.split(text(address), ","), lambda p: F.trim(p)), lambda p: p != "")
    n = F.size(parts)
    part = F.when(n >= 3, F.try_element_at(parts, F.lit(-2))).when(n == 2, F.try_element_at(parts, F.lit(-1))).otherwise("")
    bare = F.trim(F.regexp_replace(part, r"(?U)\d+", ""))
    return F.when(F.length(bare) > 2, clean(bare)).otherwise("")


def has_landmark(address: Column) -> Column:
    return text(address).rlike(C.LANDMARK).cast("int")


def address(c: Column) -> Column:
    out = clean(c)
    for short, word in C.ADDRESS_WORDS:
        out = F.regexp_replace(out, rf"(?U)\b{short}\b", word)
    return squeeze(out)


def normalize(df: DataFrame) -> DataFrame:
    """The seven derived columns of a source record, beside its own."""
    a, country = F.col("business_address"), F.col("country")
    return add_name(df).select(
        *[c for c in df.columns], "name_norm", "legal_suffix", address(a).alias("addr_norm"), postal_code(a, country).alias("pin_extracted"),
        city(a).alias("city_extracted"), street_number(a).alias("street_number"), has_landmark(a).alias("has_landmark"),
    )


def transliterate(c: Column) -> Column:
    """Devanagari letters in Latin script; texts without any are left alone."""
    letters = _map(tuple(C.DEVANAGARI.items()))
    spelled = F.array_join(F.transform(F.split(text(c), ""), lambda x: F.coalesce(F.try_element_at(letters, x), x)), "")
    return F.when(text(c).rlike("[ऀ-ॿ]"), spelled).otherwise(text(c))


def tokens(c: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(text(c), r"(?U)\s+"), lambda t: t != "")


def core_tokens(c: Column, stops: list[str] = C.LEGAL_STOPWORDS) -> Column:
    """Words that make the business's own name; all words where none is left."""
    every = tokens(c)
    own = F.filter(every, lambda t: ~among(t, stops) & (F.length(t) > 1))
    return F.when(F.size(own) > 0, own).otherwise(every)


def street_tokens(addr_norm: Column, city_norm: Column) -> Column:
    """Distinct words that name a street: no numbers, kinds of streets, cities, or words of two letters or fewer."""
    bare = F.transform(tokens(addr_norm), lambda t: F.regexp_replace(t, r"(?U)[^\w\s]", ""))
    own = F.filter(bare, lambda t: ~t.rlike(r"(?U)^\d*[a-z]?$") & (F.length(t) > 2) & ~among(t, C.STREET_TYPES) & ~among(t, C.CITIES))
    return F.array_except(own, tokens(city_norm))


def acronym(words: Column) -> Column:
    """First letters of two or more words, letters and digits alone; of two to four characters, else empty."""
    first = F.array_join(F.filter(F.transform(words, lambda t: F.left(t, F.lit(1))), lambda x: x.rlike(r"(?U)[\p{L}\p{N}]")), "")
    return F.when((F.size(words) >= 2) & F.length(first).between(2, 4), first).otherwise("")


def audit_clean(c: Column) -> Column:
    """The audit's cleaning: lower case, punctuation to spaces, words by its table."""
    table = _map(tuple(C.AUDIT_TOKENS.items()))
    words = tokens(F.regexp_replace(F.lower(text(c)), r"[#.,\-/()\[\]:;'\"]", " "))
    return F.array_join(F.transform(words, lambda t: F.coalesce(F.try_element_at(table, t), t)), " ")


def audit_core(c: Column) -> Column:
    every = tokens(audit_clean(c))
    own = F.filter(every, lambda t: ~among(t, C.AUDIT_STOPWORDS) & (F.length(t) > 1))
    return F.array_join(F.when(F.size(own) > 0, own).otherwise(every), " ")


def audit_street_number(c: Column) -> Column:
    return F.lower(F.regexp_extract(text(c), r"(?U)\b(\d+[a-zA-Z]?)\b", 1))


def audit_street_tokens(c: Column) -> Column:
    drop = sorted({*C.AUDIT_STREET_TYPES, *C.AUDIT_TOKENS.values()})
    return F.array_distinct(F.filter(tokens(audit_clean(c)), lambda t: ~t.rlike(r"(?U)^\d+[a-z]?$") & ~among(t, drop) & (F.length(t) > 2)))


def _numbers_text(c: Column) -> Column:
    c = F.regexp_replace(text(c), r"(?<=\d)[oO]\b|\b[oO](?=\d)", "0")
    return F.regexp_replace(F.regexp_replace(c, "[#№°]", " "), r"(?i)\b(?:no|n°|nº|num|number)\b\.?", " ")


def street_numbers(c: Column) -> Column:
    """The distinct numbers of an address: letter O beside digits is zero, ranges are split, of six digits at most."""
    split = F.regexp_replace(_numbers_text(c), r"(\d+)[-/](\d+)", "$1 $2")
    digits = F.transform(F.regexp_extract_all(split, F.lit(r"\b(\d+[a-zA-Z]?)\b"), F.lit(1)), lambda t: F.ltrim(F.regexp_replace(t, r"\D", ""), F.lit("0")))
    return F.array_distinct(F.transform(F.filter(digits, lambda d: F.length(d).between(1, 6)), lambda d: d.cast("int")))


def compound_doors(c: Column) -> Column:
    """The distinct door numbers of several parts, zero-stripped, parts joined by a slash."""
    doors = F.regexp_extract_all(_numbers_text(c), F.lit(r"\b(\d+[-/]\d+(?:[-/]\d+)?)\b"), F.lit(1))

    def one(d: Column) -> Column:
        parts = F.transform(F.split(d, "[-/]"), lambda p: F.ltrim(p, F.lit("0")))
        return F.array_join(F.transform(parts, lambda p: F.when(p == "", "0").otherwise(p)), "/")

    return F.array_distinct(F.transform(doors, one))


def last_pincode(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text(c), F.lit(r"\b([1-9]\d{5})\b"), F.lit(1)), F.lit(-1)), F.lit(""))


def is_placeholder(c: Column) -> Column:
    return F.lower(F.trim(text(c))).isin(C.PLACEHOLDERS)


def is_latin(c: Column) -> Column:
    """Whether over four fifths of the letters are ASCII; a text without letters is."""
    letters = F.length(F.regexp_replace(text(c), r"\P{L}", ""))
    return (letters == 0) | (F.length(F.regexp_replace(text(c), "[^A-Za-z]", "")) > 0.8 * letters)


def suite(c: Column, ascii: bool = False) -> Column:
    """The number or letter after a word for a part of a building; with ``ascii``, letters beyond ASCII end a word, as in SQL engines."""
    part = "ste|suite|unit|apt|apartment|fl|floor|bldg|building|bat|bâtiment|etg|étage|porte|bureau|flat|shop|plot"
    edge, space = (r"(?-iu:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))", r"[\t\n\f\r ]") if ascii else (r"\b", r"\s")
    return F.lower(F.regexp_extract(text(c), rf"(?iu){edge}(?:{part}){space}*#?{space}*([a-z0-9-]+){edge}", 1))


#: Upper edges and names of the histogram of similarities.
BUCKETS = [(0.2, "<0.20"), (0.4, "0.20-0.40"), (0.6, "0.40-0.60"), (0.8, "0.60-0.80"), (0.9, "0.80-0.90")]


def similarity_bucket(c: Column) -> Column:
    """Six buckets of a similarity from 0 to 1."""
    return reduce(lambda out, b: F.when(c < b[0], b[1]).otherwise(out), reversed(BUCKETS), F.lit(">=0.90"))
