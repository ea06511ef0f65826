"""Blocking: records meet through keys of several channels, all within a country.

A record gives rows (country, space, key, channel, weight); candidates come
from an equi-join on (country, space, key).  Keys are bags: a key that a record
gives twice counts twice, and it is summed up before the join, so that a pair
of records gives one row per key and not one per occurrence.  A channel's cap
drops keys with longer candidate lists before the join; only four-letter
prefixes have one by default.  :func:`preselected` needs no cap, as equal
records meet once and long lists are looked up by sets of their keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import constants as C
from linkloom.functions import normalize as N
from linkloom.functions import similarity as S
from linkloom.operators.assign import checkpoints, release

#: Weight of a shared key; the channels after "sigtoken" share its key space.
WEIGHTS = {"tok2": 12, "phonetic": 6, "postal": 8, "street": 10, "pin_street": 10, "street_city": 8, "sigtoken": 5, "acronym": 6, "short": 4, "prefix4": 2}
SPACES = {"pin_street": "street", "street_city": "street", "acronym": "sigtoken", "short": "sigtoken"}
_KEY = ("country", "space", "key")
#: Lists of more bags than this many times the wanted candidates are long; bags of more long keys than WIDE have no sets made of them.
LONG, WIDE = 4, 8
#: Bags meet in so many parts, one after the other, so that only a part's shuffle files are there at once.
PARTS = 4


@dataclass(frozen=True)
class BlockingConfig:
    """Which channels there are, how long a key's list may be, and how many candidates stay."""

    channels: tuple[str, ...] = ("tok2", "phonetic", "postal", "street", "pin_street", "sigtoken", "acronym", "short", "prefix4")
    caps: dict[str, int] = field(default_factory=lambda: {"prefix4": 500})
    #: The longest list of any key of the other channels; None leaves them alone.
    cap: int | None = None
    top_k: int = 50

    def preselect(self) -> int:
        return max(2 * self.top_k, 60)


def _significant(name: Column) -> Column:
    return F.filter(N.tokens(N.transliterate(name)), lambda t: ~N.among(t, C.GENERIC_STOPS) & (F.length(t) > 1))


def tok2_key(name: Column) -> Column:
    """The first two significant words, sorted; one alone; else the first four characters."""
    t = _significant(name)
    plain = F.left(N.transliterate(name), F.lit(4))
    return F.when(F.size(t) == 0, plain).otherwise(F.array_join(F.array_sort(F.slice(t, 1, 2)), "_"))


def phonetic_key(name: Column) -> Column:
    """The sound of the first significant word, or its first four characters where it has none."""
    first = F.coalesce(F.get(_significant(name), F.lit(0)), F.lit(""))
    code = S.double_metaphone(first)
    return F.when(first == "", "").otherwise(F.when(code == "", F.left(first, F.lit(4))).otherwise(code))


def postal_key(name: Column, pin: Column) -> Column:
    first = F.coalesce(F.get(N.tokens(N.transliterate(name)), F.lit(0)), F.lit(""))
    return F.when(pin == "", "").otherwise(F.concat_ws("_", pin, F.left(first, F.lit(3))))


def street_keys(addr: Column, number: Column) -> Column:
    """Street number with each of the first three words that may name a street."""
    t = F.filter(N.tokens(addr), lambda x: (x != number) & (F.length(x) > 2) & ~N.among(x, C.ADDRESS_STOPS))
    return F.when(number == "", F.array().cast("array<string>")).otherwise(F.transform(F.slice(t, 1, 3), lambda x: F.concat_ws("_", number, x)))


def keys(records: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """entity_id, country, space, key, channel, weight, n: how often the record gives the key."""
    r = records
    name, addr, pin, number = F.col("name_norm"), F.col("addr_norm"), F.col("pin_extracted"), F.col("street_number")
    words = F.filter(N.tokens(N.transliterate(name)), lambda t: ~N.among(t, C.GENERIC_STOPS))
    long = F.filter(words, lambda t: F.length(t) >= 4)
    one = lambda k: F.array(k)
    made = {
        "tok2": lambda: one(tok2_key(name)),
        "phonetic": lambda: one(phonetic_key(name)),
        "postal": lambda: one(postal_key(name, pin)),
        "street": lambda: street_keys(addr, number),
        "pin_street": lambda: one(F.when((pin == "") | (number == ""), "").otherwise(F.concat_ws("_", pin, number))),
        "street_city": lambda: one(F.when((number == "") | (F.col("city_extracted") == ""), "").otherwise(F.concat_ws("_", number, F.col("city_extracted")))),
        "sigtoken": lambda: long,
        "acronym": lambda: one(N.acronym(words)),
        "short": lambda: one(F.when((F.size(words) == 1) & F.length(F.get(words, F.lit(0))).between(2, 4), F.get(words, F.lit(0))).otherwise("")),
        "prefix4": lambda: F.transform(long, lambda t: F.left(t, F.lit(4))),
    }
    parts = []
    for channel in config.channels:
        space, label, weight = F.lit(SPACES.get(channel, channel)), F.lit(channel), F.lit(WEIGHTS[channel])
        parts.append(F.transform(made[channel](), lambda k: F.struct(space.alias("space"), k.alias("key"), label.alias("channel"), weight.alias("weight"))))
    out = r.select("entity_id", "country", F.explode(F.concat(*parts)).alias("k")).select("entity_id", "country", "k.*").filter("key <> ''")
    return out.groupBy("entity_id", "country", "space", "key", "channel", "weight").agg(F.count(F.lit(1)).alias("n"))


def key_counts(cand_keys: DataFrame) -> DataFrame:
    """The length of each key's list: country, space, key, postings."""
    return cand_keys.groupBy("country", "space", "key").agg(F.sum("n").alias("postings"))


def capped(cand_keys: DataFrame, config: BlockingConfig) -> DataFrame:
    """Without the keys whose lists are too long; lists are counted by partial aggregation, so none is gathered."""
    limits = {SPACES.get(c, c): config.caps.get(c, config.cap) for c in config.channels}
    bounded = {s: c for s, c in limits.items() if c is not None}
    if not bounded:
        return cand_keys
    limit = F.create_map(*[F.lit(x) for pair in bounded.items() for x in pair])
    long = key_counts(cand_keys.filter(F.col("space").isin(list(bounded)))).filter(F.col("postings") > F.try_element_at(limit, F.col("space")))
    return cand_keys.join(long.select("country", "space", "key"), ["country", "space", "key"], "left_anti")


def shared_keys(s1: DataFrame, cands: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """s1, cand, channel, votes for each key two records share; a candidate's channel is not looked at, as lists are shared by space."""
    a = keys(s1, config).select(F.col("entity_id").alias("s1"), "country", "space", "key", "channel", "weight", F.col("n").alias("n1"))
    b = capped(keys(cands, config).groupBy("entity_id", "country", "space", "key").agg(F.sum("n").alias("n")), config).select(F.col("entity_id").alias("cand"), "country", "space", "key", "n")
    return a.join(b, ["country", "space", "key"]).select("s1", "cand", "channel", (F.col("weight") * F.col("n1") * F.col("n")).alias("votes"))


def votes(s1: DataFrame, cands: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    return shared_keys(s1, cands, config).groupBy("s1", "cand").agg(F.sum("votes").alias("votes"))


def _bags(rows: DataFrame, n: Column, who: str) -> tuple[DataFrame, DataFrame]:
    """(id, bag) of the distinct bags of keys, each key with n, and (who, id) of their records: a bag's id is its least record."""
    bags = rows.groupBy("entity_id", "country", "space", "key").agg(F.sum(n).alias("n"))
    bags = bags.groupBy(F.col("entity_id").alias(who)).agg(F.array_sort(F.collect_list(F.struct(*_KEY, "n"))).alias("bag"))
    labels = bags.select(who, F.unhex(F.sha2(F.to_json("bag"), 256)).alias("label"))
    least = labels.groupBy("label").agg(F.min(who).alias("id"))
    of = labels.join(least, "label").select(who, "id").checkpoint()
    return bags.join(of.filter(F.col(who) == F.col("id")), who).select("id", "bag"), of


def _parted(bags: DataFrame, long: DataFrame) -> DataFrame:
    """id, short and long: the keys of a bag whose lists are short, and the numbers of those whose lists are long."""
    rows = bags.select("id", F.explode("bag").alias("k")).select("id", "k.*").join(long, list(_KEY), "left")
    taken = lambda which, *of: F.array_sort(F.collect_list(F.when(which, F.struct(*of, "n"))))
    return rows.groupBy("id").agg(taken(F.col("i").isNull(), *_KEY).alias("short"), taken(F.col("i").isNotNull(), "i").alias("long"))


def _subsets(bags: DataFrame, who: str, n: str) -> DataFrame:
    """who, keys and n: every set of a bag's long keys."""
    sets = F.expr("transform(sequence(1, shiftleft(1, size(long)) - 1), s -> filter(long, (x, i) -> (shiftright(s, i) & 1) = 1))")
    rows = bags.select(F.col("id").alias(who), F.explode(sets).alias("s"))
    return rows.select(who, F.transform("s", lambda x: x["i"]).alias("keys"), F.transform("s", lambda x: x["n"]).alias(n))


def met_bags(bags_a: DataFrame, bags_b: DataFrame, most: int, long: int = LONG, wide: int = WIDE) -> DataFrame:
    """a, b, some and rest: votes of a shared short key or none, and votes for long keys; of a pair, the sum of ``some`` and the most of ``rest`` count.

    Every pair is there that can be among the ``most`` best of its a.  Only
    short lists, of ``long`` times ``most`` bags or fewer, are met whole, so
    that the rows grow with the bags and not with their square.  A pair that
    shares no short key shares a set of long ones.  Every bag of that set has
    as many votes from it or more, so only the first ``most`` of the set's own
    list can be among the best: each set of a bag's long keys is looked up in
    lists cut there.  A pair found by a short key gets its votes for long keys
    from both bags.  Bags of more than ``wide`` long keys have too many sets
    and meet the long lists whole.  Long keys have numbers, as every row of a
    short key carries the long ones of its bag.
    """
    return _meet(*_ready(bags_a, bags_b, most, long, wide), wide)


def _ready(bags_a: DataFrame, bags_b: DataFrame, most: int, long: int, wide: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides as :func:`_parted` gives them, and the lists of sets of long keys, cut at ``most``."""
    lists = bags_b.select(F.explode("bag").alias("k")).groupBy(*[F.col(f"k.{c}").alias(c) for c in _KEY]).agg(F.count(F.lit(1)).alias("m"))
    spark = bags_a.sparkSession
    checkpoints(spark)
    is_long = lists.filter(F.col("m") > long * most).select(*_KEY, F.monotonically_increasing_id().alias("i")).checkpoint()
    a, b = _parted(bags_a, is_long).checkpoint(), _parted(bags_b, is_long).checkpoint()
    release(spark)
    cut = _first(_subsets(b.filter(_few(wide)), "b", "n_b"), most, ["keys", "n_b"], "b").checkpoint()
    release(spark)
    return a, b, cut


def _few(wide: int) -> Column:
    """Bags with long keys, but few enough for their sets."""
    return F.size("long").between(1, wide)


def _meet(a: DataFrame, b: DataFrame, cut: DataFrame, wide: int) -> DataFrame:
    thin, broad = F.size("long") <= wide, F.size("long") > wide
    entries = lambda df, which, who, of: df.select(F.col("id").alias(who), F.col("long").alias(f"long_{who}"), F.explode(which).alias("k")).select(who, f"long_{who}", *[F.col(f"k.{c}") for c in of], F.col("k.n").alias(f"n_{who}"))
    none = F.lit(0).cast("long")
    total = lambda c: F.aggregate(c, none, lambda acc, v: acc + v)
    shared = total(F.flatten(F.transform("long_a", lambda x: F.transform(F.filter("long_b", lambda y: x["i"] == y["i"]), lambda y: x["n"] * y["n"]))))
    met = lambda x, y, which, of, some: entries(x, which, "a", of).join(entries(y, which, "b", of), of).select("a", "b", some.alias("some"), shared.alias("rest"))
    found = met(a, b, "short", list(_KEY), F.col("n_a") * F.col("n_b"))
    found = found.unionAll(met(a.filter(broad), b, "long", ["i"], none))
    found = found.unionAll(met(a.filter(thin), b.filter(broad), "long", ["i"], none))
    by_set = total(F.zip_with("n_a", "n_b", lambda x, y: x * y))
    return found.unionAll(_subsets(a.filter(_few(wide)), "a", "n_a").join(cut, "keys").select("a", "b", none.alias("some"), by_set.alias("rest")))


def _first(df: DataFrame, n: int, by: list[str], *order) -> DataFrame:
    return df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("r") <= n).drop("r")


def preselected(s1: DataFrame, cands: DataFrame, most: int, config: BlockingConfig = BlockingConfig(), long: int = LONG, wide: int = WIDE) -> DataFrame:
    """s1 and cand of the ``most`` best votes of each s1; ties go to the smaller id.

    Equal records meet once: votes are counted between distinct bags of keys.
    The bags are ranked by votes and then by their least id, so one after the
    first ``most`` bags has no candidate among the first ``most``, nor has a
    bag's candidate after its first ``most``.  :func:`met_bags` says which
    bags meet.
    """
    return next(preselected_parts(s1, cands, most, config, long, wide, 1))


def preselected_parts(s1: DataFrame, cands: DataFrame, most: int, config: BlockingConfig = BlockingConfig(), long: int = LONG, wide: int = WIDE, parts: int = PARTS) -> Iterator[DataFrame]:
    """:func:`preselected` in ``parts`` by the bags of s1, each with all bags of the candidates; to be used up one after the other."""
    spark = s1.sparkSession
    checkpoints(spark)
    # records are dealt out by id and pairs by a, once each: what follows is grouped by that and more
    bags_a, of_a = _bags(keys(s1.repartition("entity_id"), config), F.col("weight") * F.col("n"), "s1")
    bags_b, of_b = _bags(capped(keys(cands.repartition("entity_id"), config), config), F.col("n"), "cand")
    release(spark)
    a, b, cut = _ready(bags_a, bags_b, most, long, wide)
    members = _first(of_b.select(F.col("id").alias("b"), "cand"), most, ["b"], "cand").checkpoint()

    def chosen(part: int) -> DataFrame:
        own = a.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        met = _meet(own, b, cut, wide).repartition("a").groupBy("a", "b").agg((F.sum("some") + F.max("rest")).alias("votes"))
        bags = _first(met, most, ["a"], F.desc("votes"), "b")
        rows = _first(bags.join(members, "b"), most, ["a"], F.desc("votes"), "cand")
        return rows.join(of_a.select("s1", F.col("id").alias("a")), "a").select("s1", "cand")

    for part in range(parts):
        yield chosen(part)
        release(spark)


def candidates(s1: DataFrame, cands: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """s1, cand, score, rank: the votes choose twice as many as stay, similarity of names and addresses ranks them."""
    chosen = preselected(s1, cands, config.preselect(), config)
    side = lambda df, who: df.select(F.col("entity_id").alias(who), F.col("name_norm").alias(f"{who}_name"), F.col("addr_norm").alias(f"{who}_addr"), N.transliterate(F.col("name_norm")).alias(f"{who}_latin"))
    pairs = chosen.join(side(s1, "s1"), "s1").join(side(cands, "cand"), "cand")
    set_ratio = lambda x: S.similarities(F.col(f"s1_{x}"), F.col(f"cand_{x}"), "token_set")["token_set"]
    pairs = pairs.withColumns({"n": set_ratio("name"), "t": set_ratio("latin"), "a": set_ratio("addr")})
    best = F.greatest("n", "t")
    pairs = pairs.withColumn("score", F.greatest(best, "a") + 0.3 * F.least(best, "a"))
    return top_k(pairs.select("s1", "cand", "score"), config.top_k)


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best of each s1 with their rank from 1; ties go to the smaller id."""
    w = Window.partitionBy("s1").orderBy(F.desc(score), "cand")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def channel_report(shared: DataFrame, truth: DataFrame) -> DataFrame:
    """For each channel: pairs, true pairs, true pairs that no other channel finds, and recall without it."""
    pairs = shared.groupBy("s1", "cand").agg(F.collect_set("channel").alias("channels")).join(truth.select("s1", "cand", F.lit(1).alias("hit")), ["s1", "cand"], "left")
    rows = pairs.select(F.explode("channels").alias("channel"), F.coalesce("hit", F.lit(0)).alias("hit"), (F.size("channels") == 1).cast("int").alias("alone"))
    out = rows.groupBy("channel").agg(F.count(F.lit(1)).alias("pairs"), F.sum("hit").alias("hits"), F.sum(F.col("hit") * F.col("alone")).alias("unique_catches"))
    found = pairs.agg(F.count(F.lit(1)).alias("all_pairs"), F.coalesce(F.sum("hit"), F.lit(0)).alias("all_hits"))
    total = truth.agg(F.count(F.lit(1)).alias("truth"))
    joined = out.join(F.broadcast(found.crossJoin(total)))
    return joined.select("channel", "pairs", "hits", "unique_catches", F.round(100.0 * F.col("pairs") / F.col("all_pairs"), 6).alias("volume_pct"), F.round(1000.0 * F.col("hits") / F.col("pairs"), 6).alias("hits_per_1k"), F.round((F.col("all_hits") - F.col("unique_catches")) / F.col("truth"), 6).alias("recall_without"))


def recall_at(ranked: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """k, hits, recall and mean candidates per entity for each k, in one pass."""
    total = truth.agg(F.count(F.lit(1)).alias("truth"))
    people = ranked.agg(F.countDistinct("s1").alias("people"))
    marked = ranked.join(truth.select("s1", "cand", F.lit(1).alias("hit")), ["s1", "cand"], "left").withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter(F.col("rank") <= F.col("k"))
    out = marked.groupBy("k").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.count(F.lit(1)).alias("pairs"))
    return out.join(F.broadcast(total.crossJoin(people))).select("k", "hits", "pairs", F.round(F.col("hits") / F.col("truth"), 6).alias("recall"), F.round(F.col("pairs") / F.col("people"), 6).alias("mean_candidates"))


def missed(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    return truth.join(ranked, ["s1", "cand"], "left_anti")


def truncate(matches: Column, candidates_: Column, k: int) -> tuple[Column, Column]:
    """The first k candidates, and the matches that are among them, in order."""
    kept = F.slice(candidates_, 1, k)
    return F.filter(matches, lambda m: F.array_contains(kept, m)), kept


def assemble(scored: DataFrame, k: int) -> DataFrame:
    """Matches first, then the best others, k in all; rows carry ``matched`` and ``p``."""
    w = Window.partitionBy("s1").orderBy(F.desc("matched"), F.desc("p"), "cand")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def plausible(s1: DataFrame, cands: DataFrame) -> DataFrame:
    """Candidates that look like matches of a few probed entities, whether blocking finds them or not: s1, cand, ns, asim.

    Rows carry raw names and addresses.  The probed entities are a sample, so
    their side is broadcast and every candidate of their countries is looked
    at once; a candidate must hold a word of the name or the address, and be
    like both.
    """
    low = lambda c: F.lower(N.text(F.col(c)))
    words = lambda c: F.regexp_extract_all(low(c), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0))
    left = s1.select(F.col("entity_id").alias("s1"), "country", words("business_name").alias("nw"), words("business_address").alias("aw"), low("business_name").alias("an"), low("business_address").alias("aa"))
    right = cands.select(F.col("entity_id").alias("cand"), "country", low("business_name").alias("bn"), low("business_address").alias("ba"))
    met = right.join(F.broadcast(left), "country").filter(F.exists("nw", lambda w: F.contains("bn", w)) | F.exists("aw", lambda w: F.contains("ba", w)))
    like = lambda a, b: S.similarities(F.col(a), F.col(b), "token_sort")["token_sort"]
    met = met.withColumns({"ns": like("an", "bn"), "asim": like("aa", "ba")})
    return met.filter(((F.col("ns") >= 80) & (F.col("asim") >= 55)) | ((F.col("ns") >= 90) & (F.col("asim") >= 40))).select("s1", "cand", "ns", "asim")
