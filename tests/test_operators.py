import random
import re
import time
from pathlib import Path

import pandas as pd
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.functions import normalize as N
from linkloom.operators import assign, blocking, decide, evaluate, features, guards, ml, sampling, validate
from linkloom.plans import pair_queries, registry, relations

LADDERS = [("a", "x1", 0.95), ("a", "x2", 0.95), ("a", "x3", 0.9), ("a", "x4", 0.7), ("b", "x1", 0.6), ("c", "x9", 0.8), ("d", "x5", 0.99), ("d", "x6", 0.93), ("d", "x7", 0.86), ("d", "x8", 0.8)]


@pytest.fixture
def scored(spark):
    return spark.createDataFrame(LADDERS, "s1 string, cand string, p double")


def taken(df):
    return sorted((r.s1, r.cand) for r in df.collect())


def test_rules(scored):
    assert taken(decide.dynamic_margin(scored)) == [("a", "x1"), ("a", "x2"), ("a", "x3"), ("c", "x9"), ("d", "x5"), ("d", "x6")]
    assert taken(decide.cliff(scored)) == [("a", "x1"), ("a", "x2"), ("a", "x3"), ("c", "x9"), ("d", "x5"), ("d", "x6"), ("d", "x7"), ("d", "x8")]
    assert taken(decide.fixed_tau(scored, 0.9, 1)) == [("a", "x1"), ("d", "x5")]
    assert taken(decide.softmax_mass(scored)) == [("a", "x1"), ("a", "x2"), ("c", "x9"), ("d", "x5"), ("d", "x6")]
    for rule in decide.RULES.values():
        assert set(taken(rule(scored))) <= {(a, b) for a, b, _ in LADDERS}


def test_grand_synthesis_skips_guarded_rows(spark):
    rows = [("a", "x1", 0.90, 90.0, 90.0), ("a", "x2", 0.85, 10.0, 90.0), ("a", "x3", 0.84, 90.0, 90.0)]
    df = spark.createDataFrame(rows, "s1 string, cand string, p double, name_sim double, addr_sim double")
    assert taken(decide.grand_synthesis(df)) == [("a", "x1"), ("a", "x3")]


def ladder(spark, ps, **more):
    rows = [("a", f"x{i:02}", p, *(v[i] for v in more.values())) for i, p in enumerate(ps)]
    kinds = ", ".join(f"{k} {'string' if isinstance(v[0], str) else 'double'}" for k, v in more.items())
    return spark.createDataFrame(rows, "s1 string, cand string, p double" + (f", {kinds}" if kinds else ""))


def test_rules_keep_their_caps(spark):
    many = [0.99 - i / 1000 for i in range(14)]
    assert decide.gap_cut(ladder(spark, [*many, 0.80])).count() == 10
    assert decide.gap_cut(ladder(spark, many)).count() == 4
    assert decide.rank_adaptive(ladder(spark, many)).count() == 10
    names = ["acme foods"] * 14
    assert decide.disambiguate(ladder(spark, many, cand_name=names)).count() == 10
    assert decide.feature_augmented(ladder(spark, many, name_sim=[50.0] * 14)).count() == 6
    assert decide.softmax_mass(ladder(spark, [0.2])).isEmpty() and decide.softmax_mass(ladder(spark, [0.9, 0.2])).count() == 1


def test_the_best_candidate_needs_no_consensus(spark):
    one = ladder(spark, [0.95, 0.93, 0.92], s1_name=["zzz"] * 3, cand_name=["acme foods", "acme foods ltd", "qqq"])
    assert taken(decide.triplet_consensus(one)) == [("a", "x00")]
    like = ladder(spark, [0.95, 0.93, 0.92], s1_name=["acme food"] * 3, cand_name=["acme foods", "acme foods ltd", "qqq"])
    assert taken(decide.triplet_consensus(like)) == [("a", "x00"), ("a", "x01")]


def test_grand_synthesis_starts_its_cliff_at_the_best_and_gives_a_candidate_once(spark):
    schema = "s1 string, cand string, p double, name_sim double, addr_sim double"
    guarded = [("a", "x1", 0.90, 10.0, 90.0), ("a", "x2", 0.825, 90.0, 90.0)]
    assert decide.grand_synthesis(spark.createDataFrame(guarded, schema)).isEmpty()
    shared = [("a", "x", 0.90, 90.0, 90.0), ("b", "x", 0.95, 90.0, 90.0), ("a", "y", 0.88, 90.0, 90.0)]
    assert taken(decide.grand_synthesis(spark.createDataFrame(shared, schema))) == [("a", "y"), ("b", "x")]


edges = st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from(["u", "v", "w", "x", "y"]), st.integers(0, 5)), max_size=14, unique_by=lambda e: e[:2])


@settings(max_examples=6, deadline=None)
@given(edges)
def test_greedy_bipartite_is_the_sequential_greedy(spark, rows):
    df = spark.createDataFrame([(a, b, p / 5) for a, b, p in rows], "s1 string, cand string, p double")
    used, count, want = set(), {}, []
    for a, b, p in sorted(rows, key=lambda e: (-e[2], e[0], e[1])):
        if b not in used and count.get(a, 0) < 2:
            used.add(b)
            count[a] = count.get(a, 0) + 1
            want.append((a, b))
    assert taken(assign.greedy_bipartite(df, cap=2)) == sorted(want)


def test_rank_disjoint(spark):
    df = spark.createDataFrame([("a", "x", 2), ("b", "x", 1), ("c", "x", 1), ("a", "y", 1)], "s1 string, cand string, rank int")
    assert taken(assign.rank_disjoint(df)) == [("a", "y"), ("b", "x")]


def test_metrics(spark):
    ents = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1 string")
    truth = spark.createDataFrame([("a", "x"), ("a", "z"), ("b", "y")], "s1 string, cand string")
    pred = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("c", "x")], "s1 string, cand string")
    got = {r.s1: round(r.f05, 4) for r in evaluate.entity_scores(ents, truth, pred).collect()}
    assert got == {"a": 0.7143, "b": 0.0, "c": 0.0, "d": 1.0}
    assert evaluate.micro(evaluate.entity_scores(ents, truth, pred)).first().tp == 2
    w = spark.range(1).select(evaluate.wilson(F.lit(0.5), F.lit(0)).alias("w")).first().w
    assert (w.low, w.high) == (0.0, 0.0)


def test_scores_without_pairs_of_truth(spark):
    """A group of 3,000 copies: two million true pairs, none of which is made."""
    copies = spark.range(3000).selectExpr("concat('S', 1 + id % 3, '-', id) AS entity_id", "'x' AS sig")
    s1, cands = relations.sides(copies)
    few = lambda df, c: df.filter("substring_index(entity_id, '-', -1) < 9").select(F.col("entity_id").alias(c), "sig")
    pred = few(s1, "s1").join(few(cands, "cand"), "sig").select("s1", "cand", F.lit(1).alias("same")).unionByName(spark.sql("SELECT 'S1-0' AS s1, 'S2-none' AS cand, 0 AS same"))
    n = cands.groupBy("sig").agg(F.count(F.lit(1)).alias("n_true"))
    counts = s1.join(n, "sig").select(F.col("entity_id").alias("s1"), "n_true")
    ents = s1.select(F.col("entity_id").alias("s1")).unionByName(spark.sql("SELECT 'S1-alone' AS s1"))
    got = evaluate.judged_scores(ents, counts, pred)
    whole = s1.select(F.col("entity_id").alias("s1"), "sig").join(cands.select(F.col("entity_id").alias("cand"), "sig"), "sig").select("s1", "cand")
    want = evaluate.entity_scores(ents, whole, pred)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["entity_f05", "macro_f05", "micro_f05", "tier_metrics", "noise_simulation", "oracle_bound", "model_persistence"])
def test_queries_make_no_pairs_of_truth(spark, monkeypatch, name):
    def fail(*_):
        raise AssertionError("truth grows with the square of a group of copies")

    monkeypatch.setattr(relations, "truth", fail)
    registry.QUERIES[name](spark, SF)


def test_guards(spark):
    recs = [("S1-1", "Acme Foods", "12 Main Street"), ("S2-1", "Acme Foods", "14 Main Street"), ("S2-2", "N/A", "far away"), ("S2-3", "Zeta", "12 Main Street"), ("S2-4", "Acme Foods Ltd", "12 Main St")]
    records = spark.createDataFrame(recs, "entity_id string, business_name string, business_address string")
    pairs = spark.createDataFrame([("S1-1", c, "US") for c in ("S2-1", "S2-2", "S2-3", "S2-4", "S2-none")], "s1 string, cand string, country string")
    got = {r.cand: r.reason for r in guards.apply(pairs, records).collect()}
    assert got == {"S2-1": "STREET_NUMBER_MISMATCH", "S2-2": "PLACEHOLDER_LOW_ADDR_SIM", "S2-3": "ACCEPT", "S2-4": "ACCEPT", "S2-none": "ACCEPT"}
    rows = spark.createDataFrame([("S1-1", "S2-3", "France")], "s1 string, cand string, country string")
    assert guards.apply(rows, records).first().reason == "FRANCE_GUARD_D"


MALFORMED = [("", ""), ("   ", "  "), (None, None), ("!!!", "???"), ("word " * 500, "street " * 500), ("Acme", None), ("123", "456"), ("🙂", "🙃 street")]


def test_features_are_finite_for_malformed_rows(spark):
    recs = [("S1-0", "Acme Foods SAS", "12 Main Street, Springfield, 62704", "US")] + [(f"S2-{i}", n, a, "US") for i, (n, a) in enumerate(MALFORMED)]
    norm = N.normalize(spark.createDataFrame(recs, "entity_id string, business_name string, business_address string, country string"))
    pairs = spark.createDataFrame([("S1-0", f"S2-{i}") for i in range(len(MALFORMED))], "s1 string, cand string")
    out = features.pair_features(pairs, norm, norm).collect()
    assert len(out) == len(MALFORMED) and len(features.COLUMNS) == 49
    assert all(r[c] is not None and abs(r[c]) < 1e9 for r in out for c in features.COLUMNS)


def test_blocking_counts_bags_and_caps(spark):
    recs = [("S1-1", "acme acme foods", "", "US"), ("S2-1", "acme acme foods", "", "US"), ("S2-2", "acme foods", "", "FR"), ("S3-3", "acmeology", "", "US")]
    norm = N.normalize(spark.createDataFrame(recs, "entity_id string, business_name string, business_address string, country string"))
    s1, cands = norm.filter("entity_id like 'S1%'"), norm.filter("entity_id not like 'S1%'")
    votes = {(r.s1, r.cand): r.votes for r in blocking.votes(s1, cands, blocking.BlockingConfig(channels=("sigtoken", "prefix4"))).collect()}
    assert votes == {("S1-1", "S2-1"): 5 * 4 + 5 + 2 * 4 + 2, ("S1-1", "S3-3"): 2 * 2}
    capped = blocking.BlockingConfig(channels=("prefix4",), caps={"prefix4": 1})
    assert {(r.s1, r.cand) for r in blocking.votes(s1, cands, capped).collect()} == {("S1-1", "S2-1")}
    assert blocking.candidates(s1, cands).filter("cand = 'S2-2'").isEmpty()


def test_validator(spark):
    lists = spark.createDataFrame([("S1-1", ["S2-1", "S2-1"]), ("S1-2", ["S1-2", "S9-1"]), ("S1-2", []), ("S1-9", [])], "s1 string, ids array<string>")
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "s1 string")
    known = spark.createDataFrame([("S2-1",)], "cand string")
    got = {r.rule: (r["count"], r.examples) for r in validate.findings(lists, s1, known, known.select(F.lit("S1-7").alias("s1"), "cand")).collect()}
    assert got == {"duplicate_s1": (1, "S1-2"), "duplicate_id": (1, "S1-1"), "self_match": (1, "S1-2"), "bad_prefix": (2, "S1-2,S9-1"), "unknown_id": (2, "S1-2,S9-1"), "missing_s1": (1, "S1-3"), "extra_s1": (1, "S1-9"), "outside_candidates": (4, "S1-1,S1-2")}


def test_file_rules(spark, tmp_path):
    header = ("source1_entity_id", "matched_entity_ids")
    bad = spark.createDataFrame([(0, "wrong,header"), (1, "S1-1\tS2-1"), (2, "no tab")], "row_pos long, value string")
    got = {r.rule: r["count"] for r in validate.file_findings(bad, header).collect()}
    assert got == {"empty_file": 0, "wrong_header": 1, "malformed_row": 1}
    assert {r.rule: r["count"] for r in validate.file_findings(bad.limit(0), header).collect()}["empty_file"] == 1


def test_sampling_does_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = sampling.simple(df.repartition(7), "k", 20).collect()
    assert sorted(a) == sorted(sampling.simple(df.repartition(2), "k", 20).collect())
    split = sampling.split(df, "k")
    assert 120 < split.filter("held").count() < 280
    assert sampling.overlap(split.filter("held"), split.filter("not held"), "k") == 0


def test_models(spark):
    rows = [(f"s{i}", f"c{i}", float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "s1 string, cand string, x1 double, x2 double, label int")
    out = ml.out_of_fold(df, ["x1", "x2"], folds=2)
    good = out.filter((F.col("p") >= 0.5).cast("int") == F.col("label")).count()
    assert out.count() == 120 and good > 110
    model = ml.fit(df, ["x1", "x2"], "forest")
    assert ml.importances(model, ["x1", "x2"])[0][0] == "x1"


@pytest.mark.parametrize("family", sorted(ml.FAMILIES))
def test_every_family_is_fitted_and_saved(spark, tmp_path, family):
    rows = [(f"s{i}", f"c{i}", float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "s1 string, cand string, x1 double, x2 double, label int")
    model = ml.fit(df, ["x1", "x2"], family)
    ml.save(model, str(tmp_path / "m"))
    p = [ml.probabilities(m, df).orderBy("s1").select("p").collect() for m in (model, ml.load(str(tmp_path / "m")))]
    assert p[0] == p[1] and all(0 <= r.p <= 1 for r in p[0])


def test_importance_finds_the_feature_that_counts(spark):
    rows = [(f"s{i}", f"c{i}", float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "s1 string, cand string, x1 double, x2 double, label int")
    model = ml.fit(df, ["x1", "x2"])
    assert ml.permutation_importance(model, df, ["x1", "x2"], 1)[0][0] == "x1"
    assert ml.top_features(model, ["x1", "x2"], 1, 0.999)[0] == ["x1"]
    wide = df.withColumns({"w": F.lit(1.0)})
    assert ml.stacked(wide.drop("w"), ["x1", "x2"], ["logistic", "bayes"], 2).count() == 200


def test_exact_samples(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 10 > 3).cast("string").alias("g"))
    split = sampling.stratified_split(df, F.col("g"), "k")
    assert {(r.g, r["count"]) for r in split.filter("held").groupBy("g").count().collect()} == {("true", 120), ("false", 80)}
    least = {r.k for r in sampling.least_draws(df, F.col("g"), "k", F.lit(7)).collect()}
    ranked = df.withColumn("u", sampling.draw(F.col("k"), 42)).orderBy("u", "k").collect()
    want = {r.k for g in ("true", "false") for r in [x for x in ranked if x.g == g][:7]}
    assert least == want


def test_spearman_of_many_ranges(spark):
    rows = [(i * 37 % 101, (i * 13 % 17) // 2) for i in range(400)]
    got = evaluate.spearman(spark.createDataFrame(rows, "a int, b int"), "a", "b").first().rho
    want = pd.DataFrame(rows).rank().corr().iloc[0, 1]
    assert abs(got - want) < 1e-6


def test_training_pairs(spark):
    c = spark.createDataFrame([("a", "x"), ("a", "y")], "s1 string, cand string")
    t = spark.createDataFrame([("a", "x"), ("a", "z")], "s1 string, cand string")
    got = sorted((r.cand, r.label, r.injected) for r in ml.training_pairs(c, t).collect())
    assert got == [("x", 1, False), ("y", 0, False), ("z", 1, True)]


def test_preselection_of_equal_records(spark):
    names = ["acme foods", "acme foods", "acme mills", "foods acme acme", "zeta foods", "zeta"]
    recs = [(f"S{1 if i % 3 == 0 else 2}-{i:03}", names[i * 7 % 11 % 6], "", "US" if i % 5 else "FR") for i in range(120)]
    norm = N.normalize(spark.createDataFrame(recs, "entity_id string, business_name string, business_address string, country string"))
    s1, cands = norm.filter("entity_id like 'S1%'"), norm.filter("entity_id not like 'S1%'")
    config = blocking.BlockingConfig(channels=("tok2", "sigtoken", "acronym"))
    for most in (1, 7, 1000):
        want = taken(blocking.top_k(blocking.votes(s1, cands, config), most, "votes"))
        assert taken(blocking.preselected(s1, cands, most, config)) == want and want


def test_preselection_by_short_and_long_lists(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(9)]
    recs = [(f"S{1 if i % 3 == 0 else 2}-{i:03}", " ".join(rng.choices(words, k=rng.randint(1, 5))), "", "US" if i % 7 else "FR") for i in range(240)]
    norm = N.normalize(spark.createDataFrame(recs, "entity_id string, business_name string, business_address string, country string"))
    s1, cands = norm.filter("entity_id like 'S1%'"), norm.filter("entity_id not like 'S1%'")
    config = blocking.BlockingConfig(channels=("tok2", "sigtoken", "acronym"))
    want = taken(blocking.top_k(blocking.votes(s1, cands, config), 5, "votes"))
    for long, wide in ((0, 8), (0, 1), (1, 2)):
        assert taken(blocking.preselected(s1, cands, 5, config, long, wide)) == want and want


def test_met_bags_grow_with_the_records(spark):
    made = lambda n: spark.range(n).selectExpr("lpad(id, 6, '0') AS id", "transform(array('same', concat('own', id)), k -> struct('US' AS country, 'tok2' AS space, k AS key, 1L AS n)) AS bag")
    assert blocking.met_bags(made(900), made(900), 3).count() <= 900 * (1 + 3)


def test_pairs_are_dealt_out_once(spark):
    recs = [(f"S{1 + i % 2}-{i}", f"acme{i // 2} foods", "", "US") for i in range(40)]
    norm = N.normalize(spark.createDataFrame(recs, "entity_id string, business_name string, business_address string, country string"))
    s1, cands = norm.filter("entity_id like 'S1%'"), norm.filter("entity_id not like 'S1%'")
    found = blocking.preselected(s1, cands, 3, blocking.BlockingConfig(channels=("tok2", "sigtoken")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" in plan and not re.search(r"hashpartitioning\(a#\d+, b#\d+", plan)


def test_long_keys_are_carried_as_numbers(spark):
    bags = spark.range(60).selectExpr("lpad(id, 6, '0') AS id", "array(struct('US' AS country, 'tok2' AS space, 'same' AS key, 1L AS n)) AS bag")
    long = spark.sql("SELECT 'US' AS country, 'tok2' AS space, 'same' AS key, 7L AS i")
    parted = blocking._parted(bags, long)
    assert parted.schema["long"].dataType.elementType.names == ["i", "n"]
    assert {(len(r.short), r.long[0].i) for r in parted.collect()} == {(0, 7)}


def test_kept_tables_release_their_shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x.strip() for x in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before, seen = files(), []

    def make():
        df = spark.range(5000).repartition(4, "id")
        df.count()
        seen.extend(files() - before)
        return df

    assert relations._kept(spark, "nowhere", f"kept{time.monotonic_ns()}", make).count() == 5000
    until = time.monotonic() + 10
    while (left := files() & set(seen)) and time.monotonic() < until:
        time.sleep(0.2)
    assert seen and not left


def test_pairs_are_chosen_and_compared_in_parts(spark, monkeypatch):
    assign.checkpoints(spark)
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"), "relations")
    old, seen = set(folder.glob("*")), {"pairs": [0], "compared": [0]}

    def release(_):
        for name, counts in seen.items():
            counts.append(sum(len(pd.read_parquet(f, columns=["s1"])) for d in set(folder.glob(f"*-{name}")) - old for f in d.glob("*.parquet")))

    monkeypatch.setattr(assign, "release", release)
    monkeypatch.setattr(blocking, "release", release)
    total = relations.compared(spark, f"{SF}/.").count()
    for counts in seen.values():
        assert counts[-1] == total and 0 < max(b - a for a, b in zip(counts, counts[1:])) < 0.6 * total


def test_records_meet_pairs_in_parts_and_without_the_wide_table(spark, monkeypatch):
    assign.checkpoints(spark)
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"), "relations")
    old, seen, d = set(folder.glob("*")), {name: [0] for name in ["judged", "named", "reasons", "faced"]}, f"{SF}/./."

    def release(_):
        for name, counts in seen.items():
            counts.append(sum(len(pd.read_parquet(f, columns=["s1"])) for x in set(folder.glob(f"*-{name}")) - old for f in x.glob("*.parquet")))

    monkeypatch.setattr(assign, "release", release)
    for name in ["collision_counts", "final_checklist", "cluster_disambiguation", "guard_reason_counts", "guard_street"]:
        registry.QUERIES[name](spark, d).collect()
    assert not any(key[1:] == (d, "compared") for key in relations._MADE)
    total = relations.pairs(spark, d).count()
    for counts in seen.values():
        assert counts[-1] == total and 0 < max(b - a for a, b in zip(counts, counts[1:])) < 0.6 * total


def test_a_release_waits_for_tables_that_python_has_dropped(spark):
    queue = spark.sparkContext._gateway._gateway_client.finalizer_deque
    for _ in range(3):
        made = [spark.range(i) for i in range(20)]
        del made
        assign.release(spark)
        assert not queue


def test_reranked_candidates_of_a_large_group(spark, tmp_path):
    docs = [(i, "alpha beta gamma delta epsilon zeta eta theta", "en", 45) for i in range(360)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = pair_queries.candidates_reranked(spark, str(tmp_path)).groupBy("s1").count().collect()
    unnamed = {f"S1-{i}" for i in range(7, 360, 64)}  # the placeholder of a name meets other placeholders alone
    assert len(got) == 120 and {r["count"] for r in got if r["s1"] not in unnamed} == {12}
