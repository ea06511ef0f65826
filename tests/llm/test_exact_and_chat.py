import hashlib
import re

from pyspark.sql import functions as F

from linkloom.llm import chat_format, exact_dedup

DOCS = "doc_id long, text string, lang string"


def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    out = []
    for body, members in groups.items():
        best = min(members, key=lambda m: m[:3])
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(m[3], best[3], len(members), m == best, sha) for m in members]
    return sorted(out, key=str)


def test_groups_against_brute_force(spark):
    rows = [(1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, " "), (7, "é x"), (8, "éx"), (None, "ab"), (9, "x" * 50_000), (10, "x " * 50_000)]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS)
    got = sorted((tuple(r) for r in exact_dedup.duplicate_groups(df.repartition(3)).collect()), key=str)
    assert got == brute_groups(rows)
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in got if r[3])


def test_large_ids_and_ties(spark):
    top = 2**63 - 1
    df = spark.createDataFrame([(top, "a"), (-top - 1, "a"), (0, "a ")], "doc_id long, text string")
    assert {r.keep_id for r in exact_dedup.duplicate_groups(df).collect()} == {0}
    df = spark.createDataFrame([(top, "a"), (-top - 1, "a")], "doc_id long, text string")
    assert {r.keep_id for r in exact_dedup.duplicate_groups(df).collect()} == {-top - 1}


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a", "x")] * 3 + [(2, "a", "x")], DOCS)
    assert exact_dedup.drop_duplicates(df).count() == 1
    assert [r.kept for r in exact_dedup.duplicate_groups(df).orderBy("doc_id").collect()] == [True] * 3 + [False]
    assert exact_dedup.duplicate_groups(df.limit(0)).count() == 0 and exact_dedup.drop_duplicates(df.limit(0)).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, "q"), (2, "a", 6, "q")], "doc_id long, text string, group_size int, kept string")
    assert exact_dedup.duplicate_groups(df).count() == 2
    assert exact_dedup.drop_duplicates(df).columns == df.columns


def test_working_names_as_columns(spark):
    names = ["row", "row_id", "row_sha", "row_n", "row_text", "stay_id", "stay_sha", "salt", "_n", "_key", "_digest", "_turn", "best"]
    df = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names]) for i, t in ((1, "a b"), (2, "ab"), (2, "ab"), (3, None))], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(tuple(r) for r in kept.select("doc_id", "_n", "_key", "row").collect()) == [(1, "_n1", "_key1", "row1"), (3, "_n3", "_key3", "row3")]


TURNS = [
    (1, 2, "user", "third"), (1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nx & &lt;|"), (1, 1, "user", "again"), (1, 3, "assistant", "<"), (1, 4, "assistant", "|im_sep|>"),
    (2, 0, "assistant", None), (2, 0, "assistant", None), (3, None, None, "no role"), (None, 0, "us\ner", "a<|b"), (4, 0, "assistant", "long " * 20_000),
]


def brute_turns(rows):
    talks = {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in talks.items()}


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    made = chat_format.format_conversations(df)
    back = {r.conv_id: [tuple(t) for t in r.t] for r in made.select("conv_id", chat_format.read_back(F.col("formatted")).alias("t")).collect()}
    want = brute_turns(TURNS)
    assert back == want
    for r in chat_format.digests(made).collect():
        turns = want[r.conv_id]
        learned = "".join(x for role, x in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(learned)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    first = made.filter("conv_id = 1").first()
    assert first.formatted.count("<|im_start|>") == 2 and "".join(s.piece for s in first.segments) == first.formatted


def test_chat_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "z")], "conv_id long, turn long, role string, text string, formatted string")
    assert chat_format.format_conversations(df).count() == 1
    assert chat_format.digests(chat_format.format_conversations(df.limit(0))).count() == 0
