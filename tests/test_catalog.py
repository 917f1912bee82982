"""Operators on small literal tables."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from vitrine.functions import dates, text
from vitrine.operators import cleaning, extraction, items, rarity, search, statistics, suggestion, upsert
from vitrine.streaming import ingest


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def points(spark):
    data = [(1, [1.0, 0.0, 0.0], 2), (2, [0.9, 0.1, 0.0], 2), (3, [0.0, 1.0, 0.0], 1)]
    return spark.createDataFrame(data, "id long, vector array<float>, version int")


def test_similar_leaves_the_source_out_and_keeps_its_version(points):
    assert [r["id"] for r in search.similar(points, 1).collect()] == [2]
    assert search.similar(points, 1, version=1).count() == 0
    assert search.similar(points, 1, min_score=1.0).count() == 0
    assert search.similar(points, 999).count() == 0


def test_boost_reorders(spark):
    data = [(1, 0.90, "poster", "a classic rock show"), (2, 0.85, "classic rock", "words")]
    found = search.boosted(spark.createDataFrame(data, "id long, score double, tags string, blob string"), "classic rock")
    assert [(r["id"], round(r["boosted"], 2)) for r in found.orderBy(F.desc("boosted")).collect()] == [(2, 0.95), (1, 0.93)]


def test_fusion_ignores_partitions(spark):
    a = spark.createDataFrame([(i, 1.0 / (i + 1)) for i in range(40)], "id long, score double")
    b = spark.createDataFrame([(i, float(i % 7)) for i in range(60)], "id long, score double")
    assert rows(search.fused(a.repartition(1), b.repartition(8))) == rows(search.fused(a.repartition(8), b.repartition(1)))


def test_pairs_are_a_greedy_matching(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=4).tolist() for i in range(21)}
    df = spark.createDataFrame(list(vectors.items()), "id long, vector array<double>")
    found = [r for r in search.seed_pairs(df, list(vectors)).collect()]
    pairs = [r for r in found if r["b"] is not None]
    assert len(pairs) == 10 and len(found) == 11
    assert sorted(itertools.chain.from_iterable((r["a"], r["b"]) if r["b"] is not None else (r["a"],) for r in found)) == list(range(21))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items()}
    edges = sorted(((float(unit[a] @ unit[b]), a, b) for a, b in itertools.combinations(vectors, 2)), reverse=True)
    used, want = set(), set()
    for s, a, b in edges:
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert {(r["a"], r["b"]) for r in pairs} == want


def motif_table(spark, lists):
    ids = spark.createDataFrame([(i,) for i in lists], "item_id long")
    motifs = spark.createDataFrame([(i, m) for i, ms in lists.items() for m in ms], "item_id long, motif string")
    return ids, motifs


def test_motif_frequency_counts_items_once(spark):
    _, motifs = motif_table(spark, {1: ["Eyes", "Eyes", "Fish"], 2: ["Eyes", "Brancusi"], 3: ["Eyes"]})
    assert dict(rows(rarity.motif_frequency(motifs))) == {"Eyes": 3, "Fish": 1, "Brancusi": 1}


def test_rarity_bounds_and_empty(spark):
    ids, motifs = motif_table(spark, {1: ["Eyes"], 2: ["Eyes", "Skull"], 3: [], **{i: ["Eyes"] for i in range(4, 200)}})
    found = {r["item_id"]: r for r in rarity.motif_rarity(ids, motifs).collect()}
    assert found[3]["score"] == 0 and found[3]["class"] == 1
    assert all(0 <= r["score"] <= 100 for r in found.values())
    assert found[2]["score"] > found[1]["score"]
    none, empty = motif_table(spark, {})
    assert rarity.motif_rarity(none, empty).count() == 0


def test_score_class_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 20.0, 20.1, 40.0, 40.1, 60.0, 60.1, 80.0, 80.1, 100.0)], "s double")
    assert [r[0] for r in df.select(rarity.score_class(F.col("s"))).collect()] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_ocr_lines_and_cap(spark):
    bad = "Good line here\n" + "=" * 40 + "\n" + "ababababab" * 9 + "\nAnother fine line"
    df = spark.createDataFrame([(bad,), ("The quick brown fox jumps over a lazy dog. " * 120,), ("",)], "t string")
    got = [r[0] for r in df.select(text.sanitize_ocr(F.col("t"), 100)).collect()]
    assert got[0] == "Good line here\nAnother fine line" and len(got[1]) == 100 and got[2] == ""


def test_years(spark):
    df = spark.createDataFrame([("2005",), ("c. 2005",), ("C 1999",), ("undated",), ("∅",), ("2000–2005",), (None,)], "d string")
    got = [r[0] for r in df.select(dates.norm_year(F.col("d"))).collect()]
    assert got == [2005, 2005, 1999, None, None, 2000, None]
    assert [r[0] for r in df.select(dates.norm_year(F.col("d"), True)).collect()] == [2005, 2005, 1999, 0, 0, 2000, 0]


def test_text_functions(spark):
    df = spark.createDataFrame([("T. S. Eliot [poet]", "Eyes (box 3)", "```json\n[1, [2]] x\n```", "two words\nline-\nbreak")], "a string, b string, c string, d string")
    r = df.select(
        text.collapse_initials(F.col("a")), text.mention_name(F.col("a")), text.mention_category(F.col("a")), text.box_category(F.col("b")),
        text.outer_list(text.strip_fences(F.col("c"))), text.preprocess(F.col("d")), text.both_units(F.lit(10.0)), text.occurrences(F.col("d"), "words"),
        text.truncate_words(F.col("d"), 12), text.split_values(F.lit('["x","y"]')), text.data_types(F.lit("a, b")), text.canonical_url(F.lit("http://old/x/y"), "new"),
    ).first()
    assert list(r) == ["T.S. Eliot [poet]", "T. S. Eliot", "poet", "eyes", "[1, [2]]", "two words linebreak", "10 in (25.4 cm)", 1, "two words…", ["x", "y"], ["a", "b"], "https://new/x/y"]


def test_upsert_is_idempotent_and_latest_wins(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2), (3, "e", 3)], "k int, v string, t int")
    fresh = upsert.latest(new, ["k"], [F.col("t")])
    once = upsert.upsert(old, fresh, ["k"])
    assert rows(once) == [(1, "a", 1), (2, "c", 2), (3, "e", 3)] == rows(upsert.upsert(once, fresh, ["k"]))


def test_pull_new_into_an_empty_table(spark):
    source = spark.range(5).select("id")
    assert upsert.pull_new(source, source.where("false"), "id").count() == 5


def test_all_of_counts_a_repeated_wish_once(spark):
    value = spark.createDataFrame([(1, 3, "Eyes"), (1, 3, "Fish"), (2, 3, "Eyes")], "resource_id long, property_id int, value string")
    assert rows(items.all_of(value, 3, ["Eyes", "Fish", "Eyes"])) == [(1,)]


def test_thresholds_keep_the_lowest_qualifying_score(spark):
    scored = spark.createDataFrame([("a", 1.0 - i / 100, int(i not in (2, 9, 10, 11))) for i in range(12)], "label string, score double, hit int")
    found = suggestion.thresholds(scored, {"high": 0.85, "never": 1.1}).first()
    assert found["high"] == pytest.approx(0.92) and found["never"] is None


def test_reference_validation_of_broken_answers(spark):
    df = spark.createDataFrame([(1, None), (2, "[]"), (3, "[{]"), (4, "none")], "item_id long, answer string")
    assert cleaning.validated_references(df, ["x"]).count() == 0


def test_fuzzy_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("ABC") for _ in range(rng.randint(7, 9))) for _ in range(60)]
    words = sorted({"".join(rng.choice("ABC") for _ in range(rng.randint(6, 9))) for _ in range(300)})
    dictionary = extraction.build_dictionary(spark.createDataFrame([(n, "t") for n in set(names)], "canonical string, type string"), [])
    found = extraction.fuzzy_matches(spark.createDataFrame([(1, w, 1) for w in words], "item_id int, word string, reps int"), dictionary, [])

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))

    want = {w: min(n for n in names if near(w, n)) for w in words if len(w) >= 7 and any(near(w, n) for n in names)}
    assert {r["form"]: r["canonical"] for r in found.collect()} == want


def test_tiers_have_priority(spark):
    one = "item_id int, canonical string, type string, form string, reps long, tier int"
    a = spark.createDataFrame([(1, "X", "t", "X Y", 2, 1)], one)
    b = spark.createDataFrame([(1, "X", "t", "X", 5, 2), (2, "X", "t", "X", 1, 2)], one)
    assert rows(extraction.by_priority([b, a])) == [(1, "X", "t", "X Y", 2, 1), (2, "X", "t", "X", 1, 2)]


def test_suggestions_are_new_and_in_band_order(spark):
    rng = np.random.default_rng(3)
    centre = {"a": rng.normal(size=8), "b": rng.normal(size=8)}
    data = [(i, (centre["ab"[i % 2]] + rng.normal(size=8) * 0.2).tolist()) for i in range(60)]
    vectors = spark.createDataFrame(data, "id long, v array<double>")
    labels = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "id long, label string")
    found = suggestion.pre_tag(vectors, labels, k=5).collect()
    assert {(r["id"], r["label"]) for r in found if r["band"] == "high"} >= {(i, "ab"[i % 2]) for i in range(40, 60)}
    assert not {(r["id"], r["label"]) for r in found} & {(i, "ab"[i % 2]) for i in range(40)}


def test_stream_replay_leaves_one_row_per_key(spark, tmp_path):
    schema = "k long, t long, v string"
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema).write.parquet(f"{folder}/in/1")
    state = ingest.VersionedTable(spark, f"{folder}/state", spark.read.parquet(f"{folder}/in/1").schema)

    def take():
        stream = ingest.read_stream(spark, f"{folder}/in/*", state.schema, 1)
        ingest.ingest(stream, state, ["k"], "t", f"{folder}/checkpoint").awaitTermination()
        return rows(state.read())

    assert take() == [(1, 1, "a"), (2, 1, "b")]
    spark.createDataFrame([(1, 1, "again"), (2, 2, "c"), (2, 2, "c"), (3, 1, "d")], schema).write.parquet(f"{folder}/in/2")
    assert take() == [(1, 1, "a"), (2, 2, "c"), (3, 1, "d")] == take()


def test_batches_are_gapless_over_partitions(spark):
    df = spark.range(1700).select((F.col("id") * 3).alias("id")).repartition(7)
    sizes = statistics.batches(df, "id").groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in sizes] == [500, 500, 500, 200]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    r = df.select(search.norm(F.col("a")), search.unit(F.col("z")), search.cosine(F.col("a"), F.col("z")), search.cosine(F.col("a"), F.col("a"))).first()
    assert r[0] == 5 and r[1] == [0, 0] and r[2] == 0 and math.isclose(r[3], 1)
