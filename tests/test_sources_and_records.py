"""Readers, writers and small functions that no registered query calls."""

import json

import pytest
from pyspark.sql import functions as F
from tables import SF
from vitrine.functions import dates, text
from vitrine.operators import cleaning, extraction, pages, rarity, reshape, rounds, search, suggestion
from vitrine.sources import catalog, io


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_catalog_tables_are_read_back(spark, tmp_path):
    made = catalog.sample_catalog(spark, SF)
    for name in catalog.Catalog.__dataclass_fields__:
        getattr(made, name).write.parquet(f"file://{tmp_path}/{name}")
    back = catalog.read_catalog(spark, f"file://{tmp_path}")
    assert back.value.count() == made.value.count() and back.resource.columns == made.resource.columns


def test_json_records_and_result_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "tags": ["x"]}, {"id": 2, "tags": []}], indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"id": 3, "tags": ["y", "z"]}))
    found = io.read_json_records(spark, f"file://{tmp_path}/*.json", "id long, tags array<string>")
    assert rows(found) == [(1, ["x"]), (2, []), (3, ["y", "z"])]
    (tmp_path / "r.jsonl").write_text('{"custom_id": "7", "answer": "a"}\n\n{"custom_id": "x"}\n{broken\n{"custom_id": "-1"}\n{"custom_id": "8", "answer": null}\n')
    assert rows(io.read_result_lines(spark, f"file://{tmp_path}/r.jsonl", "custom_id string, answer string").select("item_id", "answer")) == [(7, "a"), (8, None)]


def test_csv_has_its_columns_in_order_and_doubled_quotes(spark, tmp_path):
    io.write_csv(spark.createDataFrame([(1, 'say "yes", now')], "a int, b string").coalesce(1), f"file://{tmp_path}/out", ["b", "a"])
    lines = [line for f in sorted((tmp_path / "out").glob("*.csv")) for line in f.read_text().splitlines()]
    assert lines == ["b,a", '"say ""yes"", now",1']


def test_suggestions_are_written_by_item(spark, tmp_path):
    found = spark.createDataFrame([(1, "b", 0.5, "medium", 2), (1, "a", 0.9, "high", 1), (2, "a", 0.7, "high", 1)], "id long, label string, score double, band string, rank int")
    io.write_suggestions(found.coalesce(1), f"file://{tmp_path}/out")
    got = {r["item_id"]: [s["label"] for s in r["suggestions"]] for f in (tmp_path / "out").glob("*.json") for r in map(json.loads, f.read_text().splitlines())}
    assert got == {1: ["a", "b"], 2: ["a"]}
    more = found.withColumn("confidence", F.lit(0.123456)).withColumn("method", F.lit("knn")).withColumn("s_knn", F.col("score"))
    items = spark.createDataFrame([(1, "t1"), (3, "t3")], "item_id long, thumb string")
    shown = {r["item_id"]: (r["thumb"], [tuple(s) for s in r["suggestions"]]) for r in io.suggestion_records(more, items).collect()}
    assert shown == {1: ("t1", [("a", 0.9, "high", 0.1235, "knn", 0.9), ("b", 0.5, "medium", 0.1235, "knn", 0.5)]), 3: ("t3", [])}


def test_loaded_vectors_have_length_one(spark):
    df = spark.createDataFrame([(1, "a", [3.0, 4.0]), (2, "b", None), (3, "c", [])], "id long, title string, vector array<double>")
    assert rows(search.load_vectors(df, "vector", ["id", "title"])) == [(1, "a", [0.6, 0.8])]


def test_search_blob_takes_the_first_text_of_each_kind(spark):
    df = spark.createDataFrame([("", "long", "tag", "fine\nxxxxxxxxx", "b"), ("", "", "", "", "fallback"), (None, None, None, None, None)], "a string, b string, c string, d string, text_blob string")
    blob = reshape.search_blob({"description": ["a", "b"], "tags": ["c"], "ocr": ["d"]})
    assert [r[0] for r in df.select(blob).collect()] == ["long\ntag\nfine", "fallback", ""]


def test_dates_out_of_free_text(spark):
    df = spark.createDataFrame([(["c. 1999", "2004-05-06", "2001"], "2010-01-01 00:00:00"), (["undated"], "2011-01-01 00:00:00"), ([], None)], "d array<string>, c string")
    found = df.select(dates.first_year4(F.col("d"), F.col("c").cast("timestamp"))).collect()
    assert [r[0] for r in found] == [2004, 2011, 0]
    one = spark.createDataFrame([("made 1789, shown 1850 and 1999",), ("x2005y 2006",), ("none",)], "t string")
    assert rows(one.select(dates.parse_year(F.col("t")), dates.year_word(F.col("t")))) == sorted([(1850, 1999), (2005, 2006), (None, None)], key=str)
    times = spark.createDataFrame([("2020-01-01 00:00:10", None), ("bad", "1970-01-01 00:00:07"), (None, "bad")], "m string, c string")
    assert [r[0] for r in times.select(dates.modified_epoch(F.col("m"), F.col("c"))).collect()] == [1577836810, 7, 0]


def test_lines_are_garbage_without_their_white_space(spark):
    df = spark.createDataFrame([("a a a a a a a\nfine words\r\n  x y  \n\n-_-_-_-_-_-_-_-_-_-_-_-_-_-_-_-_",), (None,), ("ab " * 30,)], "t string")
    assert [r[0] for r in df.select(text.sanitize_ocr(F.col("t"))).collect()] == ["fine words\nx y", "", ""]
    assert df.limit(1).select(text.sanitize_ocr(F.lit("one two three"), 8)).first()[0] == "one two"


def test_query_parts(spark):
    assert text.query_phrases('Café  self-Portrait "!!" café') == [["cafe"], ["self", "portrait"]]
    docs = spark.createDataFrame([(1, "A self-portrait in a CAFÉ"), (2, "a portrait of the self, cafe"), (3, "self portrait"), (4, None)], "id long, text string")
    assert [r["id"] for r in search.lexical_search(docs, "self-portrait").orderBy("id").collect()] == [1, 3]
    assert [r["id"] for r in search.lexical_search(docs, "café").orderBy("id").collect()] == [1, 2]
    assert search.lexical_search(docs, "cafe self").count() == 2 and search.lexical_search(docs, " !! ").count() == 0


def test_pairs_of_too_few_items(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    assert rows(search.seed_pairs(df, [1])) == [(1, None, None)] and search.seed_pairs(df, [9]).count() == 0
    picks = spark.createDataFrame([(1, 2, "a"), (3, 4, "both"), (5, None, "none")], "a long, b long, pick string")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 6)], "id long, vector array<double>")
    found = rounds.next_round(picks, vectors).collect()
    assert sorted(x for r in found for x in (r["a"], r["b"])) == [1, 3, 4, 5]
    assert rounds.next_round(picks.where("a = 1"), vectors).count() == 0


def test_votes_come_from_the_nearest_labelled_items_only(spark):
    data = [(i, [1.0, i / 1000]) for i in range(300)]
    vectors = spark.createDataFrame(data, "id long, v array<double>")
    labels = spark.createDataFrame([(0, "low"), (1, "low"), (298, "high"), (299, "high")], "id long, label string")
    found = {(r["id"], r["label"]): r["score"] for r in suggestion.neighbour_votes(vectors, labels, 2).collect()}
    assert len({i for i, _ in found}) == 300 and found[20, "low"] == pytest.approx(1) and found[280, "high"] == pytest.approx(1)
    assert (0, "low") in found and found[0, "low"] == pytest.approx(0.5, abs=0.05)  # itself left out


def test_submissions_tags_and_pages(spark):
    files = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id long, files array<string>")
    assert rows(cleaning.split_submissions(files)) == [(1, 0, "a"), (1, 1, "b")]
    assert rows(cleaning.split_submissions(files, False)) == [(1, 0, "a"), (2, 0, None), (3, 0, None)]
    matches = spark.createDataFrame([(1, "X"), (1, "X"), (2, "Y")], "item_id long, canonical string")
    assert rows(extraction.tag_rows(matches, spark.createDataFrame([(2,)], "item_id long"))) == [(1, "X")]
    assert pages.page_numbers(41, 20, 20) == {"page": 2, "total_pages": 3, "has_previous": True, "has_next": True}
    assert pages.page_numbers(0, 0, -5) == {"page": 1, "total_pages": 1, "has_previous": False, "has_next": False}


def test_samples_and_lookups(spark):
    tags = spark.createDataFrame([(i, t) for i in range(40) for t in range(i % 5)], "id long, tag long")
    found = pages.well_tagged_sample(tags, 3)
    assert found.count() == 10 and found.where("n < 3").count() == 0 and rows(found) == rows(pages.well_tagged_sample(tags, 3))
    scores = spark.createDataFrame([(1, 2), (2, None)], "item_id long, class int")
    assert rows(rarity.rarity_of(scores, [1, 2, 3])) == [(1, 2)]
    with pytest.raises(ValueError):
        rarity.rarity_of(scores, list(range(101)))
    places = spark.createDataFrame([("NEW YORK", "New York", None, 1, False), ("YORK", "York", "city", 2, False)], "trigger string, canonical string, type string, tier int, fuzzy boolean")
    texts = spark.createDataFrame([(1, "to New York"), (2, "york"), (3, "renew yorkshire")], "item_id long, text string")
    rules = spark.createDataFrame([], "word string, canonical string, type string, context array<string>")
    got = [(r["item_id"], r["canonical"], r["type"], r["tier"]) for r in extraction.scan_places(texts, places, rules, []).collect()]
    assert sorted(got) == [(1, "New York", "region", 1), (1, "York", "city", 2), (2, "York", "city", 2), (3, "New York", "region", 1)]
