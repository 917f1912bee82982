"""Rules of records, texts and dates, held against literal values."""

import pytest
from pyspark.sql import functions as F
from vitrine.functions import dates, text
from vitrine.operators import cleaning

FULL = (
    "id int, identifier string, work_type string, mediums array<string>, support string, height string, width string, signature string, date string, framing string, owner string, "
    "location string, motifs array<string>, media_count int, box string, transcription string, category string, is_public boolean"
)
GOOD = {
    "id": 1, "identifier": "JS-2005-T1", "work_type": "Drawing", "mediums": ["Ink"], "support": "Paper", "height": "12", "width": " 9.5 ", "signature": "↗", "date": "c. 2005", "framing": "Unframed",
    "owner": "Studio", "location": "Shelf", "motifs": ["Eyes"], "media_count": 1, "box": "Eyes 3", "transcription": "words", "category": "A", "is_public": False,
}

#: What changes in a good record, its issues, and whether it may be published.
CASES = [
    ({}, [], True),
    ({"identifier": " "}, ["identifier:missing"], False),
    ({"work_type": None}, ["work_type:missing"], False),
    ({"mediums": [" ", None]}, ["mediums:missing"], False),
    ({"mediums": ["Ink", " Ink"]}, ["mediums:duplicate values"], True),
    ({"support": ""}, ["support:missing"], False),
    ({"height": None, "width": ""}, ["height:missing", "width:missing"], False),
    ({"height": "1e3", "width": '12"'}, ["height:non-numeric", "width:non-numeric"], False),
    ({"height": "-3", "width": "3."}, ["height:non-numeric", "width:non-numeric"], False),
    ({"signature": None}, ["signature:missing", "signature:dated but unsigned"], False),
    ({"signature": "x"}, ["signature:invalid"], False),
    ({"signature": "∅"}, ["signature:dated but unsigned"], True),
    ({"signature": "∅", "date": "∅"}, [], True),
    ({"date": "∅"}, ["date:signed but undated"], True),
    ({"date": ""}, ["date:missing", "date:signed but undated"], False),
    ({"date": "undated"}, [], True),
    ({"date": "2005:01:02 10:11:12"}, ["date:EXIF timestamp"], False),
    ({"date": "2005-01-02 10:11"}, ["date:ISO timestamp"], False),
    ({"date": "2005-01-02T10:11"}, ["date:ISO timestamp"], False),
    ({"date": "2005-01-02"}, [], True),
    ({"date": "1988"}, ["date:pre-1989"], False),
    ({"date": "about 2025"}, ["date:posthumous"], False),
    ({"framing": "", "owner": ""}, ["framing:missing", "owner:missing"], False),
    ({"location": "", "box": "", "transcription": ""}, ["location:missing", "box:missing", "transcription:missing"], True),
    ({"motifs": []}, ["motifs:missing"], True),
    ({"motifs": ["Eyes", "Eyes"]}, ["motifs:duplicate values"], True),
    ({"media_count": None}, ["media:no image"], False),
    ({"category": None}, ["category:missing"], True),
    ({"category": "E"}, ["category:invalid"], True),
    ({"is_public": True}, [], False),
]


def test_issues_and_readiness(spark):
    data = [tuple((GOOD | change | {"id": i})[c.split()[0]] for c in FULL.split(", ")) for i, (change, _, _) in enumerate(CASES)]
    wide = spark.createDataFrame(data, FULL)
    found = cleaning.validate_items(wide).withColumn("ready", cleaning.publish_ready(wide)).orderBy("id").collect()
    for row, (change, issues, ready) in zip(found, CASES):
        assert [f"{x['field']}:{x['message']}" for x in row["issues"]] == issues, change
        assert all(x["level"] == "error" for x in row["issues"]) and row["ready"] == ready, change
    queue = cleaning.issue_queue(cleaning.validate_items(wide)).collect()
    assert [r["n"] for r in queue] == sorted((len(i) for _, i, _ in CASES if i), reverse=True)


def test_a_table_with_few_columns(spark):
    found = cleaning.validate_items(spark.createDataFrame([(1, "")], "id int, date string")).first()
    assert [tuple(x) for x in found["issues"]] == [("date", "error", "missing")]
    assert cleaning.validate_items(spark.createDataFrame([(1,)], "id int")).first()["issues"] == []


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_cut_at_a_word(spark):
    given = ["aaa bbb ccc", "aaa bbb", "aaabbbccc", "aaa      bbbb", "  aaaaaaaaaaa", "a\nb c defgh", "aaa bbb  c", None]
    assert column(spark, given, lambda c: text.truncate_words(c, 8)) == ["aaa…", "aaa bbb", "aaabbbcc…", "aaa…", "aaaaaa…", "a\nb c…", "aaa…", None]


def test_pretty_dates(spark):
    given = ["2020-03-05", "2020-3-5", "1999", "nope", "2020-02-31", "", None, "2020-03-05T10:00"]
    assert column(spark, given, dates.pretty_date) == ["March 5, 2020", "March 5, 2020", "1999", "nope", "2020-02-31", "", None, "2020-03-05T10:00"]


def test_names(spark):
    given = ["T. S. Eliot", "A. B. C. Dee", "J.D. Salinger", "j. d. salinger", "X.  Y. Zed", "Plain"]
    want = ["T.S. Eliot", "A.B. C. Dee", "J.D. Salinger", "J. D. Salinger!", "X.Y. Zed", "Plain"]
    assert column(spark, given, lambda c: text.canonical_name(c, {"J. D. Salinger": "J. D. Salinger!"})) == want


def test_dimensions(spark):
    given = [("12", "9.5", None), ("12.0", " 3 ", "x"), ("10", None, None), ("tall", "2.25", "ext"), ("tall", None, "12 x 9"), (None, "", ""), ("1234.56", "1e1", None)]
    rows = spark.createDataFrame([(i, *g) for i, g in enumerate(given)], "i int, h string, w string, e string")
    found = [r[0] for r in rows.orderBy("i").select(text.dimensions(F.col("h"), F.col("w"), F.col("e"))).collect()]
    assert found == ["12 × 9.5 in (30.5 × 24.1 cm)", "12 × 3 in (30.5 × 7.6 cm)", "10 in (25.4 cm)", "2.3 in (5.7 cm)", "12 x 9", None, "1234.6 × 10 in (3135.8 × 25.4 cm)"]


def test_ground_truth_takes_first_values_and_counts(spark):
    items = spark.createDataFrame([(1,), (2,)], "item_id int")
    subjects = spark.createDataFrame([(1, "eye"), (1, "Boat"), (1, "junk"), (2, "EYE"), (2, "both"), (2, "idea"), (2, "unknown")], "item_id int, value string")
    actions = spark.createDataFrame([("eye", "canon", ["Eyes"]), ("both", "split", ["Eyes", "Fish"]), ("junk", "drop", None), ("idea", "nonvisual", None), ("Boat", "canon", ["Boats"])], "value string, action string, target array<string>")
    boxes = spark.createDataFrame([(1, "(box 2)", 1), (1, "Boats (box 3)", 2), (1, "Ants 4", 3)], "item_id int, value string, pos int")
    seeds = spark.createDataFrame([("boats", "Boat", "Boats"), ("ants", "eye", "Ants")], "category string, seed string, prior string")
    years = spark.createDataFrame([(1, None, 1), (1, 2005, 2), (1, 1999, 3)], "item_id int, year int, pos int")
    found = {r["item_id"]: tuple(r)[1:] for r in cleaning.ground_truth(items, subjects, actions, boxes, seeds, years, 1).collect()}
    assert found == {1: (["Eyes"], "Boats", 2005, True), 2: (["Eyes", "Fish"], None, None, False)}
    counted = {r["counter"]: r["n"] for r in cleaning.ground_truth_counters(subjects, actions, boxes, seeds).collect()}
    assert counted == {"box_derived_rows": 1, "junk_rows": 1, "nonvisual_rows": 1, "motif:Eyes": 2, "motif:Fish": 1}


@pytest.mark.parametrize("value, want", [("T. S. Eliot", "T.S. Eliot")])
def test_initials(spark, value, want):
    assert column(spark, [value], text.collapse_initials) == [want]
