"""Tables in a database, streams of new media, and profiles of words."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from vitrine.functions.text import STOPWORDS
from vitrine.operators import rarity, upsert
from vitrine.sources import catalog
from vitrine.streaming import ingest

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    """A Derby database with the catalog's tables."""
    url = f"jdbc:derby:{tmp_path_factory.mktemp('db')}/catalog;create=true"
    value = spark.createDataFrame([(i % 50, 3 + i % 3, f"v{i % 7}") for i in range(400)], "resource_id long, property_id int, value string")
    value.write.jdbc(url, "value_rows", properties={"driver": DRIVER})
    spark.createDataFrame([(i, f"t{i}", 2) for i in range(90)], "id long, title string, template_id int").write.jdbc(url, "resource", properties={"driver": DRIVER})
    spark.createDataFrame([], "id long, title string").write.jdbc(url, "empty", properties={"driver": DRIVER})
    return url, value


def test_a_table_is_read_in_ranges_with_pushed_filters(spark, database):
    url, value = database
    read = catalog.read_table(spark, url, "value_rows", "resource_id", 4, DRIVER)
    assert read.rdd.getNumPartitions() == 4 and rows(read) == rows(value)
    some = read.where((F.col("property_id") == 3) & (F.col("resource_id") > 20)).select("value")
    plan = some._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "property_id" in pushed.lower() and "resource_id" in pushed.lower()
    assert rows(some) == rows(value.where("property_id = 3 and resource_id > 20").select("value"))
    assert catalog.read_table(spark, url, "empty", "id", 4, DRIVER).count() == 0


def test_new_rows_are_pulled_from_the_database(spark, database):
    url, _ = database
    source = catalog.read_table(spark, url, "resource", "id", 3, DRIVER)
    local = source.where("id < 60")
    assert [r["id"] for r in upsert.pull_new(source, local, "id").orderBy("id").collect()] == list(range(60, 90))


def test_media_that_arrive_twice_are_filled_in_once(spark, tmp_path):
    folder, schema = f"file://{tmp_path}", "item_id long, media_type string, ts timestamp"
    at = lambda n: f"2024-01-01 00:00:{n:02d}"
    first = [(i, "image/png" if i % 3 else "text/plain", at(i)) for i in range(20)]
    make = lambda data: spark.createDataFrame(data, "item_id long, media_type string, t string").select("item_id", "media_type", F.col("t").cast("timestamp").alias("ts"))
    make(first).coalesce(1).write.parquet(f"{folder}/in/1")
    configured = spark.createDataFrame([(3,), (91,)], "property_id int")
    state = ingest.VersionedTable(spark, f"{folder}/state", spark.createDataFrame([], "item_id long, property_id int, ts timestamp").schema, 4)

    def take():
        stream = ingest.read_stream(spark, f"{folder}/in/*", spark.createDataFrame([], schema).schema, 1)
        ingest.trigger_enrichment(stream, configured, state, f"{folder}/checkpoint").awaitTermination()
        return rows(state.read().select("item_id", "property_id"))

    want = sorted((i, p) for i in range(20) if i % 3 for p in (3, 91))
    assert take() == want
    make(first[:10]).write.parquet(f"{folder}/in/2")
    make([(30, "image/gif", at(25)), (31, "video/mp4", at(26)), (None, None, at(27))]).write.parquet(f"{folder}/in/3")
    assert take() == want + [(30, 3), (30, 91)] == take()


def test_the_rarest_words_whatever_is_common(spark):
    rng = random.Random(1)
    words = ["the", "of", *(f"{a}{b}" for a in "bcdfg" for b in ("an", "ol", "ix", "um"))]
    texts = [(i, " ".join(rng.choice(words) if rng.random() < 0.8 else f"rare{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}" for _ in range(rng.randint(0, 60)))) for i in range(80)] + [(99, None)]
    df = spark.createDataFrame(texts, "item_id int, text string")
    said = {i: list(dict.fromkeys(w for w in (t or "").split() if w not in STOPWORDS)) for i, t in texts}
    df_of = Counter(w for ws in said.values() for w in ws)
    for most in (1024, 6, 0):
        want = set()
        for i, ws in said.items():
            for rank, (n, _, w) in enumerate(sorted((df_of[w], k, w) for k, w in enumerate(ws))[:5], 1):
                want.add((i, w, n, rank))
        found = rarity.lexical_profile(df, None, 5, most)
        assert {(r["item_id"], r["word"], r["df"], r["rank"]) for r in found.collect()} == want
        some = rarity.lexical_profile(df, df.where("item_id < 9").select("item_id"), 5, most)
        assert {(r["item_id"], r["word"], r["df"], r["rank"]) for r in some.collect()} == {w for w in want if w[0] < 9}
    assert rarity.lexical_profile(df.limit(0)).count() == 0
