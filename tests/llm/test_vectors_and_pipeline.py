"""Operators 3 and 9 against brute force, the registered queries, and the pipeline."""

import collections
import inspect

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from vitrine.llm import pq_dedup, projected_search, queries

import corpus_pipeline

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(400)]
    for i in range(400, 440):  # copies, near copies, and scaled ones
        rows.append((i, (np.array(rows[i % 7][1]) * (1 + i % 3) + rng.normal(size=16) * 0.03 * (i % 2)).astype(np.float32).tolist()))
    rows += [(440, None), (441, [0.0] * 16), (442, [float("nan")] + [1.0] * 15), (443, [float("inf")] + [1.0] * 15), (444, [None] + [1.0] * 15), (445, [1.0, 2.0]), (446, [])]
    return rows + [(447, rows[3][1]), (448, [-x for x in rows[3][1]])]


@pytest.fixture(scope="module")
def vectors(spark, data):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in data], "vec_id long, embedding array<float>, n int, cell int, root string").repartition(3)


def usable(v):
    return v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_embedding_dedup(spark, data, vectors):
    found = {r["vec_id"]: r for r in pq_dedup.near_duplicates(vectors).collect()}
    good = [(i, np.array(v, dtype=float)) for i, v in data if usable(v)]
    sets, links = brute.Sets(), collections.Counter()
    for a, (i, x) in enumerate(good):
        for j, y in good[a + 1 :]:
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                sets.join(i, j)
                links[i] += 1
                links[j] += 1
    assert len(found) == len(data) and sum(links.values()) > 100
    for i, _ in data:
        assert (found[i]["n_links"], found[i]["component"]) == (links[i], sets.root(i))
    assert pq_dedup.near_duplicates(vectors.where("false")).count() == 0
    assert pq_dedup.near_duplicates(vectors.where("vec_id in (440, 441)")).count() == 2


def test_probes_lose_no_link_of_a_hot_group_in_few_dimensions():
    rng = np.random.default_rng(8)
    noise = np.zeros((3000, 64))
    noise[:, :4] = rng.normal(size=(3000, 4)) * 0.12
    hot = rng.normal(size=64)
    units = pq_dedup._units(np.vstack([rng.normal(size=(3000, 64)), hot / np.linalg.norm(hot) + noise]))
    index = pq_dedup.fit(units, len(units) // 128, 8, 16)
    own, probes = index.cells(units, 0.95)
    sees = np.zeros((len(units), len(index.centroids)), dtype=bool)
    for i, p in enumerate(probes):
        sees[i, p] = True
    a, b = np.nonzero(np.triu(units @ units.T >= 0.95, 1))
    assert len(a) > 100_000 and len(set(own[3000:])) > 5 and (sees[a, own[b]] | sees[b, own[a]]).all()


def test_embedding_dedup_of_a_hot_group(spark):
    rng = np.random.default_rng(9)
    hot = np.append(np.ones(2), np.zeros(14)) + np.hstack([rng.normal(size=(900, 3)) * 0.2, np.zeros((900, 13))])
    table = np.vstack([rng.normal(size=(900, 16)), hot])
    units = table / np.linalg.norm(table, axis=1)[:, None]
    links = (units @ units.T >= 0.95).sum(axis=1) - 1
    vectors = spark.createDataFrame(list(enumerate(table.tolist())), "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["n_links"] for r in pq_dedup.near_duplicates(vectors).collect()}
    assert [found[i] for i in range(len(table))] == links.tolist() and links.sum() > 100_000


def test_search(spark, data, vectors):
    good = [(i, np.array(v, dtype=float)) for i, v in data if usable(v)]
    found = projected_search.nearest(vectors, vectors.where("vec_id % 20 = 0 or vec_id = 441"), k=7).collect()
    by = brute.grouped([r.asDict() for r in found], "query_id")
    hits = total = 0
    for i, x in good:
        if i % 20:
            continue
        want = sorted(((-float((y * x).sum()), j) for j, y in good if j != i))[:7]
        got = sorted(by[i], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 8))
        assert got == sorted(got, key=lambda r: (-r["score"], r["vec_id"]))
        scores = {j: -s for s, j in sorted((-float((y * x).sum()), j) for j, y in good)}
        assert all(r["vec_id"] != i and abs(r["score"] - scores[r["vec_id"]]) < 1e-12 for r in got)
        hits += len({r["vec_id"] for r in got} & {j for _, j in want})
        total += 7
    assert hits / total >= 0.9 and set(by) == {i for i, _ in good if i % 20 == 0}
    few = vectors.where("vec_id < 3")
    assert projected_search.nearest(few, few, k=20).groupBy("query_id").count().where("count = 2").count() == 3
    assert projected_search.nearest(vectors.where("false"), vectors.where("false")).count() == 0


@pytest.mark.parametrize(("spread", "most"), [(0.4, 0.1), (None, 0.65)])
def test_search_verifies_few_points(spread, most):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(4000, 64))
    if spread:
        points = rng.normal(size=(40, 64))[rng.integers(0, 40, 4000)] + spread * points
    centre, defaults = points.mean(axis=0), inspect.signature(projected_search.nearest).parameters
    top = ((points - centre) ** 2).sum(axis=1).max()
    shard = projected_search.Shard(np.arange(4000), points, centre, top, defaults["dims"].default, defaults["confidence"].default, 7)
    hits = 0
    for i in range(0, 4000, 40):
        scores = points @ points[i]
        scores[i] = -np.inf
        hits += len(set(shard.best(i, points[i], 20)[0].tolist()) & set(np.argsort(-scores)[:20].tolist()))
    assert hits / 2000 >= 0.92 and shard.verified / (100 * 3999) < most


def test_search_of_equal_vectors_goes_by_id(spark):
    table = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<double>")
    found = projected_search.nearest(table, table.where("vec_id = 7"), k=5).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [0, 1, 2, 3, 4]


def test_projected_search_of_very_large_and_small_vectors(spark):
    """Squares of such components overflow or vanish; neighbours are found all the same."""
    rng = np.random.default_rng(9)
    for size in (1e200, 1e-200):
        points = rng.normal(size=(300, 6))
        table = spark.createDataFrame([(i, (v * (size if i < 290 else size * 1e-3)).tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>")
        asked = table.where("vec_id >= 280").withColumn("embedding", projected_search.F.transform("embedding", lambda x: x * projected_search.F.lit(1 / size)))
        found = projected_search.nearest(table, asked, k=5)
        got = {r["query_id"]: [] for r in found.collect()}
        for r in found.orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert len(got) == 20
        rows = {r["vec_id"]: np.array(r["embedding"]) for r in table.collect()}
        hits = 0
        for q in asked.collect():
            want = sorted(((-float(rows[i] @ np.array(q["embedding"])), i) for i in rows if i != q["vec_id"]))[:5]
            hits += len({i for _, i in want} & {i for i, _ in got[q["vec_id"]]})
            assert all(s == pytest.approx(float(rows[i] @ np.array(q["embedding"]))) for i, s in got[q["vec_id"]])
        assert hits >= 90
    both = projected_search.nearest(table.withColumn("embedding", projected_search.F.transform("embedding", lambda x: x * 1e300 * 1e100)), table, k=3)
    assert both.count() == 900


def test_chi_square_quantile():
    assert abs(projected_search.chi_square_quantile(0.95, 2) - 5.9915) < 1e-3 and abs(projected_search.chi_square_quantile(0.95, 8) - 15.507) < 1e-3


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "packing"]
    good = corpus_pipeline.keep_good(spark, docs, LARGER)
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    assert good.columns == docs.columns
    assert good.join(labels, "doc_id").where("quality = 0").count() <= 1
    lost = docs.join(good, "doc_id", "left_anti").join(labels, "doc_id").where("quality = 1").count()
    assert lost <= 1
    one = corpus_pipeline.drop_near_duplicates(spark, good, LARGER)
    texts = [r["text"] for r in good.collect()]
    assert one.columns == docs.columns and one.count() == len(set(brute.similar_groups(texts)))
    rows = [(r["doc_id"], r["text"].encode()) for r in one.collect()]
    cut = {r["doc_id"]: r for r in corpus_pipeline.cut_repeats(spark, one, LARGER).collect()}
    for (key, _), (_, kept) in zip(rows, brute.repeats([t for _, t in rows], 200)):
        assert cut[key]["text"] == kept.decode("utf-8", "ignore") and cut[key]["n_chars"] == len(cut[key]["text"])
    packed = corpus_pipeline.run(spark, LARGER)
    assert packed.agg(F.countDistinct("doc_id")).first()[0] == one.count()


def test_pipeline_stages_take_odd_rows(spark, docs, none):
    for table in (docs, none):
        now = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == table.columns
        corpus_pipeline.pack_sequences(spark, now, SF).count()
