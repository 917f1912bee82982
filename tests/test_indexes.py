"""Stored words, pruned vectors and pairing against plain versions."""

import itertools
import random

import numpy as np
import pytest
from tables import SF
from vitrine.operators import search, vector_cells, word_index
from vitrine.plans import registry

registry.load()
DOCS = "id long, text string, version int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def random_docs(rng, n):
    words = ["the", "of", "café", "self", "portrait", *(f"w{i}" for i in range(60))]
    return [(i, " ".join(rng.choice(words) + rng.choice(["", "", ",", "-"]) for _ in range(rng.randint(0, 80))), i % 2) for i in range(n)]


def test_an_index_finds_what_the_texts_hold(spark, tmp_path):
    rng = random.Random(2)
    docs = random_docs(rng, 120) + [(500, None, 1), (501, "", 0)]
    df, path = spark.createDataFrame(docs, DOCS), f"file://{tmp_path}/a"
    assert word_index.index_documents(df.unionByName(spark.createDataFrame([(None, "the of", 1)], DOCS)), path) == 1
    for query, version in (("the of", None), ("self-portrait", None), ("THE Café", 1), ("the-the", 0), ("nowhere", None), (" !! ", None)):
        want = search.lexical_search(df, query, 30, 0, version)
        got = word_index.indexed_search(spark, path, query, 30, 0, version)
        assert [(r["id"], pytest.approx(r["score"])) for r in got.collect()] == [tuple(r) for r in want.collect()]


def test_a_replaced_document_loses_its_words(spark, tmp_path):
    rng, path = random.Random(3), f"file://{tmp_path}/a"
    old, new = random_docs(rng, 60), [(i, t + " fresh", v) for i, t, v in random_docs(rng, 60)]
    now = {r[0]: r for r in old}
    word_index.index_documents(spark.createDataFrame([(*r[:1], r[1] + " stale", r[2]) for r in old], DOCS), path)
    word_index.index_documents(spark.createDataFrame(old, DOCS), path)
    word_index.index_documents(spark.createDataFrame(new[:25], DOCS), path)
    now |= {r[0]: r for r in new[:25]}
    # a batch that failed before its totals were written counts for nothing, and is written again
    spark.createDataFrame([(1, 1, 99)], "id long, version int, n int").write.parquet(f"{path}/documents/batch=4")
    assert word_index.indexed_search(spark, path, "stale").count() == 0
    assert {r["id"] for r in word_index.indexed_search(spark, path, "fresh").collect()} == set(range(25))
    assert word_index.index_documents(spark.createDataFrame([(200, "fresh the of", 0)], DOCS), path) == 4
    now[200] = (200, "fresh the of", 0)
    word_index.compacted(spark, path, f"{path}-small")
    df = spark.createDataFrame(list(now.values()), DOCS)
    for where in (path, f"{path}-small"):
        for query in ("the of", "fresh", "self-portrait"):
            want = [(r["id"], pytest.approx(r["score"])) for r in search.lexical_search(df, query).collect()]
            assert [tuple(r) for r in word_index.indexed_search(spark, where, query).collect()] == want


def test_a_search_reads_its_words_folders_and_no_text(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    word_index.index_documents(spark.createDataFrame(random_docs(random.Random(4), 30), DOCS), path)
    plan = word_index.indexed_search(spark, path, "the w7")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "Scan parquet" in line]
    assert scans and not any("text" in line.split("ReadSchema")[-1] for line in scans)
    assert any("bucket" in line and "IN" in line.upper() for line in scans if "PartitionFilters" in line)


def clustered(rng, n, d=12, spread=0.15):
    centres = rng.normal(size=(25, d))
    return [(i, (centres[i % 25] + rng.normal(size=d) * spread).tolist()) for i in range(n)]


def plain_nearest(data, queries, k):
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in data}
    out = set()
    for q in queries:
        found = sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in unit if i != q)[:k]
        out |= {(q, i, r + 1) for r, (_, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("cell_rows, block_rows", [(40, 16384), (40, 16), (100000, 30)])
def test_pruned_search_is_exact(spark, cell_rows, block_rows):
    rng = np.random.default_rng(1)
    data = clustered(rng, 700) + [(1000 + i, rng.normal(size=12).tolist()) for i in range(60)] + [(2000, [0.0] * 12), (2001, [0.0] * 12)]
    odd = [(3000, None), (3001, [1.0]), (3002, [float("nan")] + [1.0] * 11), (3003, [float("inf")] + [1.0] * 11), (None, [1.0] * 12)]
    df = spark.createDataFrame(data + odd, "id long, vector array<double>").repartition(3)
    found = search.similar_all(df, 5, cell_rows=cell_rows, block_rows=block_rows).collect()
    assert {(r["id"], r["other"], r["rank"]) for r in found} == plain_nearest(data, [i for i, _ in data], 5)
    some = df.where("id % 3 = 0")
    found = search.similar_all(df, 4, some, cell_rows=cell_rows).collect()
    part = [r for r in data if r[0] % 3 == 0]
    for q in (0, 1, 2, 699, 1001):
        want = plain_nearest(part + ([] if q % 3 == 0 else [data[q] if q < 700 else data[700 + q - 1000]]), [q], 4 if q % 3 == 0 else 4)
        assert {(r["id"], r["other"], r["rank"]) for r in found if r["id"] == q} == want


def test_cells_are_pruned_where_vectors_cluster(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(clustered(rng, 1500, spread=0.03), "id long, vector array<double>").select("id", search.unit(search.F.col("vector")).alias("v"))
    report = {}
    assert vector_cells.nearest(df, df, 5, cell_rows=30, report=report).count() == 7500
    assert report["share"] < 0.3
    assert search.similar_all(df.limit(0), 3, vector="v").count() == 0
    one = search.similar_all(df.limit(1), 3, vector="v")
    assert one.count() == 0


def test_stored_vectors_are_read_by_cell(spark, tmp_path):
    rng, path = np.random.default_rng(3), f"file://{tmp_path}/v"
    data = clustered(rng, 900, spread=0.05) + [(5000, [0.0] * 12)]
    df = spark.createDataFrame([(i, v, i % 2) for i, v in data], "id long, vector array<double>, version int").select("id", search.unit(search.F.col("vector")).alias("v"), "version")
    vector_cells.store(df, path, cell_rows=40)
    for q in (data[5][1], rng.normal(size=12).tolist(), [0.0] * 12):
        want = search.vector_search(df, q, 7, vector="v")
        assert [(r["id"], pytest.approx(r["score"])) for r in vector_cells.stored_search(spark, path, q, 7).collect()] == [tuple(r) for r in want.collect()]
    want = search.similar(df, 5, 9, 1, 0.2, vector="v").collect()
    report = {}
    got = vector_cells.stored_search(spark, path, data[5][1], 9, 0.2, without=5, version=1, report=report)
    assert [r["id"] for r in got.collect()] == [r["id"] for r in want]
    assert 0 < report["share"] < 0.5 and len(got.inputFiles()) > 0


def greedy(data):
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in data}
    edges = sorted(((round(float(unit[a] @ unit[b]), 12), a, b) for a, b in itertools.combinations(sorted(unit), 2)), reverse=True)
    used, out = set(), set()
    for _, a, b in edges:
        if a not in used and b not in used:
            used |= {a, b}
            out.add((a, b))
    return out | {(i, None) for i in unit if i not in used}


@pytest.mark.parametrize("k", [8, 2])
def test_pairing_in_rounds_is_greedy(spark, k):
    rng = np.random.default_rng(k)
    data = [(i, v) for i, v in clustered(rng, 101, d=5, spread=0.4)] + [(200 + i, [1.0, 2.0, 0.0, 0.0, 1.0]) for i in range(7)]
    df = spark.createDataFrame([*data, (900, None)], "id long, vector array<double>")
    assert {(r["a"], r["b"]) for r in search.seed_pairs(df, k=k).collect()} == greedy(data) | {(900, None)}


def test_registered_pairing(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert {(r["a"], r["b"]) for r in registry.QUERIES["seeded_pairs"](spark, SF).collect()} == greedy(vectors)


def test_a_vector_is_moved_for_few_packs_and_not_for_each_cell(spark, monkeypatch):
    """300 vectors without clusters: each looks into nearly all of 100 cells, in at most nine packs of near ones."""
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 16))
    data /= np.linalg.norm(data, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, v array<double>")
    seen, written = [], vector_cells.staged

    def staged(rows, name):
        made = written(rows, name)
        if name == "probes":
            seen.append(made.count())
        return made

    monkeypatch.setattr(vector_cells, "staged", staged)
    found = {(r["id"], r["rank"]): r["other"] for r in vector_cells.nearest(df, df, 4, cell_rows=3).collect()}
    assert seen[1] <= 300 * 16
    scores = data @ data.T
    np.fill_diagonal(scores, -2)
    assert found == {(i, n + 1): int(j) for i in range(300) for n, j in enumerate(np.argsort(-scores[i])[:4])}


def test_an_index_is_written_without_moving_its_postings(spark, tmp_path):
    """What the shuffles of a batch carry is no more than the texts, here 40 of 5,000 words of which none comes twice."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(5000))) for i in range(40)], "id long, text string")
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.executorList(False).apply(0).totalShuffleWrite()
    word_index.index_documents(docs, f"file://{tmp_path}/i")
    moved = store.executorList(False).apply(0).totalShuffleWrite() - before
    assert moved < docs.selectExpr("sum(length(text))").first()[0]
    assert spark.read.parquet(f"file://{tmp_path}/i/postings").count() == 200_000


def test_stored_files_grow_with_rows_and_not_with_cells(spark, tmp_path):
    """900 vectors in 90 cells: two files, or a few for each block of 150; a search reads the folders that it needs."""
    rng = np.random.default_rng(5)
    data = clustered(rng, 900, spread=0.02) + [(5000 + i, [0.0] * 12) for i in range(3)]
    df = spark.createDataFrame(data, "id long, vector array<double>").repartition(4).select("id", search.unit(search.F.col("vector")).alias("v"))
    vector_cells.store(df, f"file://{tmp_path}/a", cell_rows=10)
    vector_cells.store(df, f"file://{tmp_path}/b", cell_rows=10, block_rows=150)
    assert len(list((tmp_path / "a" / "vectors").rglob("*.parquet"))) == 2
    assert len(list((tmp_path / "b" / "vectors").rglob("*.parquet"))) <= 20
    assert len(list((tmp_path / "b" / "vectors").glob("pack=*"))) >= 7
    for q in (data[7][1], rng.normal(size=12).tolist(), [0.0] * 12):
        want = [tuple(r) for r in search.vector_search(df, q, 40, vector="v").collect()]
        for name in ("a", "b"):
            found = vector_cells.stored_search(spark, f"file://{tmp_path}/{name}", q, 40)
            assert [(r["id"], pytest.approx(r["score"])) for r in found.collect()] == want
    near = vector_cells.stored_search(spark, f"file://{tmp_path}/b", data[7][1], 5)
    assert len(near.inputFiles()) >= 1 and near.count() == 5
    zeros = df.where("id >= 5000")
    vector_cells.store(zeros, f"file://{tmp_path}/z")
    assert [r["id"] for r in vector_cells.stored_search(spark, f"file://{tmp_path}/z", [1.0] * 12, 2).collect()] == [5000, 5001]


def test_a_vectors_length_is_made_once(spark):
    """Not once, or twice, for each component."""
    made = search.unit(search.F.col("v")).alias("u")  # its usual name would repeat it
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],), ([1.0, None],)], "v array<double>")
    plan = df.select(made)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("SQRT(") == 1
    assert [r[0] for r in df.select(made).collect()] == [[0.6, 0.8], [0.0, 0.0], None, [], [1.0, None]]


def test_documents_stay_where_they_are_and_share_rows_of_words(spark, tmp_path):
    """texts with ids of their own are not moved, and a word has a row for many documents."""
    docs = spark.createDataFrame([(i, "The of the " + " ".join(f"w{i}x{j}" for j in range(500)), i % 2) for i in range(64)], DOCS).repartition(8).cache()
    size, path = docs.selectExpr("sum(length(text))").first()[0], f"file://{tmp_path}/i"
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.executorList(False).apply(0).totalShuffleWrite()
    word_index.index_documents(docs, path)
    assert store.executorList(False).apply(0).totalShuffleWrite() - before < size / 10
    held = spark.read.parquet(f"{path}/postings").where("word = 'the'")
    assert held.count() <= 8 and held.selectExpr("sum(size(id))").first()[0] == 64
    assert rows(held.selectExpr("inline(arrays_zip(id, at))").where("id < 2")) == [(0, [0, 2]), (1, [0, 2])]
    word_index.index_documents(docs.where("version = 0"), path)  # of the first batch half counts still
    word_index.index_documents(docs.where("version = 1 and id < 9"), path)
    word_index.compacted(spark, path, f"{path}-small")
    assert spark.read.parquet(f"{path}-small/postings").where("word = 'the'").selectExpr("sum(size(id))").first()[0] == 64
    want = [(r["id"], pytest.approx(r["score"])) for r in search.lexical_search(docs, "the-of").collect()]
    assert [tuple(r) for r in word_index.indexed_search(spark, f"{path}-small", "the-of").collect()] == want


def test_the_next_round_pairs_the_survivors_of_all_vectors(spark):
    """of all vectors, not of one version."""
    first = [tuple(r)[:2] for r in registry.QUERIES["seeded_pairs"](spark, SF).collect()]
    left = {i for a, b in first for i in ((b,) if a % 3 == 0 else (a, b)) if i is not None}
    left |= {a for a, b in first if b is None}
    found = registry.QUERIES["next_round"](spark, SF).collect()
    assert sorted(i for r in found for i in (r["a"], r["b"]) if i is not None) == sorted(left)
    assert {i % 2 for i in left} == {0, 1}
