"""Suggested labels against a plain matrix version."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from vitrine.operators import suggestion
from vitrine.operators.running import running_sums


def unit(a):
    size = np.sqrt((a * a).sum(axis=-1, keepdims=True))
    return a / np.where(size > 0, size, 1)


def matrix(vectors, own, weak, prompts, k):
    """Scores by method, combined scores and methods of ids x names, with every vote and every zero written out."""
    ids, u = sorted(vectors), unit(np.array([vectors[i] for i in sorted(vectors)], dtype=float))
    names = sorted(prompts) if prompts else sorted({x for xs in own.values() for x in xs})
    text = u @ unit(np.array([prompts[n] for n in names], dtype=float)).T if prompts else None
    centre, votes, known = np.zeros((len(ids), len(names))), np.zeros((len(ids), len(names))), []
    for c, name in enumerate(names):
        mine = [r for r, i in enumerate(ids) if name in own.get(i, ())]
        total, n = u[mine].sum(axis=0), len(mine)
        if weak is not None and n < 8:
            more = [r for r, i in enumerate(ids) if name in weak.get(i, ())]
            if more:
                near = u[more] @ unit(total + u[more].sum(axis=0))
                kept = [r for r, s in zip(more, near) if s >= np.quantile(near, 0.4) - 1e-15]
                total, n = total + u[kept].sum(axis=0), n + len(kept)
        known.append(n > 0)
        if n:
            centre[:, c] = u @ unit(total)
            for r in mine if n > 1 else ():
                centre[r, c] = u[r] @ unit(total - u[r])
    tagged = [r for r, i in enumerate(ids) if own.get(i)]
    for r in range(len(ids)):
        near = sorted((-(u[r] @ u[t]), ids[t], t) for t in tagged if t != r)[:k]
        whole = sum(max(-s, 0) for s, _, _ in near)
        for s, i, _ in near:
            for name in own[i]:
                votes[r, names.index(name)] += max(-s, 0) / whole if whole else 0
    by = {"centroid": centre, "knn": votes} | ({"text": text} if prompts else {})
    z = {m: (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-6) for m, x in by.items()}
    score, method = np.zeros_like(centre), np.empty(centre.shape, dtype=object)
    for c in range(len(names)):
        used = [m for m in by if m != "centroid" or known[c]]
        share = sum(suggestion.WEIGHTS[m] for m in used)
        score[:, c] = sum(z[m][:, c] * suggestion.WEIGHTS[m] / share for m in used)
        for r in range(len(ids)):
            method[r, c] = max(used, key=lambda m: z[m][r, c])
    return ids, names, score, method


def plain_tags(ids, names, score, own, top):
    found = collections.defaultdict(list)
    tagged = [r for r, i in enumerate(ids) if own.get(i)]
    for c, name in enumerate(names):
        rows = sorted(((score[r, c], name in own[ids[r]]) for r in tagged), reverse=True)
        if sum(h for _, h in rows) < 5:
            continue
        cut = {}
        for bar in (0.9, 0.6):
            hits = 0
            for n, (s, h) in enumerate(rows, 1):
                hits += h
                if n >= 5 and hits / n >= bar:
                    cut[bar] = s
        for r, i in enumerate(ids):
            if name not in own.get(i, ()) and 0.6 in cut and score[r, c] >= cut[0.6]:
                above = [h for s, h in rows if s >= score[r, c]]
                band = "high" if score[r, c] >= cut.get(0.9, np.inf) else "medium"
                found[i].append((band != "high", -(sum(above) + 1) / (len(above) + 2), name, band))
    return {(i, name, band, n + 1): -conf for i, rows in found.items() for n, (_, conf, name, band) in enumerate(sorted(rows)[:top])}


@pytest.mark.parametrize("block", [16384, 40])
@pytest.mark.parametrize("prompted", [False, True])
def test_matrix(spark, prompted, block):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(7, 12))
    vectors = {i: (centres[i % 7] + rng.normal(size=12) * 1.1).tolist() for i in range(150)}
    own = {i: {"abcdefg"[i % 7]} | ({"a"} if i % 10 == 0 else set()) for i in range(150) if i % 3 and (i % 7 < 4 or i < 40)}
    weak = {i: {"abcdefg"[i % 7]} for i in range(0, 150, 5)} if prompted else None
    prompts = {n: centres[c].tolist() for c, n in enumerate("abcdefg")} | {"nobody": rng.normal(size=12).tolist()} if prompted else None
    ids, names, score, method = matrix(vectors, own, weak, prompts, 6)
    pairs = lambda given: spark.createDataFrame([(i, n) for i, ns in given.items() for n in ns], "id long, label string")
    odd = [(1000, None), (1001, [1.0, 2.0]), (1002, [float("nan")] * 12), (None, [1.0] * 12)]
    args = (
        spark.createDataFrame([*vectors.items(), *odd], "id long, v array<double>").repartition(3).where("id is not null"),
        pairs(own).unionByName(pairs({1000: {"a"}})),
        spark.createDataFrame(list(prompts.items()), "label string, v array<double>") if prompted else None,
    )
    more = {"k": 6, "weak": pairs(weak) if prompted else None, "block_rows": block}
    found = {(r["id"], r["label"]): r for r in suggestion.label_scores(*args, **more).collect()}
    assert len(found) == len(ids) * len(names)
    assert max(abs(found[i, n]["score"] - score[r, c]) for r, i in enumerate(ids) for c, n in enumerate(names)) < 1e-9
    assert all(found[i, n]["method"] == method[r, c] for r, i in enumerate(ids) for c, n in enumerate(names))
    tags = {(r["id"], r["label"], r["band"], r["rank"]): r["confidence"] for r in suggestion.pre_tag(*args, **more, top=3).collect()}
    want = plain_tags(ids, names, score, own, 3)
    assert tags == pytest.approx(want) and len(want) > 20
    bars = {r["label"]: r for r in suggestion.calibration(*args, **more).collect()}
    assert sorted(bars) == names and all(r["uncalibrated"] == (r["calib_pos"] < 5) and (r["medium"] is None or r["calib_pos"] >= 5) for r in bars.values())


def test_targets_only(spark):
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, (rng.normal(size=4) + [4 * (i % 2), 0, 0, 0]).tolist()) for i in range(60)], "id long, v array<double>")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "id long, label int")
    targets = spark.createDataFrame([(i,) for i in (45, 50, 51, 99)], "id long")
    found = suggestion.pre_tag(vectors, labels, k=5, targets=targets)
    assert {r["id"] for r in found.collect()} <= {45, 50, 51} and found.count() > 0


def test_running_sums_of_one_large_group(spark):
    """A group that holds nearly all rows is dealt over many tasks, and sums are those of a plain list."""
    rng = random.Random(4)
    data = [("hot", rng.randint(0, 4000) / 7, rng.randint(0, 1)) for _ in range(9000)] + [("b", 1.0, 1), ("b", 1.0, 0), ("c", -2.0, 1), (None, 1.0, 1), ("b", None, 1)]
    df = spark.createDataFrame(data, "label string, score double, hit int").withColumn("one", F.lit(1))
    found = running_sums(df, "label", "score", {"n": "one", "hits": "hit"}, pieces=12)
    got = {(r["label"], r["score"]): (r["n"], r["hits"]) for r in found.collect()}
    want = {}
    for label in "hot", "b", "c":
        rows, n, hits = sorted((r for r in data if r[0] == label and r[1] is not None), key=lambda r: -r[1]), 0, 0
        for _, score, hit in rows:
            n, hits = n + 1, hits + hit
            want[label, score] = (n, hits)
    assert got == want
    placed = df.where("label = 'hot'").groupBy("label", "score").count().repartitionByRange(12, "label", F.col("score").desc())
    sizes = [r["n"] for r in placed.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < len({r[1] for r in data}) / 4


def test_equal_scores_put_hits_first(spark):
    scored = spark.createDataFrame([("a", 1.0, 1)] * 4 + [("a", 0.5, 0)] * 3 + [("a", 0.5, 1)] * 2 + [("b", 1.0, 1)] * 4, "label string, score double, hit int")
    found = {r["label"]: (r["bar"], r["never"]) for r in suggestion.thresholds(scored, {"bar": 1.0, "never": 1.1}).collect()}
    assert found == {"a": (0.5, None), "b": (None, None)}
    both = suggestion.precision_at(scored, spark.createDataFrame([(1, "a", 0.7), (2, "a", 0.1), (3, "b", 2.0), (4, "a", 0.7)], "id long, label string, score double"))
    assert {r["id"]: r["confidence"] for r in both.collect()} == pytest.approx({1: 5 / 6, 2: 7 / 11, 3: 1 / 2, 4: 5 / 6})
