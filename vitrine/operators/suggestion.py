"""Suggested labels for vectors: centroids, neighbours' votes and prompts, with thresholds calibrated on labelled rows.

Scores form a matrix of items and labels.  It is made in blocks, each a matrix product, and only what a step asks for
leaves a block: moments, counts by score, rows above a floor, or, for ``label_scores``, all of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.running import running_sums
from vitrine.operators.search import BLOCK_ROWS, similar_all, unit, usual_length
from vitrine.operators.staging import staged

#: Weights of centroid, neighbours and prompt; own labels under which a centroid takes weak ones; positives under which a
#: label is not calibrated; rows that a threshold needs above it: fixed values of the method.
WEIGHTS = {"centroid": 0.5, "knn": 0.3, "text": 0.2}
LEAST_OWN, LEAST_POSITIVES, LEAST_ROWS = 8, 5, 5
#: Precision that the bands need.
BARS = {"high": 0.9, "medium": 0.6}
#: Rows of a label that a calibration reports precision for, and the width of the score ranges that rows are counted in.
RANKS, RANGE = (10, 25, 50), 1 / 32


def _summed(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, total, n): sums of equally long vectors, added up in the JVM before anything is moved."""
    both = Summarizer.metrics("sum", "count").summary(array_to_vector(F.col(vector)))
    return rows.groupBy(by).agg(both.alias("s")).select(by, vector_to_array(F.col("s.sum")).alias("total"), F.col("s.count").alias("n"))


def centroids(vectors: DataFrame, labels: DataFrame, weak: DataFrame | None = None) -> DataFrame:
    """(label, centroid, total, n): unit mean and component sums of the unit vectors of each label.  ``vectors``: id, v.

    ``weak`` (id, label) are uncertain labels.  A label with fewer than ``LEAST_OWN`` vectors of its own takes those
    of them whose similarity to the mean of all is in the upper 60 %.
    """
    units = vectors.where(F.col("v").isNotNull()).select("id", unit(F.col("v")).alias("u"))
    own = _summed(units.join(labels.distinct(), "id").where(F.col("label").isNotNull()), "label", "u")
    if weak is not None:
        few = own.where(F.col("n") >= LEAST_OWN).select("label")
        rows = units.join(weak.distinct(), "id").where(F.col("label").isNotNull()).join(few, "label", "left_anti")
        added = _added(own, _summed(rows, "label", "u"))
        near = rows.join(added.select("label", unit(F.col("total")).alias("c")), "label").withColumn("score", F.aggregate(F.zip_with("u", "c", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x))
        own = _added(own, _summed(weak_positives(near), "label", "u"))
    return own.select("label", unit(F.col("total")).alias("centroid"), "total", "n")


def _added(one: DataFrame, two: DataFrame) -> DataFrame:
    """Sums and counts of two tables (label, total, n), label by label."""
    joined = one.join(two.select("label", F.col("total").alias("t"), F.col("n").alias("m")), "label", "full_outer")
    total = F.when(F.col("t").isNull(), F.col("total")).when(F.col("total").isNull(), F.col("t")).otherwise(F.zip_with("total", "t", lambda x, y: x + y))
    return joined.select("label", total.alias("total"), (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))


def neighbour_votes(vectors: DataFrame, labels: DataFrame, k: int = 25) -> DataFrame:
    """(id, label, score): the share of each label among the similarities of the ``k`` nearest labelled others, negative
    ones counting as none.  Only labelled vectors are candidates, and all of them; an item that nothing votes for has no
    rows, which is a score of 0 for every label."""
    named = vectors.withColumnRenamed("v", "vector")
    marked = named.join(labels.select("id").distinct(), "id", "left_semi")
    chosen = similar_all(named, k, marked).withColumn("w", F.greatest("score", F.lit(0.0)))
    total = chosen.groupBy("id").agg(F.sum("w").alias("total"))
    votes = chosen.join(labels.distinct().withColumnRenamed("id", "other"), "other").groupBy("id", "label").agg(F.sum("w").alias("w"))
    return votes.join(total, "id").select("id", "label", F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(0.0).alias("score"))


def vote_moments(votes: DataFrame, labels: DataFrame, items: int) -> DataFrame:
    """(label, m, d): mean and population deviation, at least 1e-6, of each label's votes (id, label, score) over ``items``
    items, most of which have no row and count as 0.  ``labels``: label."""
    given = votes.groupBy("label").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    means = labels.join(given, "label", "left").select("label", (F.coalesce("s", F.lit(0.0)) / items).alias("m"), F.coalesce("n", F.lit(0)).alias("n"))
    around = votes.join(means, "label").groupBy("label").agg(F.sum((F.col("score") - F.col("m")) ** 2).alias("q"))
    q = F.coalesce("q", F.lit(0.0)) + (items - F.col("n")) * F.col("m") ** 2
    return means.join(around, "label", "left").select("label", "m", F.greatest(F.sqrt(q / items), F.lit(1e-6)).alias("d"))


@dataclass
class Scores:
    """The matrix of items and labels in blocks: rows of items (i, j, id, u, own, votes, tagged, target) and of labels
    (i, j, label, total, n, prompt and, once known, moments)."""

    items: DataFrame
    labels: DataFrame
    id_type: str
    label_type: str
    prompted: bool

    def product(self, body: Callable, schema: str) -> DataFrame:
        """``body`` (items, labels, their scores by method) over all blocks; the rows that it gives."""
        prompted = self.prompted

        def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
            parts = []
            if len(two):
                step = max(1, 1_000_000 // len(two))
                for at in range(0, len(one), step):
                    some = one.iloc[at : at + step]
                    found = body(some, two, _block_scores(some, two, prompted))
                    if found is not None and len(found):
                        parts.append(found)
            return pd.concat(parts) if parts else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

        return self.items.groupBy("i", "j").cogroup(self.labels.groupBy("i", "j")).applyInPandas(run, schema)


def _block_scores(one: pd.DataFrame, two: pd.DataFrame, prompted: bool) -> dict[str, np.ndarray]:
    """Scores of a block by method.  A label's own vector meets the mean of the others, where it has others."""
    u = np.stack(one.u.to_numpy())
    n, place = two.n.to_numpy(), {label: c for c, label in enumerate(two.label.to_numpy())}
    total = np.stack([t if t is not None else np.zeros(u.shape[1]) for t in two.total.to_numpy()])
    sizes = np.sqrt((total * total).sum(axis=1))
    centre = u @ (total / np.where(sizes > 0, sizes, 1.0)[:, None]).T
    for r, given in enumerate(one.own.to_numpy()):
        for label in given if given is not None else ():
            if (c := place.get(label)) is not None and n[c] > 1:
                rest = total[c] - u[r]
                size = np.sqrt(rest @ rest)
                if size > 0:
                    centre[r, c] = u[r] @ rest / size
    votes = np.zeros_like(centre)
    for r, given in enumerate(one.votes.to_numpy() if "votes" in one else ()):
        for vote in given if given is not None else ():
            if (c := place.get(vote["label"])) is not None:
                votes[r, c] = vote["score"]
    found = {"centroid": centre, "knn": votes}
    if prompted:
        found["text"] = u @ np.stack(two.prompt.to_numpy()).T
    return found


def _dealt(vectors: DataFrame, found: DataFrame, labels: DataFrame, votes: DataFrame | None, prompts: DataFrame | None, targets: DataFrame | None, block_rows: int) -> Scores:
    """Items and labels dealt into blocks of about ``block_rows`` that meet each other."""
    kind, id_type = dict(labels.dtypes)["label"], dict(vectors.dtypes)["id"]
    own = labels.where(F.col("label").isNotNull()).groupBy("id").agg(F.collect_set("label").alias("own"))
    rows = vectors.where(F.col("v").isNotNull()).select("id", unit(F.col("v")).alias("u")).join(own, "id", "left")
    if votes is not None:
        rows = rows.join(votes.groupBy("id").agg(F.collect_list(F.struct("label", "score")).alias("votes")), "id", "left")
    if targets is not None:
        rows = rows.join(targets.select("id").distinct().withColumn("target", F.lit(True)), "id", "left").where("own is not null or target")
    else:
        rows = rows.withColumn("target", F.lit(True))
    names = found.select("label", "total", "n")
    if prompts is not None:
        names = names.join(prompts.select("label", unit(F.col("v")).alias("prompt")), "label", "right")
    blocks = max(1, math.ceil(names.count() / block_rows))
    pieces = max(1, math.ceil(rows.count() / block_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(F.pmod(F.xxhash64("id"), F.lit(pieces)).cast("int").alias("i"), every(blocks).alias("j"), "*")
    right = names.withColumn("n", F.coalesce("n", F.lit(0))).select(every(pieces).alias("i"), F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int").alias("j"), "*")
    return Scores(left, right, id_type, kind, prompts is not None)


def centroid_scores(vectors: DataFrame, labels: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, label, score): inner product of each unit vector with each label's centroid; for the label's own rows with
    the centroid of the others, where there are others.  ``vectors``: id, v; ``labels``: id, label, string or number.
    Vectors that are not as long as most are left out."""
    vectors = usual_length(vectors, "v")
    scores = _dealt(vectors, centroids(vectors, labels), labels, None, None, None, block_rows)
    return scores.product(lambda one, two, found: _rows(one, two, {"score": found["centroid"]}), f"id {scores.id_type}, label {scores.label_type}, score double")


def _rows(one: pd.DataFrame, two: pd.DataFrame, values: dict[str, np.ndarray], where: np.ndarray | None = None) -> pd.DataFrame:
    """A row for each cell of a block, or for those in ``where``."""
    r, c = np.nonzero(np.ones((len(one), len(two)), dtype=bool) if where is None else where)
    return pd.DataFrame({"id": one.id.to_numpy()[r], "label": two.label.to_numpy()[c]} | {n: v[r, c] for n, v in values.items()})


def _with_moments(vectors: DataFrame, labels: DataFrame, prompts: DataFrame | None, k: int, weak: DataFrame | None, targets: DataFrame | None, block_rows: int) -> Scores:
    """The matrix with each label's mean and deviation of each method, over labelled and target items."""
    vectors, labels = usual_length(vectors, "v"), labels.where(F.col("label").isNotNull())
    if prompts is not None:
        prompts = prompts.where(F.col("v").isNotNull())
    found = staged(centroids(vectors, labels, weak), "centroids")
    asked = vectors if targets is None else vectors.join(targets.select("id").unionByName(labels.select("id")).distinct(), "id", "left_semi")
    votes = staged(neighbour_votes(asked, labels, k).where("score > 0"), "votes")
    scores = _dealt(vectors, found, labels, votes, prompts, targets, block_rows)

    def sums(one, two, by):
        out = {"label": two.label.to_numpy(), "n": np.full(len(two), len(one), dtype=np.int64)}
        for name in [x for x in by if x != "knn"]:
            mean = by[name].mean(axis=0)
            out |= {f"m_{name}": mean, f"q_{name}": ((by[name] - mean) ** 2).sum(axis=0)}
        return pd.DataFrame(out)

    dense = ["centroid"] + ["text"] * scores.prompted
    schema = f"label {scores.label_type}, n long, " + ", ".join(f"m_{x} double, q_{x} double" for x in dense)
    blocks = staged(scores.product(sums, schema), "moments")
    items = scores.items.where("j = 0").count()
    means = blocks.groupBy("label").agg(*[(F.sum(F.col("n") * F.col(f"m_{x}")) / F.sum("n")).alias(f"mean_{x}") for x in dense])
    around = blocks.join(means, "label").groupBy("label").agg(
        *[F.first(f"mean_{x}").alias(f"m_{x}") for x in dense],
        *[F.greatest(F.sqrt(F.sum(F.col(f"q_{x}") + F.col("n") * (F.col(f"m_{x}") - F.col(f"mean_{x}")) ** 2) / F.sum("n")), F.lit(1e-6)).alias(f"d_{x}") for x in dense],
    )
    voted = vote_moments(votes, around.select("label"), max(items, 1)).select("label", F.col("m").alias("m_knn"), F.col("d").alias("d_knn"))
    known = staged(around.join(voted, "label"), "moments")
    return Scores(scores.items, scores.labels.join(known, "label"), scores.id_type, scores.label_type, scores.prompted)


def _combined(two: pd.DataFrame, by: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums of z-scores and the number of the method with the largest one.  A label without a centroid shares out
    the centroid's weight among the others; a missing vote is a vote of 0."""
    names = list(by)
    z = {x: (by[x] - two[f"m_{x}"].to_numpy()) / two[f"d_{x}"].to_numpy() for x in names}
    known = (two.n.to_numpy() > 0) & np.array([t is not None and np.any(t) for t in two.total.to_numpy()])
    weight = {x: np.where(known, WEIGHTS[x], 0.0) if x == "centroid" else np.full(len(two), WEIGHTS[x]) for x in names}
    whole = sum(weight.values())
    score = sum(z[x] * (weight[x] / whole) for x in names)
    best = np.argmax(np.stack([np.where(known, z[x], -9.0) if x == "centroid" else z[x] for x in names]), axis=0)
    return score, best


def label_scores(vectors: DataFrame, labels: DataFrame, prompts: DataFrame | None = None, k: int = 25, weak: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, label, score, method) of all vectors (id, v) and labels, from labels (id, label) and, if given, prompt vectors
    (label, v), which then say what labels there are.  A score is the weighted sum of z-scores, standardised within the
    label over all items; the method is the one with the largest z-score, of equal ones the first of centroid, knn, text.

    Null ids, labels and vectors are left out, and vectors that are not as long as most.  ``pre_tag`` does not make these
    rows, of which there is one for each item and label.
    """
    scores = _with_moments(vectors, labels, prompts, k, weak, None, block_rows)

    def body(one, two, by):
        score, best = _combined(two, by)
        return _rows(one, two, {"score": score, "method": np.array(list(by))[best]})

    return scores.product(body, f"id {scores.id_type}, label {scores.label_type}, score double, method string")


def precision_steps(scored: DataFrame, pieces: int | None = None) -> DataFrame:
    """(label, score, n, hits, best): rows and hits of each label down to each score, from (label, score, hit), and the
    precision that the list reaches within the rows of that score, hits first, over ``LEAST_ROWS`` rows or more."""
    sums = running_sums(scored.withColumn("__one", F.lit(1)).withColumn("hit", F.col("hit").cast("long")), "label", "score", {"n": "__one", "hits": "hit"}, pieces)
    own = scored.groupBy("label", "score").agg(F.count("*").alias("__n"), F.sum("hit").alias("__h"))
    first = F.greatest(F.col("n") - F.col("__n") + F.greatest("__h", F.lit(1)), F.lit(LEAST_ROWS))
    return sums.join(own, ["label", "score"]).select("label", "score", "n", "hits", F.when(F.col("n") >= LEAST_ROWS, F.col("hits") / first).alias("best"))


def thresholds(scored: DataFrame, bars: dict[str, float], pieces: int | None = None) -> DataFrame:
    """(label, <bar names>): the lowest score down to which the precision is at least the bar, over ``LEAST_ROWS`` rows
    or more; null where there is none.  ``scored``: label, score, hit; of equal scores hits come first."""
    steps = precision_steps(scored, pieces)
    return steps.groupBy("label").agg(*[F.min(F.when(F.col("best") >= bar, F.col("score"))).alias(n) for n, bar in bars.items()])


def precision_at(calibration: DataFrame, target: DataFrame, pieces: int | None = None) -> DataFrame:
    """Smoothed precision among calibration rows (label, score, hit) with at least a target's score: target (id, label,
    score) + confidence.  Each score is looked up once, however many targets have it."""
    rows = calibration.select("label", "score", F.lit(1).alias("c"), F.col("hit").cast("long").alias("hit"))
    asked = target.select("label", "score", F.lit(0).alias("c"), F.lit(0).cast("long").alias("hit")).distinct()
    steps = running_sums(rows.unionByName(asked), "label", "score", {"n": "c", "hits": "hit"}, pieces)
    found = steps.select("label", "score", ((F.col("hits") + 1) / (F.col("n") + 2)).alias("confidence"))
    return target.join(found, ["label", "score"]).select(*target.columns, "confidence")


def precision_at_ranks(scored: DataFrame, ranks: list[int]) -> DataFrame:
    """Precision among the best k rows of each label (of as many as there are), to three decimals."""
    rows = scored.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), F.desc("hit")))).where(F.col("r") <= max(ranks))
    return rows.groupBy("label").agg(*[F.round(F.avg(F.when(F.col("r") <= k, F.col("hit"))), 3).alias(f"p{k}") for k in ranks])


def weak_positives(scored: DataFrame, share: float = 0.4) -> DataFrame:
    """Rows (label, score) at or above a quantile of their label's scores."""
    cut = scored.groupBy("label").agg(F.percentile("score", F.lit(share)).alias("cut"))
    return scored.join(cut, "label").where(F.col("score") >= F.col("cut")).drop("cut")


def band(score: Column, high: Column, medium: Column) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def _calibrated(scores: Scores, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calibration rows, candidates): the labelled rows that may lie above a label's lowest threshold or among its first
    ranks, with hit, and the target rows at least as high.

    A threshold has at most (positives / least bar) rows above it.  Labelled rows are first counted by label and range of
    scores; the floor is the lowest range within which so many lie, so no label's rows are all made unless most are
    positive.
    """
    least = min(BARS.values())

    def counts(one, two, by):
        score, _ = _combined(two, by)
        tagged = one.own.notna().to_numpy()
        if not tagged.any():
            return None
        cell = np.floor(score[tagged] / RANGE).astype(np.int64)
        flat = pd.DataFrame({"label": np.tile(two.label.to_numpy(), int(tagged.sum())), "cell": cell.ravel()})
        return flat.groupby(["label", "cell"], as_index=False).size().rename(columns={"size": "n"})

    cells = scores.product(counts, f"label {scores.label_type}, cell long, n long").groupBy("label", "cell").agg(F.sum("n").alias("n"))
    positives = labels.where(F.col("label").isNotNull()).distinct().join(scores.items.where("j = 0").select("id"), "id", "left_semi").groupBy("label").agg(F.count("*").alias("positives"))
    down = running_sums(cells, "label", "cell", {"above": "n"})
    wanted = F.greatest(F.ceil(F.coalesce("positives", F.lit(0)) / least), F.lit(max(RANKS)))
    floor = down.join(positives, "label", "left").groupBy("label").agg(
        F.coalesce(F.max(F.when(F.col("above") >= wanted, F.col("cell"))), F.min("cell")).alias("cell"), F.first(F.coalesce("positives", F.lit(0))).alias("positives")
    )
    known = staged(floor.select("label", (F.col("cell") * RANGE).alias("floor"), "positives"), "floors")
    floored = Scores(scores.items, scores.labels.join(known, "label"), scores.id_type, scores.label_type, scores.prompted)

    def above(one, two, by):
        score, best = _combined(two, by)
        kept = score >= two.floor.to_numpy()
        tagged, place = one.own.notna().to_numpy(), {label: c for c, label in enumerate(two.label.to_numpy())}
        own = np.zeros(score.shape, dtype=bool)
        for r, given in enumerate(one.own.to_numpy()):
            for label in given if given is not None else ():
                if label in place:
                    own[r, place[label]] = True
        target = one.target.fillna(False).to_numpy(dtype=bool)
        shape = score.shape
        values = {
            "score": score, "method": np.array(list(by))[best], "hit": own.astype(np.int64),
            "tagged": np.broadcast_to(tagged[:, None], shape), "target": np.broadcast_to(target[:, None], shape),
            **{f"s_{x}": v for x, v in by.items()},
        }
        return _rows(one, two, values, kept & (tagged | target)[:, None])

    parts = ", ".join(f"s_{x} double" for x in ["centroid", "knn"] + ["text"] * scores.prompted)
    rows = floored.product(above, f"id {scores.id_type}, label {scores.label_type}, score double, method string, hit long, tagged boolean, target boolean, {parts}")
    rows = staged(rows, "candidates")
    return rows.where("tagged").select("label", "score", "hit"), rows.where("target and hit = 0").drop("tagged", "target", "hit")


def _calibration(scores: Scores, rows: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each label, from the calibration rows."""
    positives = labels.where(F.col("label").isNotNull()).distinct().join(scores.items.where("j = 0").select("id"), "id", "left_semi").groupBy("label").agg(F.count("*").alias("calib_pos"))
    known = scores.labels.where("i = 0").select("label", (F.col("n") > 0).alias("centroid")).join(positives, "label", "left").withColumn("calib_pos", F.coalesce("calib_pos", F.lit(0)))
    steps = precision_steps(rows)
    found = []
    for name, bar in BARS.items():
        lowest = F.min_by(F.struct("score", "n", "hits"), F.when(F.col("best") >= bar, F.col("score")))
        found.append(lowest.alias(name))
    cuts = steps.groupBy("label").agg(*found)
    listed = [x for name in BARS for x in (F.col(f"{name}.score").alias(name), F.col(f"{name}.n").alias(f"{name}_support"), F.round(F.col(f"{name}.hits") / F.col(f"{name}.n"), 3).alias(f"{name}_precision"))]
    ranks = [F.when(F.col("calib_pos") > 0, F.col(f"p{k}")).alias(f"p{k}") for k in RANKS]
    enough = F.col("calib_pos") >= LEAST_POSITIVES
    shown = cuts.select("label", *listed)
    joined = known.join(precision_at_ranks(rows, list(RANKS)), "label", "left").join(shown, "label", "left")
    return joined.select("label", (~enough).alias("uncalibrated"), "calib_pos", "centroid", *ranks, *[F.when(enough, F.col(c)).alias(c) for c in shown.columns[1:]])


def calibration(vectors: DataFrame, labels: DataFrame, prompts: DataFrame | None = None, k: int = 25, weak: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """How well each label's scores find its labelled rows: (label, uncalibrated, calib_pos, centroid, p10, p25, p50, and
    for high and medium the lowest score whose precision is enough, with the rows and the precision down to it).

    A label with fewer than ``LEAST_POSITIVES`` positives is not calibrated: it has no thresholds.
    """
    scores = _with_moments(vectors, labels, prompts, k, weak, None, block_rows)
    return _calibration(scores, _calibrated(scores, labels)[0], labels)


def pre_tag(
    vectors: DataFrame, labels: DataFrame, prompts: DataFrame | None = None, k: int = 25, weak: DataFrame | None = None, targets: DataFrame | None = None, top: int = 5, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Suggestions for all vectors, or for ``targets`` (id): (id, label, score, confidence, method, band, rank, s_centroid,
    s_knn, s_text with prompts), labels that an item has left out.

    Bands come from thresholds calibrated on the labelled rows; a label that is not calibrated suggests nothing.  An
    item's best ``top`` go by band, then confidence, then label; the confidence is the smoothed precision among labelled
    rows with at least the score.  Only rows that may be suggested or calibrate are made.
    """
    scores = _with_moments(vectors, labels, prompts, k, weak, targets, block_rows)
    rows, candidates = _calibrated(scores, labels)
    cuts = staged(_calibration(scores, rows, labels), "calibration").where("medium is not null").select("label", "high", "medium")
    marked = candidates.join(cuts, "label").where(F.col("score") >= F.col("medium")).withColumn("band", band(F.col("score"), F.col("high"), F.col("medium"))).drop("high", "medium")
    sure = precision_at(rows, staged(marked, "suggested"))
    order = Window.partitionBy("id").orderBy(F.array_position(F.array(F.lit("high"), F.lit("medium")), F.col("band")), F.desc("confidence"), "label")
    parts = [c for c in sure.columns if c.startswith("s_")]
    return sure.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("id", "label", "score", "confidence", "method", "band", "rank", *parts)


def band_totals(found: DataFrame) -> DataFrame:
    """Rows and items per band."""
    return found.groupBy("band").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("items"))


def best_bands(found: DataFrame, items: DataFrame) -> DataFrame:
    """(best, items): items by the best band that a suggestion of theirs (id, band) has, high, medium or none; ``items``:
    id."""
    best = found.groupBy("id").agg(F.max(F.when(F.col("band") == "high", 2).when(F.col("band") == "medium", 1).otherwise(0)).alias("b"))
    joined = items.select("id").distinct().join(best, "id", "left")
    return joined.groupBy(F.when(F.col("b") == 2, "high").when(F.col("b") == 1, "medium").otherwise("none").alias("best")).agg(F.count("*").alias("items"))
