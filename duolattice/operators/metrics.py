"""Predictions and their measures over score tables: id, y (true label), label, score - one row per example and label."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which one range is enough.
SINGLE = 100_000


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """A table that several jobs read, kept meanwhile; one that the caller keeps is left as it is."""
    mine = df.storageLevel == StorageLevel.NONE
    try:
        yield df.persist(StorageLevel.MEMORY_AND_DISK) if mine else df
    finally:
        if mine:
            df.unpersist()


def predict_labels(scores: DataFrame) -> DataFrame:
    """id, y, yhat: the label of the highest score, ties to the smallest label."""
    best = F.min_by("label", F.struct((-F.col("score")).alias("s"), F.col("label").alias("l")))
    return scores.groupBy("id", "y").agg(best.alias("yhat"))


def classification_metrics(predictions: DataFrame) -> DataFrame:
    """From id, y, yhat: n, correct, accuracy, and precision, recall and F1 of label 1 (0 where there is nothing to divide by). A row with copies counts as so many."""
    y, h = F.col("y") == 1, F.col("yhat") == 1
    often = F.col("copies") if "copies" in predictions.columns else F.lit(1).cast("long")
    number = lambda c: F.coalesce(F.sum(F.when(c, often)), F.lit(0).cast("long"))
    counts = predictions.agg(number(F.lit(True)).alias("n"), number(F.col("y") == F.col("yhat")).alias("correct"), number(y & h).alias("tp"), number(h).alias("predicted"), number(y).alias("positive"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    p, r = ratio("tp", "predicted"), ratio("tp", "positive")
    return counts.select("n", "correct", ratio("correct", "n").alias("accuracy"), p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def precision_recall(ranked: DataFrame, buckets: int = 64) -> DataFrame:
    """From id, y, score (of label 1): rank, running positives, by score descending, then id.

    Boundaries (score, id) from a hash sample cut the rows into ranges, tied scores too; each range is ranked by itself and moved
    by the counts before it, so no task sorts everything."""
    ranked = ranked.select("id", "y", "score")
    n, cuts = ranked.count(), []
    if n > SINGLE:
        some = ranked.filter(F.pmod(F.xxhash64("score", "id"), F.lit(n // (64 * buckets) or 1)) == 0).filter(F.col("id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
        seen = sorted((-r.score, r.id) for r in some.select("score", "id").distinct().collect())
        cuts = seen[(step := max(1, len(seen) // buckets)) :: step]
    # Null scores come last, those that aren't numbers first.
    after = lambda s, i: F.col("score").isNull() | (F.lit(-s) > F.col("score")) | ((F.lit(-s) == F.col("score")) & (F.lit(i) <= F.col("id")))

    def passed(low: int, high: int) -> Column:
        """How many boundaries a row has passed, between these numbers: halved again and again."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(after(*cuts[middle]), passed(middle + 1, high)).otherwise(passed(low, middle))

    ranged = ranked.withColumn("part", passed(0, len(cuts)))
    offsets = {} if not cuts else {r.part: (r.n, r.p) for r in ranged.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("p")).collect()}
    seen, positives, moved = 0, 0, []
    for k in range(len(cuts) + 1):
        moved.append((seen, positives))
        seen, positives = seen + offsets.get(k, (0, 0))[0], positives + offsets.get(k, (0, 0))[1]
    w = Window.partitionBy("part").orderBy(F.desc("score"), "id")
    pick = lambda j: F.get(F.array(*(F.lit(m[j]).cast("long") for m in moved)), F.col("part"))
    running = F.count_if(F.col("y") == 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ranged.select("id", "y", "score", (F.row_number().over(w) + pick(0)).alias("rank"), (running + pick(1)).alias("hits"))


def average_precision_11pt(ranked: DataFrame) -> DataFrame:
    """avg_precision: mean of the interpolated precision at recall 0, 0.1, ..., 1 (that at 0 is 1); null without positives."""
    with kept(ranked.select("id", "y", "score")) as ranked:
        curve = precision_recall(ranked)
        total = ranked.agg(F.count_if(F.col("y") == 1).alias("total"))
        points = curve.filter("y = 1").crossJoin(F.broadcast(total)).select((F.col("hits") / F.col("rank")).alias("p"), (F.col("hits") / F.col("total")).alias("r"))
        # Fixed value: ten, with a margin for rounding.
        best = points.agg(*(F.max(F.when(F.col("r") * 10.0000001 >= k, F.col("p"))).alias(f"p{k}") for k in range(1, 11))).first()
    mean = None if best.p1 is None else (1.0 + sum(best)) / 11
    return ranked.sparkSession.createDataFrame([(mean,)], "avg_precision double")


def metric_lines(metrics: dict[str, float], grid: int, n: int, correct: int) -> list[str]:
    """Log lines of an evaluation."""
    lines = [f"{grid}-Accuracy: {metrics['accuracy']:.4f} ( {correct} of {n} )"]
    return lines + [f"{grid}-{name}: {metrics[key]:.4f}" for name, key in (("Precision", "precision"), ("Recall", "recall"), ("Fscore", "f1"), ("11ptAvgPrec", "avg_precision")) if metrics.get(key) is not None]


def evaluate(scores: DataFrame) -> dict[str, float]:
    """All measures of a score table."""
    with kept(scores) as scores:
        row = classification_metrics(predict_labels(scores)).first().asDict()
        row["avg_precision"] = average_precision_11pt(scores.filter("label = 1")).first().avg_precision
    return row
