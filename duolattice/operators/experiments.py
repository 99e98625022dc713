"""What goes around experiments: character alphabets, weight blocks, grids, random settings, splits, logs and line files."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .numbering import with_dense_index


def char_pair_alphabet(pairs: DataFrame) -> DataFrame:
    """base_id, feature, weight: every source with every target character (and -, ^, $), but for (-, -), in order.

    The number of different characters bounds both sides of the product."""
    side = lambda c: pairs.select(F.explode(F.concat(c, F.array(F.lit("-"), F.lit("^"), F.lit("$")))).alias(c)).distinct()
    product = side("source").crossJoin(F.broadcast(side("target"))).filter(~((F.col("source") == "-") & (F.col("target") == "-")))
    # Weights of matches and of substitutions.
    weight = F.when(F.col("source") == F.col("target"), F.log(F.lit(1e8))).when((F.col("source") == "-") | (F.col("target") == "-"), F.lit(0.0)).otherwise(F.log(F.lit(1 / 3)))
    named = product.select(F.concat(F.lit("A:"), "source", F.lit(">"), "target").alias("feature"), weight.alias("weight"))
    return with_dense_index(named, "feature", "base_id").select("base_id", "feature", "weight")


def replicate_weights(w: DataFrame, u: DataFrame, k: int) -> DataFrame:
    """idx, weight of the blocks of k classes, each w then u; with two classes the w of class 0 is negated; zeros are left out.

    w, u: idx, weight."""
    n_w, n_u = (d.agg(F.max("idx")).first()[0] for d in (w, u))
    n_w, n_u = (0 if n_w is None else n_w + 1), (0 if n_u is None else n_u + 1)
    spark = w.sparkSession
    both = w.withColumn("is_w", F.lit(True)).unionByName(u.select((F.col("idx") + n_w).alias("idx"), "weight").withColumn("is_w", F.lit(False)))
    sign = F.when((F.lit(k) == 2) & (F.col("c") == 0) & F.col("is_w"), -1.0).otherwise(1.0)
    blocks = both.crossJoin(F.broadcast(spark.range(k).withColumnRenamed("id", "c")))
    return blocks.select((F.col("c") * (n_w + n_u) + F.col("idx")).cast("long").alias("idx"), (F.col("weight") * sign).alias("weight")).filter("weight <> 0")


def param_grid(spark: SparkSession, options: dict[str, list]) -> DataFrame:
    """One row for each combination of values (as strings), numbered in order of the options as given."""
    rows = [(i, *map(str, c)) for i, c in enumerate(itertools.product(*options.values()))]
    return spark.createDataFrame(rows, ", ".join(["run int", *(f"`{k}` string" for k in options)]))


def param_random(options: dict[str, tuple], n: int, seed: int = 0) -> list[dict]:
    """n random settings. An option is ("float", low, high), ("int", low, high), ("log", low, high), ("bool",) or ("set", values)."""
    r = random.Random(seed)
    draw = {
        "float": lambda a, b: r.uniform(a, b),
        "int": lambda a, b: r.randint(a, b),
        "log": lambda a, b: math.exp(r.uniform(math.log(a), math.log(b))),
        "bool": lambda: r.random() < 0.5,
        "set": lambda values: r.choice(values),
    }
    return [{name: draw[kind](*args) for name, (kind, *args) in options.items()} for _ in range(n)]


def job_scripts(command: str, grid: list[dict]) -> list[str]:
    """A shell script for each setting of a grid."""
    return ["#!/bin/sh\n" + " ".join([command, *(f"--{k}={v}" for k, v in g.items())]) + "\n" for g in grid]


def seed_pool_split(examples: DataFrame, id_col: str = "id", y_col: str = "y") -> DataFrame:
    """Adds part: "seed" for all positives and the first negative, "pool" for the other negatives."""
    first = examples.filter(F.col(y_col) != 1).agg(F.min(id_col).alias("__first"))
    joined = examples.crossJoin(F.broadcast(first))
    return joined.withColumn("part", F.when((F.col(y_col) == 1) | (F.col(id_col) == F.col("__first")), "seed").otherwise("pool")).drop("__first")


def sample_train(examples: DataFrame, size: float, keep_positives: bool = False, negative_ratio: float | None = None, id_col: str = "id", y_col: str = "y", seed: int = 0, order: Column | None = None) -> DataFrame:
    """Adds selected. size: a share (up to 1) or a number of rows; with keep_positives all positives are among them; with
    negative_ratio all positives and that many times as many others are selected. The order is the given one, then
    by id, or else that of a hash of the id; rows are counted one by one, those of the same id too."""
    n = examples.count()
    positives = examples.filter(F.col(y_col) == 1).count()
    hashed = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 30))
    by = [hashed, F.xxhash64(F.lit(seed), id_col), F.col(id_col)] if order is None else [order, F.col(id_col)]
    keep = F.col(y_col) == 1 if keep_positives or negative_ratio is not None else F.lit(False)
    wanted = int(size * n) if size <= 1 else int(size)
    if negative_ratio is not None:
        wanted = int(negative_ratio * positives)
    elif keep_positives:
        wanted = max(0, wanted - positives)
    # A threshold on the hash leaves about the wanted rows (and some more); only those are ranked, at their exact number.
    # Where ids repeat it may leave too few, and all rows are ranked.
    others = examples.filter(~keep)
    n_others = n - positives if keep_positives or negative_ratio is not None else n
    share = min(1.0, 1.2 * wanted / max(1, n_others) + 100 / max(1, n_others))
    near = others if share >= 1 or order is not None else others.filter(hashed < int(share * (1 << 30)))
    if near is not others and near.count() < wanted:
        near = others
    chosen = near.orderBy(*by).limit(wanted).groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("__take"))
    joined = examples.withColumn("__other", ~keep).join(chosen, F.col(id_col).eqNullSafe(F.col("__id")), "left")
    joined = joined.withColumn("__n", F.row_number().over(Window.partitionBy(id_col, "__other").orderBy(y_col)))
    return joined.withColumn("selected", keep | (F.col("__n") <= F.coalesce("__take", F.lit(0)))).drop("__id", "__take", "__other", "__n")


def complement(examples: DataFrame, selected: DataFrame, id_col: str = "id") -> DataFrame:
    """Examples that aren't selected."""
    return examples.join(selected.select(id_col), id_col, "left_anti")


_METRIC = r"^(\d+)-(?:[A-Za-z0-9]+-)?(Accuracy|Precision|Recall|Fscore|11ptAvgPrec): (\S+)"


def parse_metric_lines(lines: DataFrame) -> DataFrame:
    """run, grid, stat, value from log lines (run, value)."""
    part = lambda k: F.regexp_extract("value", _METRIC, k)
    return lines.filter(F.col("value").rlike(_METRIC)).select("run", part(1).cast("int").alias("grid"), part(2).alias("stat"), part(3).cast("double").alias("v")).withColumnRenamed("v", "value")


def pivot_metrics(metrics: DataFrame, options: DataFrame | None = None) -> DataFrame:
    """One row for each run and grid cell, a column for each stat; options (run, ...) are joined on."""
    wide = metrics.groupBy("run", "grid").pivot("stat").agg(F.first("value"))
    return wide if options is None else wide.join(options, "run")


def metrics_table(rows: list[dict], html: bool = False) -> str:
    """Rows as a text or an HTML table."""
    if not rows:
        return ""
    names = list(rows[0])
    cells = [names, *([str(r.get(n, "")) for n in names] for r in rows)]
    if html:
        body = "\n".join("<tr>" + "".join(f"<td>{c}</td>" for c in line) + "</tr>" for line in cells)
        return f"<table>\n{body}\n</table>\n"
    wide = [max(len(line[k]) for line in cells) for k in range(len(names))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(line, wide)).rstrip() for line in cells) + "\n"


def zip_lines(left: DataFrame, right: DataFrame) -> DataFrame:
    """Lines (id, value) of two files side by side, with a tab between, by their number; lines of the first that begin with -- go before it is numbered again."""
    kept = left.filter(~F.col("value").startswith("--"))
    key = F.format_string("%020d", F.col("id"))
    numbered = with_dense_index(kept.withColumn("__k", key), "__k", "n").select(F.col("n").cast("long").alias("id"), F.col("value").alias("a"))
    return right.withColumnRenamed("value", "b").join(numbered, "id").select("id", F.concat_ws("\t", "b", "a").alias("value"))


def eleven_point_from_predictions(lines: list[str]) -> float | None:
    """11-point average precision from lines of a prediction file."""
    rows = []
    for line in lines:
        m = re.match(r"(\d+) y (-?\d+) yHat -?\d+ scores (.*)", line)
        scores = m[3].split()
        rows.append((-dict(zip(scores[::2], map(float, scores[1::2])))["1"], int(m[1]), int(m[2])))
    hits = np.cumsum([y == 1 for _, _, y in sorted(rows)])
    if not len(hits) or not hits[-1]:
        return None
    precision, recall = hits / np.arange(1, len(hits) + 1), hits / hits[-1]
    # Fixed value: ten, with a margin for rounding.
    return float(np.mean([1.0, *(precision[recall * 10.0000001 >= k].max() for k in range(1, 11))]))
