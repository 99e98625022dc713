"""Queries over losses of observed features, lattices as graphs, phrase windows and whole training runs, and DuckDB SQL beside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model_queries import CHUNKS_SQL, NO_FINAL, PLAIN, UNIT, _vocabulary, chunks, walk_sql, weight, weight_sql
from .operators import experiments, lattice, metrics, observed
from .operators.dictionary import Dictionary
from .operators.latent import NoLatent
from .operators.machine import build
from .plans.objectives import OBJECTIVES, DistributedLoss, ModelSpec, vectorize
from .plans.training import Config, active_learning, grid_search, resume
from .queries import KR_SQL, ORACLE_SQL, PAIRS_SQL, PHRASES_SQL, _aligned, _label_scores, part_pairs, query
from .sources import pairs as files
from .sources.shared import scratch_path

# Losses of observed features. Weights are multiples of 1/64 and values whole numbers, so margins are exact, those at the kink too.

_WEIGHT_SQL = "(((ascii(feature) * 31 + length(feature) * 17) % 101 - 50) / CAST(64 AS DOUBLE))"
_OBSERVED_SQL = f"""WITH {KR_SQL}, v AS (SELECT id, feature, CAST(count(*) AS DOUBLE) AS v FROM kr GROUP BY id, feature),
s AS (SELECT p.id, CASE WHEN p.y = 1 THEN 1.0 ELSE -1.0 END AS t, coalesce(sum(v * {_WEIGHT_SQL}), 0) AS s FROM pairs p LEFT JOIN v USING (id) GROUP BY p.id, p.y)"""


def _observed_loss_sql(loss: str, slope: str) -> str:
    """loss, slope: of a pair with sign t and score s, the slope along a feature of value 1."""
    return f"""{_OBSERVED_SQL}, rows_ AS (
    SELECT 'loss' AS feature, round(avg({loss}), 6) AS value FROM s
    UNION ALL SELECT feature, round(sum(v * ({slope})) / (SELECT count(*) FROM s), 6) FROM v JOIN s USING (id) GROUP BY feature
) SELECT * FROM rows_ WHERE value <> 0"""


def _observed_loss(spark, sf_dir, model: str) -> DataFrame:
    """feature, value: the average loss (feature "loss") and its derivatives that aren't zero to six places."""
    pairs = part_pairs(spark, sf_dir)
    values = observed.kr_word(pairs, normalize=False, bias=False)
    dictionary = Dictionary.fit(values, [1])
    names = {r.base_id: r.feature for r in dictionary.features.collect()}
    theta = np.array([((ord(names[i][0]) * 31 + len(names[i]) * 17) % 101 - 50) / 64 for i in range(dictionary.size)])
    objective = OBJECTIVES[model](ModelSpec(build(0), NoLatent(), n_features=dictionary.size))
    loss, grad = DistributedLoss(objective, vectorize(pairs, values, dictionary))(theta)
    rows = [("loss", float(loss)), *((names[i], float(g)) for i, g in enumerate(grad))]
    return spark.createDataFrame(rows, "feature string, value double").withColumn("value", F.round("value", 6)).filter("value <> 0")


@query(_observed_loss_sql("greatest(0, -t * s) + ln(1 + exp(-abs(s)))", "-t / (1 + exp(t * s))"))
def loss_logistic_observed(spark, sf_dir):
    return _observed_loss(spark, sf_dir, "LogLinearBinaryObs")


@query(_observed_loss_sql("greatest(0, 1 - t * s)", "CASE WHEN t * s < 1 THEN -t ELSE 0.0 END"))
def loss_hinge_observed(spark, sf_dir):
    return _observed_loss(spark, sf_dir, "MaxMarginBinaryObs")


# Lattices as graphs

_EDGES_SQL = f"""WITH RECURSIVE {CHUNKS_SQL}, {walk_sql(UNIT, False)}, edges AS (
    SELECT DISTINCT id, p.i AS i, p.j AS j, p.op AS op, 'S:' || p.op AS f, 'A:' || p.s || '>' || p.t AS g FROM (SELECT id, steps[len(steps)] AS p FROM walk WHERE len(steps) > 0)
)"""


def _per_lattice(spark, sf_dir, of, schema: str) -> DataFrame:
    """Rows (id, ...) that a function of a batch of lattices, a pair's place in it and the weights gives."""
    pairs = chunks(spark, sf_dir)
    names = _vocabulary(pairs, PLAIN)
    index, vector, machine = {n: i for i, n in enumerate(names)}, np.array([64 * weight(n) for n in names]), build(0, exact_match=True)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 128):
                ids, source, target = (c.to_pylist() for c in b.slice(a, 128).columns)
                lattices = lattice.Batch(list(zip(source, target)), machine, PLAIN, index, NO_FINAL)
                w = lattices.weigh(vector)
                rows = [(i, *of(lattices, p, w)) for p, i in enumerate(ids)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], columns)

    columns = [c.split()[0] for c in schema.split(", ")]
    return pairs.select("id", "source", "target").mapInArrow(kernel, schema)


@query(_EDGES_SQL + f""" SELECT id, op, CAST(64 * ({weight_sql("f", 0)} + {weight_sql("g", 0)}) AS BIGINT) AS weight, count(*) AS edges FROM edges GROUP BY ALL
UNION ALL SELECT id, 'None', 0, 1 FROM chunks""")
def drawn_edges(spark, sf_dir):
    """Lattices drawn as text, and the edges in it: operation, weight (here a whole number), how many."""
    drawn = _per_lattice(spark, sf_dir, lambda b, p, w: (b.graphviz(p, w),), "id long, text string")
    lines = drawn.select("id", F.explode(F.split("text", "\n")).alias("line"))
    shape = r'^\d+ -> \d+ \[label="(\S+) (\S+)"\];$'
    edges = lines.select("id", F.regexp_extract("line", shape, 1).alias("op"), F.regexp_extract("line", shape, 2).alias("w")).filter("op <> ''")
    return edges.groupBy("id", "op", F.col("w").cast("double").cast("long").alias("weight")).agg(F.count("*").alias("edges"))


def _ordered(b: lattice.Batch, p: int, w: np.ndarray) -> tuple[int, int, int]:
    """Nodes, edges that go forward in their order, edges that go back in the reversed one."""
    mine = np.flatnonzero(b.pair == p)
    place = {v: k for k, v in enumerate(lattice.topological_order(b, p))}
    turned = {v: k for k, v in enumerate(lattice.topological_order(b, p, reverse=True))}
    ends = list(zip(b.src[mine].tolist(), b.dst[mine].tolist()))
    return len(place), sum(place[s] < place[d] for s, d in ends), sum(turned[s] > turned[d] for s, d in ends)


@query(_EDGES_SQL + """ SELECT id, (len(source) + 1) * (len(target) + 1) + 1 AS nodes, n + 1 AS forward, n + 1 AS back
FROM chunks JOIN (SELECT id, count(*) AS n FROM edges GROUP BY id) USING (id)""")
def nodes_in_order(spark, sf_dir):
    """All edges go forward in the topological order."""
    return _per_lattice(spark, sf_dir, _ordered, "id long, nodes long, forward long, back long")


# Phrases, and predictions from files


@query(f"""WITH RECURSIVE {PHRASES_SQL.replace("SELECT unnest([1, 2]) AS w", "SELECT unnest([1, 2, 3]) AS w")} SELECT id, feature, CAST(count(*) AS DOUBLE) AS value FROM found GROUP BY id, feature""")
def phrase_windows(spark, sf_dir):
    """Phrase pairs of up to three tokens a side."""
    return observed.bk_word(_aligned(spark, sf_dir), normalize=False, bias=False, add_mismatches=False, size=3)


@query(ORACLE_SQL["avg_precision_11pt"])
def avg_precision_of_files(spark, sf_dir):
    """11-point average precision of predictions that were written and read again."""
    scores = _label_scores(spark, sf_dir).withColumn("score", F.round("score", 6))
    path = scratch_path(spark, "ranked")
    files.write_predictions(scores.join(metrics.predict_labels(scores), ["id", "y"]), path)
    read = files.parse_predictions(spark.read.text(path)).select("id", "y", F.col("scores")[1].alias("score"))
    return metrics.average_precision_11pt(read).select(F.round("avg_precision", 6).alias("avg_precision"))


# Training runs of a model with one weight, that of the bias, whose optimum SQL finds by Newton's steps

BIAS = Config(model="LogLinearBinaryObs", latent="Empty", observed="Bias", init="zero", beta=0.01, tolerance=1e-8)


def _newton_sql(betas: list[float]) -> str:
    return f"""WITH RECURSIVE {PAIRS_SQL}, x AS (SELECT CASE WHEN y = 1 THEN 1.0 ELSE -1.0 END AS t, 1.0 / greatest(length(source), length(target)) AS a FROM pairs), newton AS (
    SELECT 0 AS k, CAST(beta AS DOUBLE) AS beta, CAST(0 AS DOUBLE) AS u FROM (SELECT unnest({betas}) AS beta)
    UNION ALL
    SELECT k + 1, beta, u - (avg(-t * a * q) + beta * u) / (avg(a * a * q * (1 - q)) + beta) FROM (SELECT k, beta, u, t, a, 1 / (1 + exp(t * u * a)) AS q FROM newton, x WHERE k < 20) GROUP BY k, beta, u
), best AS (SELECT beta, u, avg(ln(1 + exp(-t * u * a))) + beta / 2 * u * u AS value, avg(CASE WHEN t * u > 0 THEN 1.0 ELSE 0.0 END) AS accuracy FROM newton, x WHERE k = 20 GROUP BY beta, u)"""


@query(_newton_sql([0.1, 0.01, 0.001]) + " SELECT tolerance, beta, round(value, 5) AS value, round(u, 2) AS bias, round(accuracy, 6) AS accuracy FROM best, (SELECT unnest([CAST(1e-6 AS DOUBLE), 1e-8]) AS tolerance)")
def grid_of_models(spark, sf_dir):
    """Every tolerance with every beta: where training ends, and the accuracy there."""
    pairs = part_pairs(spark, sf_dir).persist()
    found = grid_search(pairs, BIAS, [1e-8, 1e-6], [0.01, 0.1, 0.001], pairs, early_stop=False)
    pairs.unpersist()
    rows = [(t, b, round(float(m.result.value), 5), round(float(m.theta[0]), 2) + 0.0, round(float(e["accuracy"]), 6)) for t, b, m, e in found]
    return spark.createDataFrame(rows, "tolerance double, beta double, value double, bias double, accuracy double")


@query(_newton_sql([BIAS.beta]) + " SELECT run, round(u, 2) AS bias, round(accuracy, 6) AS accuracy FROM best, (SELECT unnest(['trained', 'resumed']) AS run)")
def resumed_models(spark, sf_dir):
    """A model that is trained and saved, and the same read again."""
    pairs, folder, rows = part_pairs(spark, sf_dir).persist(), scratch_path(spark, "model"), []
    for run in ("trained", "resumed"):
        model = resume(spark, pairs, BIAS, folder)
        if (model.result is None) != (run == "resumed"):
            raise RuntimeError(f"the model was not {run}")
        rows.append((run, round(float(model.theta[0]), 2) + 0.0, round(float(model.evaluate(pairs)["accuracy"]), 6)))
    pairs.unpersist()
    return spark.createDataFrame(rows, "run string, bias double, accuracy double")


@query(f"""WITH {PAIRS_SQL}, pool AS (SELECT id, greatest(length(source), length(target)) AS size FROM pairs WHERE y <> 1 AND id > (SELECT min(id) FROM pairs WHERE y <> 1))
SELECT CAST(row_number() OVER (ORDER BY size, id) - 1 AS INTEGER) AS round, id FROM pool ORDER BY size, id LIMIT 3""")
def actively_chosen(spark, sf_dir):
    """Three rounds of active learning from all positive pairs and one other: the bias is positive, so the shortest pairs score highest."""
    split = experiments.seed_pool_split(part_pairs(spark, sf_dir)).persist()
    _, chosen = active_learning(split.filter("part = 'seed'").drop("part"), split.filter("part = 'pool'").drop("part"), BIAS, 3)
    split.unpersist()
    return spark.createDataFrame(list(enumerate(chosen)), "round int, id long")
