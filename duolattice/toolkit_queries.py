"""Queries over functions, readers and sinks, feature options, regularizers, optimizers and tools, and DuckDB SQL beside them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import linalg
from .functions import scalars as S
from .model_queries import CHUNKS_SQL, NO_FINAL, PLAIN, UNIT, _spec, _theta, base_sql, chunks, walk_sql, weight
from .operators import alignment, experiments, metrics, ngrams, observed
from .operators.dictionary import Dictionary, init_weights, transfer_weights
from .plans.objectives import OBJECTIVES, ModelSpec, best_alignments, loss_of_different, vectorize, vectorize_columns
from .plans.optimizers import bmrm, estimate_rate, lbfgs, lbfgs_minibatch, sgd
from .plans.regularizers import L2, NoRegularizer, Regularized, SoftTying
from .operators.latent import NoLatent
from .operators.machine import build
from .queries import ALIGNED_SQL, KR_SQL, PAIRS_SQL, PLACES_SQL, SCORES_SQL, _label_scores, _scores, part_pairs, part_texts, query, spaced_words, table
from .sources import pairs as files
from .sources import synthetic
from .sources.shared import scratch_path

# Functions


@query("""SELECT event_id, round(value + k, 6) AS total, round(value * k, 6) AS product, round(CASE WHEN k > 0 THEN value / k END, 6) AS quotient, round(sqrt(value), 6) AS root, round(value, 6) AS same
FROM (SELECT event_id, value, event_id % 5 AS k FROM events)""")
def log_arithmetic(spark, sf_dir):
    """Sums, products, quotients and roots of numbers that are held as logarithms; zero is held as minus infinity."""
    log = lambda c: F.when(c == 0, S.NEG_INF).otherwise(F.log(c))
    k = F.col("event_id") % 5
    a, b = log(F.col("value")), log(k.cast("double"))
    back = lambda c: F.round(F.exp(c), 6)
    return table(spark, sf_dir, "events").select("event_id", back(S.log_add(a, b)).alias("total"), back(S.log_mul(a, b)).alias("product"), F.when(k > 0, back(S.log_div(a, b))).alias("quotient"), back(S.log_sqrt(a)).alias("root"), back(S.log_abs(a)).alias("same"))


@query("""SELECT event_id, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(ln(1 + value), 6) AS log1, round(greatest(0.0, x), 6) AS hinge, CASE WHEN event_id % 3 <> event_id % 2 THEN 1.0 ELSE 0.0 END AS delta
FROM (SELECT *, value / 10 - 2 AS x FROM events)""")
def scalar_losses(spark, sf_dir):
    x = F.col("value") / 10 - 2
    return table(spark, sf_dir, "events").select("event_id", F.round(S.sigmoid(x), 6).alias("sigmoid"), F.round(S.log1_plus(F.col("value")), 6).alias("log1"), F.round(S.hinge(x), 6).alias("hinge"), S.delta(F.col("event_id") % 3, F.col("event_id") % 2).alias("delta"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS e FROM embeddings),
c AS (SELECT vec_id, e, list_transform(range(1, len(e) + 1), lambda i: list_sum(e[1:i])) AS s FROM v),
f AS (SELECT *, coalesce(list_position(list_transform(s, lambda x: round(x, 9) > 1), TRUE), 0) - 1 AS k FROM c)
SELECT vec_id, round(list_sum(list_transform(e, lambda x: exp(x))), 6) AS exps, round(list_sum(list_filter(list_transform(e, lambda x: ln(x + 1)), lambda x: TRUE)), 6) AS logs, round(list_sum(e), 6) AS total,
       round(s[len(s)], 6) AS last, CAST(k AS INTEGER) AS first, CAST(floor(k / 8.0) AS INTEGER) AS "row", CAST(k % 8 AS INTEGER) AS col FROM f""")
def array_functions(spark, sf_dir):
    e = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e")).withColumn("s", S.cumsum(F.col("e")))
    rows = rows.withColumn("first", S.first_index_gt(F.transform("s", lambda x: F.round(x, 9)), 1.0))
    place = S.ind2sub("first", 8)
    return rows.select("vec_id", F.round(S.vec_sum(S.vec_exp(F.col("e"))), 6).alias("exps"), F.round(S.vec_sum(S.vec_log(F.transform("e", lambda x: x + 1))), 6).alias("logs"), F.round(S.vec_sum(F.col("e")), 6).alias("total"), F.round(F.element_at("s", -1), 6).alias("last"), "first", place["row"].alias("row"), place["col"].alias("col"))


def _algebra(x: np.ndarray) -> dict[str, float]:
    """A number for each operation of linear algebra on a vector."""
    n = len(x)
    outer, logs = np.outer(x, x), x[:, None] + x[None, :]
    w = linalg.WeightVector()
    for i, v in enumerate(x):
        w.set(i, v)
    w.add(0, 1.0)
    w.scale(2.0)
    p = linalg.Parameters(3, 2, 2, 1)
    p.set_all(x)
    p.add(p.index_u(), 1.0)
    zero = linalg.WeightVector(x.copy())
    zero.zero()
    return {
        "log_exp": linalg.log_vector(linalg.exp_vector(x)).sum(),
        "exp_matrix": linalg.exp_matrix(outer).sum(),
        "log_add": np.exp(linalg.log_add(x, x[::-1])).sum(),
        "add_exponentiated": linalg.add_exponentiated(x.copy(), x, 0.5).sum(),
        "subtract": (linalg.subtract(x, x[::-1]) ** 2).sum(),
        "add_outer_lower_log": np.exp(linalg.add_outer_lower_log(np.full((n, n), -np.inf), np.log(2.0), x, x)).sum(),
        "add_lower_triangular": linalg.add_lower_triangular(np.zeros((n, n)), outer).sum(),
        "add_scaled": linalg.add_scaled(x.copy(), x, -3.0).sum(),
        "symmetric_product": linalg.symmetric_product(np.tril(outer), x, x).sum(),
        "lower_covariance": linalg.lower_covariance(logs, x).sum(),
        "scale_rows": linalg.scale_rows_by_sigmoid_slope(outer, linalg.sigmoid_vector(x)).sum(),
        "lower_to_symmetric": linalg.lower_to_symmetric(np.tril(outer)).sum(),
        "sigmoid_vector": linalg.sigmoid_vector(x).sum(),
        "inner_dense": w.inner(x),
        "inner_sparse": w.inner({0: 1.0, n - 1: 2.0}),
        "inner_empty": linalg.WeightVector().inner(x),
        "squared_l2": w.squared_l2(),
        "zero": zero.squared_l2(),
        "parameters_inner": p.inner(x),
        "parameters_parts": p.w.sum() + 2 * p.u.sum() + 3 * p.shared_w.sum() + 4 * p.shared_u.sum(),
        "parameters_starts": float(p.index_w() + 10 * p.index_u() + 100 * p.index_shared_w() + 1000 * p.index_shared_u() + 10_000 * len(p)),
        "numerical_gradient": linalg.numerical_gradient(lambda t: float((t**2).sum() + t[0] * t[1]), x, 1),
    }


_EIGHT = "list_transform(range(0, 8), lambda k: list_sum(list_transform(embedding[8 * k + 1 : 8 * k + 8], lambda x: CAST(x AS DOUBLE))))"
_PAIRED = "list_sum(list_transform(range(1, 9), lambda i: list_sum(list_transform(range(1, {0}), lambda j: {1}))))".format
_SUMMED = "list_sum(list_transform(range(1, 9), lambda i: {0}))".format
_ALGEBRA_SQL = {
    "log_exp": _SUMMED("x[i]"), "exp_matrix": _PAIRED("9", "exp(x[i] * x[j])"), "log_add": _SUMMED("exp(x[i]) + exp(x[9 - i])"),
    "add_exponentiated": _SUMMED("x[i] + 0.5 * exp(x[i])"), "subtract": _SUMMED("(x[i] - x[9 - i]) * (x[i] - x[9 - i])"),
    "add_outer_lower_log": _PAIRED("i + 1", "2 * exp(x[i] + x[j])"), "add_lower_triangular": _PAIRED("i + 1", "x[i] * x[j]"), "add_scaled": _SUMMED("-2 * x[i]"),
    "symmetric_product": _SUMMED("x[i]") + " + " + _PAIRED("9", "x[i] * x[j] * x[j]"), "lower_covariance": _PAIRED("i + 1", "exp(x[i] + x[j]) - x[i] * x[j]"),
    "scale_rows": _PAIRED("9", "x[i] * x[j] / (1 + exp(-x[i])) * (1 - 1 / (1 + exp(-x[i])))"), "lower_to_symmetric": _PAIRED("9", "x[i] * x[j]"), "sigmoid_vector": _SUMMED("1 / (1 + exp(-x[i]))"),
    "inner_dense": _SUMMED("2 * x[i] * x[i]") + " + 2 * x[1]", "inner_sparse": "2 * (x[1] + 1) + 4 * x[8]", "inner_empty": "0.0", "squared_l2": _SUMMED("4 * x[i] * x[i]") + " + 8 * x[1] + 4", "zero": "0.0",
    "parameters_inner": _SUMMED("x[i] * x[i]") + " + x[4]", "parameters_parts": "x[1] + x[2] + x[3] + 2 * (x[4] + 1 + x[5]) + 3 * (x[6] + x[7]) + 4 * x[8]", "parameters_starts": "87530.0", "numerical_gradient": "2 * x[2] + x[1]",
}


@query(f"WITH v AS (SELECT vec_id, {_EIGHT} AS x FROM embeddings) " + " UNION ALL ".join(f"SELECT vec_id, '{n}' AS operation, round(CAST({e} AS DOUBLE), 5) AS value FROM v" for n, e in _ALGEBRA_SQL.items()))
def linear_algebra(spark, sf_dir):
    """The kernels' linear algebra on the eight block sums of every vector."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, name, round(float(v), 5) + 0.0) for i, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for name, v in _algebra(np.array(e, float).reshape(8, -1).sum(1)).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.float64()))], ["vec_id", "operation", "value"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(kernel, "vec_id long, operation string, value double")


_THETA = [0.7, 0.8, 1.1, 0.1, 0.9, 0.2, 0.6, 0.3]


@query("""WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
s AS (SELECT *, [exp(0.7 * a + 0.8 * b), exp(1.1 * a + 0.1 * b), exp(0.9 * a + 0.2 * b), exp(0.6 * a + 0.3 * b)] AS s FROM v),
p AS (SELECT *, list_transform(s, lambda x: x / list_sum(s)) AS p, [s[3] / (s[3] + s[4]), s[4] / (s[3] + s[4])] AS r FROM s)
SELECT vec_id, round(p[1] * a + 2 * p[1] * b + 3 * p[2] * a + 4 * p[2] * b + 5 * p[3] * a + 6 * p[3] * b + 7 * p[4] * a + 8 * p[4] * b, 6) AS mean,
       round(5 * r[1] * a + 6 * r[1] * b + 7 * r[2] * a + 8 * r[2] * b, 6) AS mean_given,
       round(p[1] * (1 - p[1]) * a * a, 6) AS variance, round(-p[1] * p[2] * a * b, 6) AS covariance, round(-r[1] * r[2] * a * b, 6) AS covariance_given,
       round(r[1], 6) AS latent, round(p[4], 6) AS joint, round(a + 10 * b, 6) AS phi FROM p""")
def synthetic_moments(spark, sf_dir):
    """Features, posteriors, means and covariances of the synthetic model with two labels and two latent ones."""
    names = ["mean", "mean_given", "variance", "covariance", "covariance_given", "latent", "joint", "phi"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta, count = np.array(_THETA), np.arange(1, 9)
        for b in batches:
            out = []
            for e in b.column(1).to_pylist():
                x = np.array(e[:2], float)
                cov, given = synthetic.phi_covariance(x, theta, 2, 2), synthetic.phi_covariance(x, theta, 2, 2, 1)
                out.append([synthetic.phi_mean(x, theta, 2, 2) @ count, synthetic.phi_mean(x, theta, 2, 2, 1) @ count, cov[0, 0], cov[0, 3], given[4, 7], synthetic.latent(x, 1, theta, 2, 2)[0], synthetic.joint(x, theta, 2, 2)[1, 1], synthetic.phi(x, 1, 0, 2, 2)[4:6] @ [1, 10]])
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in np.round(np.array(out), 6).T)], ["vec_id", *names])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(kernel, "vec_id long, " + ", ".join(f"{n} double" for n in names))


# Readers and sinks. Files go to the shared folder and are read again.


def _written(lines: DataFrame, name: str) -> str:
    path = scratch_path(lines.sparkSession, name)
    lines.write.text(path)
    return path


_JOINED = "array_to_string({0}, ' ')".format


@query(f"WITH {CHUNKS_SQL} SELECT '^ ' || {_JOINED('source')} || ' $' AS source, '^ ' || {_JOINED('target')} || ' $' AS target, y, count(*) AS cnt FROM chunks GROUP BY ALL")
def read_word_pairs(spark, sf_dir):
    """Lines of label and tokens, read with begin and end markers."""
    lines = chunks(spark, sf_dir).select(F.concat_ws("\t", F.col("y").cast("string"), F.array_join("source", " "), F.array_join("target", " ")).alias("value"))
    read = files.read_pairs(spark, _written(lines, "word-pairs"), "WordPair", markers=True)
    return read.groupBy(F.array_join("source", " ").alias("source"), F.array_join("target", " ").alias("target"), "y").agg(F.count("*").alias("cnt"))


@query(f"WITH {CHUNKS_SQL} SELECT count(*) AS n, count(*) AS ids, CAST(100 AS BIGINT) AS first, 99 + count(*) AS last FROM chunks")
def line_ids(spark, sf_dir):
    """Ids of the lines of many files: dense, from the first id on."""
    lines = chunks(spark, sf_dir).select(F.concat_ws("\t", F.lit("1"), F.array_join("source", " "), F.array_join("target", " ")).alias("value"))
    read = files.read_pairs(spark, _written(lines.repartition(7), "sentence-pairs"), "SentencePair", first_id=100)
    return read.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("first"), F.max("id").alias("last"))


COGNATES_SQL = ALIGNED_SQL.replace("p_name AS source", "replace(p_name, ' ', '') AS source")


@query(f"WITH RECURSIVE {COGNATES_SQL} SELECT p.source, p.target, p.y, s, t, edit_distance, p.target || ',x|' || p.source || ',y' AS phrases, count(*) AS cnt FROM aligned JOIN pairs p USING (id) GROUP BY ALL")
def read_cognate_pairs(spark, sf_dir):
    """Lines of sign, words and phrase pairs; words are read by character and aligned."""
    pairs = part_pairs(spark, sf_dir).select("y", F.replace(F.array_join("source", ""), F.lit(" "), F.lit("")).alias("s"), F.array_join("target", "").alias("t"))
    lines = pairs.select(F.format_string("%s %s %s\t%s,x|%s,y", F.when(F.col("y") == 1, "+").otherwise("-"), "s", "t", "t", "s").alias("value"))
    read = files.read_pairs(spark, _written(lines, "phrase-pairs"), "PhrasePairs")
    text = [F.array_join(a, "").alias(b) for a, b in (("source", "source"), ("target", "target"), ("aligned_source", "s"), ("aligned_target", "t"))]
    return read.select(*text, "y", "edit_distance", F.array_join("phrase_pairs", "|").alias("phrases")).groupBy("source", "target", "y", "s", "t", "edit_distance", "phrases").agg(F.count("*").alias("cnt"))


@query("""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source)
SELECT DISTINCT '^+' || lang || '+' || source || '+$' AS ngram FROM c UNION SELECT DISTINCT lang FROM c""")
def read_lexicon(spark, sf_dir):
    """Lines of n-grams with sentence marks and counts."""
    counts = table(spark, sf_dir, "documents").groupBy("lang", "source").count()
    lines = counts.select(F.explode(F.array(F.format_string("<s> %s %s </s>\t%d", "lang", "source", "count"), F.format_string("%s\t%d", "lang", "count"))).alias("value"))
    return files.read_lexicon(spark, _written(lines, "lexicon"))


@query(f"WITH {KR_SQL}, f AS (SELECT DISTINCT feature FROM kr) SELECT CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS base_id, feature, 2 AS labels, round({'((length(feature) * 13) % 31 - 15) / 8.0'}, 6) AS weight FROM f")
def dictionary_files(spark, sf_dir):
    """A dictionary and weights, written and read again."""
    fitted = Dictionary.fit(observed.substring_pairs(part_pairs(spark, sf_dir)), [0, 1])
    path = scratch_path(spark, "dictionary")
    files.write_dictionary(fitted.features, fitted.labels, f"{path}/features")
    features, labels = files.read_dictionary(spark, f"{path}/features")
    rows = fitted.features.select("base_id", F.concat_ws(" ", "base_id", ((F.length("feature") * 13) % 31 - 15) / 8.0).alias("value"))
    rows.select("value").write.text(f"{path}/weights")
    return features.join(files.read_weights(spark, f"{path}/weights").withColumnRenamed("idx", "base_id"), "base_id").select("base_id", "feature", F.lit(len(labels)).alias("labels"), F.round("weight", 6).alias("weight"))


@query(f"WITH {SCORES_SQL} SELECT id, y, CASE WHEN round(score, 9) > 0 THEN 1 ELSE 0 END AS yhat, round(-score, 6) AS zero, round(score, 6) AS one FROM scored")
def prediction_files(spark, sf_dir):
    """Predictions, written and read again."""
    scores = _label_scores(spark, sf_dir)
    path = scratch_path(spark, "predictions")
    files.write_predictions(scores.join(metrics.predict_labels(scores), ["id", "y"]), path)
    read = files.parse_predictions(spark.read.text(path))
    return read.select("id", "y", "yhat", F.round(F.col("scores")[0], 6).alias("zero"), F.round(F.col("scores")[1], 6).alias("one"))


@query(base_sql("CAST(1 AS DOUBLE)", "0, 1") + """, best AS (SELECT id, label, path, score FROM (SELECT ps.*, row_number() OVER (PARTITION BY ps.id, label ORDER BY score DESC, list_transform(steps, lambda s: s.rank)) AS r FROM ps JOIN paths USING (id, path)) WHERE r = 1)
SELECT b.id, CAST(b.label AS INTEGER) AS label, array_to_string(list_transform(steps, lambda s: s.s), ' ') AS s, array_to_string(list_transform(steps, lambda s: s.t), ' ') AS t,
       CAST(len(list_filter(steps, lambda s: s.s = '-')) + len(list_filter(steps, lambda s: s.t = '-')) AS INTEGER) AS gaps FROM best b JOIN paths p ON p.id = b.id AND p.path = b.path""")
def printed_alignments(spark, sf_dir):
    """Best alignments of each label as printed blocks, parsed again."""
    pairs = chunks(spark, sf_dir)
    spec = _spec(pairs, PLAIN)
    blocks = best_alignments(OBJECTIVES["LogLinearMulti"](spec), pairs, _theta(spec, [0, 1]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, label, " ".join(s), " ".join(t), gaps) for i, label, block in zip(*(c.to_pylist() for c in b.columns)) for s, t, gaps in alignment.parse_alignments(block)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32()))], ["id", "label", "s", "t", "gaps"])

    return blocks.select("id", "label", "block").mapInArrow(kernel, "id long, label int, s string, t string, gaps int")


@query(f"""WITH {PAIRS_SQL} SELECT id, array_to_string(string_split(source, ''), '_') || '~' || array_to_string(string_split(target, ''), '_') AS key, CAST(greatest(length(source), length(target)) - 2 AS INTEGER) AS size,
source LIKE 's%t' AS marked FROM pairs""")
def pair_keys(spark, sf_dir):
    """Keys of pairs, sizes without markers, and whether a side begins and ends with markers (here s and t stand for them)."""
    swap = F.transform("source", lambda x: F.when(x == "s", "^").when(x == "t", "$").otherwise(x))
    return part_pairs(spark, sf_dir).select("id", alignment.hash_string(F.col("source"), F.col("target")).alias("key"), alignment.pair_size(F.col("source"), F.col("target"), markers=True).alias("size"), alignment.has_markers(F.concat(F.array(F.lit("-")), swap, F.array(F.lit("-")))).alias("marked"))


# Options of observed features

_OFFSET_SQL = KR_SQL.replace("ss.sub || ',' || ts.sub AS feature", """CASE WHEN length(p.source) > length(p.target)
    THEN ss.sub || CASE WHEN ss.p <> ts.p THEN '[' || CAST(ss.p - ts.p AS VARCHAR) || ']' ELSE '' END || ',' || ts.sub
    ELSE ss.sub || ',' || ts.sub || CASE WHEN ss.p <> ts.p THEN '[' || CAST(ts.p - ss.p AS VARCHAR) || ']' ELSE '' END END AS feature""").replace("FROM ss JOIN ts ON", "FROM ss JOIN pairs p ON p.id = ss.id JOIN ts ON")


@query(f"WITH {_OFFSET_SQL} SELECT id, feature, count(*) AS cnt FROM kr GROUP BY id, feature")
def kr_encoded_offsets(spark, sf_dir):
    return observed.substring_pairs(part_pairs(spark, sf_dir), encode_offset=True)


_DASHED = "list_transform(string_split({0}, ''), lambda x: CASE WHEN x IN ('e', ' ') THEN '-' ELSE x END)".format
_SUBS = """{0} AS (SELECT id, p, array_to_string(list_filter(t[p : p + k - 1], lambda x: x <> '-'), '+') AS sub
    FROM (SELECT id, t, k, unnest(range(1, len(t) - k + 2)) AS p FROM (SELECT id, {1} AS t FROM pairs), (SELECT unnest([1, 2]) AS k) WHERE len(t) >= k) WHERE t[p + k - 1] <> '-')""".format


@query(f"WITH {PAIRS_SQL}, {_SUBS('ss', _DASHED('source'))}, {_SUBS('ts', _DASHED('target'))} SELECT ss.id, ss.sub || ',' || ts.sub AS feature, count(*) AS cnt FROM ss JOIN ts ON ss.id = ts.id AND abs(ss.p - ts.p) <= 1 GROUP BY ss.id, feature")
def kr_without_epsilons(spark, sf_dir):
    """Substrings that end in an epsilon (here the letter e and spaces stand for it) are left out, epsilons within others too."""
    dash = lambda c: F.transform(c, lambda x: F.when(x.isin("e", " "), "-").otherwise(x))
    return observed.substring_pairs(part_pairs(spark, sf_dir).withColumns({"source": dash("source"), "target": dash("target")}), ignore_epsilon=True)


@query(f"""WITH {CHUNKS_SQL}, sides AS (SELECT id, f, greatest(len(source), len(target)) AS size, list_transform(source, lambda x: CASE WHEN f = 1 THEN left(x, 2) ELSE CAST(length(x) AS VARCHAR) END) AS s, list_transform(target, lambda x: CASE WHEN f = 1 THEN left(x, 2) ELSE CAST(length(x) AS VARCHAR) END) AS t FROM chunks, (SELECT unnest([1, 2]) AS f)),
ss AS (SELECT id, f, size, p, array_to_string(s[p : p + k - 1], '+') AS sub FROM (SELECT *, unnest(range(1, len(s) - k + 2)) AS p FROM sides, (SELECT unnest([1, 2]) AS k) WHERE len(s) >= k)),
ts AS (SELECT id, f, p, array_to_string(t[p : p + k - 1], '+') AS sub FROM (SELECT *, unnest(range(1, len(t) - k + 2)) AS p FROM sides, (SELECT unnest([1, 2]) AS k) WHERE len(t) >= k))
SELECT ss.id, ss.sub || ',' || ts.sub AS feature, round(CAST(count(*) AS DOUBLE) / any_value(size), 6) AS value FROM ss JOIN ts ON ss.id = ts.id AND ss.f = ts.f AND abs(ss.p - ts.p) <= 1 GROUP BY ss.id, feature
UNION ALL SELECT id, 'Bias', round(1.0 / greatest(len(source), len(target)), 6) FROM chunks""")
def kr_sentence_features(spark, sf_dir):
    mark = lambda c: F.transform(c, lambda x: F.concat(x, F.lit("~"), F.substring(x, 1, 2), F.lit("~"), F.length(x).cast("string")))
    pairs = chunks(spark, sf_dir).withColumns({"source": mark("source"), "target": mark("target")})
    return observed.observed_features(pairs, "KRSentence").withColumn("value", F.round("value", 6))


@query(f"""WITH RECURSIVE {PLACES_SQL}, named AS (SELECT id, unnest(['p,q', 'p,q', CASE WHEN id % 2 = 0 THEN 'even,x' ELSE 'odd,x' END]) AS feature FROM pairs UNION ALL SELECT id, feature FROM mm)
SELECT id, feature, CAST(count(*) AS DOUBLE) AS value FROM named GROUP BY id, feature UNION ALL SELECT id, 'Bias', 1.0 FROM pairs UNION ALL SELECT id, 'NED', round(CAST(edit_distance AS DOUBLE) / size, 6) FROM aligned WHERE edit_distance > 0""")
def given_phrase_features(spark, sf_dir):
    """Phrases that came with the pairs, mismatches, bias and normalised edit distance."""
    phrases = F.array(F.lit("p,q"), F.lit("p,q"), F.when(F.col("id") % 2 == 0, "even,x").otherwise("odd,x"))
    aligned = alignment.align(part_pairs(spark, sf_dir), 3).withColumn("phrase_pairs", phrases)
    return observed.observed_features(aligned, "BKPhrasePairs", ned=True, normalize=False).withColumn("value", F.round("value", 6))


@query(f"WITH {CHUNKS_SQL} SELECT id, 'Bias' AS feature, round(1.0 / greatest(len(source), len(target)), 6) AS value FROM chunks")
def bias_features(spark, sf_dir):
    pairs = chunks(spark, sf_dir)
    return observed.observed_features(pairs, "Bias").unionByName(observed.observed_features(pairs, "Empty")).withColumn("value", F.round("value", 6))


# Dictionaries and first weights

_NAMES_SQL = f"""WITH RECURSIVE {CHUNKS_SQL}, {walk_sql(UNIT, False)}, names AS (
    SELECT DISTINCT unnest(['S:' || p.op, 'A:' || p.s || '>' || p.t]) AS feature FROM (SELECT steps[len(steps)] AS p FROM walk WHERE len(steps) > 0)
), numbered AS (SELECT CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS base_id, feature FROM names)"""


def _latent_dictionary(spark, sf_dir) -> Dictionary:
    names = list(_spec(chunks(spark, sf_dir), PLAIN).index)
    return Dictionary.fit(spark.createDataFrame([(n,) for n in names], "feature string"), [0, 1])


@query(_NAMES_SQL + """ SELECT base_id, feature, l AS label, round((2.0 * l - 1) * 2 / 3 * CASE WHEN feature LIKE 'S:Mat%' OR (feature LIKE 'A:%' AND split_part(feature[3:], '>', 1) = split_part(feature, '>', 2)) THEN 1 ELSE -1 END, 6) AS weight FROM numbered, (SELECT unnest([0, 1]) AS l)""")
def heuristic_weights(spark, sf_dir):
    """First weights by the meaning of features, for both labels."""
    d = _latent_dictionary(spark, sf_dir)
    theta = init_weights("heuristic", d)
    return spark.createDataFrame([(r.base_id, r.feature, y, round(float(theta[d.index(r.base_id, y)]), 6)) for r in d.features.collect() for y in d.labels], "base_id int, feature string, label int, weight double")


@query(_NAMES_SQL + """, fresh AS (SELECT feature FROM names UNION SELECT 'S:New'), again AS (SELECT row_number() OVER (ORDER BY feature) - 1 AS k, feature FROM fresh)
SELECT CAST(k AS INTEGER) AS base_id, a.feature, l AS label, CASE WHEN n.feature IS NULL OR l = 2 THEN 0.0 ELSE l * 1000.0 + n.base_id + 1 END AS weight FROM again a LEFT JOIN numbered n USING (feature), (SELECT unnest([0, 1, 2]) AS l)""")
def transferred_weights(spark, sf_dir):
    """Weights of an earlier model in the places of a larger dictionary with one more label."""
    old = _latent_dictionary(spark, sf_dir)
    weights = np.array([1000.0 * y + i + 1 for y in old.labels for i in range(old.size)])
    new = Dictionary.union([old, Dictionary.fit(spark.createDataFrame([("S:New",)], "feature string"), [2])])
    theta = transfer_weights(old, weights, new)
    return spark.createDataFrame([(r.base_id, r.feature, y, float(theta[new.index(r.base_id, y)])) for r in new.features.collect() for y in new.labels], "base_id int, feature string, label int, weight double")


# Regularizers at the weights of the latent features

_W = "((((ascii(substr(feature, 3, 1)) * 31 + ascii(right(feature, 1)) * 7 + length(feature) * 17 + label * 29) % 101 - 50) / CAST(64 AS DOUBLE)))"


@query(_NAMES_SQL + f""", w AS (SELECT feature, label, {_W} AS w FROM names, (SELECT unnest([0, 1, 2]) AS label)),
t AS (SELECT a.feature, a.label, a.w, s.w AS shared FROM w a JOIN w s ON s.feature = a.feature AND s.label = 2 WHERE a.label < 2)
SELECT 'L2' AS regularizer, round(sum(0.15 * w * w), 6) AS value, round(sum(abs(0.3 * w)), 6) AS slope FROM t
UNION ALL SELECT 'L2, two betas', round(sum(CASE WHEN label = 0 THEN 0.1 ELSE 0.2 END * w * w), 6), round(sum(abs(CASE WHEN label = 0 THEN 0.2 ELSE 0.4 END * w)), 6) FROM t
UNION ALL SELECT 'None', 0.0, 0.0
UNION ALL SELECT 'SoftTying', round((SELECT sum(0.25 * (w - shared) * (w - shared)) FROM t) + (SELECT sum(0.05 * w * w) FROM w WHERE label = 2), 6),
    round((SELECT sum(abs(0.5 * (w - shared))) FROM t) + (SELECT sum(abs(g)) FROM (SELECT 0.1 * any_value(shared) - sum(0.5 * (w - shared)) AS g FROM t GROUP BY feature)), 6)""")
def regularizer_values(spark, sf_dir):
    """Penalty, and the sum of the absolute slopes."""
    names = list(_spec(chunks(spark, sf_dir), PLAIN).index)
    theta = np.array([weight(n, y) for y in (0, 1) for n in names])
    shared = np.array([weight(n, 2) for n in names])
    rows = [(n, *r(t)) for n, r, t in (("L2", L2(0.3), theta), ("L2, two betas", L2(w_beta=0.2, u_beta=0.4, width=len(names)), theta), ("None", NoRegularizer(), theta), ("SoftTying", SoftTying(2, len(names), False, 1.0, 0.5, 0.5, 0.1, 0.1), np.concatenate([theta, shared])))]
    return spark.createDataFrame([(n, round(float(v), 6), round(float(np.abs(g).sum()), 6)) for n, v, g in rows], "regularizer string, value double, slope double")


# Optimizers: a model of two observed features, whose optimum SQL finds by Newton's steps and whose plain steps it repeats

_TWO_SQL = f"""{PAIRS_SQL}, x AS (SELECT CASE WHEN y = 1 THEN 1.0 ELSE -1.0 END AS t, 1.0 / greatest(length(source), length(target)) AS a, CAST(levenshtein(source, target) AS DOUBLE) / greatest(length(source), length(target)) AS b FROM pairs)"""
BETA = 0.01
_NEWTON_SQL = f"""WITH RECURSIVE {_TWO_SQL}, newton AS (
    SELECT 0 AS k, CAST(0 AS DOUBLE) AS u, CAST(0 AS DOUBLE) AS v
    UNION ALL
    SELECT k + 1, u - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), v - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM (
        SELECT k, u, v, avg(-t * a * q) + {BETA} * u AS g1, avg(-t * b * q) + {BETA} * v AS g2, avg(a * a * q * (1 - q)) + {BETA} AS h11, avg(a * b * q * (1 - q)) AS h12, avg(b * b * q * (1 - q)) + {BETA} AS h22
        FROM (SELECT k, u, v, t, a, b, 1 / (1 + exp(t * (u * a + v * b))) AS q FROM newton, x WHERE k < 15) GROUP BY k, u, v)
), best AS (SELECT u, v, avg(ln(1 + exp(-t * (u * a + v * b)))) + {BETA / 2} * (u * u + v * v) AS value FROM newton, x WHERE k = 15 GROUP BY u, v)"""


@contextmanager
def _two_features(spark, sf_dir):
    """The loss of logistic regression on a bias and the normalised edit distance. Pairs of equal labels and vectors are one, with their number."""
    with loss_of_different(OBJECTIVES["LogLinearBinaryObs"](ModelSpec(build(0), NoLatent(), n_features=2)), _two_vectors(part_texts(spark, sf_dir))) as loss:
        yield loss


def _two_vectors(texts):
    """Tokens are characters, so lengths and distances are those of the texts, and no arrays of tokens are made."""
    size = F.greatest(F.char_length("source"), F.char_length("target"))
    vectors = vectorize_columns(texts, {observed.BIAS: 1.0 / size, observed.NED: F.levenshtein("source", "target") / size})
    # The loss doesn't read the texts; without them equal vectors of different pairs are equal.
    return vectors.withColumns({c: F.lit(None).cast("array<string>") for c in ("source", "target")})


@query(_NEWTON_SQL + """, o AS (SELECT unnest(['lbfgs', 'lbfgs, one minibatch', 'bmrm']) AS optimizer) SELECT optimizer, round(value, 5) AS value, round(u, 2) AS bias, round(v, 2) AS ned FROM o, best""")
def optima(spark, sf_dir):
    """Where the convex optimizers end."""
    zero = np.zeros(2)
    with _two_features(spark, sf_dir) as loss:
        penalised = Regularized(loss, L2(BETA))
        found = {"lbfgs": lbfgs(penalised, zero, 1e-9), "lbfgs, one minibatch": lbfgs_minibatch(lambda k, e: Regularized(loss.minibatch(1, k, e), L2(BETA)), zero, batches=1, epochs=6, per_batch=40, tol=1e-9), "bmrm": bmrm(loss, zero, BETA, 1e-13, 200)}
    return spark.createDataFrame([(n, round(float(r.value), 5), round(float(r.theta[0]), 2) + 0.0, round(float(r.theta[1]), 2)) for n, r in found.items()], "optimizer string, value double, bias double, ned double")


@query(f"""WITH RECURSIVE {_TWO_SQL}, steps AS (
    SELECT 0 AS k, CAST(0 AS DOUBLE) AS u, CAST(0 AS DOUBLE) AS v
    UNION ALL
    SELECT k + 1, (1 - {BETA} * eta) * u - eta * g1, (1 - {BETA} * eta) * v - eta * g2 FROM (
        SELECT k, u, v, 2.0 / (1 + 2.0 * {BETA} * k) AS eta, avg(-t * a / (1 + exp(t * (u * a + v * b)))) AS g1, avg(-t * b / (1 + exp(t * (u * a + v * b)))) AS g2 FROM steps, x WHERE k < 25 GROUP BY k, u, v)
) SELECT round(u, 6) AS bias, round(v, 6) AS ned FROM steps WHERE k = 25""")
def gradient_steps(spark, sf_dir):
    """Twenty-five steps of gradient descent with falling rates (one minibatch)."""
    with _two_features(spark, sf_dir) as loss:
        r = sgd(lambda k, e: loss, np.zeros(2), BETA, 1, rate=2.0, epochs=25)
    return spark.createDataFrame([(round(float(r.theta[0]), 6), round(float(r.theta[1]), 6))], "bias double, ned double")


@query(f"""WITH RECURSIVE {_TWO_SQL}, tried AS (SELECT n, 0.1 * pow(2.0, n) AS rate FROM (SELECT unnest(range(0, 14)) AS n)), steps AS (
    SELECT n, rate, 0 AS k, CAST(0 AS DOUBLE) AS u, CAST(0 AS DOUBLE) AS v FROM tried
    UNION ALL
    SELECT n, rate, k + 1, (1 - {BETA} * eta) * u - eta * g1, (1 - {BETA} * eta) * v - eta * g2 FROM (
        SELECT n, rate, k, u, v, rate / (1 + rate * {BETA} * k) AS eta, avg(-t * a / (1 + exp(t * (u * a + v * b)))) AS g1, avg(-t * b / (1 + exp(t * (u * a + v * b)))) AS g2 FROM steps, x WHERE k < 3 GROUP BY n, rate, k, u, v)
), ended AS (SELECT n, rate, avg(ln(1 + exp(-t * (u * a + v * b)))) + {BETA / 2} * (u * u + v * v) AS value FROM steps, x WHERE k = 3 GROUP BY n, rate, u, v),
good AS (SELECT * FROM ended WHERE n < 10 AND n < coalesce((SELECT min(n) FROM ended WHERE value >= ln(2)), 99))
SELECT round(0.5 * arg_min(rate, value), 6) AS rate FROM good""")
def estimated_rate(spark, sf_dir):
    """Half of the best of the improving rates."""
    with _two_features(spark, sf_dir) as loss:
        rate = estimate_rate(loss, np.zeros(2), BETA)
    return spark.createDataFrame([(round(float(rate), 6),)], "rate double")


# Tools


@query(f"""WITH {CHUNKS_SQL}, sides AS (SELECT 'source' AS side, source AS t FROM chunks UNION ALL SELECT 'target', target FROM chunks), dw AS (SELECT DISTINCT side, t FROM sides),
toks AS (SELECT side, list_concat(['<s>'], list_concat(t, ['</s>'])) AS t FROM dw),
grams AS (SELECT side, n, array_to_string(t[i : i + n - 1], ' ') AS ngram FROM (SELECT *, unnest(range(1, len(t) - n + 2)) AS i FROM toks, (SELECT unnest([2, 3]) AS n) WHERE len(t) >= n)),
counts AS (SELECT side, n, ngram, count(*) AS cnt FROM grams GROUP BY ALL)
SELECT side, replace(replace(replace(ngram, '</s>', '$'), '<s>', '^'), ' ', '+') AS ngram FROM (SELECT *, row_number() OVER (PARTITION BY side, n ORDER BY cnt DESC, ngram DESC) AS r FROM counts) WHERE r <= 12""")
def side_lexicons(spark, sf_dir):
    """From pairs to lexicons of both sides."""
    found = ngrams.lexicon_pipeline(chunks(spark, sf_dir), top=12)
    return found["source"].withColumn("side", F.lit("source")).unionByName(found["target"].withColumn("side", F.lit("target"))).select("side", "ngram")


@query("""SELECT 'run' || CAST(k % 4 AS VARCHAR) AS run, CAST(k // 4 AS INTEGER) AS grid, stat, v AS value
FROM (SELECT l_.doc_id AS k, unnest(['Accuracy', 'Fscore', '11ptAvgPrec']) AS stat, unnest([0.25 + (doc_id % 7) / 16.0, 0.5, (doc_id % 3) / 4.0]) AS v FROM labels l_)""")
def metric_logs(spark, sf_dir):
    """Measures from log lines, among other lines."""
    labels = table(spark, sf_dir, "labels").select("doc_id").collect()
    lines = [(f"run{i % 4}", line) for (i,) in labels for line in [*metrics.metric_lines({"accuracy": 0.25 + i % 7 / 16, "f1": 0.5, "avg_precision": i % 3 / 4}, i // 4, 10, 5), "Done"]]
    return experiments.parse_metric_lines(spark.createDataFrame(lines, "run string, value string"))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, text AS value FROM (SELECT doc_id, lang || CAST(doc_id AS VARCHAR) AS text FROM documents WHERE doc_id % 3 <> 0)),
b AS (SELECT doc_id AS id, source AS value FROM documents) SELECT b.id, b.value || chr(9) || a.value AS value FROM b JOIN a USING (id)""")
def zipped_lines(spark, sf_dir):
    """Lines of two files side by side; comment lines of the first are dropped before it is numbered."""
    docs = table(spark, sf_dir, "documents")
    left = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("--"), "lang")).otherwise(F.concat("lang", F.col("doc_id").cast("string"))).alias("value"))
    return experiments.zip_lines(left, docs.select(F.col("doc_id").alias("id"), F.col("source").alias("value")))
