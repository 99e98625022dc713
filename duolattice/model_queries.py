"""Queries over the model operators, and DuckDB SQL that works them out again by going through all alignments.

Pairs are neighbouring runs of three events of a user; the label says whether the second run has the larger largest value. SQL lists
every path of every pair's lattice, with its edit steps, and takes partitions, expectations, losses and gradients from the list.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import lattice
from .operators.latent import SentenceAlignment, WordAlignment
from .operators.machine import Allowed, build
from .plans.objectives import OBJECTIVES, DistributedLoss, ModelSpec, gather_latent, score_examples, vectorize
from .queries import query, table

NO_FINAL = lattice.LatticeOptions(final_features=False)

# Pairs

CHUNKS_SQL = """seqs AS (
    SELECT user_id, list(event_type ORDER BY ts, event_id) AS seq, list(value ORDER BY ts, event_id) AS val FROM events GROUP BY user_id
), chunks AS (
    SELECT user_id * 1000 + c AS id, seq[3 * c + 1 : 3 * c + 3] AS source, seq[3 * c + 4 : 3 * c + 6] AS target,
           CASE WHEN list_max(val[3 * c + 4 : 3 * c + 6]) > list_max(val[3 * c + 1 : 3 * c + 3]) THEN 1 ELSE 0 END AS y
    FROM (SELECT *, unnest(range(0, CAST(ceil(len(seq) / 3.0) AS BIGINT) - 1)) AS c FROM seqs)
)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, target, y."""
    events = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type", "value")))
    seqs = table(spark, sf_dir, "events").groupBy("user_id").agg(events.alias("e")).filter(F.size("e") > 3)
    cut = seqs.select("user_id", "e", F.explode(F.sequence(F.lit(0), F.ceil(F.size("e") / 3).cast("int") - 2)).alias("c"))
    a, b = F.slice("e", 3 * F.col("c") + 1, 3), F.slice("e", 3 * F.col("c") + 4, 3)
    return cut.select((F.col("user_id") * 1000 + F.col("c")).alias("id"), a["event_type"].alias("source"), b["event_type"].alias("target"), (F.array_max(b["value"]) > F.array_max(a["value"])).cast("int").alias("y"))


def weight(feature: str, label: int = 0) -> float:
    """A weight for every feature and label by arithmetic that SQL has too; multiples of 1/64, so that sums of them are exact."""
    return ((ord(feature[2]) * 31 + ord(feature[-1]) * 7 + len(feature) * 17 + label * 29) % 101 - 50) / 64


def weight_sql(feature: str, label: object) -> str:
    return f"(((ascii(substr({feature}, 3, 1)) * 31 + ascii(right({feature}, 1)) * 7 + length({feature}) * 17 + ({label}) * 29) % 101 - 50) / CAST(64 AS DOUBLE))"


# Operations of the machines: name, kind, source and target tokens.
UNIT = [("Del1", "Del", 1, 0), ("Ins1", "Ins", 0, 1), ("Sub11", "Sub", 1, 1), ("Mat11", "Mat", 1, 1)]
REPLACE = [("Del1", "Del", 1, 0), ("Ins1", "Ins", 0, 1), ("Rep11", "Rep", 1, 1)]
TWO = [("Del1", "Del", 1, 0), ("Del2", "Del", 2, 0), ("Ins1", "Ins", 0, 1), ("Ins2", "Ins", 0, 2), ("Sub11", "Sub", 1, 1), ("Mat11", "Mat", 1, 1), ("Sub12", "Sub", 1, 2), ("Sub21", "Sub", 2, 1), ("Sub22", "Sub", 2, 2), ("Mat22", "Mat", 2, 2)]
TWO_REPLACE = [("Del1", "Del", 1, 0), ("Del2", "Del", 2, 0), ("Ins1", "Ins", 0, 1), ("Ins2", "Ins", 0, 2), ("Rep11", "Rep", 1, 1), ("Rep12", "Rep", 1, 2), ("Rep21", "Rep", 2, 1), ("Rep22", "Rep", 2, 2)]
_PHRASES = "source[i + 1 : i + ns]", "target[j + 1 : j + nt]"
_FITS = f"i + ns <= len(source) AND j + nt <= len(target) AND (kind <> 'Mat' OR {_PHRASES[0]} = {_PHRASES[1]}) AND (kind <> 'Sub' OR {_PHRASES[0]} <> {_PHRASES[1]})"


def walk_sql(ops: list[tuple], ban: bool, condition: str = "TRUE", pairs: str = "chunks", name: str = "") -> str:
    """walk: all beginnings of paths with their steps; paths: whole paths, numbered. ban: no deletion right after an insertion."""
    values = ", ".join(f"('{n}', '{k}', {s}, {t}, {r})" for r, (n, k, s, t) in enumerate(ops))
    banned = "AND NOT (kind = 'Del' AND len(steps) > 0 AND steps[len(steps)].op LIKE 'Ins%')" if ban else ""
    phrase = lambda p, n: f"CASE WHEN {n} = 0 THEN '-' ELSE array_to_string({p}, '+') END"
    return f"""ops{name} AS (SELECT * FROM (VALUES {values}) o(op, kind, ns, nt, rank)), walk{name} AS (
    SELECT id, y, source, target, 0 AS i, 0 AS j, CAST([] AS STRUCT(op VARCHAR, s VARCHAR, t VARCHAR, i INTEGER, j INTEGER, rank INTEGER)[]) AS steps FROM {pairs}
    UNION ALL
    SELECT id, y, source, target, CAST(i + ns AS INTEGER), CAST(j + nt AS INTEGER),
           list_append(steps, {{'op': op, 's': {phrase(_PHRASES[0], "ns")}, 't': {phrase(_PHRASES[1], "nt")}, 'i': i, 'j': j, 'rank': CAST(rank AS INTEGER)}})
    FROM walk{name}, ops{name} WHERE {_FITS} {banned} AND {condition}
), paths{name} AS (SELECT *, row_number() OVER () AS path FROM walk{name} WHERE i = len(source) AND j = len(target))"""


# Numbers of paths, by machine

_ALLOWED = {"pattern": Allowed(pattern="[a-m].*"), "other pattern": Allowed(pattern="[a-m].*", accept=False), "lexicons": Allowed(source_lexicon=frozenset({"click+view", "view+click"}), target_lexicon=frozenset({"click+click", "view+click", "click+error"}))}
_NO_PATTERN = "len(list_filter(list_concat({0}, {1}), lambda x: x[1] {2} BETWEEN 'a' AND 'm')) = 0".format
_IN = lambda p, words: f"(len({p}) < 2 OR array_to_string({p}, '+') IN ({words}))"
MACHINES = {
    "order 0": (dict(order=0, exact_match=True), UNIT, False, "TRUE", None),
    "order 1": (dict(order=1, exact_match=True), UNIT, True, "TRUE", None),
    "order 1, redundant": (dict(order=1, exact_match=True, allow_redundant=True), UNIT, False, "TRUE", None),
    "order 2": (dict(order=2, exact_match=True), UNIT, True, "TRUE", None),
    "order 2, replace": (dict(order=2), REPLACE, True, "TRUE", None),
    "order 0, replace": (dict(order=0), REPLACE, False, "TRUE", None),
    "identical": (dict(order=0, exact_match=True, identical_unigrams=True), [o for o in UNIT if o[0] != "Sub11"], False, "TRUE", None),
    "phrases": (dict(order=0, max_source=2, max_target=2, exact_match=True), TWO, False, "TRUE", None),
    "phrases, order 1, replace": (dict(order=1, max_source=2, max_target=2), TWO_REPLACE, True, "TRUE", None),
    "pattern": (dict(order=0), REPLACE, False, _NO_PATTERN(*_PHRASES, "NOT"), "pattern"),
    "other pattern": (dict(order=0), REPLACE, False, _NO_PATTERN(*_PHRASES, ""), "other pattern"),
    "lexicons": (dict(order=1, max_source=2, max_target=2), TWO_REPLACE, True, _IN(_PHRASES[0], "'click+view', 'view+click'") + " AND " + _IN(_PHRASES[1], "'click+click', 'view+click', 'click+error'"), "lexicons"),
}


def _path_counts(spark, sf_dir, names: list[str]) -> DataFrame:
    pairs, out = chunks(spark, sf_dir), None
    plain = WordAlignment(align_ngrams=False, collapsed_ngrams=False, state_ngrams=False)
    for name in names:
        options, _, _, _, allowed = MACHINES[name]
        logs = lattice.infer(pairs, build(**options), plain, {}, "log_partition", NO_FINAL, allowed=_ALLOWED.get(allowed))
        part = logs.select("id", F.lit(name).alias("machine"), F.round(F.exp("value")).cast("long").alias("paths"))
        out = part if out is None else out.unionByName(part)
    return out


def _path_counts_sql(names: list[str]) -> str:
    parts = [walk_sql(MACHINES[n][1], MACHINES[n][2], MACHINES[n][3], name=str(k)) for k, n in enumerate(names)]
    found = " UNION ALL ".join(f"SELECT id, '{n}' AS machine, (SELECT count(*) FROM paths{k} p WHERE p.id = c.id) AS paths FROM chunks c" for k, n in enumerate(names))
    return f"WITH RECURSIVE {CHUNKS_SQL}, {', '.join(parts)} {found}"


_ORDERS = ["order 0", "order 1", "order 1, redundant", "order 2", "order 2, replace"]
_KINDS = ["order 0, replace", "identical", "phrases", "phrases, order 1, replace"]
_CONDITIONS = ["pattern", "other pattern", "lexicons"]


@query(_path_counts_sql(_ORDERS))
def path_counts_by_order(spark, sf_dir):
    return _path_counts(spark, sf_dir, _ORDERS)


@query(_path_counts_sql(_KINDS))
def path_counts_by_operations(spark, sf_dir):
    return _path_counts(spark, sf_dir, _KINDS)


@query(_path_counts_sql(_CONDITIONS))
def path_counts_by_condition(spark, sf_dir):
    return _path_counts(spark, sf_dir, _CONDITIONS)


@query(f"""WITH RECURSIVE {CHUNKS_SQL}, {walk_sql(UNIT, True)}, nodes AS (
    SELECT DISTINCT id, len(source) AS n, len(target) AS m, i, j, CASE WHEN len(steps) > 0 THEN steps[len(steps)].op ELSE 'sta' END AS state FROM walk
), steps_ AS (
    SELECT DISTINCT id, len(steps) > 0 AS made, steps[len(steps)].i AS i, steps[len(steps)].j AS j, steps[len(steps)].op AS op, CASE WHEN len(steps) > 1 THEN steps[len(steps) - 1].op ELSE 'sta' END AS state FROM walk WHERE len(steps) > 0
), ended AS (SELECT id, count(*) AS finals FROM nodes WHERE i = n AND j = m GROUP BY id)
SELECT id, a.nodes + 1 AS nodes, b.edges + finals AS edges
FROM (SELECT id, count(*) AS nodes FROM nodes GROUP BY id) a JOIN (SELECT id, count(*) AS edges FROM steps_ GROUP BY id) b USING (id) JOIN ended USING (id)""")
def lattice_sizes(spark, sf_dir):
    """Nodes (positions and states) and edges of the lattices of order 1, the ones into the goal too."""
    return lattice.infer(chunks(spark, sf_dir), build(1, exact_match=True), WordAlignment(order=1), {}, "size", NO_FINAL)


# Names of latent features

_STEPS = """steps_ AS (
    SELECT source, target, len(steps) AS k, steps[len(steps)] AS p, CASE WHEN len(steps) > 1 THEN steps[len(steps) - 1] ELSE {'op': 'None', 's': '-', 't': '-', 'i': 0, 'j': 0, 'rank': 0} END AS q,
           CASE WHEN len(steps) > 2 THEN steps[len(steps) - 2] WHEN len(steps) = 2 THEN {'op': 'None', 's': '-', 't': '-', 'i': 0, 'j': 0, 'rank': 0} END AS o, i AS i2, j AS j2
    FROM walk WHERE len(steps) > 0
)"""


def _names(spark, sf_dir, order: int, generator) -> DataFrame:
    return gather_latent(chunks(spark, sf_dir), ModelSpec(build(order, exact_match=True), generator, NO_FINAL))


@query(f"""WITH RECURSIVE {CHUNKS_SQL}, {walk_sql(UNIT, True)}, {_STEPS}
SELECT DISTINCT feature FROM (
    SELECT unnest(['S:' || p.op, 'S:' || q.op || '>' || p.op, 'A:' || p.s || '>' || p.t, 'A:' || q.s || '>' || q.t || '_' || p.s || '>' || p.t]) AS feature FROM steps_
    UNION ALL
    SELECT 'C:' || CASE WHEN q.s <> '-' THEN q.s || '_' ELSE '' END || CASE WHEN p.s <> '-' THEN p.s || '_' ELSE '' END || '>' || CASE WHEN q.t <> '-' THEN q.t || '_' ELSE '' END || CASE WHEN p.t <> '-' THEN p.t || '_' ELSE '' END
    FROM steps_ WHERE p.s = '-' OR p.t = '-' OR q.s = '-' OR q.t = '-'
)""")
def latent_feature_names(spark, sf_dir):
    """State n-grams, alignment n-grams, and these without epsilons, of order 1."""
    return _names(spark, sf_dir, 1, WordAlignment(order=1))


@query(f"""WITH RECURSIVE {CHUNKS_SQL}, {walk_sql([("Del1", "Del", 1, 0), ("Ins1", "Ins", 0, 1), ("Sub11", "Sub", 1, 1), ("Mat1", "Mat", 1, 1)], True)}, {_STEPS}
SELECT DISTINCT unnest(list_concat(['S:' || p.op, 'S:' || q.op || '>' || p.op], CASE WHEN o IS NULL THEN [] ELSE ['S:' || o.op || '>' || q.op || '>' || p.op] END)) AS feature FROM steps_""")
def state_trigram_names(spark, sf_dir):
    """State n-grams of order 2."""
    return _names(spark, sf_dir, 2, WordAlignment(order=2, align_ngrams=False, collapsed_ngrams=False))


_WINDOW = "coalesce({0}[{1}], '^') || '+' || {2} || '+' || coalesce({0}[{3} + 1], '$')".format


@query(f"""WITH RECURSIVE {CHUNKS_SQL}, {walk_sql(UNIT, False)}, {_STEPS}
SELECT DISTINCT feature FROM (
    SELECT 'W:' || {_WINDOW("source", "p.i", "p.s", "i2")} || '>' || {_WINDOW("target", "p.j", "p.t", "j2")} AS feature FROM steps_
    UNION ALL SELECT 'Bi:' || p.s || '+' || coalesce(source[i2 + 1], '$') || '>' || p.t FROM steps_ WHERE p.s <> '-'
    UNION ALL SELECT 'Bi:' || p.s || '>' || p.t || '+' || coalesce(target[j2 + 1], '$') FROM steps_ WHERE p.t <> '-'
)""")
def window_feature_names(spark, sf_dir):
    return _names(spark, sf_dir, 0, WordAlignment(align_ngrams=False, collapsed_ngrams=False, state_ngrams=False, window=1, bigrams=True))


_TOKEN_SQL = "list_transform({0}, lambda x: x || '~' || upper(left(x, 1)) || '~' || CAST(length(x) % 3 AS VARCHAR))".format


@query(f"""WITH RECURSIVE {CHUNKS_SQL}, marked AS (SELECT id, y, {_TOKEN_SQL("source")} AS source, {_TOKEN_SQL("target")} AS target FROM chunks), {walk_sql(REPLACE, False, pairs="marked")}, {_STEPS}
SELECT DISTINCT feature FROM (
    SELECT 'S:' || p.op AS feature FROM steps_
    UNION ALL SELECT 'A:' || CASE WHEN p.s = '-' THEN '-' ELSE string_split(p.s, '~')[f] || '+' END || '>' || CASE WHEN p.t = '-' THEN '-' ELSE string_split(p.t, '~')[f] || '+' END FROM steps_, (SELECT unnest([2, 3]) AS f)
)""")
def sentence_feature_names(spark, sf_dir):
    """Features of tokens with two indicators each."""
    mark = lambda c: F.transform(c, lambda x: F.concat(x, F.lit("~"), F.upper(F.substring(x, 1, 1)), F.lit("~"), (F.length(x) % 3).cast("string")))
    pairs = chunks(spark, sf_dir).withColumns({"source": mark("source"), "target": mark("target")})
    return gather_latent(pairs, ModelSpec(build(0), SentenceAlignment(), NO_FINAL))


# Inference. pf: features of each path and how often; ps: its score under the weights of a label.


def features_sql(scale: str, align: bool = True) -> str:
    kinds = "['S:' || p.op, 'A:' || p.s || '>' || p.t]" if align else "['S:' || p.op]"
    return f"""pf AS (
    SELECT id, y, path, feature, count(*) * {scale} AS v, min(size) AS size
    FROM (SELECT id, y, path, greatest(len(source), len(target)) AS size, unnest({kinds}) AS feature FROM (SELECT *, unnest(steps) AS p FROM paths))
    GROUP BY id, y, path, feature
)"""


ONE, SHARE = "CAST(1 AS DOUBLE)", "(CAST(1 AS DOUBLE) / min(size))"
PLAIN = WordAlignment(collapsed_ngrams=False, normalize=False)
SHARED = WordAlignment(collapsed_ngrams=False)
STATES = WordAlignment(align_ngrams=False, collapsed_ngrams=False, normalize=False)


def scores_sql(labels: str) -> str:
    """Scores of paths, log partitions, probabilities of paths and expected features, for each label of the weights."""
    return f"""ps AS (
    SELECT id, y, label, path, sum(v * {weight_sql("feature", "label")}) AS score FROM pf, (SELECT unnest([{labels}]) AS label) GROUP BY id, y, label, path
), tops AS (SELECT id, label, max(score) AS top FROM ps GROUP BY id, label),
z AS (SELECT id, y, label, any_value(top) + ln(sum(exp(score - top))) AS lz, count(*) AS n FROM ps JOIN tops USING (id, label) GROUP BY id, y, label),
q AS (SELECT id, ps.y, label, path, score, exp(score - lz) AS p FROM ps JOIN z USING (id, label)),
ef AS (SELECT id, any_value(pf.y) AS y, label, feature, sum(p * v) AS e FROM q JOIN pf USING (id, path) GROUP BY id, label, feature)"""


def base_sql(scale: str, labels: str, align: bool = True) -> str:
    return f"WITH RECURSIVE {CHUNKS_SQL}, {walk_sql(UNIT, False)}, {features_sql(scale, align)}, {scores_sql(labels)}"


def _vocabulary(pairs: DataFrame, generator) -> list[str]:
    """Names of the latent features of all pairs (a bounded set: kinds of edits and pairs of event types)."""
    return sorted(r.feature for r in gather_latent(pairs, ModelSpec(build(0, exact_match=True), generator, NO_FINAL)).collect())


def _inferred(spark, sf_dir, generator, mode: str, **options) -> DataFrame:
    pairs = chunks(spark, sf_dir)
    weights = {n: weight(n) for n in _vocabulary(pairs, generator)}
    return lattice.infer(pairs, build(0, exact_match=True), generator, weights, mode, NO_FINAL, **options)


@query(base_sql(SHARE, "0") + " SELECT id, feature, round(e, 6) AS value FROM ef")
def expected_features(spark, sf_dir):
    """Expectations of all features, by passes inside and outside."""
    return _inferred(spark, sf_dir, SHARED, "expected").withColumn("value", F.round("value", 6))


@query(base_sql(ONE, "0", align=False) + ", pairs_ AS (SELECT id, a.feature, b.feature AS other, sum(p * a.v * b.v) AS value FROM q JOIN pf a USING (id, path) JOIN pf b USING (id, path) GROUP BY id, a.feature, b.feature), active AS (SELECT DISTINCT id, feature FROM pf) SELECT a.id, a.feature, b.feature AS other, round(coalesce(value, 0), 6) AS value FROM active a JOIN active b ON a.id = b.id LEFT JOIN pairs_ c ON c.id = a.id AND c.feature = a.feature AND c.other = b.feature")
def feature_cooccurrences(spark, sf_dir):
    """Expected products of every two features."""
    return _inferred(spark, sf_dir, STATES, "cooccurrences").withColumn("value", F.round("value", 6))


# The best path takes, of equally good steps, the first operation.
BEST_SQL = "best AS (SELECT id, label, path FROM (SELECT ps.id, label, ps.path, row_number() OVER (PARTITION BY ps.id, label ORDER BY score DESC, list_transform(steps, lambda s: s.rank)) AS r FROM ps JOIN paths USING (id, path)) WHERE r = 1)"


@query(base_sql(ONE, "0") + f", {BEST_SQL} SELECT b.id, feature, v AS value FROM best b JOIN pf USING (id, path)")
def best_path_features(spark, sf_dir):
    return _inferred(spark, sf_dir, PLAIN, "max_features")


@query(base_sql(ONE, "0") + " SELECT id, CAST(r - 1 AS INTEGER) AS rank, score FROM (SELECT id, score, row_number() OVER (PARTITION BY id ORDER BY score DESC) AS r FROM ps) WHERE r <= 5")
def kbest_scores(spark, sf_dir):
    return _inferred(spark, sf_dir, PLAIN, "k_best", k=5).select("id", "rank", F.col("value").alias("score"))


# Objectives: the loss and its gradient at given weights


def _spec(pairs: DataFrame, generator) -> ModelSpec:
    return ModelSpec(build(0, exact_match=True), generator, NO_FINAL, index={n: i for i, n in enumerate(_vocabulary(pairs, generator))})


def _theta(spec: ModelSpec, labels: list[int]) -> np.ndarray:
    return np.array([weight(n, k) for k in labels for n in spec.index])


def _loss(spark, sf_dir, model: str, generator, labels: list[int]) -> DataFrame:
    """label, feature, value: the average loss (feature "loss", label -1), and its derivatives that aren't zero to six places."""
    pairs = chunks(spark, sf_dir)
    spec = _spec(pairs, generator)
    loss, grad = DistributedLoss(OBJECTIVES[model](spec), vectorize(pairs, None, None))(_theta(spec, labels))
    names = [(k, n) for k in labels for n in spec.index]
    rows = [(-1, "loss", float(loss)), *((k, n, float(g)) for (k, n), g in zip(names, grad))]
    return spark.createDataFrame(rows, "label int, feature string, value double").withColumn("value", F.round("value", 6)).filter("value <> 0")


def _loss_sql(scale: str, labels: str, rest: str) -> str:
    """rest: CTEs loss (value) and grad (label, feature, value), both summed over the pairs."""
    return f"""{base_sql(scale, labels)}, total AS (SELECT count(*) AS n FROM chunks), {rest}, rows_ AS (
    SELECT CAST(-1 AS INTEGER) AS label, 'loss' AS feature, round(value / n, 6) AS value FROM loss, total
    UNION ALL SELECT CAST(label AS INTEGER), feature, round(value / n, 6) FROM grad, total
) SELECT * FROM rows_ WHERE value <> 0"""


_BINARY = """s AS (SELECT id, CASE WHEN y = 1 THEN 1.0 ELSE -1.0 END AS t, lz - {0} AS s FROM z),
loss AS (SELECT sum(ln(1 + exp(-t * s))) AS value FROM s),
grad AS (SELECT label, feature, sum(-t / (1 + exp(t * s)) * e) AS value FROM ef JOIN s USING (id) GROUP BY label, feature)""".format


@query(_loss_sql(SHARE, "1", _BINARY("ln(n)")))
def loss_log_linear_binary(spark, sf_dir):
    return _loss(spark, sf_dir, "LogLinearBinary", SHARED, [1])


@query(_loss_sql(SHARE, "1", _BINARY("0")))
def loss_log_linear_binary_unscaled(spark, sf_dir):
    return _loss(spark, sf_dir, "LogLinearBinaryUnscaled", SHARED, [1])


# Probabilities of labels 0 and 1, from a score for each.
_SOFTMAX = """wide AS (SELECT id, y, max(score) FILTER (label = 0) AS a, max(score) FILTER (label = 1) AS b FROM sc GROUP BY id, y),
prob AS (SELECT id, y, greatest(a, b) + ln(1 + exp(-abs(a - b))) AS lse, CASE WHEN y = 0 THEN a ELSE b END AS own, unnest([0, 1]) AS label, unnest([1 / (1 + exp(b - a)), 1 / (1 + exp(a - b))]) AS p FROM wide)"""


@query(_loss_sql(SHARE, "0, 1", f"""sc AS (SELECT id, y, label, lz AS score FROM z), {_SOFTMAX},
loss AS (SELECT sum(lse - own) AS value FROM prob WHERE label = 0),
grad AS (SELECT label, feature, sum((p - CASE WHEN prob.y = label THEN 1 ELSE 0 END) * e) AS value FROM ef JOIN prob USING (id, label) GROUP BY label, feature)"""))
def loss_log_linear_multi(spark, sf_dir):
    return _loss(spark, sf_dir, "LogLinearMulti", SHARED, [0, 1])


# Labels 0 and 1 of the weights are w, 2 and 3 are u of the same labels. cov: covariances with a direction, from each path's value along it.
_COV = """cov AS (SELECT q.id, q.label, feature, sum(p * v * f) - sum(p * v) * any_value(m) AS c FROM (SELECT q.id, q.label - 2 AS label, q.path, q.p, f FROM q JOIN along a ON a.id = q.id AND a.label = q.label - 2 AND a.path = q.path) q
    JOIN pf ON pf.id = q.id AND pf.path = q.path JOIN (SELECT q.id, q.label - 2 AS label, sum(p * f) AS m FROM q JOIN along a ON a.id = q.id AND a.label = q.label - 2 AND a.path = q.path GROUP BY q.id, q.label) m ON m.id = q.id AND m.label = q.label
    GROUP BY q.id, q.label, feature)"""
_ALONG = ("along AS (SELECT id, label - 2 AS label, path, sum(v * ({0})) AS f FROM (SELECT pf.*, label FROM pf, (SELECT unnest([2, 3]) AS label)) GROUP BY id, label, path),\n" + _COV).format


@query(_loss_sql(SHARE, "0, 1, 2, 3", f"""sc AS (SELECT id, y, label - 2 AS label, sum(e * {weight_sql("feature", "label - 2")}) AS score FROM ef WHERE label >= 2 GROUP BY id, y, label), {_SOFTMAX}, {_ALONG(weight_sql("feature", "label - 2"))},
loss AS (SELECT sum(lse - own) AS value FROM prob WHERE label = 0),
grad AS (SELECT ef.label - 2 AS label, feature, sum((p - CASE WHEN prob.y = prob.label THEN 1 ELSE 0 END) * e) AS value FROM ef JOIN prob ON prob.id = ef.id AND prob.label = ef.label - 2 GROUP BY ef.label, feature
    UNION ALL SELECT cov.label + 2, feature, sum((p - CASE WHEN prob.y = prob.label THEN 1 ELSE 0 END) * c) FROM cov JOIN prob ON prob.id = cov.id AND prob.label = cov.label GROUP BY cov.label, feature)"""))
def loss_expected_features(spark, sf_dir):
    """Scores w . E_u[phi]."""
    return _loss(spark, sf_dir, "LogLinearMultiELFV", SHARED, [0, 1, 2, 3])


# The direction is that of w where the sigmoid is as steep as at the expectations; what all scores share (the halves of features) cancels.
@query(_loss_sql(SHARE, "0, 1, 2, 3", f"""bent AS (SELECT id, y, label - 2 AS label, feature, 1 / (1 + exp(-e)) AS m FROM ef WHERE label >= 2),
sc AS (SELECT id, y, label, sum((m - 0.5) * {weight_sql("feature", "label")}) AS score FROM bent GROUP BY id, y, label), {_SOFTMAX},
along AS (SELECT id, label, path, sum(v * m * (1 - m) * {weight_sql("feature", "label")}) AS f FROM pf JOIN bent USING (id, feature) GROUP BY id, label, path), {_COV},
loss AS (SELECT sum(lse - own) AS value FROM prob WHERE label = 0),
grad AS (SELECT label, feature, sum((p - CASE WHEN prob.y = label THEN 1 ELSE 0 END) * (m - 0.5)) AS value FROM bent JOIN prob USING (id, label) GROUP BY label, feature
    UNION ALL SELECT cov.label + 2, feature, sum((p - CASE WHEN prob.y = prob.label THEN 1 ELSE 0 END) * c) FROM cov JOIN prob ON prob.id = cov.id AND prob.label = cov.label GROUP BY cov.label, feature)"""))
def loss_bent_expectations(spark, sf_dir):
    """Scores w . sigmoid(E_u[phi])."""
    return _loss(spark, sf_dir, "LogLinearMultiELFV_sigmoid", SHARED, [0, 1, 2, 3])


@query(_loss_sql(SHARE, "0, 1, 2, 3", f"""sc AS (SELECT id, y, label, lz AS score FROM z WHERE label < 2), {_SOFTMAX}, {_ALONG(weight_sql("feature", "label") + " - " + weight_sql("feature", "label - 2"))},
away AS (SELECT id, sum(e * ({weight_sql("feature", "label")} - {weight_sql("feature", "label - 2")})) AS d FROM ef WHERE label = y + 2 GROUP BY id),
loss AS (SELECT sum(lse + d - lz) AS value FROM prob JOIN away USING (id) JOIN z ON z.id = prob.id AND z.label = prob.y + 2 WHERE prob.label = 0),
grad AS (SELECT label, feature, sum(g) AS value FROM (
    SELECT ef.label, feature, p * e AS g FROM ef JOIN prob ON prob.id = ef.id AND prob.label = ef.label
    UNION ALL SELECT label - 2, feature, -e FROM ef WHERE label = y + 2
    UNION ALL SELECT cov.label + 2, feature, c FROM cov JOIN chunks USING (id) WHERE cov.label = chunks.y) GROUP BY label, feature)"""))
def loss_two_models(spark, sf_dir):
    """The bound with latent vectors from a second model."""
    return _loss(spark, sf_dir, "LogLinearMultiUW", SHARED, [0, 1, 2, 3])


@query(_loss_sql(ONE, "1", f"""{BEST_SQL}, m AS (SELECT b.id, b.path, ps.y, score, CASE WHEN ps.y = 1 THEN score ELSE -score END AS margin FROM best b JOIN ps USING (id, label, path)),
loss AS (SELECT sum(greatest(0, 1 - margin)) AS value FROM m),
grad AS (SELECT 1 AS label, feature, sum(CASE WHEN m.y = 1 THEN -v ELSE v END) AS value FROM m JOIN pf USING (id, path) WHERE margin < 1 GROUP BY feature)"""))
def loss_max_margin_binary(spark, sf_dir):
    return _loss(spark, sf_dir, "MaxMarginBinary", PLAIN, [1])


@query(_loss_sql(ONE, "0, 1", f"""{BEST_SQL}, m AS (SELECT b.id, b.label, b.path, ps.y, score + CASE WHEN b.label <> ps.y THEN 1 ELSE 0 END AS s, score FROM best b JOIN ps USING (id, label, path)),
worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, label) AS r FROM m) WHERE r = 1),
loss AS (SELECT sum(w.s - m.score) AS value FROM worst w JOIN m ON m.id = w.id AND m.label = w.y),
grad AS (SELECT label, feature, sum(g) AS value FROM (SELECT w.label, feature, v AS g FROM worst w JOIN pf USING (id, path) UNION ALL SELECT m.label, feature, -v FROM m JOIN pf USING (id, path) WHERE m.label = m.y) GROUP BY label, feature)"""))
def loss_max_margin_multi(spark, sf_dir):
    return _loss(spark, sf_dir, "MaxMarginMulti", PLAIN, [0, 1])


@query(base_sql(SHARE, "0, 1, 2, 3") + " SELECT CAST(label // 2 AS INTEGER) AS model, id, CAST(y AS INTEGER) AS y, CAST(label % 2 AS INTEGER) AS label, round(lz, 6) AS score FROM z")
def scores_of_two_models(spark, sf_dir):
    """Both labels' scores under two weight vectors, over lattices that are built once."""
    pairs = chunks(spark, sf_dir)
    spec = _spec(pairs, SHARED)
    scores = score_examples(OBJECTIVES["LogLinearMulti"](spec), vectorize(pairs, None, None), [_theta(spec, [0, 1]), _theta(spec, [2, 3])])
    return scores.withColumn("score", F.round("score", 6))
