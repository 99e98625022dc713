"""Registered queries over the generic tables, and DuckDB SQL for those that SQL can express.

Words are runs of 3 to 8 letters a-z of the lower-cased documents. Pairs of character sequences are the name and the type of
every part, labelled 1 if their edit distance is at most 8. Event pairs are the event types of a user and of the next user, in
order of time.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .functions.folds import fold_log_partition, fold_viterbi
from .operators import alignment, experiments, lattice, metrics, ngrams, observed
from .operators.dictionary import Dictionary
from .operators.latent import WordAlignment
from .operators.machine import build
from .plans.objectives import different
from .plans.training import Config, train
from .sources.synthetic import posterior

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Helper views

WORDS_SQL = "words AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,8}')) AS word FROM documents)"
DISTINCT_SQL = WORDS_SQL + ", dw AS (SELECT DISTINCT word FROM words)"
GRAMS_SQL = DISTINCT_SQL + """, toks AS (
    SELECT list_concat(['<s>'], list_concat(string_split(word, ''), ['</s>'])) AS t FROM dw
), grams AS (
    SELECT n, array_to_string(t[i : i + n - 1], ' ') AS ngram
    FROM (SELECT t, n, unnest(range(1, len(t) - n + 2)) AS i FROM toks, (SELECT unnest([2, 3]) AS n) WHERE len(t) >= n)
), counts AS (SELECT n, ngram, count(*) AS cnt FROM grams GROUP BY n, ngram)"""
PAIRS_SQL = """pairs AS (
    SELECT p_partkey AS id, p_name AS source, lower(p_type) AS target, CASE WHEN levenshtein(p_name, lower(p_type)) <= 8 THEN 1 ELSE 0 END AS y FROM part
)"""
EVENT_PAIRS_SQL = """seqs AS (
    SELECT user_id, list(event_type ORDER BY ts, event_id) AS seq FROM events GROUP BY user_id
), event_pairs AS (
    SELECT a.user_id AS id, a.seq AS source, b.seq AS target FROM seqs a JOIN seqs b ON b.user_id = a.user_id + 1
)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,8}"), 0)).alias("word"))


def spaced_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("word").distinct().select(ngrams.spaced(F.col("word")).alias("word"))


def gram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.ngram_counts(spaced_words(spark, sf_dir), 2, 3)


def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, target, y: pairs as texts."""
    kind = F.lower("p_type")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("source"), kind.alias("target"), (F.levenshtein(F.col("p_name"), kind) <= 8).cast("int").alias("y"))


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, target, y: a token is a character."""
    chars = lambda c: F.filter(F.split(c, ""), lambda t: t != "")
    return part_texts(spark, sf_dir).withColumns({c: chars(c) for c in ("source", "target")})


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(ordered, lambda e: e["event_type"]).alias("seq"))


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = event_sequences(spark, sf_dir)
    left = seqs.select(F.col("user_id").alias("id"), F.col("seq").alias("source"))
    return left.join(seqs.select((F.col("user_id") - 1).alias("id"), F.col("seq").alias("target")), "id")


# N-gram toolkit


@query(f"WITH {DISTINCT_SQL} SELECT word, array_to_string(string_split(word, ''), ' ') AS spaced FROM dw")
def distinct_words(spark, sf_dir):
    return words(spark, sf_dir).select("word").distinct().select("word", ngrams.spaced(F.col("word")).alias("spaced"))


@query(f"WITH {GRAMS_SQL} SELECT CAST(n AS INTEGER) AS n, ngram, cnt FROM counts")
def char_ngram_counts(spark, sf_dir):
    return gram_counts(spark, sf_dir)


@query(f"""WITH {GRAMS_SQL}, cc AS (SELECT n, cnt, count(*) AS types FROM counts GROUP BY n, cnt)
SELECT CAST(n AS INTEGER) AS n, cnt, types, CAST(sum(types) OVER (PARTITION BY n ORDER BY cnt ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM cc""")
def ngram_count_cdf(spark, sf_dir):
    return ngrams.count_cdf(gram_counts(spark, sf_dir))


@query(f"""WITH {GRAMS_SQL}, cc AS (SELECT n, cnt, count(*) AS types FROM counts GROUP BY n, cnt),
cdf AS (SELECT n, cnt, sum(types) OVER (PARTITION BY n ORDER BY cnt ROWS UNBOUNDED PRECEDING) AS c, sum(types) OVER (PARTITION BY n) AS t FROM cc),
m AS (SELECT n, min(cnt) AS min_count FROM cdf WHERE CAST(c AS DOUBLE) / CAST(t AS DOUBLE) > 0.95 GROUP BY n)
SELECT CAST(n AS INTEGER) AS n, ngram, cnt FROM counts JOIN m USING (n) WHERE cnt >= min_count""")
def ngram_cut_fraction(spark, sf_dir):
    return ngrams.select_ngrams(gram_counts(spark, sf_dir), cut=0.95)


@query(f"""WITH {GRAMS_SQL} SELECT CAST(n AS INTEGER) AS n, ngram, cnt FROM (
SELECT *, row_number() OVER (PARTITION BY n ORDER BY cnt DESC, ngram DESC) AS r FROM counts) WHERE r <= 250""")
def ngram_topk(spark, sf_dir):
    return ngrams.select_ngrams(gram_counts(spark, sf_dir), top=250)


@query(f"""WITH {GRAMS_SQL} SELECT CAST(n AS INTEGER) AS n, ngram, cnt FROM (
SELECT *, sum(cnt) OVER (PARTITION BY n ORDER BY cnt DESC, ngram DESC ROWS UNBOUNDED PRECEDING) AS c, sum(cnt) OVER (PARTITION BY n) AS t FROM counts)
WHERE CAST(c AS DOUBLE) <= 0.25 * CAST(t AS DOUBLE)""")
def ngram_prob_mass(spark, sf_dir):
    return ngrams.select_ngrams(gram_counts(spark, sf_dir), mass=0.25)


@query(f"""WITH {GRAMS_SQL}, lex AS (SELECT ngram FROM (SELECT ngram, row_number() OVER (PARTITION BY n ORDER BY cnt DESC, ngram DESC) AS r FROM counts) WHERE r <= 100)
SELECT CAST(n AS INTEGER) AS n, replace(ngram, ' ', '+') AS ngram, cnt FROM counts WHERE ngram IN (SELECT ngram FROM lex)""")
def lexicon_semi_join(spark, sf_dir):
    counts = gram_counts(spark, sf_dir).withColumn("ngram", F.regexp_replace("ngram", " ", "+"))
    lexicon = ngrams.select_ngrams(gram_counts(spark, sf_dir), top=100).select(F.regexp_replace("ngram", " ", "+").alias("ngram"))
    return ngrams.in_lexicon(counts, lexicon).select("n", "ngram", "cnt")


# Experiment toolkit

ALPHABET_SQL = PAIRS_SQL + """, cs AS (SELECT DISTINCT unnest(list_concat(string_split(source, ''), ['-', '^', '$'])) AS s FROM pairs),
ct AS (SELECT DISTINCT unnest(list_concat(string_split(target, ''), ['-', '^', '$'])) AS t FROM pairs),
alphabet AS (
    SELECT CAST(row_number() OVER (ORDER BY 'A:' || s || '>' || t) - 1 AS INTEGER) AS base_id, 'A:' || s || '>' || t AS feature,
           CASE WHEN s = t THEN ln(1e8) WHEN s = '-' OR t = '-' THEN 0.0 ELSE ln(1.0 / 3.0) END AS weight
    FROM cs, ct WHERE NOT (s = '-' AND t = '-')
)"""


@query(f"WITH {ALPHABET_SQL} SELECT base_id, feature, round(CAST(weight AS DOUBLE), 9) AS weight FROM alphabet")
def char_pair_alphabet(spark, sf_dir):
    return experiments.char_pair_alphabet(part_pairs(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


@query(f"""WITH {ALPHABET_SQL}, size AS (SELECT count(*) AS n FROM alphabet), both_ AS (
    SELECT base_id AS idx, weight, TRUE AS is_w FROM alphabet UNION ALL SELECT base_id + n, weight * 0.5, FALSE FROM alphabet, size
)
SELECT CAST(c * (SELECT 2 * n FROM size) + idx AS BIGINT) AS idx, round(CAST(CASE WHEN c = 0 AND is_w THEN -weight ELSE weight END AS DOUBLE), 9) AS weight
FROM both_, (SELECT unnest([0, 1]) AS c) WHERE weight <> 0""")
def weights_multiclass(spark, sf_dir):
    w = experiments.char_pair_alphabet(part_pairs(spark, sf_dir)).select(F.col("base_id").cast("long").alias("idx"), "weight")
    return experiments.replicate_weights(w, w.withColumn("weight", F.col("weight") * 0.5), 2).withColumn("weight", F.round("weight", 9))


@query("""SELECT CAST(row_number() OVER (ORDER BY o, b, ord) - 1 AS INTEGER) AS run, model, beta, ord AS "order"
FROM (VALUES (0, 'LogLinearMulti'), (1, 'MaxMarginMulti')) x(o, model), (VALUES (0, '0.1'), (1, '1.0'), (2, '10.0')) y(b, beta), (VALUES ('0'), ('1')) z(ord)""")
def param_grid(spark, sf_dir):
    return experiments.param_grid(spark, {"model": ["LogLinearMulti", "MaxMarginMulti"], "beta": [0.1, 1.0, 10.0], "order": [0, 1]})


@query("""SELECT doc_id, toxic AS y, CASE WHEN toxic = 1 OR doc_id = (SELECT min(doc_id) FROM labels WHERE toxic <> 1) THEN 'seed' ELSE 'pool' END AS part FROM labels""")
def al_seed_pool_split(spark, sf_dir):
    return experiments.seed_pool_split(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y")), "doc_id")


SAMPLE_SQL = """marked AS (
    SELECT doc_id, toxic AS y, toxic = 1 OR r <= (SELECT CAST(floor(2 * count(*)) AS BIGINT) FROM labels WHERE toxic = 1) AS selected
    FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic = 1 ORDER BY (doc_id * 7919) % 100003, doc_id) AS r FROM labels)
)"""


def _sampled(spark, sf_dir):
    """All positives and twice as many others, in an order by arithmetic on the id that SQL has too."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"))
    return experiments.sample_train(labels, 1, negative_ratio=2, id_col="doc_id", order=(F.col("doc_id") * 7919) % 100003)


@query(f"WITH {SAMPLE_SQL} SELECT doc_id, y FROM marked WHERE selected")
def sample_negatives(spark, sf_dir):
    return _sampled(spark, sf_dir).filter("selected").drop("selected")


@query(f"WITH {SAMPLE_SQL} SELECT doc_id, y FROM marked WHERE NOT selected")
def split_complement(spark, sf_dir):
    marked = _sampled(spark, sf_dir)
    return experiments.complement(marked.drop("selected"), marked.filter("selected"), "doc_id")


@query("""WITH m AS (SELECT source AS run, 0 AS grid, lang AS stat, avg(n_chars) AS value FROM documents GROUP BY source, lang)
SELECT run, grid, round(max(value) FILTER (stat = 'en'), 4) AS en, round(max(value) FILTER (stat = 'de'), 4) AS de, round(max(value) FILTER (stat = 'fr'), 4) AS fr, round(max(value) FILTER (stat = 'es'), 4) AS es FROM m GROUP BY run, grid""")
def log_metrics_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("run"), F.lit(0).alias("grid"), F.col("lang").alias("stat")).agg(F.avg("n_chars").alias("value"))
    wide = experiments.pivot_metrics(rows)
    return wide.select("run", "grid", *(F.round(c, 4).alias(c) for c in ("en", "de", "fr", "es")))


# Pairs and observed features


@query(f"WITH {PAIRS_SQL} SELECT id, CAST(levenshtein(source, target) AS INTEGER) AS distance FROM pairs")
def levenshtein_unit(spark, sf_dir):
    return part_pairs(spark, sf_dir).select("id", alignment.edit_distance(F.col("source"), F.col("target"), 1).alias("distance"))


@query(f"""WITH RECURSIVE {PAIRS_SQL}, rows_ AS (
    SELECT id, source, target, 0 AS i, range(0, len(target) + 1) AS r FROM pairs
    UNION ALL
    SELECT id, source, target, i + 1, list_reduce(list_concat([[i + 1]], list_transform(range(1, len(target) + 1), lambda j:
        [CASE WHEN source[i + 1] = target[j] THEN r[j] ELSE least(r[j] + 3, r[j + 1] + 1) END, CASE WHEN source[i + 1] = target[j] THEN 1 ELSE 0 END])),
        lambda acc, x: list_append(acc, CASE WHEN x[2] = 1 THEN x[1] ELSE least(x[1], acc[len(acc)] + 1) END))
    FROM rows_ WHERE i < len(source)
)
SELECT id, CAST(r[len(r)] AS INTEGER) AS distance FROM rows_ WHERE i = len(source)""")
def levenshtein_sub3(spark, sf_dir):
    return part_pairs(spark, sf_dir).select("id", alignment.edit_distance(F.col("source"), F.col("target"), 3).alias("distance"))


@query(f"WITH {PAIRS_SQL} SELECT id, round(CAST(levenshtein(source, target) AS DOUBLE) / greatest(length(source), length(target)), 6) AS ned FROM pairs")
def normalized_edit_distance(spark, sf_dir):
    ned = alignment.edit_distance(F.col("source"), F.col("target"), 1) / alignment.pair_size(F.col("source"), F.col("target"))
    return part_pairs(spark, sf_dir).select("id", F.round(ned, 6).alias("ned"))


KR_SQL = PAIRS_SQL + """, ss AS (
    SELECT id, p, array_to_string(string_split(source[p : p + k - 1], ''), '+') AS sub FROM (
        SELECT id, source, k, unnest(range(1, length(source) - k + 2)) AS p FROM pairs, (SELECT unnest([1, 2]) AS k) WHERE length(source) >= k)
), ts AS (
    SELECT id, p, array_to_string(string_split(target[p : p + k - 1], ''), '+') AS sub FROM (
        SELECT id, target, k, unnest(range(1, length(target) - k + 2)) AS p FROM pairs, (SELECT unnest([1, 2]) AS k) WHERE length(target) >= k)
), kr AS (SELECT ss.id, ss.sub || ',' || ts.sub AS feature FROM ss JOIN ts ON ss.id = ts.id AND abs(ss.p - ts.p) <= 1)"""


@query(f"WITH {KR_SQL} SELECT id, feature, count(*) AS cnt FROM kr GROUP BY id, feature")
def kr_substring_pairs(spark, sf_dir):
    return observed.substring_pairs(part_pairs(spark, sf_dir))


@query(f"""WITH {KR_SQL}, both_ AS (
    SELECT id, feature FROM kr UNION ALL SELECT id, regexp_replace(regexp_replace(feature, '[b-df-hj-np-tv-z]', '[C]', 'g'), '[aeiou]', '[V]', 'g') FROM kr
) SELECT id, feature, count(*) AS cnt FROM both_ GROUP BY id, feature""")
def kr_vowel_backoff(spark, sf_dir):
    return observed.substring_pairs(part_pairs(spark, sf_dir), vowels="aeiou")


# Cells of the alignment hold cost and both filled-up sides; of equal costs the diagonal comes first, then a gap in the source.
ALIGNED_SQL = PAIRS_SQL + """, rows_ AS (
    SELECT id, source, target, 0 AS i, list_transform(range(0, len(target) + 1), lambda j: {'c': j, 's': repeat('-', j), 't': left(target, j)}) AS r FROM pairs
    UNION ALL
    SELECT id, source, target, i + 1, list_reduce(list_concat([[{'c': i + 1, 's': left(source, i + 1), 't': repeat('-', i + 1)}]],
        list_transform(range(1, len(target) + 1), lambda j: [
            {'c': r[j].c + CASE WHEN source[i + 1] = target[j] THEN 0 ELSE 3 END, 's': r[j].s || source[i + 1], 't': r[j].t || target[j]},
            {'c': CASE WHEN source[i + 1] = target[j] THEN 1000000 ELSE r[j + 1].c + 1 END, 's': r[j + 1].s || source[i + 1], 't': r[j + 1].t || '-'},
            {'c': CASE WHEN source[i + 1] = target[j] THEN 1000000 ELSE 1 END, 's': '-', 't': target[j]}])),
        lambda acc, x: list_append(acc, CASE
            WHEN x[1].c <= acc[len(acc)].c + x[3].c AND x[1].c <= x[2].c THEN x[1]
            WHEN acc[len(acc)].c + x[3].c <= x[2].c THEN {'c': acc[len(acc)].c + x[3].c, 's': acc[len(acc)].s || x[3].s, 't': acc[len(acc)].t || x[3].t}
            ELSE x[2] END))
    FROM rows_ WHERE i < len(source)
), aligned AS (SELECT id, r[len(r)].s AS s, r[len(r)].t AS t, CAST(r[len(r)].c AS INTEGER) AS edit_distance, greatest(len(source), len(target)) AS size FROM rows_ WHERE i = len(source))"""


@query(f"WITH RECURSIVE {ALIGNED_SQL} SELECT id, s, t, edit_distance FROM aligned")
def aligned_pairs(spark, sf_dir):
    return alignment.align(part_pairs(spark, sf_dir).select("id", "source", "target", "y"), 3).select("id", F.array_join("aligned_source", "").alias("s"), F.array_join("aligned_target", "").alias("t"), "edit_distance")


def _aligned(spark, sf_dir):
    return alignment.align(part_pairs(spark, sf_dir).select("id", "source", "target", "y"), 3)


# Places of the aligned sides, and runs of mismatches that a match ends.
PLACES_SQL = ALIGNED_SQL + """, places AS (
    SELECT id, size, edit_distance, k, s[k] AS a, t[k] AS b, s[k] = t[k] AS hit FROM (SELECT *, unnest(range(1, len(s) + 1)) AS k FROM aligned)
), ended AS (
    SELECT id, k, hit, a, b, coalesce(max(CASE WHEN hit THEN k END) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last FROM places
), runs AS (
    SELECT e.id, e.k, coalesce(c.a, f.a) || coalesce(string_agg(CASE WHEN p.a <> '-' THEN p.a END, '' ORDER BY p.k), '') || e.a AS x,
           coalesce(c.b, f.b) || coalesce(string_agg(CASE WHEN p.b <> '-' THEN p.b END, '' ORDER BY p.k), '') || e.b AS z
    FROM ended e JOIN places p ON p.id = e.id AND p.k > e.last AND p.k < e.k JOIN places f ON f.id = e.id AND f.k = 1 LEFT JOIN places c ON c.id = e.id AND c.k = e.last
    WHERE e.hit GROUP BY e.id, e.k, e.a, e.b, c.a, c.b, f.a, f.b
), mm AS (
    SELECT id, 'MM:' || x || ',' || z AS feature FROM runs
    UNION ALL SELECT id, 'MM:' || coalesce(nullif(x[2 : len(x) - 1], ''), '-') || ',,' || coalesce(nullif(z[2 : len(z) - 1], ''), '-') FROM runs
)"""


@query(f"WITH RECURSIVE {PLACES_SQL} SELECT id, feature, CAST(count(*) AS DOUBLE) AS value FROM mm GROUP BY id, feature")
def mismatch_features(spark, sf_dir):
    rows = observed.bk_word(_aligned(spark, sf_dir), bias=False, normalize=False)
    return rows.filter(F.col("feature").startswith(observed.MISMATCH))


# Windows of one and two tokens of the source with a match; windows of the target move right from the first match until a match outside comes.
PHRASES_SQL = PLACES_SQL + """, lefts AS (
    SELECT id, k, a, hit, row_number() OVER (PARTITION BY id ORDER BY k) AS n FROM places WHERE a <> '-'
), rights AS (
    SELECT id, k, b, hit, row_number() OVER (PARTITION BY id ORDER BY k) AS n, count(*) OVER (PARTITION BY id) AS many FROM places WHERE b <> '-'
), sizes AS (SELECT unnest([1, 2]) AS w), wins AS (
    SELECT l.id, l.n, w, string_agg(m.a, '+' ORDER BY m.n) AS x, list(m.k ORDER BY m.k) FILTER (m.hit) AS linked
    FROM lefts l, sizes JOIN lefts m ON m.id = l.id AND m.n BETWEEN l.n AND l.n + w - 1 GROUP BY l.id, l.n, w HAVING count(*) = w AND count(*) FILTER (m.hit) > 0
), begun AS (
    SELECT v.id, v.n, v.w, v.x, v.linked, z.w AS tw, r.many, greatest(0, r.n - z.w) AS first, greatest(r.n, least(r.many, greatest(0, r.n - z.w) + z.w)) AS stop
    FROM wins v JOIN rights r ON r.id = v.id AND r.k = v.linked[1], sizes z
), moved AS (
    SELECT *, first + d AS lo, stop + d AS hi FROM (SELECT *, unnest(range(0, many - stop + 1)) AS d FROM begun) g
    WHERE NOT EXISTS (SELECT 1 FROM rights o WHERE o.id = g.id AND o.n > g.stop AND o.n <= g.stop + g.d AND o.hit AND NOT list_contains(g.linked, o.k))
), found AS (
    SELECT m.id, m.x || ',' || string_agg(r.b, '+' ORDER BY r.n) AS feature
    FROM moved m JOIN rights r ON r.id = m.id AND r.n > m.lo AND r.n <= m.hi GROUP BY m.id, m.n, m.w, m.tw, m.d, m.x, m.linked
    HAVING list(r.k ORDER BY r.k) FILTER (r.hit) = m.linked
)"""


@query(f"""WITH RECURSIVE {PHRASES_SQL}, bk AS (SELECT id, feature, count(*) AS n FROM found GROUP BY id, feature)
SELECT id, feature, round(CAST(n AS DOUBLE) / size, 6) AS value FROM bk JOIN aligned USING (id)
UNION ALL SELECT id, 'Bias', round(1.0 / size, 6) FROM aligned
UNION ALL SELECT id, 'NED', round(CAST(edit_distance AS DOUBLE) / size, 6) FROM aligned WHERE edit_distance > 0""")
def phrase_pairs_bk(spark, sf_dir):
    return observed.bk_word(_aligned(spark, sf_dir), add_mismatches=False, ned=True).withColumn("value", F.round("value", 6))


@query(f"WITH {KR_SQL}, f AS (SELECT DISTINCT feature FROM kr) SELECT CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS base_id, feature FROM f")
def feature_dictionary(spark, sf_dir):
    return Dictionary.fit(observed.substring_pairs(part_pairs(spark, sf_dir)), [0, 1]).features


# A deterministic weight for every feature: the code of its first character and its length.
WEIGHT_SQL = "((ascii(feature) * 31 + length(feature) * 17) % 101 - 50) / 50.0"
SCORES_SQL = KR_SQL + f""", counts_ AS (SELECT id, feature, count(*) AS cnt FROM kr GROUP BY id, feature), scored AS (
    SELECT p.id, p.y, sum(CAST(cnt AS DOUBLE) / greatest(length(p.source), length(p.target)) * CAST({WEIGHT_SQL} AS DOUBLE)) AS score
    FROM counts_ c JOIN pairs p ON c.id = p.id GROUP BY p.id, p.y
)"""


def _scores(spark, sf_dir):
    """id, y, score: observed features times the deterministic weights."""
    pairs = part_pairs(spark, sf_dir)
    values = observed.kr_word(pairs, bias=False)
    weight = ((F.ascii("feature") * 31 + F.length("feature") * 17) % 101 - 50) / 50.0
    summed = values.groupBy("id").agg(F.sum(F.col("value") * weight).alias("score"))
    return pairs.select("id", "y").join(summed, "id")


@query(f"WITH {SCORES_SQL} SELECT id, y, round(score, 6) AS score FROM scored")
def sparse_dot_scores(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"""WITH {SCORES_SQL}, s AS (SELECT score, CASE WHEN y = 1 THEN 1.0 ELSE -1.0 END AS y FROM scored)
SELECT count(*) AS n, round(avg(ln(1 + exp(-y * score))), 6) AS loss, round(avg(-y * score / (1 + exp(y * score))), 6) AS slope FROM s""")
def logistic_loss_grad(spark, sf_dir):
    """Average logistic loss, and its derivative along the weights themselves."""
    y = F.when(F.col("y") == 1, 1.0).otherwise(-1.0)
    m = y * F.col("score")
    return _scores(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg(S.log1_plus(F.exp(-m))), 6).alias("loss"), F.round(F.avg(-m * (1 - S.sigmoid(m))), 6).alias("slope"))


# Scores that reach a threshold in exact numbers may miss it in sums of doubles, so they are rounded before they are compared.


@query(f"""WITH {SCORES_SQL}, s AS (SELECT round(CASE WHEN y = 1 THEN score ELSE -score END, 9) AS m FROM scored)
SELECT count(*) AS n, round(avg(greatest(0.0, 1 - m)), 6) AS loss, round(avg(CASE WHEN m < 1 THEN -m ELSE 0.0 END), 6) AS slope FROM s""")
def hinge_loss_grad(spark, sf_dir):
    m = F.round(F.when(F.col("y") == 1, F.col("score")).otherwise(-F.col("score")), 9)
    return _scores(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg(S.hinge(1 - m)), 6).alias("loss"), F.round(F.avg(F.when(m < 1, -m).otherwise(0.0)), 6).alias("slope"))


# Log-linear scores of vectors

SOFTMAX_SQL = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT vec_id, label, list_transform(range(0, 8), lambda k: e[k * 8 + 1] * 4 + e[k * 8 + 2] * 2 + e[k * 8 + 3]) AS sc FROM v),
z AS (SELECT vec_id, label, sc, list_max(sc) + ln(list_sum(list_transform(sc, lambda x: exp(x - list_max(sc))))) AS lse FROM s)"""


def _class_scores(spark, sf_dir):
    e = lambda i: F.get("embedding", i).cast("double")
    sc = F.array(*(e(F.lit(k * 8)) * 4 + e(F.lit(k * 8 + 1)) * 2 + e(F.lit(k * 8 + 2)) for k in range(8)))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", sc.alias("sc"))


@query(f"WITH {SOFTMAX_SQL} SELECT vec_id, round(lse - sc[label % 8 + 1], 6) AS loss FROM z")
def multi_softmax_loss(spark, sf_dir):
    scores = _class_scores(spark, sf_dir)
    return scores.select("vec_id", F.round(S.log_sum_exp(F.col("sc")) - F.get("sc", F.col("label") % 8), 6).alias("loss"))


@query(f"""WITH {SOFTMAX_SQL}, p AS (SELECT vec_id, list_transform(sc, lambda x: exp(x - lse)) AS p FROM z)
SELECT vec_id, CAST(i AS INTEGER) AS k, round(p[i + 1], 6) AS p FROM (SELECT vec_id, p, unnest(range(0, 8)) AS i FROM p)""")
def synthetic_posterior(spark, sf_dir):
    """p(y, z | x) of the synthetic model whose eight blocks (two labels, four latent ones) read three components each."""
    scores = _class_scores(spark, sf_dir)
    theta = [float(i == j) for i in range(8) for j in range(8)]
    p = posterior(F.col("sc"), theta, 2, 4, 8)
    return scores.select("vec_id", F.posexplode(p).alias("k", "v")).select("vec_id", "k", F.round("v", 6).alias("p"))


@query(f"WITH {SCORES_SQL} SELECT id, y, CASE WHEN round(score, 9) > 0 THEN 1 ELSE 0 END AS yhat FROM scored")
def argmax_predictions(spark, sf_dir):
    return metrics.predict_labels(_label_scores(spark, sf_dir))


def _label_scores(spark, sf_dir):
    """id, y, label, score."""
    s = F.explode(F.array(F.struct(F.lit(0).alias("label"), (-F.col("score")).alias("score")), F.struct(F.lit(1).alias("label"), F.col("score").alias("score"))))
    return _scores(spark, sf_dir).withColumn("score", F.round("score", 9)).select("id", "y", s.alias("s")).select("id", "y", "s.label", "s.score")


@query(f"""WITH {SCORES_SQL}, p AS (SELECT y, CASE WHEN round(score, 9) > 0 THEN 1 ELSE 0 END AS h FROM scored),
c AS (SELECT count(*) AS n, count(*) FILTER (y = h) AS correct, CAST(count(*) FILTER (y = 1 AND h = 1) AS DOUBLE) AS tp, count(*) FILTER (h = 1) AS np, count(*) FILTER (y = 1) AS pos FROM p),
r AS (SELECT n, correct, CAST(correct AS DOUBLE) / n AS accuracy, coalesce(tp / nullif(np, 0), 0.0) AS precision, coalesce(tp / nullif(pos, 0), 0.0) AS recall FROM c)
SELECT n, correct, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 6) AS f1 FROM r""")
def classification_metrics(spark, sf_dir):
    row = metrics.classification_metrics(metrics.predict_labels(_label_scores(spark, sf_dir)))
    return row.select("n", "correct", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query(f"""WITH {SCORES_SQL}, o AS (SELECT y, row_number() OVER w AS k, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) OVER w AS hits FROM (SELECT id, y, round(score, 6) AS score FROM scored)
    WINDOW w AS (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT CAST(hits AS DOUBLE) / k AS p, CAST(hits AS DOUBLE) / (SELECT count(*) FROM scored WHERE y = 1) AS r FROM o WHERE y = 1),
lv AS (SELECT l, (SELECT max(p) FROM pr WHERE r * 10.0000001 >= l) AS best FROM (SELECT unnest(range(1, 11)) AS l))
SELECT round((1 + sum(best)) / 11, 6) AS avg_precision FROM lv""")
def avg_precision_11pt(spark, sf_dir):
    scores = _scores(spark, sf_dir).withColumn("score", F.round("score", 6))
    return metrics.average_precision_11pt(scores).select(F.round("avg_precision", 6).alias("avg_precision"))


# Lattices over event sequences


def _rows_sql(delete: float, insert: float, substitute: float, match: float, plus: str) -> str:
    """The table of the dynamic program row by row; plus: how two values that reach a cell are joined, as SQL of $a and $b."""
    add = lambda a, b: plus.replace("$a", f"({a})").replace("$b", f"({b})")
    reached = add(f"r[j + 1] + {delete}", f"r[j] + CASE WHEN source[i + 1] = target[j] THEN {match} ELSE {substitute} END")
    return f"""WITH RECURSIVE {EVENT_PAIRS_SQL}, rows_ AS (
    SELECT id, source, target, 0 AS i, list_transform(range(0, len(target) + 1), lambda j: CAST(j AS DOUBLE) * {insert}) AS r FROM event_pairs
    UNION ALL
    SELECT id, source, target, i + 1, list_reduce(list_concat([[r[1] + {delete}]], list_transform(range(1, len(target) + 1), lambda j: [{reached}])),
        lambda acc, x: list_append(acc, {add("x[1]", f"acc[len(acc)] + {insert}")}))
    FROM rows_ WHERE i < len(source)
) SELECT id, round(r[len(r)], 6) AS value FROM rows_ WHERE i = len(source)"""


LOG_ADD = "(greatest($a, $b) + ln(1 + exp(least($a, $b) - greatest($a, $b))))"
EDIT_WEIGHTS = {"S:Del1": -1.0, "S:Ins1": -1.0, "S:Sub11": -0.5, "S:Mat11": 1.0}


@query(_rows_sql(0.0, 0.0, 0.0, 0.0, LOG_ADD))
def alignment_path_count(spark, sf_dir):
    """Log of the number of alignments."""
    return event_pairs(spark, sf_dir).select("id", F.round(fold_log_partition(F.col("source"), F.col("target")), 6).alias("value"))


@query(_rows_sql(-1.0, -1.0, -0.5, 1.0, LOG_ADD))
def alignment_log_partition(spark, sf_dir):
    return event_pairs(spark, sf_dir).select("id", F.round(fold_log_partition(F.col("source"), F.col("target"), -1.0, -1.0, -0.5, 1.0), 6).alias("value"))


@query(_rows_sql(-1.0, -1.0, -0.5, 1.0, "greatest($a, $b)"))
def viterbi_score(spark, sf_dir):
    return event_pairs(spark, sf_dir).select("id", F.round(fold_viterbi(F.col("source"), F.col("target"), -1.0, -1.0, -0.5, 1.0), 6).alias("value"))


def _lattice(pairs: DataFrame, mode: str, **options) -> DataFrame:
    generator = WordAlignment(align_ngrams=False, collapsed_ngrams=False, normalize=False)
    return lattice.infer(pairs, build(0, exact_match=True), generator, EDIT_WEIGHTS, mode, lattice.LatticeOptions(final_features=False), **options)


@query(_rows_sql(-1.0, -1.0, -0.5, 1.0, LOG_ADD))
def lattice_log_partition(spark, sf_dir):
    """As alignment_log_partition, by the general lattice kernel."""
    return _lattice(event_pairs(spark, sf_dir), "log_partition").select("id", F.round("value", 6).alias("value"))


@query(_rows_sql(-1.0, -1.0, -0.5, 1.0, "greatest($a, $b)"))
def lattice_viterbi(spark, sf_dir):
    return _lattice(event_pairs(spark, sf_dir), "viterbi").select("id", F.round("value", 6).alias("value"))


# Rows of both tables, forward over beginnings and backward over what is left, for the part pairs.
FORWARD = "(greatest($a, $b) + ln(1 + exp(least($a, $b) - greatest($a, $b))))"
_join = lambda a, b: FORWARD.replace("$a", f"({a})").replace("$b", f"({b})")
OPS_SQL = f"""WITH RECURSIVE {PAIRS_SQL}, ahead AS (
    SELECT id, source, target, 0 AS i, list_transform(range(0, len(target) + 1), lambda j: CAST(-j AS DOUBLE)) AS r FROM pairs
    UNION ALL
    SELECT id, source, target, i + 1, list_reduce(list_concat([[r[1] - 1]], list_transform(range(1, len(target) + 1), lambda j: [{_join("r[j + 1] - 1", "r[j] + CASE WHEN source[i + 1] = target[j] THEN 1.0 ELSE -0.5 END")}])),
        lambda acc, x: list_append(acc, {_join("x[1]", "acc[len(acc)] - 1")}))
    FROM ahead WHERE i < len(source)
), turned AS (SELECT id, reverse(source) AS source, reverse(target) AS target FROM pairs), back AS (
    SELECT id, source, target, 0 AS i, list_transform(range(0, len(target) + 1), lambda j: CAST(-j AS DOUBLE)) AS r FROM turned
    UNION ALL
    SELECT id, source, target, i + 1, list_reduce(list_concat([[r[1] - 1]], list_transform(range(1, len(target) + 1), lambda j: [{_join("r[j + 1] - 1", "r[j] + CASE WHEN source[i + 1] = target[j] THEN 1.0 ELSE -0.5 END")}])),
        lambda acc, x: list_append(acc, {_join("x[1]", "acc[len(acc)] - 1")}))
    FROM back WHERE i < len(source)
), cells AS (
    SELECT a.id, a.source, a.target, a.i, j, a.r[j + 1] AS alpha, len(a.source) AS n, len(a.target) AS m FROM (SELECT *, unnest(range(0, len(target) + 1)) AS j FROM ahead) a
), total AS (SELECT id, alpha AS z FROM cells WHERE i = n AND j = m), after AS (SELECT id, i AS left_i, j AS left_j, r[j + 1] AS beta FROM (SELECT *, unnest(range(0, len(target) + 1)) AS j FROM back)), used AS (
    SELECT c.id, 'Del1' AS op, exp(alpha - 1 + beta - z) AS p FROM cells c JOIN total USING (id) JOIN after b ON b.id = c.id AND left_i = n - i - 1 AND left_j = m - j
    UNION ALL SELECT c.id, 'Ins1', exp(alpha - 1 + beta - z) FROM cells c JOIN total USING (id) JOIN after b ON b.id = c.id AND left_i = n - i AND left_j = m - j - 1
    UNION ALL SELECT c.id, CASE WHEN source[i + 1] = target[j + 1] THEN 'Mat11' ELSE 'Sub11' END, exp(alpha + CASE WHEN source[i + 1] = target[j + 1] THEN 1.0 ELSE -0.5 END + beta - z)
        FROM cells c JOIN total USING (id) JOIN after b ON b.id = c.id AND left_i = n - i - 1 AND left_j = m - j - 1
) SELECT id, op, round(sum(p), 6) AS expected FROM used GROUP BY id, op"""


@query(OPS_SQL)
def expected_op_counts(spark, sf_dir):
    return _lattice(part_pairs(spark, sf_dir), "expected_ops").select("id", "op", F.round("value", 6).alias("expected"))


# Cells hold the three best ways on from a place, with a letter for each step in order of the machine's moves; the sequences are turned around.
_WAY = "list_transform({0}, lambda c: {{'s': c.s - {1}, 'o': '{2}' || c.o}})".format
KBEST_SQL = f"""WITH RECURSIVE {PAIRS_SQL}, turned AS (SELECT id, reverse(source) AS source, reverse(target) AS target FROM pairs), rows_ AS (
    SELECT id, source, target, 0 AS i, list_transform(range(0, len(target) + 1), lambda j: [{{'s': CAST(j AS DOUBLE), 'o': repeat('b', j)}}]) AS r FROM turned
    UNION ALL
    SELECT id, source, target, i + 1, list_reduce(list_concat([[[{{'s': r[1][1].s + 1, 'o': 'a' || r[1][1].o}}]]],
        list_transform(range(1, len(target) + 1), lambda j: [list_concat({_WAY("r[j + 1]", "-1.0", "a")},
            CASE WHEN source[i + 1] = target[j] THEN {_WAY("r[j]", "1.0", "d")} ELSE {_WAY("r[j]", "-0.5", "c")} END)])),
        lambda acc, x: list_append(acc, list_sort(list_concat(x[1], {_WAY("acc[len(acc)]", "-1.0", "b")}))[1:3]))
    FROM rows_ WHERE i < len(source)
) SELECT id, CAST(k - 1 AS INTEGER) AS rank, round(-c.s, 6) + 0.0 AS score, replace(replace(replace(replace(array_to_string(string_split(c.o, ''), ' '), 'a', 'Del1'), 'b', 'Ins1'), 'c', 'Sub11'), 'd', 'Mat11') AS ops
FROM (SELECT id, k, r[len(r)][k] AS c FROM (SELECT *, unnest(range(1, len(r[len(r)]) + 1)) AS k FROM rows_ WHERE i = len(source)))"""


@query(KBEST_SQL)
def kbest_alignments(spark, sf_dir):
    return _lattice(part_pairs(spark, sf_dir), "k_best", k=3).select("id", "rank", (F.round("value", 6) + 0.0).alias("score"), F.array_join("ops", " ").alias("ops"))


@query("""WITH t AS (SELECT event_type AS cur, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT 'S:' || coalesce(prev, 'None') || '>' || cur AS feature, count(*) AS cnt FROM t GROUP BY 1""")
def bigram_state_transitions(spark, sf_dir):
    """State bigrams of the event sequences, each of which starts at None: events stand for the operations of a path."""
    generator = WordAlignment(order=1, align_ngrams=False, collapsed_ngrams=False)
    steps = event_sequences(spark, sf_dir).select(F.explode(F.transform("seq", lambda e, i: F.struct(F.get("seq", i - 1).alias("prev"), e.alias("cur")))).alias("p"))
    counts = steps.groupBy("p.prev", "p.cur").agg(F.count("*").alias("cnt"))

    def kernel(batches):
        for b in batches:
            rows = []
            for prev, cur, n in zip(*(c.to_pylist() for c in b.columns)):
                history = [(prev or "None", "-", "-"), (cur, "x", "y")]
                rows += [(f, n) for f in generator.names(history, [], [], 0, 0, 0, 0, False) if ">" in f]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["feature", "cnt"])

    return counts.select("prev", "cur", "cnt").mapInArrow(kernel, "feature string, cnt long")


# Training (rows only)


def _trained(spark, sf_dir, **options) -> DataFrame:
    """Objective at the end of training on all part pairs, and measures on them."""
    with different(part_pairs(spark, sf_dir)) as (pairs, _):
        trained = train(pairs, Config(init="zero", **options))
        m = trained.classified(pairs)
    return spark.createDataFrame([(trained.config.model, float(trained.result.value), float(m["accuracy"]), float(m["f1"]))], "model string, objective double, accuracy double, f1 double")


@query()
def train_logreg_obs(spark, sf_dir):
    return _trained(spark, sf_dir, model="LogLinearBinaryObs", latent="Empty", observed="KRWord", beta=0.001, max_iters=12, tolerance=1e-3)


@query()
def train_svm_obs(spark, sf_dir):
    return _trained(spark, sf_dir, model="MaxMarginBinaryObs", latent="Empty", observed="KRWord", beta=0.01, max_iters=12, tolerance=1e-2)


@query()
def train_latent_multi(spark, sf_dir):
    return _trained(spark, sf_dir, model="LogLinearMulti", latent="WordAlignment", no_collapsed_align_ngrams=True, exact_match_state=True, beta=0.001, max_iters=8, tolerance=1e-2)
