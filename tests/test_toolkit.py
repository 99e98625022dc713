import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duolattice.operators import experiments as E
from duolattice.operators import metrics as M
from duolattice.operators import ngrams as N


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ngram_counts(spark):
    words = spark.createDataFrame([("a b",), ("a",)], "word string")
    assert rows(N.ngram_counts(words, 2, 3)) == sorted([(2, "<s> a", 2), (2, "a b", 1), (2, "b </s>", 1), (2, "a </s>", 1), (3, "<s> a b", 1), (3, "a b </s>", 1), (3, "<s> a </s>", 1)])


def test_selection_against_loops(spark):
    r = random.Random(5)
    data = [(n, f"g{n}{i}", r.choice([1, 1, 1, 2, 2, 3, 7, 9])) for n in (1, 2) for i in range(40)]
    df = spark.createDataFrame(data, "n int, ngram string, cnt long")
    for n in (1, 2):
        own = sorted([(c, g) for m, g, c in data if m == n], reverse=True)
        total = sum(c for c, _ in own)
        kept, p = [], 0
        for c, g in own:
            p += c
            if p > 0.3 * total:
                break
            kept.append((n, g, c))
        assert [x for x in rows(N.select_ngrams(df, mass=0.3)) if x[0] == n] == sorted(kept)
        assert [x for x in rows(N.select_ngrams(df, top=5)) if x[0] == n] == sorted((n, g, c) for c, g in own[:5])
        counts = sorted({c for c, _ in own})
        first = next(k for k in counts if sum(c <= k for c, _ in own) / len(own) > 0.6)
        assert [x for x in rows(N.select_ngrams(df, cut=0.6)) if x[0] == n] == sorted((n, g, c) for c, g in own if c >= first)
    with pytest.raises(ValueError):
        N.select_ngrams(df)


def test_lexicon_pipeline(spark):
    pairs = spark.createDataFrame([(list("ab"), list("cd")), (list("ab"), list("ce"))], "source array<string>, target array<string>")
    lex = N.lexicon_pipeline(pairs, 2, 2, mass=None, top=2)
    assert {r.ngram for r in lex["target"].collect()} == {"e+$", "^+c"}
    kept = N.in_lexicon(spark.createDataFrame([("a",), ("a+b",), ("e+$",)], "ngram string"), lex["target"])
    assert {r.ngram for r in kept.collect()} == {"a", "e+$"}
    assert rows(N.distinct_words(pairs, "source")) == [("a b",)]


def test_metrics(spark):
    data = [(1, 1, 0.9), (2, 0, 0.8), (3, 1, 0.7), (4, 0, -0.1), (5, 1, 0.0)]
    scores = spark.createDataFrame([(i, y, k, s if k else -s) for i, y, s in data for k in (0, 1)], "id long, y int, label int, score double")
    predictions = {r.id: r.yhat for r in M.predict_labels(scores).collect()}
    assert predictions == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0}  # ties go to the smallest label
    m = M.evaluate(scores)
    assert (m["accuracy"], m["precision"], m["recall"]) == pytest.approx((0.6, 2 / 3, 2 / 3)) and m["f1"] == pytest.approx(2 / 3)
    best = lambda r: max(p for p, q in ((1, 1 / 3), (2 / 3, 2 / 3), (3 / 4, 1)) if q * 10.0000001 >= r)
    assert m["avg_precision"] == pytest.approx((1 + sum(best(k) for k in range(1, 11))) / 11)
    nothing = M.evaluate(scores.filter("y = 0"))
    assert nothing["precision"] == 0 and nothing["f1"] == 0 and nothing["avg_precision"] is None
    assert M.metric_lines(m, 0, 5, 3)[0] == "0-Accuracy: 0.6000 ( 3 of 5 )"


def test_ranking_in_ranges(spark):
    n = 100_500
    df = spark.range(n).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0).alias("score"))
    got = M.precision_recall(df, 8)
    last = got.orderBy(F.desc("rank")).first()
    assert last["rank"] == n and last.hits == (n + 2) // 3 and got.select("rank").distinct().count() == n
    sample = got.filter("rank = 5000").first()
    above = df.filter((F.col("score") > sample.score) | ((F.col("score") == sample.score) & (F.col("id") <= sample.id)))
    assert above.count() == 5000 and above.filter("y = 1").count() == sample.hits


def test_one_tied_score_is_ranked_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(M, "SINGLE", 100)
    n = 20_000
    tied = spark.range(n).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), F.lit(0.5).alias("score"))
    odd = spark.createDataFrame([(n, 1, None), (n + 1, 0, float("nan")), (None, 1, 0.5)], "id long, y int, score double")
    got = sorted(M.precision_recall(tied.unionByName(odd), 8).collect(), key=lambda r: r.rank)
    # Not a number, then the null id of the tied score, then the ids in order, then the null score.
    assert [r.id for r in got] == [n + 1, None, *range(n), n] and [r.rank for r in got] == list(range(1, n + 4))
    assert got[-1].hits == (n + 2) // 3 + 2


def test_alphabet_and_weight_blocks(spark):
    pairs = spark.createDataFrame([(["a"], ["a", "b"])], "source array<string>, target array<string>")
    got = E.char_pair_alphabet(pairs).orderBy("base_id").collect()
    assert len(got) == 4 * 5 - 1 and [r.feature for r in got] == sorted(r.feature for r in got)
    by = {r.feature: r.weight for r in got}
    assert by["A:a>a"] == pytest.approx(math.log(1e8)) and by["A:a>-"] == 0 and by["A:a>b"] == pytest.approx(math.log(1 / 3))
    w = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 2.0)], "idx long, weight double")
    u = spark.createDataFrame([(0, 5.0)], "idx long, weight double")
    assert rows(E.replicate_weights(w, u, 2)) == [(0, -1.0), (2, -2.0), (3, 5.0), (4, 1.0), (6, 2.0), (7, 5.0)]
    assert len(rows(E.replicate_weights(w, u, 3))) == 9


def test_settings(spark):
    assert [tuple(r) for r in E.param_grid(spark, {"a": [1, 2], "b": ["x"]}).collect()] == [(0, "1", "x"), (1, "2", "x")]
    drawn = E.param_random({"f": ("float", 0, 1), "i": ("int", 2, 4), "l": ("log", 0.1, 10), "b": ("bool",), "s": ("set", ["u", "v"])}, 20, 1)
    assert all(0 <= d["f"] <= 1 and 2 <= d["i"] <= 4 and 0.1 <= d["l"] <= 10 and d["s"] in "uv" for d in drawn)
    assert E.job_scripts("run", [{"a": 1}]) == ["#!/bin/sh\nrun --a=1\n"]


def test_splits(spark):
    df = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(50)], "id long, y int")
    parts = {r.id: r.part for r in E.seed_pool_split(df).collect()}
    assert {i for i, p in parts.items() if p == "seed"} == {*range(0, 50, 5), 1}
    chosen = E.sample_train(df, 0.5).filter("selected")
    assert chosen.count() == 25
    assert E.complement(df, chosen).count() == 25
    assert E.sample_train(df, 20, keep_positives=True).filter("selected").groupBy("y").count().orderBy("y").collect()[1]["count"] == 10
    ratio = E.sample_train(df, 1, negative_ratio=2).filter("selected")
    assert ratio.count() == 30 and ratio.filter("y = 1").count() == 10


def test_samples_of_repeated_ids(spark):
    for seed in range(4):
        # One id holds a third of the rows.
        df = spark.createDataFrame([(max(i, 1000), 0) for i in range(3000)], "id long, y int")
        marked = E.sample_train(df, 0.2, seed=seed)
        assert marked.count() == 3000 and marked.filter("selected").count() == 600
    first = E.sample_train(df.distinct(), 10, order=-F.col("id")).filter("selected")
    assert sorted(r.id for r in first.collect()) == list(range(2990, 3000))


def test_logs(spark):
    lines = spark.createDataFrame([("r1", "0-Accuracy: 0.9000 ( 9 of 10 )"), ("r1", "noise"), ("r1", "0-Eval-Fscore: 0.5"), ("r2", "1-Accuracy: 0.1 ( 1 of 10 )")], "run string, value string")
    wide = E.pivot_metrics(E.parse_metric_lines(lines), spark.createDataFrame([("r1", "b=1"), ("r2", "b=2")], "run string, opts string"))
    got = {r.run: r for r in wide.collect()}
    assert got["r1"].Accuracy == 0.9 and got["r1"].Fscore == 0.5 and got["r2"].Fscore is None and got["r2"].opts == "b=2"
    assert E.metrics_table([{"a": 1, "b": "x"}]) == "a  b\n1  x\n" and "<td>x</td>" in E.metrics_table([{"a": 1, "b": "x"}], html=True)


def test_zipped_lines(spark):
    left = spark.createDataFrame([(0, "p1"), (1, "-- comment"), (2, "p2")], "id long, value string")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "id long, value string")
    assert rows(E.zip_lines(left, right)) == [(0, "a\tp1"), (1, "b\tp2")]


def test_average_precision_of_prediction_files():
    lines = ["0 y 1 yHat 1 scores 0 -0.9 1 0.9", "1 y 0 yHat 1 scores 0 -0.5 1 0.5"]
    assert E.eleven_point_from_predictions(lines) == 1.0 and E.eleven_point_from_predictions(lines[1:]) is None


@pytest.mark.parametrize("name", ["gradient_steps", "estimated_rate", "optima"])
def test_two_features_of_repeated_pairs(spark, name, tmp_path, monkeypatch):
    """Equal pairs are one example of the loss, so many copies of few pairs need no job for each evaluation; the result is that of each pair once."""
    from duolattice import queries as Q
    from duolattice import toolkit_queries
    from duolattice.plans import objectives as J

    part = spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate([("large ring", "LARGE"), ("hot bolt", "ECONOMY"), ("plate", "Plates"), ("a much longer name", "X")])], "p_partkey long, p_name string, p_type string")
    part.write.parquet(str(tmp_path / "one" / "part.parquet"))
    part.crossJoin(spark.range(5)).select((F.col("p_partkey") + 10 * F.col("id")).alias("p_partkey"), "p_name", "p_type").write.parquet(str(tmp_path / "five" / "part.parquet"))
    monkeypatch.setattr(J, "LOCAL_ROWS", 10)
    monkeypatch.delattr(J.DistributedLoss, "__call__")
    with toolkit_queries._two_features(spark, str(tmp_path / "five")) as loss:
        assert len(loss.rows) == 4 and loss.n == 20
    assert rows(Q.QUERIES[name](spark, str(tmp_path / "five"))) == rows(Q.QUERIES[name](spark, str(tmp_path / "one")))


@pytest.fixture
def alike(spark, tmp_path):
    """Six pairs, all different, of two labels and vectors."""
    part = [(1, "abcd", "ABCE"), (2, "efgh", "EFGX"), (3, "ij é", "IJ_é"), (4, "a much longer name", "X"), (5, "a much longer bolt", "Y"), (6, "k\U0001f600lm", "K\U0001f600LN")]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_rate_of_different_pairs_with_equal_vectors(spark, alike):
    """The loss of two features holds different vectors, not different pairs, so many different pairs stay few examples."""
    from duolattice import queries as Q
    from duolattice import toolkit_queries

    with toolkit_queries._two_features(spark, alike) as loss:
        assert loss.n == 6 and sorted((r[2], r[3], r[4], r[5]) for r in loss.rows) == [(0, [0, 1], [1 / 18, 1.0], 2), (1, [0, 1], [0.25, 0.25], 4)]
        assert rows(Q.QUERIES["estimated_rate"](spark, alike)) == [(round(float(toolkit_queries.estimate_rate(loss, np.zeros(2), toolkit_queries.BETA)), 6),)]


def test_optima_of_different_pairs(spark, alike, monkeypatch):
    """Vectors come from their rows, not through a table of features; the three optimizers end at the same place."""
    from duolattice import queries as Q
    from duolattice import toolkit_queries

    monkeypatch.delattr(toolkit_queries.Dictionary, "fit")
    found = rows(Q.QUERIES["optima"](spark, alike))
    assert [r[0] for r in found] == ["bmrm", "lbfgs", "lbfgs, one minibatch"] and len({r[1:] for r in found}) == 1


def test_optima_on_the_cluster(spark, alike, monkeypatch):
    """An evaluation there is a job, so the bundle method must end when its gap is closed, not with its 200 iterations."""
    from duolattice import queries as Q
    from duolattice.plans import objectives as J

    here, calls, evaluate = rows(Q.QUERIES["optima"](spark, alike)), [], J.DistributedLoss.__call__
    monkeypatch.setattr(J, "LOCAL_ROWS", 1)
    monkeypatch.setattr(J.DistributedLoss, "__call__", lambda self, theta: calls.append(1) or evaluate(self, theta))
    assert rows(Q.QUERIES["optima"](spark, alike)) == here and 0 < len(calls) < 100
