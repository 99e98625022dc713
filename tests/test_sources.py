import numpy as np
import pytest
from pyspark.sql import functions as F

from duolattice.operators.dictionary import Dictionary
from duolattice.sources import pairs as P
from duolattice.sources import synthetic


def test_word_pairs_are_numbered_in_order(spark, he_tiny_file, he_tiny):
    rows = P.read_pairs(spark, he_tiny_file, "WordPair", first_id=5).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(5, 25))
    assert [(r.source, r.target, r.y) for r in rows] == he_tiny


def test_markers(spark, he_tiny_file):
    r = P.read_pairs(spark, he_tiny_file, "WordPair", markers=True).orderBy("id").first()
    assert r.source == ["^", "0", "1", "2", "$"]
    with pytest.raises(ValueError):
        P.read_pairs(spark, he_tiny_file, "SentencePair", markers=True)
    with pytest.raises(ValueError):
        P.read_pairs(spark, he_tiny_file, "Nothing")


def test_cognate_readers(spark, tmp_path):
    (tmp_path / "c").write_bytes("+ night  nacht\n- ab c\n".encode("latin-1"))
    a = P.read_pairs(spark, str(tmp_path / "c"), "CognatePair").orderBy("id").collect()
    assert [(r.y, "".join(r.source), "".join(r.target)) for r in a] == [(1, "night", "nacht"), (0, "ab", "c")]
    b = P.read_pairs(spark, str(tmp_path / "c"), "CognatePairAligner").orderBy("id").first()
    assert b.edit_distance == 4 and len(b.aligned_source) == len(b.aligned_target)
    (tmp_path / "p").write_text("+ ab ac\ta,a|b,c\n")
    assert P.read_pairs(spark, str(tmp_path / "p"), "PhrasePairs").first().phrase_pairs == ["a,a", "b,c"]


def test_bytes_are_tokens(spark, tmp_path):
    (tmp_path / "l").write_bytes(b"+ \xe9a b\n")
    assert P.read_pairs(spark, str(tmp_path / "l"), "CognatePair").first().source == ["\xe9", "a"]


def test_lexicon(spark, tmp_path):
    (tmp_path / "x").write_text("<s> a\t3\na b </s> 2\nlonely 1\n")
    assert {r.ngram for r in P.read_lexicon(spark, str(tmp_path / "x")).collect()} == {"^+a", "a+b+$", "lonely"}


def test_weights_and_dictionary_files(spark, tmp_path):
    P.write_weights(np.array([0.5, 0.0, -1.0]), spark, str(tmp_path / "w"))
    assert {r.idx: r.weight for r in P.read_weights(spark, str(tmp_path / "w"), 10).collect()} == {10: 0.5, 11: 0.0, 12: -1.0}
    (tmp_path / "dup").write_text("0 1\n0 2.5\n")
    assert P.read_weights(spark, str(tmp_path / "dup")).first().weight == 3.5
    d = Dictionary.fit(spark.createDataFrame([("b",), ("a b",)], "feature string"), [0, 1])
    P.write_dictionary(d.features, [1], str(tmp_path / "d"))
    features, labels = P.read_dictionary(spark, str(tmp_path / "d"))
    assert labels == [1] and {r.feature: r.base_id for r in features.collect()} == {"a b": 0, "b": 1}


def test_predictions_round_trip(spark, tmp_path):
    scores = spark.createDataFrame([(0, 1, 1, 0, -0.2), (0, 1, 1, 1, 0.2)], "id long, y int, yhat int, label int, score double")
    assert P.prediction_lines(scores).first().value == "0 y 1 yHat 1 scores 0 -0.2 1 0.2"
    P.write_predictions(scores, str(tmp_path / "p"))
    assert P.parse_predictions(spark.read.text(str(tmp_path / "p"))).first().scores == {0: -0.2, 1: 0.2}


def test_alignment_sink(spark, tmp_path):
    P.write_alignments(spark.createDataFrame([(3, 1, 0, "block\n")], "id long, y int, label int, block string"), str(tmp_path / "a"))
    assert [r.value for r in spark.read.text(str(tmp_path / "a")).collect()][:2] == ["3 (yi = 1)  y = 0", "block"]


THETA = np.array([7, 8, 11, 1, 9, 2, 6, 3, 12, 10, 4, 5]) / 12


def test_synthetic_model(spark):
    x = np.array([0.0, 1, 2])
    p = synthetic.joint(x, THETA, 2, 2).ravel()
    assert p == pytest.approx([0.43765227644, 0.10613990040, 0.34084393560, 0.11536388756])
    assert synthetic.latent(x, 1, THETA, 2, 2) == pytest.approx([0.74712426727, 0.25287573273])
    row = spark.range(1).select(synthetic.posterior(F.array(*(F.lit(v) for v in x)), THETA.tolist(), 2, 2, 3).alias("p")).first()
    assert row.p == pytest.approx(p)
    phi = np.array([synthetic.phi(x, y, z, 2, 2) for y in range(2) for z in range(2)])
    assert np.allclose(synthetic.phi_mean(x, THETA, 2, 2), p @ phi)
    assert np.allclose(synthetic.phi_covariance(x, THETA, 2, 2), (phi.T * p) @ phi - np.outer(p @ phi, p @ phi))
    q = synthetic.latent(x, 0, THETA, 2, 2)
    assert np.allclose(synthetic.phi_covariance(x, THETA, 2, 2, 0), (phi[:2].T * q) @ phi[:2] - np.outer(q @ phi[:2], q @ phi[:2]))


def test_generated_examples(spark):
    rows = synthetic.generate(spark, 3000, 3, 2, 2, THETA.tolist(), seed=4).collect()
    share = np.mean([r.y for r in rows])
    expected = np.mean([synthetic.joint(np.array(r.x), THETA, 2, 2)[1].sum() for r in rows])
    assert abs(share - expected) < 0.04 and {r.z for r in rows} == {0, 1}
