import random
from collections import Counter

import pytest

from duolattice.operators import observed as O
from duolattice.operators.alignment import align
from duolattice.operators.dictionary import Dictionary, init_weights, transfer_weights
from duolattice.operators.latent import vowel_classes
from duolattice.operators.numbering import with_dense_index
from duolattice.operators import numbering

SCHEMA = "id long, source array<string>, target array<string>"


def values(df):
    return {(r.id, r.feature): r.value for r in df.collect()}


def brute_pairs(s, t, size, offset, encode=False, ignore=False):
    """Substring pairs by plain loops."""

    def subs(x, i):
        out, kept = [], []
        for j in range(size):
            if i + j < len(x) and not (ignore and x[i + j] == "-"):
                kept.append(x[i + j])
                out.append("+".join(kept))
        return out

    turned = len(s) > len(t)
    short, long = (t, s) if turned else (s, t)
    out = Counter()
    for i in range(len(short)):
        for j in range(-offset, offset + 1):
            if 0 <= i + j < len(long):
                for a in subs(short, i):
                    for b in subs(long, i + j):
                        b = f"{b}[{j}]" if encode and j else b
                        out[f"{b},{a}" if turned else f"{a},{b}"] += 1
    return out


@pytest.mark.parametrize("encode, ignore", [(False, False), (True, False), (False, True)])
def test_substring_pairs(spark, encode, ignore):
    r = random.Random(2)
    rows = [(i, r.choices("ab-", k=r.randint(1, 5)), r.choices("ab-", k=r.randint(1, 5))) for i in range(25)]
    got = O.substring_pairs(spark.createDataFrame(rows, SCHEMA), 2, 1, encode, ignore)
    assert {(x.id, x.feature): x.cnt for x in got.collect()} == {(i, f): n for i, s, t in rows for f, n in brute_pairs(s, t, 2, 1, encode, ignore).items()}


def test_features_of_the_shared_set(spark, he_tiny):
    df = spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(he_tiny)], SCHEMA)
    rows = O.observed_features(df, "KRWord")
    assert Dictionary.fit(rows, [1]).size == 686
    v = values(rows)
    assert v[0, "Bias"] == pytest.approx(1 / 3) and v[1, "6,3"] == pytest.approx(1 / 6)


def test_vowels(spark):
    assert vowel_classes("be>A+1", "aeiou") == "[C][V]>[V]+[C]"
    got = {x.feature for x in O.substring_pairs(spark.createDataFrame([(1, ["b"], ["e"])], SCHEMA), vowels="aeiou").collect()}
    assert got == {"b,e", "[C],[V]"}


def test_sentence_features(spark):
    df = spark.createDataFrame([(1, ["WRD1~N~x", "WRD2~V~y"], ["WRD1~N~z"])], SCHEMA)
    got = values(O.observed_features(df, "KRSentence", bias=False, normalize=False, size=1))
    assert got == {(1, "N,N"): 1, (1, "V,N"): 1, (1, "x,z"): 1, (1, "y,z"): 1}


def test_bias_and_empty(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["c"])], SCHEMA)
    assert values(O.observed_features(df, "Bias")) == {(1, "Bias"): 0.5}
    assert values(O.observed_features(df, "Bias", normalize=False)) == {(1, "Bias"): 1.0}
    assert values(O.observed_features(df, "Empty")) == {}
    with pytest.raises(ValueError):
        O.observed_features(df, "Other")


def test_mismatches():
    assert O.mismatches(list("^ab$"), list("^cb$")) == ["MM:^ab,^cb", "MM:a,,c"]
    assert O.mismatches(list("^-a$"), list("^ca$")) == ["MM:^a,^ca", "MM:-,,c"]
    # A mismatch at the first place is its own context; one at the end is not given.
    assert O.mismatches(list("ab"), list("cb")) == ["MM:aab,ccb", "MM:a,,c"] and O.mismatches(list("ab"), list("ac")) == []
    assert O.mismatches(list("^-a$"), list("^ca$"), collapse=False)[0] == "MM:^-a,^ca"


def test_phrase_pairs():
    s, t = list("s-itti-ng"), list("-kitt-en-")
    assert O.phrase_pairs(s, t, 1, 1) == ["i,i", "t,t", "t,t", "n,n"]
    assert O.phrase_pairs(s, t, 1, 2) == ["i,k+i", "t,t+e", "n,e+n"]
    assert O.phrase_pairs(s, t, 2, 2)[:3] == ["s+i,k+i", "i+t,i+t", "t+t,t+t"]
    assert O.phrase_pairs(["a"], ["b"], 1, 1) == []


def test_aligned_generators(spark):
    df = align(spark.createDataFrame([(1, list("^ab$"), list("^cb$"))], SCHEMA))
    v = values(O.observed_features(df, "BKWord", ned=True, markers=True))
    assert v[1, "NED"] == pytest.approx(2 / 2) and v[1, "Bias"] == pytest.approx(0.5) and v[1, "b,b"] == pytest.approx(0.5)
    raw = values(O.observed_features(df, "BKWord", normalize=False, ned=True, markers=True))
    assert raw[1, "NED"] == pytest.approx(1.0) and raw[1, "MM:^ab,^cb"] == 1
    given = spark.createDataFrame([(1, list("ab"), list("ab"), ["a,a", "a,a", "x"])], SCHEMA + ", phrase_pairs array<string>")
    p = values(O.observed_features(align(given), "BKPhrasePairs", normalize=False))
    assert p == {(1, "a,a"): 2.0, (1, "x"): 1.0, (1, "Bias"): 1.0}


def test_dictionary(spark):
    rows = spark.createDataFrame([(1, "b", 2.0), (1, "a", 1.0), (2, "zz", 5.0)], "id long, feature string, value double")
    d = Dictionary.fit(rows.filter("feature <> 'zz'"), [0, 1])
    assert {r.feature: r.base_id for r in d.features.collect()} == {"a": 0, "b": 1} and d.dim == 4 and d.index(1, 1) == 3
    v = d.transform(rows).collect()
    assert [(r.id, r.indices, r["values"]) for r in v] == [(1, [0, 1], [1.0, 2.0])]
    assert {r.feature: r.base_id for r in d.lookup(rows.select("feature")).collect()} == {"a": 0, "b": 1, "zz": -1}
    assert d.reverse_lookup(spark.createDataFrame([(1,)], "base_id int")).first().feature == "b"
    u = Dictionary.union([d, Dictionary.fit(rows.filter("feature = 'zz'"), [2])])
    assert u.size == 3 and u.labels == [0, 1, 2]
    old = init_weights("zero", d) + [1, 2, 3, 4]
    assert transfer_weights(d, old, u).tolist() == [1, 2, 0, 3, 4, 0, 0, 0, 0]
    assert init_weights("noise", d, 0.1, 3).std() > 0 and init_weights("heuristic", Dictionary.fit(spark.createDataFrame([("A:a>a",)], "feature string"), [0, 1])).tolist() == pytest.approx([-2 / 3, 2 / 3])
    with pytest.raises(ValueError):
        init_weights("other", d)


def test_numbers_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(numbering, "SINGLE", 10)
    names = [f"n{i:04d}é" for i in range(700)]
    df = spark.createDataFrame([(n,) for n in random.Random(1).sample(names, len(names))], "feature string")
    got = {r.feature: r.k for r in with_dense_index(df, "feature", "k").collect()}
    assert got == {n: i for i, n in enumerate(names)}
