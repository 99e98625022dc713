import random

from pyspark.sql import functions as F

from duolattice.operators import alignment
from duolattice.operators import alignment as A


def test_known_alignment():
    cost, s, t = A.align_tokens(list("sitting"), list("kitten"), 3)
    assert cost == 5 and "".join(s) == "s-itti-ng" and "".join(t) == "-kitt-en-"


def test_costs_agree_with_the_fold(spark):
    r = random.Random(1)
    rows = [(i, r.choices("abc", k=r.randint(0, 6)), r.choices("abc", k=r.randint(0, 6))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, source array<string>, target array<string>")
    for sub in (1, 3):
        got = {x.id: x.d for x in df.select("id", A.edit_distance(F.col("source"), F.col("target"), sub).alias("d")).collect()}
        assert got == {i: A.align_tokens(s, t, sub)[0] for i, s, t in rows}
    for i, s, t in rows:
        _, a, b = A.align_tokens(s, t, 3)
        assert [x for x in a if x != "-"] == s and [x for x in b if x != "-"] == t
        assert all(x == y or "-" in (x, y) for x, y in zip(a, b))


def test_pair_helpers(spark):
    df = spark.createDataFrame([(["^", "a", "$"], ["-", "^", "$"])], "s array<string>, t array<string>")
    r = df.select(A.has_markers(F.col("s")).alias("m"), A.has_markers(F.col("t")).alias("n"), A.hash_string(F.col("s"), F.col("t")).alias("h"), A.pair_size(F.col("s"), F.col("t"), True).alias("k"), A.has_markers(F.array(F.lit("-"))).alias("z")).first()
    assert r.m and r.n and not r.z and r.h == "^_a_$~-_^_$" and r.k == 1


def test_printed_alignments_round_trip():
    text = A.format_alignment(0, -300, ["Mat11", "Ins1"], ["s", "-"], ["s", "u"]) + A.format_alignment(1, 0.5, ["Del1"], ["x"], ["-"])
    assert text.startswith("Alignment 0 ( weight = -300 ):\nMat11 Ins1 \n|s| \n|s|u\n")
    assert A.parse_alignments(text) == [(["s", "-"], ["s", "u"], 1), (["x"], ["-"], 1)]


def test_null_sides(spark):
    df = spark.createDataFrame([(1, None, ["a"], 1), (2, ["a"], ["b", "a"], 0), (3, [], None, 1)], "id long, source array<string>, target array<string>, y int")
    got = {r.id: (r.aligned_source, r.longest, r.edit_distance) for r in alignment.align(df).collect()}
    assert got == {1: (None, None, None), 2: (["-", "a"], 2, 1), 3: (None, None, None)}


def test_single_characters_take_no_fold(spark):
    """Single characters go to Spark's function on strings; tokens of several characters, empty ones and other costs to the fold."""
    pairs = [(["a", "é", "\U0001f600"], ["é", "\U0001f600", "b"]), (["ab", "c"], ["a", "bc"]), (["", "a"], ["a", ""]), (["a"], []), ([], ["a", "b"]), ([], []), (["a", "b"], ["ab"])]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id long, source array<string>, target array<string>")
    for sub in (1, 3):
        got = {x.id: x.d for x in df.select("id", A.edit_distance(F.col("source"), F.col("target"), sub).alias("d")).collect()}
        assert got == {i: A.align_tokens(*p, sub)[0] for i, p in enumerate(pairs)}
    plan = df.select(A.edit_distance(F.col("source"), F.col("target"), 1))._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" in plan.lower()
