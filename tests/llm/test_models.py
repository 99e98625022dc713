import pickle
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from duolattice.llm import quality, toxicity, topk, warc
from duolattice.llm.queries import QUERIES
from pyspark.sql import functions as F
from test_duplicates import WORDS, lower, same_rows

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op5_topk", "op10_warc"])
def test_queries_against_sql(spark, name):
    same_rows(spark, name)


# Quality


def test_quality_of_awkward_rows(spark, awkward, none):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (2, 1), (3, None), (4, 5), (None, 1), (99, 1)], "doc_id long, quality int")
    model = quality.fit(awkward, labels)
    got = quality.score(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(awkward, model, 0.0)
    assert Counter(map(tuple, kept.collect())) == Counter(map(tuple, awkward.collect()))
    assert quality.keep_good(awkward, model, 1.1).count() == quality.score(none, model).count() == 0
    nothing = quality.fit(awkward, labels.filter("false"))
    assert {r.score for r in quality.score(awkward, nothing).collect()} == {0.5}
    single = quality.fit(awkward, labels.filter("quality = 1"))
    assert len({r.score for r in quality.score(awkward, single).collect()}) == 1


def test_features_do_not_depend_on_neighbours():
    texts = ["One two. Two!", None, "", "x | y | y", "é" * 50, "A\nB\nC " * 500]
    together = quality.features(pa.array(texts, pa.string()))
    alone = np.concatenate([quality.features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone) and not together[1].any() and not together[2].any()
    row = dict(zip(quality.FEATURES, together[3]))
    assert row["bars"] == pytest.approx(2 / 9) and row["bare"] == pytest.approx(2 / 5) and row["top_word"] == pytest.approx(2 / 5)


def test_op7_against_brute_force(spark):
    """Scores of op7 again: the learnt rows' features one text at a time, and table entries added in plain loops."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    learnt = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 5)
    one = lambda i: quality.features(pa.array([docs[i]], pa.string()))[0]
    model = quality.train(np.stack([one(i) for i in learnt]), np.array([labels[i] for i in learnt], float))
    for r in QUERIES["op7_quality"](spark, SF).collect():
        x = one(r.doc_id)
        bins = lambda edges, k: sum(v >= e for v, e in zip([x[k]] * len(edges[k]), edges[k]))
        margin = model.intercept + sum(t[bins(model.edges, k)] for k, t in enumerate(model.tables)) + sum(t[bins(model.coarse, a), bins(model.coarse, b)] for (a, b), t in zip(model.pairs, model.pair_tables))
        assert r.score == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-6) and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def brute_features(text):
    """The features of a text of ASCII letters, by plain loops."""
    words, n = text.split(), max(1, len(text))
    share = lambda chars: sum(c in chars for c in text) / n
    w = max(1, len(words))
    out = {"log_bytes": np.log1p(len(text)), "mean_word": sum(map(len, words)) / w, "upper": sum(c.isupper() for c in text) / n, "digits": share("0123456789"), "stops": share(".,;:?"), "marks": share("#$%&*@^~<>{}[]\\/=+_"), "bars": share("|"), "bangs": share("!")}
    out |= {"spaces": share(" \t\r\n\x0b\x0c"), "bare": sum(not any(c.isalpha() for c in x) for x in words) / w, "stutter": sum(a == b for a, b in zip(words, words[1:])) / w, "distinct": len(set(words)) / w}
    return out | {"top_word": max(Counter(words).values(), default=0) / w, "pairs": len(set(zip(words, words[1:]))) / w, "line_words": len(words) / (text.count("\n") + 1), "log_words": np.log1p(len(words))}


def test_features_against_loops():
    texts = ["One two, two two!\n3 | 4", "a a a a", "x" * 500, "Word " * 900, "\n\n|", "A.B c#d\tE"]
    got = quality.features(pa.array(texts))
    for t, row in zip(texts, got):
        assert dict(zip(quality.FEATURES, row)) == pytest.approx(brute_features(t))


def test_interactions_are_learnt():
    r = np.random.default_rng(0)
    x = r.random((4000, 4))
    # The pairs' bins are tenths, from 0.05 on.
    y = ((x[:, 0] > 0.55) ^ (x[:, 1] > 0.55)).astype(float)
    model = quality.train(x, y, rounds=20)
    assert model.pairs[0] == (0, 1) and ((model.predict(x) > 0.5) == y).mean() > 0.95
    tables = quality.train(x, (x[:, 2] > 0.3).astype(float), rounds=60, n_pairs=0)
    assert ((tables.predict(x) > 0.5) == (x[:, 2] > 0.3)).mean() > 0.98


def accuracy(spark, name, label, mod, left):
    rows = {r.doc_id: r for r in QUERIES[name](spark, LARGER).collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % mod == left) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [i for i in labels if rows[i].held_out]
    return np.array([[rows[i].predicted, labels[i]] for i in held])


def test_op7_on_held_out_rows(spark):
    r = accuracy(spark, "op7_quality", "quality", 5, 0)
    assert (r[:, 0] == r[:, 1]).mean() > 0.95


# Toxicity


def test_op4_on_held_out_rows(spark):
    r = accuracy(spark, "op4_toxicity", "toxic", 3, 1)
    assert (r[:, 0] == r[:, 1]).mean() > 0.95 and r[r[:, 1] == 0, 0].mean() < 0.02 and r[r[:, 1] == 1, 0].mean() > 0.8


def test_op4_gives_evidence(spark):
    rows = QUERIES["op4_toxicity"](spark, LARGER).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    full = [r for r in rows if WORDS.search(lower(texts[r.doc_id]))]
    assert sum(len(r.evidence) == 15 for r in full) >= 0.9 * len(full)


def test_op4_against_brute_force(spark):
    """Scores, neighbours and cosines of op4, worked out again with dictionaries over all pairs."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, SF).collect()}
    bag = {i: Counter(t for w in WORDS.findall(lower(t)) for t in [w, *([w[:5] + "*"] if len(w) >= 5 else [])]) for i, t in docs.items()}
    train = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 3 != 1)
    df, of = Counter(t for b in bag.values() for t in b), {y: [i for i in train if labels[i] == y] for y in (0, 1)}
    weight = {}
    for t in {t for i in train for t in bag[i]}:
        g = 0.0
        has = sum(t in bag[i] for i in train)
        for y in (0, 1):
            for n, margin in ((sum(t in bag[i] for i in of[y]), has), (sum(t not in bag[i] for i in of[y]), len(train) - has)):
                g += 2 * n * np.log(n * len(train) / (len(of[y]) * margin)) if n else 0
        weight[t] = (np.log((1 + len(docs)) / (1 + df[t])) + 1) * (0.03 + (g / (g + 15)) ** 2)
    vector = {}
    for i, b in bag.items():
        v = {t: n * weight[t] for t, n in b.items() if t in weight}
        norm = sum(x * x for x in v.values()) ** 0.5
        vector[i] = {t: x / norm for t, x in v.items()}

    def vote(i, examples):
        c = {j: sum(x * vector[j].get(t, 0) for t, x in vector[i].items()) for j in examples}
        near = sorted((j for j in examples if c[j] > 0), key=lambda j: (-round(c[j], 9), j))[:15]
        w = [1 / (1.05 - min(1, c[j])) for j in near]
        return near, [c[j] for j in near], sum(a * labels[j] for a, j in zip(w, near)) / sum(w) if near else -1

    own = {i: vote(i, [j for j in train if j != i])[2] for i in train}
    steps = sorted({round(v, 3) for v in own.values() if v >= 0})
    n, toxic = ([sum(f(i) for i in train if round(own[i], 3) == s) for s in steps] for f in (lambda i: 1, lambda i: labels[i]))
    # Isotonic regression by its formula: the largest over beginnings of the smallest over ends of the means, pooled where they are the same.
    means = [max(min(sum(toxic[a:b]) / sum(n[a:b]) for b in range(k + 1, len(steps) + 1)) for a in range(k + 1)) for k in range(len(steps))]
    pool = lambda k: [j for j in range(len(steps)) if abs(means[j] - means[k]) < 1e-12]
    rate = [(sum(toxic[j] for j in pool(k)) + 0.05) / (sum(n[j] for j in pool(k)) + 0.5) for k in range(len(steps))]
    rate = [max(rate[: k + 1]) for k in range(len(steps))]
    for i in docs:
        near, cosines, v = vote(i, train)
        assert [e.example for e in got[i].evidence] == near and np.allclose([e.cosine for e in got[i].evidence], cosines)
        if near:
            assert got[i].score == pytest.approx(rate[max([k for k, s in enumerate(steps) if s <= round(v, 3)], default=0)])


def test_toxicity_of_awkward_rows(spark, awkward, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(8, None), (9, 7), (None, 1), (10, 0), (10, 1)], "doc_id long, toxic int")
    model = toxicity.fit(awkward, labels)
    assert sorted(model.ids) == list(range(8))
    got = toxicity.score(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.fit(awkward, labels.filter("false"))
    assert {r.score for r in toxicity.score(awkward, blank).collect()} == {0.0}
    named = awkward.withColumn("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    texts = toxicity.fit(named, labels.withColumn("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string"))))
    assert Counter((r.doc_id, r.score) for r in toxicity.score(named, texts).collect()) == Counter((None if r.doc_id is None else f"doc {r.doc_id}", r.score) for r in got)


@pytest.fixture(scope="module")
def examples():
    r = np.random.default_rng(2)
    n, t = 300, 40
    rows = [(np.sort(r.choice(t, k, replace=False)), r.integers(1, 4, k)) for k in r.integers(1, 8, n)]
    rows[5] = rows[6] = rows[200]
    rows[7] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    weight = r.random(t) + 0.5
    return toxicity.Model(np.arange(t), weight, (np.arange(n) * 3).tolist(), (r.random(n) < 0.4).astype(float), rows, 0.1), weight


def test_neighbours_against_all(examples, monkeypatch):
    model, weight = examples
    dense = np.zeros((len(model.rows), len(weight)))
    for i, (t, n) in enumerate(model.rows):
        dense[i, t] = n * weight[t]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-300)
    r, ids = np.random.default_rng(4), np.array(model.ids)
    assert ids.tolist() != sorted(ids.tolist())  # the blocks are in another order
    for _ in range(60):
        found = np.sort(r.choice(len(weight), r.integers(1, 9), replace=False))
        n = r.integers(1, 5, len(found))
        q = np.zeros(len(weight))
        q[found] = n * weight[found]
        cosines = dense @ (q / np.linalg.norm(q))
        want = [i for i in np.lexsort((ids, -np.round(cosines, 9))) if cosines[i] > 0][: model.k]
        best, c = model.nearest(found, n, np.array([0, len(found)]))[0]
        assert ids[best].tolist() == ids[want].tolist() and np.allclose(c, cosines[want])
        (empty, (score, near, _)) = model.score(found, n, np.array([0, 0, len(found)]))
        assert 0 <= score <= 1 and near == ids[best].tolist() and empty == (0.1, [], [])
    assert (np.diff(model.rates) >= 0).all()
    again = pickle.loads(pickle.dumps(model))
    assert again.score(found, n, np.array([0, len(found)])) == model.score(found, n, np.array([0, len(found)]))


def test_blocks_below_the_last_neighbour_are_passed_over(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 20)
    rows = [(np.array([i // 20, 40]), np.array([9, 1])) for i in range(800)]
    model = toxicity.Model(np.arange(41), np.ones(41), list(range(800)), np.zeros(800), rows, 0.1)
    (best, _), (_, c) = model.nearest(np.array([7, 40, 40]), np.array([1, 1, 1]), np.array([0, 2, 3]))
    # With both terms the block of the seventh is enough; with the common one alone all blocks may hold neighbours.
    assert model.scored.tolist() == [3, 40] and best.tolist() == list(range(140, 155)) and len(c) == 15
    assert len(model.dense) == 1 and len(model.owner) == 800


def test_terms_of_texts():
    term, text = toxicity.terms(pa.array(["Stupid stupid x éééééé", None, "stupidity 12345"], pa.string()))
    names = ["stupid", "stupid", "x", "éééééé", "stupidity", "12345", "stupi*", "stupi*", "ééééé*", "stupi*", "12345*"]
    assert text.tolist() == [0, 0, 0, 0, 2, 2, 0, 0, 0, 2, 2]
    assert all((a == b) == (m == n) for a, m in zip(term, names) for b, n in zip(term, names))
    vocabulary = np.sort(term[[0, 2, 6]])
    t, n, cuts = toxicity.find(pa.array(["STUPID, stupified? x", None, "none stupid none"], pa.string()), vocabulary)
    place = {int(term[k]): name for k, name in ((0, "stupid"), (2, "x"), (6, "stupi*"))}
    assert [{place[int(vocabulary[i])]: int(m) for i, m in zip(t[a:b], n[a:b])} for a, b in zip(cuts, cuts[1:])] == [{"stupid": 1, "stupi*": 2, "x": 1}, {}, {"stupid": 1, "stupi*": 1}]
    assert toxicity.find(pa.array([], pa.string()), vocabulary)[2].tolist() == [0] and toxicity.find(pa.array(["x"]), vocabulary[:0])[2].tolist() == [0, 0]


def test_all_labelled_rows_are_examples_up_to_the_bound(spark):
    n = 1600
    docs = spark.createDataFrame([(i, "rude " * 6 if i % 2 else "rude " * 5 + "kind") for i in range(n)] + [(4, "rude")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)] + [(5, 1)] * 9, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert sorted(model.ids) == list(range(n)) and len(model.vocabulary) == 2
    assert all((r.score > 0.9) == (r.doc_id % 2) for r in toxicity.score(docs, model).filter("doc_id <> 4").collect())
    assert len(toxicity.fit(docs, labels, labelled=100).ids) == 100


# Top-k


def brute_topk(rows, k=10):
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, done = [], set()
    for i, q in sorted(ok):
        if i % 100 or i in done:
            continue
        done.add(i)
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in ok if j != i)
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return Counter(out)


def test_topk_of_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "RANGE_ROWS", 97)
    r = np.random.default_rng(1)
    rows = [(i, r.normal(0, 0.3, 6).astype(np.float32).tolist()) for i in range(400)]
    rows[3] = (3, None)
    rows[7] = (7, [1.0, None, 0.0, 0.0, 0.0, 0.0])
    rows[8] = (8, [float("nan")] * 6)
    rows[9] = (9, [float("inf")] * 6)
    rows[10] = (10, [0.5])
    rows[11] = (11, [])
    rows[12] = (12, [3e30] * 6)
    rows[200] = (200, [-2e25] + [0.1] * 5)
    rows += [(None, [1.0] * 6), rows[20], rows[20], (21, rows[22][1]), rows[300]]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string").repartition(3)
    got = topk.search(df, F.col("vec_id") % 100 == 0)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert Counter(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_topk(rows)
    monkeypatch.setattr(topk, "QUERY_BYTES", 60)
    assert Counter(map(tuple, topk.search(df, F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score").collect())) == brute_topk(rows)
    assert topk.search(df.filter("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.search(df.filter("vec_id in (0, 1)"), F.col("vec_id") % 100 == 0).count() == 1


def test_blocks_are_passed_over(monkeypatch):
    r = np.random.default_rng(3)
    centres = r.integers(-500, 500, (12, 8)).astype(float)
    rows = [centres[i % 12] + r.integers(-5, 5, 8) for i in range(3000)]
    ids = np.arange(3000)
    queries = topk.Queries(ids[:5] * 1000000 + 7, rows[:5], 10)
    best = queries.begin()
    queries.offer(best, ids, rows)
    for b, q in zip(best, rows[:5]):
        s = np.stack(rows) @ q
        order = np.lexsort((ids, -s))[:10]
        assert b.ids.tolist() == ids[order].tolist() and b.scores.tolist() == s[order].tolist()


# WARC


def warc_rows(spark, rows, **options):
    df = spark.createDataFrame([(i, u, h, "x", b"y") for i, u, h in rows], "page_id long, url string, html string, digest string, payload binary").repartition(3)
    return warc.read_archives(warc.write_archives(df, **options)).collect()


def test_archives_of_awkward_pages(spark):
    rows = [(1, "http://a/ b\r\nc?é", "same"), (2, None, "same"), (9, "u", "same"), (9, "u", "same"), (None, "n", "same"), (4, "e", None), (5, "f", ""), (None, "only", "lonely"), (6, "l", "long " * 50000), (7, "x", "\r\n\r\nWARC/1.1\r\n\u0000é")]
    got = warc_rows(spark, rows)
    import base64
    import hashlib

    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    keep = {"same": 9, "": 5, "lonely": None, rows[8][2]: 6, rows[9][2]: 7}
    want = Counter()
    for i, _, h in rows:
        k = keep[h or ""]
        want[(i, len((h or "").encode()), sha(h), "response" if i == k else "revisit", None if i == k else k)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {r.page_id: r.payload.decode() for r in got if r.record_type == "response" and r.page_id in (6, 7)} == {6: rows[8][2], 7: rows[9][2]}
    assert {r.url for r in got if r.page_id == 2} == {None} and {r.url for r in got if r.page_id == 1} == {"http://a/%20b%0D%0Ac?%C3%A9"}
    assert all(r.record_type == "response" for r in warc_rows(spark, rows[:3], min_bytes=5))
    assert warc_rows(spark, [(1, "u", "h")])[0].record_type == "response"


def test_no_archives_of_nothing(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(df)).count() == 0


def test_archives_roll_over(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 1000)
    w = warc.ArchiveWriter(f"file://{tmp_path}")
    records = [warc.record_bytes(i, "u", b"page %d" % i, "A" * 32, False, None, "d") for i in range(300)]
    for r in records:
        w.add(r)
    path, n, size = w.close()
    assert n == 300 and size == (tmp_path / path.rsplit("/", 1)[1]).stat().st_size and list(warc.frames(path)) == records


def test_bad_archives_are_errors(tmp_path):
    import zstandard

    def refuse(data, match):
        (tmp_path / "x").write_bytes(data)
        with pytest.raises(ValueError, match=match):
            for f in warc.frames(f"file://{tmp_path}/x"):
                warc.parse_record(f)

    w = warc.ArchiveWriter(f"file://{tmp_path}")
    payload = b"hello"
    import base64
    import hashlib

    good = warc.record_bytes(1, "u", payload, base64.b32encode(hashlib.sha1(payload).digest()).decode(), False, None, "2020-01-01T00:00:00Z")
    w.add(good)
    path, _, _ = w.close()
    data = (tmp_path / path.rsplit("/", 1)[1]).read_bytes()
    assert warc.parse_record(next(warc.frames(path)))["page_id"] == 1
    refuse(b"", "no leading frame")
    refuse(zstandard.compress(good), "doesn't begin with a dictionary")
    refuse(data[:20], "cut off")
    refuse(data[:-3], "cut off")
    for bad, match in ((good + b"x", "block"), (good.replace(b"hello", b"hellp"), "digest"), (good.replace(b"WARC/1.1", b"BLAH/1.1"), "begin"), (good.replace(b"WARC-Date: 2020-01-01T00:00:00Z\r\n", b""), "lacks"), (good.replace(b"response\r\nWARC-Rec", b"metadata\r\nWARC-Rec"), "unknown record"), (good.replace(b"Content-Length: 5", b"Content-Length: 6"), "match its length")):
        with pytest.raises(ValueError, match=match):
            warc.parse_record(bad)
