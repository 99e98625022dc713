import random
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
import regex
import xxhash

from duolattice.llm import common, components, decontaminate, line_dedup, simhash, token_shards, topk, warc
from duolattice.llm.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORDS = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def same_rows(spark, name):
    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


@pytest.mark.parametrize("name", ["op2_decontamination", "op9_line_dedup"])
def test_queries_against_sql(spark, name):
    same_rows(spark, name)


# SimHash


def brute_print(text, k=4):
    words = regex.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(items, radius=4):
    """Component of each (id, text), by comparing all fingerprints."""
    prints = [brute_print(t) for _, t in items]
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    members = {}
    for i in range(len(items)):
        members.setdefault(find(i), []).append(items[i][0])
    least = {r: min((m for m in ms if m is not None), default=None) for r, ms in members.items()}
    return [(items[i][0], f"{prints[i]:016x}", least[find(i)]) for i in range(len(items))]


def test_near_duplicates_of_awkward_rows(awkward, none):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = Counter(map(tuple, simhash.near_duplicates(awkward).collect()))
    assert got == Counter(brute_groups(rows))
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.deduplicate(awkward)
    assert kept.columns == awkward.columns and kept.count() == len({g[2] for g in brute_groups(rows)})
    assert simhash.deduplicate(none).count() == 0


def test_groups_without_ids(spark):
    df = spark.createDataFrame([(None, "just one"), (None, "just one"), (5, "something else here")], "doc_id long, text string")
    assert Counter(r.component_id for r in simhash.near_duplicates(df).collect()) == Counter([None, None, 5])
    assert simhash.deduplicate(df).count() == 2


def test_links_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HELD", 1 << 14)  # so that there are many buckets, and hot ones are split
    r = np.random.default_rng(1)
    base = r.integers(0, 2**64, 300, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(x) for x in r.choice(64, k, replace=False))) for k in (1, 2, 3, 4, 5, 6) for b in base[:50]]
    middle = np.uint64(0xABCDEF0123456789)
    cluster = [middle ^ np.uint64(1 << a | 1 << b) for a in range(0, 64, 3) for b in range(0, 64, 2)]
    fps = np.unique(np.concatenate([base, np.array(near + cluster, np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    star = {r.a: r.b for r in components.stars(simhash.links(df, len(fps))).collect()}
    ii, jj = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    root = simhash._roots(len(fps), ii, jj)
    signed = fps.view(np.int64)
    groups, want = {}, {}
    for k, x in enumerate(signed.tolist()):
        groups.setdefault(star.get(x, x), set()).add(x)
        want.setdefault(int(root[k]), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    with pytest.raises(ValueError):
        simhash.links(df, 1, radius=3)


def test_skewed_fingerprints(spark, monkeypatch):
    """Thousands of fingerprints around one centre: rows stay below what each fingerprint's variants allow, and no link is lost."""
    monkeypatch.setattr(simhash, "HELD", 1 << 16)
    made = []
    plain = simhash.materialized
    monkeypatch.setattr(simhash, "materialized", lambda df, name: (lambda out: made.append((name, out.count())) or out)(plain(df, name)))
    r = np.random.default_rng(2)
    flips = [sum(1 << int(x) for x in r.choice(64, k, replace=False)) for k in r.integers(1, 6, 4000)]
    fps = np.unique(np.array([0x123456789ABCDEF0 ^ f for f in flips] + r.integers(0, 2**64, 500, dtype=np.uint64).tolist(), np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    star = {r.a: r.b for r in components.stars(simhash.links(df, len(fps))).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    root = simhash._roots(len(fps), *np.nonzero(near))
    groups, want = {}, {}
    for k, x in enumerate(fps.view(np.int64).tolist()):
        groups.setdefault(star.get(x, x), set()).add(x)
        want.setdefault(int(root[k]), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert any(n for name, n in made if name == "hot") and all(n <= len(fps) * simhash.balls(64, 2)[0] for _, n in made)


def test_ids_of_other_types(spark):
    rows = [("b", "one two three four five"), ("a", "one two three four five"), (None, "one two three four five"), ("c", "l1\nl2\nl3"), ("d", "l1\nl2\nl3\nl4")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == {"b": "a", "a": "a", None: "a", "c": "c", "d": "d"}
    assert sorted(r.doc_id for r in simhash.deduplicate(df).collect()) == ["a", "c", "d"]
    assert {r.doc_id: r.text for r in line_dedup.deduplicate_lines(df).collect()}["d"] == "l4"
    with pytest.raises(TypeError):
        simhash.fingerprints(df.selectExpr("array(doc_id) as doc_id", "text"))
    with pytest.raises(TypeError):
        token_shards.write_shards(df, "")
    with pytest.raises(TypeError):
        warc.write_archives(df, id_col="doc_id", url_col="text", payload_col="text")
    with pytest.raises(TypeError):
        topk.search(df.selectExpr("doc_id as vec_id", "array(1.0) as embedding"), F.lit(True))


def test_no_folder_of_its_own_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_long_chains(spark):
    n = 200
    chain = [(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)]
    random.Random(1).shuffle(chain)
    got = {r.a: r.b for r in components.stars(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 1001: 1000}
    assert components.stars(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_leave_one_table(spark):
    shared = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    found = components.stars(spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long"))
    assert len(set(shared.iterdir()) - before) == 1
    assert {r.b for r in found.collect()} == {0} and found.count() == 20


def test_op6(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(map(tuple, QUERIES["op6_simhash"](spark, SF).collect())) == Counter(brute_groups([tuple(r) for r in rows]))


# Decontamination


def brute_contamination(texts, items, window):
    wins = []
    for name, text in items:
        w = WORDS.findall(lower(text))
        n = min(window, len(w))
        wins += [("null" if name is None else str(name), tuple(w[i : i + n])) for i in range(len(w) - n + 1)] if w else []
    out = []
    for text in texts:
        w, hit, found = WORDS.findall(lower(text)), set(), set()
        for name, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(name)
        out.append((len(w), len(hit), sorted(found)))
    return out


ITEMS = [(1, "the same TEXT"), (2, "lorem ipsum dolor sit amet 12 lorem ipsum dolor sit amet 12"), (2, "tis"), (3, None), (None, "b c"), (4, "..."), (10, "twice. the")]


@pytest.mark.parametrize("blocks", [False, True])
def test_contamination_of_awkward_rows(spark, awkward, none, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(decontaminate, "ITEM_BYTES", 40)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    if blocks:
        awkward = awkward.union(awkward.filter("doc_id = 3"))  # in the order of a shuffle
        awkward = awkward.groupBy(*awkward.columns).count().select(*awkward.columns).repartition(5)
    rows = awkward.collect()
    want = brute_contamination([r.text for r in rows], ITEMS, 10)
    got = decontaminate.contamination(awkward, bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == Counter((r.doc_id, n, h, tuple(i)) for r, (n, h, i) in zip(rows, want))
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got)
    kept = decontaminate.remove_contaminated(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == sum(h == 0 for _, h, _ in want)
    assert decontaminate.contamination(none, bench).count() == decontaminate.remove_contaminated(none, bench).count() == 0
    assert decontaminate.contamination(awkward, bench.filter("false")).filter("n_hit > 0").count() == 0


def test_random_windows():
    r = random.Random(3)
    import pyarrow as pa

    for _ in range(80):
        v = "ab cd é X1 zz".split()
        texts = [None if r.random() < 0.1 else " ".join(r.choices(v, k=r.randint(0, 40))) for _ in range(12)]
        items = [(str(i), " ".join(r.choices(v, k=r.randint(0, 7)))) for i in range(5)]
        got = decontaminate.scan(pa.array(texts, pa.string()), decontaminate.Items(items, 4))
        assert list(zip(got["n_words"].tolist(), got["n_hit"].tolist(), [sorted(set(i)) for i in got["items"]])) == brute_contamination(texts, items, 4)


def test_suffix_array_order():
    r = np.random.default_rng(5)
    ids = r.integers(0, 3, 300)
    order = decontaminate.suffix_array(ids, 400)
    end = lambda i: next((j for j in range(i, 300) if ids[j] == 0), 300)
    key = lambda i: tuple(ids[i : end(i)])
    keys = [key(i) for i in order if ids[i]]
    assert keys == sorted(keys) and sorted(order) == list(range(300))


def test_text_of_many_different_words():
    import pyarrow as pa

    n = (1 << 21) + 10
    text = " ".join(map(str, range(n))) + " 7 8 9"
    items = decontaminate.Items([("a", f"x {n - 3} {n - 2} {n - 1} 7"), ("b", "7 8 9 11"), ("c", "7 9 10")], 3)
    got = decontaminate.scan(pa.array([text, "7 8 9"]), items)
    assert got["n_hit"].tolist() == [9, 3] and [sorted(set(i)) for i in got["items"]] == [["a", "b"], ["b"]]
    ids = np.random.default_rng(6).integers(0, 3, 300)
    ends = [int(np.flatnonzero(np.append(ids, 0)[i:] == 0)[0]) + i for i in range(300)]
    keys = [tuple(ids[i : ends[i]]) for i in decontaminate.suffix_array(np.where(ids, ids + (1 << 21), 0), 400) if ids[i]]
    assert len(keys) == (ids > 0).sum() and keys == sorted(keys)


def test_shorter_matches_beside_longer_ones():
    import pyarrow as pa

    r, n = random.Random(8), 12
    for _ in range(40):
        words = r.choices("ab", k=n)
        texts = [" ".join(words), " ".join(["y", *words[: n - 3], "z"]), " ".join(words[2:9])]
        got = decontaminate.scan(pa.array(texts), decontaminate.Items([("7", " ".join(words))], 4), 4)["matches"]
        want = set()
        for d, t in enumerate(map(str.split, texts)):
            for i in range(len(t)):
                for j in range(n):
                    size = next(m for m in range(n + 1) if i + m >= len(t) or j + m >= n or t[i + m] != words[j + m])
                    if size >= 4 and not (i and j and t[i - 1] == words[j - 1]):
                        want.add((d, i, "7", j, size))
        assert len(got) == len(set(got)) and set(got) == want


def test_matches_deeper_than_any_window():
    import pyarrow as pa

    r = random.Random(5)
    words = [r.choice("abcdefgh") + r.choice("xyz") for _ in range(7006)]
    texts = [" ".join(["q", *words[:7001], f"u{d}"]) for d in range(6)] + [" ".join(words)]
    got = decontaminate.scan(pa.array(texts), decontaminate.Items([("7", " ".join(words))], 10), 10)["matches"]
    assert {(d, s, t, n) for d, s, _, t, n in got if n > 20} == {(d, 1, 0, 7001) for d in range(6)} | {(6, 0, 0, 7006)}


def test_words_that_share_a_hash(monkeypatch):
    import pyarrow as pa

    plain = decontaminate.word_hashes
    # Two letters are told apart by their length alone.
    monkeypatch.setattr(decontaminate, "word_hashes", lambda low, b, e: np.where(e - b == 2, np.uint64(7), plain(low, b, e)))
    texts = ["aa bb cc long aa", "cc bb aa", None, "bb cc x"]
    items = [("1", "bb cc"), ("2", "aa bb"), ("3", "dd"), ("4", "x"), ("5", "long aa")]
    got = decontaminate.scan(pa.array(texts, pa.string()), decontaminate.Items(items, 2))
    assert list(zip(got["n_words"].tolist(), got["n_hit"].tolist(), [sorted(set(i)) for i in got["items"]])) == brute_contamination(texts, items, 2)


def test_large_benchmarks_are_searched_at_once():
    import time

    import pyarrow as pa

    r = np.random.default_rng(9)
    v = np.array([f"w{i}" for i in range(30_000)])
    items = decontaminate.Items([(str(i), " ".join(v[r.integers(0, len(v), 4000)])) for i in range(100)], 10)
    texts = [" ".join(v[r.integers(0, len(v), 3000)]) for _ in range(10)] + [" ".join(v[items.words[500:540]])]
    began = time.perf_counter()
    got = decontaminate.scan(pa.array(texts), items)
    assert time.perf_counter() - began < 5 and got["n_hit"].sum() == 0
    words = np.array([s.decode() for s in items.spellings])[items.words]
    assert decontaminate.scan(pa.array([" ".join(words[500:540])]), items)["n_hit"].tolist() == [40]


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x a b c d y a b"), (2, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "z a b c d q")], "item_id long, text string")
    got = {tuple(r) for r in decontaminate.matches(docs, bench, 3).collect()}
    assert got == {(1, 1, "7", 1, 4), (2, 0, "7", 1, 3)}


# Line deduplication


def brute_lines(rows):
    """rows: (id, text), in order of id. Text and removed lines of each."""
    seen, out = set(), []
    for _, text in rows:
        lines = (text or "").split("\n")
        full = [i for i, line in enumerate(lines) if line.replace(" ", "")]
        gone = set()
        for a, b, c in zip(full, full[1:], full[2:]):
            w = (lines[a], lines[b], lines[c])
            if w in seen:
                gone |= set(range(a, c + 1))
            seen.add(w)
        out.append((text if not gone else "\n".join(line for i, line in enumerate(lines) if i not in gone), len(gone)))
    return out


def test_lines_against_loops(spark):
    r = random.Random(2)
    rows = [(i, None if i == 3 else "\n".join(r.choices(["aa", "b b", "c", "", "  ", "dd"], k=r.randint(0, 12)))) for i in range(60)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, covered string, k1 int").repartition(3)
    got = {g.doc_id: (g.text, g.n) for g in line_dedup.deduplicate_lines(df, removed_col="n").collect()}
    assert got == {i: w for (i, _), w in zip(rows, brute_lines(rows))}
    assert line_dedup.deduplicate_lines(df).columns == df.columns


def test_lines_of_awkward_rows(spark, awkward, none):
    assert Counter(map(tuple, line_dedup.deduplicate_lines(awkward).collect())) == Counter(map(tuple, awkward.collect()))
    assert line_dedup.deduplicate_lines(none).count() == 0
    text = "one\ntwo\nthree"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (1, text + "\nfour")], "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in line_dedup.deduplicate_lines(df).collect())
    # Rows that repeat an id and a text are one document; another text of that id comes before or after them by its hash.
    assert got[(None, "")] == 1 and (got == Counter([(1, text), (1, text), (None, ""), (1, "four")]) or got == Counter([(1, ""), (1, ""), (None, ""), (1, text + "\nfour")]))


def test_no_python_on_the_native_path(spark):
    df = QUERIES["op9_line_dedup"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
