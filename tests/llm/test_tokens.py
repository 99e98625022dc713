import hashlib
import os
import time
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from duolattice.llm import sentencepiece_codec as S
from duolattice.llm import token_counts as C
from duolattice.llm import token_shards as K
from duolattice.llm.queries import QUERIES, vocabulary

PIECES, BYTES, RANKS = (vocabulary(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_equal_the_library(awkward, library):
    got = S.encode_decode(awkward, PIECES).collect()
    rows = awkward.select("doc_id", "text").collect()
    want = []
    for r in rows:
        ids = library.encode(r.text or "")
        want.append((r.doc_id, " ".join(map(str, [*ids, library.eos_id()])), len(ids) + 1, library.decode(ids)))
    assert Counter(map(tuple, got)) == Counter(want)


def test_both_agendas_agree():
    c = S.PieceCodec(PIECES)
    for text in ["▁internationalisation", "▁▁▁▁a", "▁" + "na" * 20, "▁été漢", "▁aaaaaaaa"]:
        assert c.merge_short(text) == c.merge_long(text)


def test_other_ends_and_decoding(spark, awkward, none, library):
    got = {r.decoded for r in S.decode_ids(S.encode_decode(awkward, PIECES, add_bos=True), PIECES).collect()}
    assert got == {library.decode(library.encode(r.text or "")) for r in awkward.collect()}
    first = S.encode_decode(awkward.filter("doc_id = 1"), PIECES, add_bos=True, add_eos=False).first()
    assert (first.ids, first.n_tokens) == ("1", 1)
    assert S.encode_decode(awkward.filter("doc_id = 1"), PIECES, add_eos=False).first().n_tokens == 0
    assert S.encode_decode(none, PIECES).count() == 0


def test_a_difference_is_an_error(monkeypatch):
    c = S.PieceCodec(PIECES)
    monkeypatch.setattr(c, "segment_ids", lambda s: [0])
    with pytest.raises(RuntimeError):
        c.learn([["▁abc"]])


def test_whole_texts_are_held_against_the_library(spark, library):
    c = S.PieceCodec(PIECES)
    ids = " ".join(map(str, library.encode("one two")))
    c.check("one two", [ids], "one two")
    with pytest.raises(RuntimeError, match="encodes"):
        c.check("one two", ["1"], "one two")
    with pytest.raises(RuntimeError, match="decodes"):
        c.check("one two", [ids], "one  two")
    long = S.SPACE + "y" * 1000
    c.learn([[long]])
    assert long in c.cache
    c.learn([["▁z"]])
    assert long not in c.cache and "▁z" in c.cache


def test_small_caches_give_the_same(library):
    c = S.PieceCodec(PIECES, cache_limit=3)
    for text in ["one two three four", "five six one", "\u0000 odd two"]:
        segments = c.segments(text)
        c.learn([segments])
        ids, back = c.both_ways(segments)
        assert " ".join(ids) == " ".join(map(str, library.encode(text))) and back == library.decode(library.encode(text))


def test_op1(spark, library):
    got = {r.doc_id: r for r in QUERIES["op1_sentencepiece"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "") + [library.eos_id()]
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BYTES)


def tokens(t, text):
    return len(t.encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_library(awkward, none, tokenizer):
    got = Counter(map(tuple, C.token_counts(awkward, BYTES).collect()))
    assert got == Counter((r.doc_id, len((r.text or "").encode()), tokens(tokenizer, r.text or "")) for r in awkward.collect())
    assert C.token_counts(none, BYTES).count() == 0


def test_every_prefix(awkward, tokenizer):
    c = C.PrefixCounter(BYTES)
    for text in ["I'll don't  go\n\n home 'twas", "a<|endoftext|>b <|endoft", "é漢字😀x  ", "12 345abc!!! ...  x\t\ty", "we 're  's", " \n \n x"]:
        assert c.at_prefixes(text) == [tokens(tokenizer, text[:k]) for k in range(len(text) + 1)]
        want = c.at_prefixes(text)
        for b in range(-1, want[-1] + 2):
            assert c.fitting(text, b) == (want[-1], max((k for k, n in enumerate(want) if n <= b), default=-1))
            assert c.truncate(text, b) == text[: max(0, c.fitting(text, b)[1])]


def test_every_prefix_of_random_texts(tokenizer):
    c, r = C.PrefixCounter(BYTES), np.random.default_rng(7)
    parts = [" ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "the", "THE", "é", "漢", "😀", "12", "!", "<|endoftext|>", "<|end", "\u00a0", "a", "'v", "'ve", "\u0301", "\x1c"]
    for _ in range(300):
        text = "".join(parts[i] for i in r.integers(0, len(parts), r.integers(1, 12)))
        want = [tokens(tokenizer, text[:k]) for k in range(len(text) + 1)]
        assert c.at_prefixes(text) == want, text
        for b in range(want[-1] + 1):
            assert c.fitting(text, b) == (want[-1], max(k for k, n in enumerate(want) if n <= b)), (text, b)


def test_prefixes_of_long_runs(tokenizer):
    c = C.PrefixCounter(BYTES)
    for run in (" " * 10_000, "x " + "\n" * 10_000 + "y", " " + "abcdefghij" * 1000, "é" * 5000, "-" * 10_000, "'" * 5000 + "s"):
        began = time.perf_counter()
        counts = c.at_prefixes(run)
        assert time.perf_counter() - began < 8
        for k in (1, 17, 800, len(run) // 2, len(run) - 1, len(run)):
            assert counts[k] == tokens(tokenizer, run[:k])
        assert c.fitting(run, counts[-1] // 2)[1] == max(k for k, n in enumerate(counts) if n <= counts[-1] // 2)
    assert all(len(p) <= C.LONGEST_KEPT for p in c.counts)


def test_random_tokens_side_by_side():
    c, e, r = C.PrefixCounter(BYTES), K.encoder(RANKS), np.random.default_rng(0)
    names = list(c.token)
    for _ in range(3000):
        piece = b"".join(names[i] for i in r.integers(0, len(names), r.integers(1, 5)))
        counts = c.prefixes(piece)
        assert len(counts) == len(piece) + 1 and counts[-1] == len(e._core_bpe.encode_single_piece(piece))


def test_budgets(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.fits, r.keep_chars) for r in C.within_budget(C.prefix_counts(df, BYTES), 2).collect()}
    assert got == {1: (False, 7), 2: (True, 0)}


def test_op8(spark, tokenizer):
    rows = {r.doc_id: r for r in QUERIES["op8_token_counts"](spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n, text = tokens(tokenizer, d.text or ""), d.text or ""
        r = rows[d.doc_id]
        assert (r.n_tokens, r.over_limit) == (n, n > 1024)
        assert r.keep_chars == len(text) if n <= 1024 else tokens(tokenizer, text[: r.keep_chars]) <= 1024 < min(tokens(tokenizer, text[: r.keep_chars + j]) for j in range(1, 9))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations(n):
    p = K.Permutation(n, 9)
    s = p.slots(np.arange(n))
    assert sorted(s) == list(range(n)) and np.array_equal(p.numbers(s), np.arange(n))
    assert n < 1000 or (s != K.Permutation(n, 10).slots(np.arange(n))).any()


def test_shards_hold_every_document(spark, awkward, tmp_path):
    folder = f"file://{tmp_path}/shards"
    index = K.write_shards(awkward, RANKS, length=64, rows=100, folder=folder)
    rows = sorted(index.collect(), key=lambda r: r.slot)
    e = K.encoder(RANKS)
    assert [r.slot for r in rows] == list(range(len(rows))) and all((r.slot // 100, r.slot % 100) == (r.shard, r.row) for r in rows)
    sequences = list(K.read_slots(folder, 0, len(rows), RANKS, 64, 100))
    assert [hashlib.sha256(s.tobytes()).hexdigest() for s in sequences] == [r.tokens_sha256 for r in rows]
    assert np.array_equal(next(K.read_slots(folder, 105, 1, RANKS, 64, 100)), sequences[105])
    order, stream, found = K.Permutation(len(rows), 42).slots(np.arange(len(rows))), [], []
    for s in order:
        stream += sequences[s][: rows[s].n_tokens].tolist()
    for part in np.split(np.array(stream), np.flatnonzero(np.array(stream) == e.n_vocab) + 1):
        if len(part):
            found.append(e.decode(part[:-1].tolist()))
    assert Counter(found) == Counter(r.text or "" for r in awkward.collect())
    assert {d for r in rows for d in r.doc_ids} == {r.doc_id for r in awkward.collect()}
    table = K.read_shards(spark, index, RANKS, 64).collect()
    assert len(table) == len(rows) and all(t.tokens == sequences[t.shard * 100 + t.row].tolist() for t in table)


def brute_slot(number, n, key, rounds=6):
    """The slot of a sequence with plain integers: Feistel rounds over an even number of bits, until the value is below n."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    full = 2**64 - 1
    while True:
        left, right = number >> half, number & (2**half - 1)
        for r in range(rounds):
            x = (right + key * 0x9E3779B97F4A7C15 + (r + 1) * 0xBF58476D1CE4E5B9) & full
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
            x = (x ^ x >> 27) * 0x94D049BB133111EB & full
            left, right = right, left ^ (x ^ x >> 31) & (2**half - 1)
        number = left << half | right
        if number < n:
            return number


@pytest.mark.parametrize("n", [1, 2, 5, 63, 1000])
def test_slots_against_plain_integers(n):
    assert K.Permutation(n, 42).slots(np.arange(n)).tolist() == [brute_slot(i, n, 42) for i in range(n)]


def test_shards_against_brute_force(spark, tmp_path):
    """All shard bytes of one partition's documents: tokens and end marks in a row, cut, numbered, permuted."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").coalesce(1)
    folder = f"file://{tmp_path}/shards"
    index = {r.slot: r for r in K.write_shards(docs, RANKS, length=512, rows=50, folder=folder).collect()}
    e = K.encoder(RANKS)
    stream, owner = [], []
    for d in docs.collect():
        ids = [*e.encode_ordinary(d.text or ""), e.n_vocab]
        stream += ids
        owner += [d.doc_id] * len(ids)
    n = -(-len(stream) // 512)
    for i in range(n):
        slot, own = brute_slot(i, n, 42), stream[i * 512 : (i + 1) * 512]
        whole = np.array(own + [e.n_vocab] * (512 - len(own)), "<u2").tobytes()
        shard, row = divmod(slot, 50)
        with open(f"{tmp_path}/shards/shard-{shard:07d}.bin", "rb") as f:
            f.seek(row * 1024)
            assert f.read(1024) == whole
        r = index[slot]
        assert (r.shard, r.row, r.n_tokens, r.tokens_sha256) == (shard, row, len(own), hashlib.sha256(whole).hexdigest())
        assert r.doc_ids == list(dict.fromkeys(owner[i * 512 : (i + 1) * 512]))
    assert len(index) == n


def test_tasks_write_several_shards(spark, tmp_path):
    """With few writers the shards are the same files."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").coalesce(1)
    kept = []
    for writers in (10_000, 3):
        index = K.write_shards(docs, RANKS, length=64, rows=50, folder=f"file://{tmp_path}/{writers}", writers=writers)
        kept.append(sorted((r.slot, r.shard, r.row, r.doc_ids, r.n_tokens, r.tokens_sha256) for r in index.collect()))
    assert kept[0] == kept[1] and kept[0][-1][1] > 9
    names = sorted(os.listdir(tmp_path / "3"))
    assert names == sorted(os.listdir(tmp_path / "10000"))
    assert all((tmp_path / "3" / n).read_bytes() == (tmp_path / "10000" / n).read_bytes() for n in names)


def test_no_shards_of_nothing(none):
    assert K.write_shards(none, RANKS).count() == 0


def test_op3(spark):
    rows = QUERIES["op3_token_shards"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    e = K.encoder(RANKS)
    assert sum(r.n_tokens for r in rows) == sum(len(e.encode_ordinary(d.text or "")) + 1 for d in docs)
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
