"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within `radius` bits share a variant within half the radius of each. All variants of every distinct
fingerprint are made, and equal variants meet. Variants are shuffled by their leading bits: a fingerprint goes once to each
bucket that holds some of its variants, with the number of changes already spent there, and its variants in the bucket are made
where they meet, so the shuffle carries a few dozen rows a fingerprint instead of thousands. The number of leading bits follows
the number of fingerprints; a bucket that holds too many variants is split by further leading bits. All fingerprints of one variant
are within the radius of each other, so a bucket gives a spanning forest of its links, not all pairs; every link is verified.
Components of the forests' union are the near-duplicate groups, over distinct fingerprints: exact copies are one node.

Defined results: null and empty texts, and texts of white space, have fingerprint zero and link like any other; fewer words
than a shingle are one shingle; rows with a null id belong to groups but are never their smallest member while another has an
id (a group without ids has a null component_id); ids may be numbers, strings or dates; repeated rows are kept by `fingerprints` and `near_duplicates`, and
`deduplicate` keeps one row of each group; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, forget_others, free_name, materialized, row_key
from .components import stars

#: Variants that a task holds at a time.
HELD = 1 << 22
#: Leading bits by which a bucket that holds too many is split.
STEP = 8


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles' XXH64, as an unsigned number."""
    import xxhash

    words = (text or "").encode().lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    line = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(line, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[:n].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())])
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    counts = np.zeros(64, np.int64)
    for a in range(0, n, 255):
        counts += np.unpackbits(rows[a : a + 255], axis=1).sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, no_id, k1 and k2 (the row's key; null ids come last), fp (the fingerprint's 64 bits as a long)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    no_id, k1, k2 = row_key(docs, id_col, text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in chunks(batches, text_at=4):
            fps = np.array([fingerprint(t, shingle, seed) for t in batch.column(4).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(fps)], [id_col, "no_id", "k1", "k2", "fp"])

    keyed = docs.select(F.col(id_col), no_id.alias("no_id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("t"))
    return keyed.mapInArrow(kernel, f"`{id_col}` {id_type}, no_id boolean, k1 {id_type}, k2 long, fp long")


def masks(bits: int, most: int) -> list[tuple[int, int]]:
    """All ways to change at most `most` of the given low bits: (mask, number of bits)."""
    return [(sum(1 << b for b in chosen), n) for n in range(most + 1) for chosen in combinations(range(bits), n)]


def _spread(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = v * np.uint64(0x9E3779B97F4A7C15)
        return v ^ (v >> np.uint64(31))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of n nodes' components, by edges a-b."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, again := root[root]):
            root = again
        if np.array_equal(root, before):
            return root


def bucket_links(fps: np.ndarray, spent: np.ndarray, low_bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links that a bucket's variants show, as (member, root) of fingerprints.

    fps: distinct fingerprints, spent: changes made in the leading bits to reach the bucket. Too many variants are made in passes."""
    order = np.argsort(fps)
    fps, spent = fps[order], spent[order]
    low = np.uint64((1 << low_bits) - 1)
    made = {s: np.array([m for m, _ in masks(low_bits, half - s)], np.uint64) for s in range(half + 1)}
    total = sum(int((spent == s).sum()) * len(m) for s, m in made.items())
    passes = max(1, math.ceil(total / HELD))
    root = np.arange(len(fps))
    for p in range(passes):
        variants, owners = [], []
        for s, m in made.items():
            who = np.flatnonzero(spent == s)
            step = max(1, HELD // max(1, len(m)) // 4)
            for a in range(0, len(who), step):
                w = who[a : a + step]
                v = ((fps[w] & low)[:, None] ^ m[None, :]).ravel()
                o = np.repeat(w.astype(np.int32), len(m))
                if passes > 1:
                    mine = _spread(v) % np.uint64(passes) == np.uint64(p)
                    v, o = v[mine], o[mine]
                variants.append(v)
                owners.append(o)
        v, o = np.concatenate(variants), np.concatenate(owners)
        del variants, owners
        by = np.argsort(v)
        v, o = v[by], o[by]
        same = np.flatnonzero(v[1:] == v[:-1])
        if not same.size:
            continue
        pairs = np.unique(o[same].astype(np.int64) * len(fps) + o[same + 1])
        a, b = pairs // len(fps), pairs % len(fps)
        if (np.bitwise_count(fps[a] ^ fps[b]) > 2 * half).any():
            raise RuntimeError("fingerprints that share a variant are too far apart")
        ra, rb = root[a], root[b]
        root = _roots(len(fps), np.concatenate([ra, np.arange(len(fps))]), np.concatenate([rb, root]))
    member = np.flatnonzero(root != np.arange(len(fps)))
    return fps[member], fps[root[member]]


def balls(bits: int, half: int) -> list[int]:
    """Variants that a fingerprint still makes in so many bits, by the changes that it has spent."""
    return [sum(math.comb(bits, k) for k in range(half - s + 1)) for s in range(half + 1)]


def links(fps: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """fps: distinct fingerprints (fp), n of them. Spanning links a-b of those within the radius of each other.

    Buckets that hold more than HELD variants, those that fingerprints of other buckets bring along included, are split by STEP more
    leading bits, again and again; with all 64 bits a bucket is one variant. So a fingerprint is never copied more often than it
    has variants, however many share a bucket."""
    if radius % 2:
        raise ValueError("the radius must be even")
    half = radius // 2
    lead = min(32, max(0, math.ceil(math.log2(max(1, n * balls(64, half)[0] / HELD)))))

    def sent(rows: DataFrame, depth: int, step: int) -> DataFrame:
        """Rows (fp, spent, bucket of `depth` bits) sent on to the buckets of `step` more bits."""
        if not step:
            return rows
        part = F.shiftrightunsigned("fp", 64 - depth - step).bitwiseAND(F.lit((1 << step) - 1).cast("long"))
        changes = F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(s).alias("s")) for m, s in masks(step, half)))
        open_ = F.filter(changes, lambda c: c["s"] + F.col("spent") <= half)
        return rows.select("fp", "spent", "bucket", part.alias("p"), F.explode(open_).alias("c")).select("fp", (F.col("spent") + F.col("c.s")).alias("spent"), F.shiftleft("bucket", step).bitwiseOR(F.col("p").bitwiseXOR(F.col("c.m"))).alias("bucket"))

    def forest_of(low_bits: int):
        def forest(t: pa.Table) -> pa.Table:
            a, b = bucket_links(t.column("fp").to_numpy().view(np.uint64), t.column("spent").to_numpy(), low_bits, half)
            return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

        return forest

    rows = sent(fps.select("fp", F.lit(0).alias("spent"), F.lit(0).cast("long").alias("bucket")), 0, lead)
    depth, out = lead, None
    while True:
        made = F.get(F.array(*(F.lit(v).cast("long") for v in balls(64 - depth, half))), F.col("spent"))
        hot = rows.groupBy("bucket").agg(F.sum(made).alias("load")).filter(F.col("load") > HELD).select("bucket")
        hot = materialized(hot, "hot") if depth < 64 else None
        split = hot is not None and not hot.isEmpty()
        cold = rows.join(hot, "bucket", "left_anti") if split else rows
        part = cold.groupBy("bucket").applyInArrow(forest_of(64 - depth), "a long, b long")
        out = part if out is None else out.unionByName(part)
        if not split:
            return out
        step = min(STEP, 64 - depth)
        rows = materialized(sent(rows.join(hot, "bucket", "left_semi"), depth, step), "buckets")
        depth += step


def groups(prints: DataFrame, radius: int = 4) -> DataFrame:
    """prints: what `fingerprints` gives, written already. All distinct fp with rep, the smallest row key of their group (no_id, k1, k2)."""
    by_fp = materialized(prints.groupBy("fp").agg(F.min(F.struct("no_id", "k1", "k2")).alias("rep")), "fingerprints")
    star = stars(links(by_fp.select("fp"), by_fp.count(), radius))
    members = star.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(star.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
    reps = members.join(by_fp, "fp").groupBy("root").agg(F.min("rep").alias("group_rep"))
    grouped = members.join(reps, "root").select("fp", "group_rep")
    # Written, so that what joins it next is a plain join of two shuffles, whose hot keys can be split.
    return materialized(by_fp.join(grouped, "fp", "left").select("fp", F.coalesce("group_rep", "rep").alias("rep")), "groups")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id_col, fingerprint (16 lower-case hex digits), component_id (smallest id of its group)."""
    prints = materialized(fingerprints(docs, shingle, seed, id_col, text_col), "simhash")
    by_fp = groups(prints, radius)
    component = F.when(~F.col("rep.no_id"), F.col("rep.k1"))
    return prints.join(by_fp, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def deduplicate(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each near-duplicate group: that of the smallest id; columns as they are."""
    prints = materialized(fingerprints(docs, shingle, seed, id_col, text_col), "simhash")
    by_fp = groups(prints, radius)
    keep = by_fp.select("rep.*").distinct()
    names = [free_name(docs, f"__{c}") for c in keep.columns]
    keyed = docs.withColumns(dict(zip(names, row_key(docs, id_col, text_col))))
    kept = keyed.join(keep.toDF(*names), names, "left_semi")
    return kept.dropDuplicates(names).select(*docs.columns)
