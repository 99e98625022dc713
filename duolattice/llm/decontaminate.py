"""Benchmark decontamination with suffix arrays over the training documents.

Each chunk of documents becomes a shard: its words are numbered, and the positions of all words are sorted by the words that
follow them (a suffix array, by prefix doubling that only re-sorts what is still tied). Every suffix of every benchmark item is
then binary-searched in every shard, first by its first two words and then one word deeper at a time up to its window, which gives
all locations of the window; `matches` goes on from there word by word.
Shards are built and searched where their documents are read; the benchmark goes to the tasks in blocks of about ITEM_BYTES. One
block shuffles nothing. Of several, each block's findings are written before the next is made, and merged by id and text.

Words are maximal runs of digits, letters (A-Z lower-cased) and non-ASCII characters. A window is `window` consecutive words
of an item; an item of fewer words, but not none, is one window. A document word inside an occurrence of a window is hit.

Defined results: null and empty texts have no words and are clean; an empty benchmark leaves every document clean; items are
told apart by item_id, rows that repeat one are one item, rows with a null id together are the item "null"; every document
row is kept (or, by remove_contaminated, judged) by itself, repeated rows and null ids too; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, forget_others, materialized, text_bytes, word_hashes, word_spans

#: Bytes of benchmark text that go to the tasks at once.
ITEM_BYTES = 16 << 20
SHARD_BYTES = 8 << 20


class Items:
    """Words of a block of benchmark items: their distinct spellings, and where each item's words start."""

    def __init__(self, rows: list[tuple[str | None, str | None]], window: int):
        flat, starts = text_bytes(pa.array([t for _, t in rows], pa.string()))
        low, begin, end = word_spans(flat)
        seen: dict[bytes, int] = {}
        #: For each word the number of its spelling.
        self.words = np.fromiter((seen.setdefault(low[b:e].tobytes(), len(seen)) for b, e in zip(begin, end)), np.int64, len(begin))
        self.spellings = list(seen)
        # The spellings' hashes, and their bytes one after the other.
        first_at = np.unique(self.words, return_index=True)[1]
        self.low, self.begin, self.end = low, begin[first_at], end[first_at]
        self.hashes = word_hashes(low, self.begin, self.end)
        first = np.searchsorted(begin, starts)
        self.names = ["null" if i is None else i for i, _ in rows]
        # For each suffix (every word starts one): its item, its length, and the words of the window that starts there, 0 if none does.
        sizes = np.diff(first)
        self.item = np.repeat(np.arange(len(rows)), sizes)
        self.length = np.repeat(first[1:], sizes) - np.arange(len(self.words))
        total = np.repeat(sizes, sizes)
        self.windowed = np.where(self.length >= window, window, np.where((total < window) & (self.length == total), total, 0))


def same_words(low: np.ndarray, begin: np.ndarray, end: np.ndarray, other: np.ndarray, other_begin: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether words of two byte arrays are equal, pair by pair."""
    size = end - begin
    same = size == other_end - other_begin
    at = np.flatnonzero(same)
    first = np.cumsum(size[at]) - size[at]
    inside = np.arange(int(size[at].sum())) - np.repeat(first, size[at])
    equal = low[np.repeat(begin[at], size[at]) + inside] == other[np.repeat(other_begin[at], size[at]) + inside]
    if len(at):
        same[at] = np.logical_and.reduceat(equal, first)
    return same


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ids (0: end of a document) sorted by what follows them, at least `depth` symbols deep."""
    n = len(ids)
    padded = np.concatenate([ids, np.zeros(2, np.int64)])
    # What stands after an end belongs to another document and doesn't count.
    second = np.where(ids == 0, 0, padded[1 : n + 1])
    # Three symbols make a key, or two of more than 21 bits.
    known = 3 if ids.max(initial=0) < 1 << 21 else 2
    key = ids << 42 | second << 21 | np.where(second == 0, 0, padded[2 : n + 2]) if known == 3 else ids << 32 | second
    order = np.argsort(key)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    ordered = key[order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    while True:
        start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[order] = start
        tied = ~head
        tied[:-1] |= tied[1:]
        if known >= depth or not tied.any():
            return order
        at = np.flatnonzero(tied)
        members = order[at]
        follow = rank[np.minimum(members + known, n)]
        again = np.lexsort((follow, start[at]))
        order[at] = members[again]
        group, follow = start[at][again], follow[again]
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])])
        head[at] = fresh
        known *= 2


def _narrow(ids: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of the suffix-array ranges whose symbol at depth is the wanted one."""

    def bound(first: np.ndarray, last: np.ndarray, limit: np.ndarray) -> np.ndarray:
        first, last = first.copy(), last.copy()
        while (open_ := np.flatnonzero(first < last)).size:
            mid = (first[open_] + last[open_]) >> 1
            less = ids[order[mid] + depth] < limit[open_]
            first[open_[less]] = mid[less] + 1
            last[open_[~less]] = mid[~less]
        return first

    left = bound(lo, hi, want)
    return left, bound(left, hi, want + 1)


class Shard:
    """Suffix array over the words of some documents, and the numbers that the items' spellings have there."""

    def __init__(self, texts: pa.Array, depth: int, items: Items):
        flat, starts = text_bytes(texts)
        low, begin, end = word_spans(flat)
        n_docs = len(starts) - 1
        doc = np.searchsorted(starts, begin, "right") - 1
        self.n_words = np.bincount(doc, minlength=n_docs)
        vocabulary, example, number = np.unique(word_hashes(low, begin, end), return_index=True, return_inverse=True)
        number += 1
        self.spelled = self.number_items(low, begin, end, vocabulary, example, number, items)
        # One end symbol (0) after the words of each document; word w of document d stands at w + d.
        size = len(begin) + n_docs
        self.ids = np.zeros(size + depth + 2, np.int64)
        self.ids[np.arange(len(begin)) + doc] = number
        self.doc = np.zeros(size, np.int64)
        ends = np.cumsum(self.n_words + 1) - 1
        self.doc[ends[:-1] + 1] = 1
        self.doc = np.cumsum(self.doc)
        self.first = np.concatenate([[0], ends[:-1] + 1]) if n_docs else np.zeros(0, np.int64)
        self.order = suffix_array(self.ids[:size], depth)

    @staticmethod
    def number_items(low: np.ndarray, begin: np.ndarray, end: np.ndarray, vocabulary: np.ndarray, example: np.ndarray, number: np.ndarray, items: Items) -> np.ndarray:
        """The shard's numbers of the items' spellings, -1 for those that it doesn't have.

        Spellings of equal hashes are compared byte by byte with the shard's example of the hash, and so are the shard's own words
        of these hashes; words that share a hash with another get numbers of their own."""
        out = np.full(len(items.spellings), -1)
        if not len(vocabulary) or not len(out):
            return out
        k = np.minimum(np.searchsorted(vocabulary, items.hashes), len(vocabulary) - 1)
        met = np.flatnonzero(vocabulary[k] == items.hashes)
        w = example[k[met]]
        same = same_words(low, begin[w], end[w], items.low, items.begin[met], items.end[met])
        out[met[same]] = k[met[same]] + 1
        wanted = np.zeros(len(vocabulary), bool)
        wanted[k[met]] = True
        own = np.flatnonzero(wanted[number - 1])
        w = example[number[own] - 1]
        odd = own[~same_words(low, begin[own], end[own], low, begin[w], end[w])]
        fresh: dict[bytes, int] = {}
        for o in odd:
            number[o] = len(vocabulary) + 1 + fresh.setdefault(low[begin[o] : end[o]].tobytes(), len(fresh))
        for m in met[~same]:
            if items.spellings[m] in fresh:
                out[m] = len(vocabulary) + 1 + fresh[items.spellings[m]]
        return out

    def search(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """For every suffix of the items: the range of the suffix array that has the window that starts there (empty if none does or none occurs)."""
        want, n = self.spelled[items.words], len(items.words)
        lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
        # The suffix array is in order of its suffixes' first two symbols, whatever its depth.
        first = self.ids[self.order]
        pairs = first << 32 | self.ids[self.order + 1]
        single = np.flatnonzero((items.windowed == 1) & (want > 0))
        lo[single], hi[single] = np.searchsorted(first, want[single], "left"), np.searchsorted(first, want[single], "right")
        two = np.flatnonzero((want[:-1] > 0) & (want[1:] > 0) & (items.item[:-1] == items.item[1:])) if n else np.zeros(0, np.int64)
        key, which = np.unique(want[two] << 32 | want[two + 1], return_inverse=True)
        left, right = np.searchsorted(pairs, key, "left"), np.searchsorted(pairs, key, "right")
        found = (left < right)[which]
        two, which = two[found], which[found]
        lo2, hi2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        lo2[two], hi2[two] = left[which], right[which]
        # Windows can only occur if all their pairs of neighbours do.
        lacking = np.concatenate([[0], np.cumsum(lo2 == hi2)])
        live = np.flatnonzero(items.windowed >= 2)
        live = live[lacking[live + items.windowed[live] - 1] == lacking[live]]
        lo[live], hi[live] = lo2[live], hi2[live]
        depth = 2
        while (live := live[items.windowed[live] > depth]).size:
            a, b = _narrow(self.ids, self.order, lo[live], hi[live], depth, want[live + depth])
            lo[live], hi[live] = a, b
            live, depth = live[a < b], depth + 1
        return lo, hi

    def common(self, place: np.ndarray, suffix: np.ndarray, items: Items, known: int) -> np.ndarray:
        """How many words each place shares with its suffix of the items, where the first `known` are the same."""
        want = self.spelled[items.words]
        out = np.full(len(place), known)
        live = np.arange(len(place))
        while (live := live[items.length[suffix[live]] > out[live]]).size:
            live = live[self.ids[place[live] + out[live]] == want[suffix[live] + out[live]]]
            out[live] += 1
        return out

    def places(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the given ranges of the suffix array, and for each the number of its range."""
        sizes = hi - lo
        which = np.repeat(np.arange(len(lo)), sizes)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.order[lo[which] + inside], which


def scan(texts: pa.Array, items: Items, min_match: int = 0) -> dict:
    """What a shard of these texts has of the items: per document words, hit spans, items; with min_match, the items' window then, the maximal matches too."""
    shard = Shard(texts, max(2, int(max(items.windowed, default=1))), items)
    n = len(shard.n_words)
    spans: list[list] = [[] for _ in range(n)]
    found: list[list] = [[] for _ in range(n)]
    n_hit = np.zeros(n, np.int64)
    result = {"n_words": shard.n_words, "n_hit": n_hit, "spans": spans, "items": found, "matches": []}
    if not len(shard.order) or not len(items.words):
        return result
    lo, hi = shard.search(items)
    hits = np.flatnonzero(hi > lo)
    if hits.size:
        place, which = shard.places(lo[hits], hi[hits])
        cover = np.zeros(len(shard.order) + 1, np.int64)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + items.windowed[hits][which], -1)
        edge = np.diff((np.cumsum(cover) > 0).view(np.int8), prepend=0)
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            d = shard.doc[a]
            spans[d].append((int(a - shard.first[d]), int(b - shard.first[d])))
            n_hit[d] += b - a
        pairs = np.unique(shard.doc[place] * len(items.names) + items.item[hits][which])
        for p in pairs:
            d, i = divmod(int(p), len(items.names))
            found[d].append(items.names[i])
    if min_match:
        long = hits[items.windowed[hits] == min_match]
        # A suffix whose match is the rest of the match before it says nothing new at the same places.
        place, which = shard.places(lo[long], hi[long])
        suffix = long[which]
        before = shard.ids[np.maximum(place - 1, 0)]
        want = shard.spelled[items.words]
        inner = (place > 0) & (suffix > 0) & (items.item[np.maximum(suffix - 1, 0)] == items.item[suffix]) & (before == want[np.maximum(suffix - 1, 0)]) & (before > 0)
        place, suffix = place[~inner], suffix[~inner]
        for p, s, length in zip(place, suffix, shard.common(place, suffix, items, min_match)):
            d = int(shard.doc[p])
            item = int(items.item[s])
            result["matches"].append((d, int(p - shard.first[d]), items.names[item], int(s - np.searchsorted(items.item, item)), int(length)))
    return result


def item_blocks(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> tuple[int, Iterator[Items]]:
    """The number of blocks of about ITEM_BYTES of text that the benchmark makes, and these; only one is on the driver at a time."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // ITEM_BYTES) or 1

    def made() -> Iterator[Items]:
        for k in range(n):
            part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
            yield Items([(r.id, r.text) for r in part.collect()], window)

    return n, made()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id_col, n_words, n_hit, spans (hit words, from and before), items (their ids as strings, sorted)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "h1", "h2", "n_words", "n_hit", "spans", "items"]
    schema = f"`{id_col}` {id_type}, h1 long, h2 long, n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>"
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    # Two hashes of the text tell rows apart; rows of the same id and text have the same result.
    keyed = docs.select(id_col, text_col, F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit(1), text_col).alias("h2"))

    def report(block: Items, every: bool):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget_others()
            for batch in chunks(batches, limit=SHARD_BYTES):
                r = scan(batch.column(1), block)
                kept = np.arange(batch.num_rows) if every else np.flatnonzero(r["n_hit"])
                spans = pa.array([[{"start": a, "end": b} for a, b in r["spans"][k]] for k in kept], span_type)
                items = pa.array([sorted(set(r["items"][k])) for k in kept], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(kept)) for k in (0, 2, 3)), pa.array(r["n_words"][kept]), pa.array(r["n_hit"][kept]), spans, items], names)

        return kernel

    n, blocks = item_blocks(benchmark, window)
    if n == 1:
        return keyed.mapInArrow(report(next(blocks), True), schema).drop("h1", "h2")
    # More blocks than one: what each finds is written, so that only one is held at a time, and merged by id and text.
    every = materialized(keyed.mapInArrow(report(Items([], window), True), schema).select(id_col, "h1", "h2", "n_words"), "words")
    found = None
    for b in blocks:
        part = materialized(keyed.mapInArrow(report(b, False), schema).drop("n_words", "n_hit"), "hits")
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy(F.col(id_col).alias("__id"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2")).agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    join = lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s)))
    joined = every.join(merged, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2")), "left")
    joined = joined.withColumn("spans", F.aggregate(F.coalesce("all", empty), empty, join)).withColumn("items", F.coalesce("items", F.expr("cast(array() as array<string>)")))
    return joined.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])).select(id_col, "n_words", "n_hit", "spans", "items")


def matches(docs: DataFrame, benchmark: DataFrame, min_words: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All maximal verbatim matches of at least min_words (not part of a longer one at the same places): id_col, start (word of the document), item_id, item_start, n_words."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def report(block: Items):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, limit=SHARD_BYTES):
                rows = scan(batch.column(1), block, min_words)["matches"]
                if rows:
                    d, start, item, item_start, n = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array(start, pa.int64()), pa.array(item, pa.string()), pa.array(item_start, pa.int64()), pa.array(n, pa.int64())], [id_col, "start", "item_id", "item_start", "n_words"])

        return kernel

    out = None
    n, blocks = item_blocks(benchmark, min_words)
    for b in blocks:
        part = docs.select(id_col, text_col).mapInArrow(report(b), f"`{id_col}` {id_type}, start long, item_id string, item_start long, n_words long")
        if n > 1:  # written, so that only one block is held at a time
            part = materialized(part, "matches")
        out = part if out is None else out.unionByName(part)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """The documents without a hit word, all columns as they are; the others go."""
    at = docs.columns.index(text_col)

    def clean(block: Items):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget_others()
            for batch in chunks(batches, text_at=at, limit=SHARD_BYTES):
                yield batch.filter(pa.array(scan(batch.column(at), block)["n_hit"] == 0))

        return kernel

    n, blocks = item_blocks(benchmark, window)
    for b in blocks:
        docs = docs.mapInArrow(clean(b), docs.schema)
        if n > 1:  # written, so that only one block is held at a time
            docs = materialized(docs, "clean")
    return docs
