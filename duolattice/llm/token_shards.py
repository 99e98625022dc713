"""Token-ID output in training order.

Documents are tokenised, each followed by the end token, and the tokens of a task are packed into sequences of equal length
(only a task's last one is filled up with end tokens). The packed sequences are written to the shared folder in compressed
blocks, whose counts give every sequence a global number; a keyed Feistel permutation with cycle-walking turns the number into
a global slot. Sequences are dealt to tasks by ranges of slots, many in one compressed row, and each task writes its ranges as
shards of fixed stride, one after the other: the sequence of slot s stands in shard s // rows at byte (s % rows) * stride. Readers go through
shards one after another and can go on at any slot.

Texts are tokenised once, and only token ids are shuffled, once. What a repeated task would pack anew has been written before
it is numbered; a shard is written under another name and then renamed, and holds the same bytes whenever it is written again.

Defined results: null and empty texts are an end token alone; repeated rows and null ids are documents like others; ids must be whole numbers (other types are an error); an empty
table gives no shards and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MEMORIES, chunks, forget_others, integral, materialized, scratch_path
from .token_counts import PATTERN
from .warc import file_system

_ENCODERS: dict = MEMORIES.setdefault("encoders", {})
#: Tokens in bytes that a task collects before it deals them to the shards.
DEAL_BYTES = 64 << 20
#: Tasks that write shards, at most; with more shards a task writes several, one after the other.
WRITERS = 8192


def encoder(path: str):
    """The tokenizer of a file of ranks, one for each worker process; its end token is the first free id."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of 0 .. n - 1: Feistel rounds over the next even number of bits, repeated until the value is below n."""

    n: int
    key: int
    rounds: int = 6

    @property
    def half(self) -> int:
        return max(1, -(-max(1, (self.n - 1).bit_length()) // 2))

    def _round(self, x: np.ndarray, r: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = x + np.uint64((self.key * 0x9E3779B97F4A7C15 + (r + 1) * 0xBF58476D1CE4E5B9) & (2**64 - 1))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        h, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> h, x & low
        for r in reversed(range(self.rounds)) if back else range(self.rounds):
            if back:
                left, right = right ^ self._round(left, r), left
            else:
                left, right = right, left ^ self._round(right, r)
        return left << h | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = np.asarray(x, np.uint64).copy()
        open_ = np.arange(len(out))
        while len(open_):
            out[open_] = self._once(out[open_], back)
            open_ = open_[out[open_] >= self.n]
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


def token_type(vocabulary_path: str) -> np.dtype:
    return np.dtype("<u2") if encoder(vocabulary_path).n_vocab < 1 << 16 else np.dtype("<u4")


def _compressed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=6).compress(data)


def _plain(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


PACKED = "part int, first int, doc_ids array<array<long>>, sizes array<int>, tokens binary"
DEALT = "shard int, slots array<long>, doc_ids array<array<long>>, sizes array<int>, tokens binary"
INDEX = "slot long, shard int, row int, path string, doc_ids array<long>, n_tokens int, tokens_sha256 string"
_LISTS = pa.list_(pa.list_(pa.int64()))


def pack(docs: DataFrame, vocabulary_path: str, length: int, id_col: str, text_col: str) -> DataFrame:
    """Blocks of sequences: the task's number, the block's first sequence in it, documents and token counts of the sequences, their tokens."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("encoders")
        e, dtype, part = encoder(vocabulary_path), token_type(vocabulary_path), TaskContext.get().partitionId()
        end, made = e.n_vocab, 0
        held, owners = np.zeros(0, dtype), []  # tokens not yet given out; (tokens that are left, document) of their documents

        def give(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, owners, made
            n = -(-len(held) // length) if last else len(held) // length
            if not n:
                return
            used = min(len(held), n * length)
            filled = np.full(n * length, end, dtype)
            filled[:used] = held[:used]
            ends = np.cumsum([size for size, _ in owners])
            cuts = np.arange(n + 1) * length
            cuts[-1] = used
            # A sequence holds the documents from the one of its first token to the one of its last.
            low, high = np.searchsorted(ends, cuts[:-1], "right"), np.searchsorted(ends, cuts[1:] - 1, "right")
            lists = [[d for _, d in owners[a : b + 1]] for a, b in zip(low.tolist(), high.tolist())]
            columns = [pa.array([part], pa.int32()), pa.array([made], pa.int32()), pa.array([lists], _LISTS), pa.array([np.diff(cuts)], pa.list_(pa.int32())), pa.array([_compressed(filled.tobytes())], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "first", "doc_ids", "sizes", "tokens"])
            held, made = held[used:], made + n
            owners = [(int(b - max(used, b - size)), d) for b, (size, d) in zip(ends, owners) if b > used]

        for batch in chunks(batches, limit=1 << 20):
            parts = [held]
            for d, ids in zip(batch.column(0).to_pylist(), e.encode_ordinary_batch([t or "" for t in batch.column(1).to_pylist()], num_threads=1)):
                ids.append(end)
                parts.append(np.array(ids, dtype))
                owners.append((len(ids), d))
            held = np.concatenate(parts)
            yield from give(False)
        yield from give(True)

    return docs.select(integral(docs, id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(kernel, PACKED)


def write_shards(docs: DataFrame, vocabulary_path: str, length: int = 1024, rows: int = 8192, key: int = 42, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", writers: int = WRITERS) -> DataFrame:
    """Writes the shards and returns their index, already written: slot, shard, row, path, doc_ids, n_tokens, tokens_sha256 (of the stored bytes)."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-shards")
    packed = materialized(pack(docs, vocabulary_path, length, id_col, text_col), "packed")
    # One row for each task that packed.
    counts = {r.part: r.n for r in packed.groupBy("part").agg(F.sum(F.size("sizes")).alias("n")).collect()}
    first, total = {}, 0
    for part in sorted(counts):
        first[part] = total
        total += counts[part]
    if not total:
        return spark.createDataFrame([], INDEX)
    starts = spark.sparkContext.broadcast(first)
    order, dtype = Permutation(total, key), token_type(vocabulary_path)
    stride = length * dtype.itemsize

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        first, size = starts.value, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for shard, own in sorted(held.items()):
                own.sort(key=lambda r: r[0])
                slots, lists, sizes, tokens = zip(*own)
                columns = [pa.array([shard], pa.int32()), pa.array([slots], pa.list_(pa.int64())), pa.array([lists], _LISTS), pa.array([sizes], pa.list_(pa.int32())), pa.array([_compressed(b"".join(tokens))], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "slots", "doc_ids", "sizes", "tokens"])
            held.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                part, begin, lists, sizes, tokens = (c[k].as_py() for c in batch.columns)
                tokens = _plain(tokens)
                slots = order.slots(np.arange(len(sizes)) + first[part] + begin)
                for i, slot in enumerate(slots.tolist()):
                    held.setdefault(slot // rows, []).append((slot, lists[i], sizes[i], tokens[i * stride : (i + 1) * stride]))
                size += len(tokens)
                if size > DEAL_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    def store(shard: int, own: list[tuple]) -> pa.RecordBatch:
        own.sort(key=lambda r: r[0])
        slots, lists, sizes, tokens = zip(*own)
        if list(slots) != list(range(shard * rows, min(total, (shard + 1) * rows))):
            raise RuntimeError(f"shard {shard} lacks sequences")
        path = f"{folder}/shard-{shard:07d}.bin"
        fs, where = file_system(path)
        fs.create_dir(where.rpartition("/")[0], recursive=True)
        temporary = f"{where}.{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary, compression=None) as out:
            for t in tokens:
                out.write(t)
        fs.move(temporary, where)
        n = len(slots)
        columns = [pa.array(slots, pa.int64()), pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array([path] * n), pa.array(lists, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array([hashlib.sha256(t).hexdigest() for t in tokens])]
        return pa.RecordBatch.from_arrays(columns, ["slot", "shard", "row", "path", "doc_ids", "n_tokens", "tokens_sha256"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        open_ = None
        for batch in batches:
            for k in range(batch.num_rows):
                shard, slots, lists, sizes, tokens = (c[k].as_py() for c in batch.columns)
                if shard != open_ and own:
                    yield store(open_, own)
                    own = []
                open_, tokens = shard, _plain(tokens)
                own += [(slot, d, n, tokens[i * stride : (i + 1) * stride]) for i, (slot, d, n) in enumerate(zip(slots, lists, sizes))]
        if own:
            yield store(open_, own)

    shards = -(-total // rows)
    run = -(-shards // writers)
    dealt = packed.mapInArrow(deal, DEALT).repartitionById(-(-shards // run), F.floor(F.col("shard") / run).cast("int")).sortWithinPartitions("shard")
    index = materialized(dealt.mapInArrow(write, INDEX), "token-index")
    starts.unpersist()
    return index


def read_slots(folder: str, first: int, n: int, vocabulary_path: str, length: int = 1024, rows: int = 8192) -> Iterator[np.ndarray]:
    """Sequences of n slots from the first on, in order; a reader that stopped goes on with the next slot."""
    dtype = token_type(vocabulary_path)
    stride = length * dtype.itemsize
    while n > 0:
        shard, row = divmod(first, rows)
        fs, where = file_system(f"{folder}/shard-{shard:07d}.bin")
        with fs.open_input_file(where) as f:
            f.seek(row * stride)
            for _ in range(min(n, rows - row)):
                stored = f.read(stride)
                if not stored:
                    return
                yield np.frombuffer(stored, dtype)
                first, n = first + 1, n - 1


def read_shards(spark: SparkSession, index: DataFrame, vocabulary_path: str, length: int = 1024) -> DataFrame:
    """Rows of all shards of an index: shard, row, tokens."""
    dtype = token_type(vocabulary_path)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, where = file_system(path)
                with fs.open_input_stream(where, compression=None) as f:
                    row = 0
                    while stored := f.read(1024 * length * dtype.itemsize):
                        t = np.frombuffer(stored, dtype).reshape(-1, length)
                        lists = pa.FixedSizeListArray.from_arrays(pa.array(t.ravel().astype(np.int32)), length).cast(pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), shard, np.int32)), pa.array(np.arange(row, row + len(t), dtype=np.int32)), lists], ["shard", "row", "tokens"])
                        row += len(t)

    files = index.select("shard", "path").distinct()
    return files.mapInArrow(kernel, "shard int, row int, tokens array<int>")
