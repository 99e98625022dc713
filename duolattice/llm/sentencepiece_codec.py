"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with byte fallback.

Encoding keeps, for each segment, an agenda of adjacent symbol pairs in order of score (ties: leftmost first), and merges until
no pair is a piece. No piece has a space mark after another character, so no merge crosses from a word to the space mark that
follows it: texts are cut there, and each distinct segment is encoded once per worker while it stays in a bounded cache. In
each Arrow batch, all segments that were new are encoded by the sentencepiece library too, and one whole text is encoded and
decoded by it; a difference is an error.

Defined results: null and empty texts have no pieces (only the ids asked for by add_bos/add_eos) and decode to an empty
text; rows are kept one for one, repeated rows and null ids too; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import MEMORIES, chunks, forget_others

SPACE = "▁"
#: Characters of the longest segment that is remembered from one batch to the next.
LONGEST_KEPT = 200
_SEGMENTS = re.compile(f"{SPACE}+[^{SPACE}]*")
_CODECS: dict[tuple, "PieceCodec"] = MEMORIES.setdefault("pieces", {})


class PieceCodec:
    """Encoder and decoder of one model file. cache_limit bounds the segments kept in memory."""

    def __init__(self, model_path: str, cache_limit: int = 600_000):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(sp.is_unused(i) for i in range(n)) or not all(sp.is_byte(i) for i in self.byte_ids):
            raise ValueError("only vocabularies with byte fallback and without unused pieces are supported")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, s in zip(self.pieces, special) if not s):
            raise ValueError("a piece has a space mark after another character")
        if sp.normalize("  ﬁ ").replace(SPACE, " ") != "   ﬁ ":
            raise ValueError("only models that leave texts as they are, with one space before them, are supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.cost = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.bytes_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.ordinary = frozenset(self.ids.values())
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.cache: dict[str, str] = {}  # a segment's ids
        self.odd: dict[str, str] = {}  # texts of the few segments that decode to something else than themselves
        self.long: list[str] = []  # segments that are remembered for one batch only
        self.cache_limit = cache_limit

    def merge(self, segment: str) -> list[str]:
        """The segment's symbols after all merges."""
        return self.merge_short(segment) if len(segment) <= 48 else self.merge_long(segment)

    def merge_short(self, segment: str) -> list[str]:
        """The agenda is a flat list with the cost of every adjacent pair, in which the first smallest one is looked up."""
        cost, never = self.cost.get, math.inf
        symbols = list(segment)
        agenda = [cost(a + b, never) for a, b in zip(segment, segment[1:])]
        while agenda:
            best = min(agenda)
            if best == never:
                break
            i = agenda.index(best)
            pair = symbols[i] + symbols[i + 1]
            symbols[i : i + 2] = (pair,)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(pair + symbols[i + 1], never)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + pair, never)
        return symbols

    def merge_long(self, segment: str) -> list[str]:
        """The agenda is a heap; entries whose symbols have changed since are passed over."""
        cost = self.cost.get
        symbols: list = list(segment)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            c = cost(pair)
            if c is not None:
                agenda.append((c, i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                wider = pair + symbols[k]
                c = cost(wider)
                if c is not None:
                    heapq.heappush(agenda, (c, i, wider))
            h = before[i]
            if h >= 0:
                wider = symbols[h] + pair
                c = cost(wider)
                if c is not None:
                    heapq.heappush(agenda, (c, h, wider))
        return [s for s in symbols if s is not None]

    def segment_ids(self, segment: str) -> list[int]:
        ids, symbols = self.ids, self.merge(segment)
        try:
            return [ids[s] for s in symbols]
        except KeyError:
            out = []
        for s in symbols:
            if s in ids:
                out.append(ids[s])
            else:
                out += [self.byte_ids[b] for b in s.encode()]
        return out

    def pieces_text(self, ids: list[int]) -> str:
        """Text of the ids, space marks as spaces and the leading one kept."""
        if self.ordinary.issuperset(ids):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        out, pending = [], bytearray()
        for i in ids:
            b = self.bytes_of.get(i)
            if b is not None:
                pending.append(b)
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending.clear()
            if i not in self.silent:
                out.append(self.pieces[i])
        if pending:
            out.append(pending.decode(errors="replace"))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        """As the library: the space before the text goes."""
        return self.pieces_text(ids).removeprefix(" ")

    @staticmethod
    def segments(text: str) -> list[str]:
        return _SEGMENTS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for s in self.segments(text) for i in self.segment_ids(s)]

    def learn(self, segmented: list[list[str]]) -> None:
        """Fills the cache with the segments' ids, new ones checked against the library."""
        if len(self.cache) > self.cache_limit:
            self.cache.clear()
            self.odd.clear()
        known = self.cache
        long = [s for s in self.long if s in known]
        for s in long:
            del known[s]
            self.odd.pop(s, None)
        new = [s for s in set().union(*segmented) if s not in known]
        self.long = [s for s in new if len(s) > LONGEST_KEPT]
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            expected = self.library.encode([s[1:].replace(SPACE, " ") for s in part], num_threads=1)
            for s, theirs in zip(part, expected):
                # A single space mark is the library's empty text, which has no pieces there.
                ids = self.segment_ids(s)
                if ids != theirs and s != SPACE:
                    raise RuntimeError(f"the library encodes {s!r} as {theirs}, not {ids}")
                known[s] = " ".join(map(str, ids))
                text = self.pieces_text(ids)
                if text != s.replace(SPACE, " "):
                    self.odd[s] = text

    def both_ways(self, segments: list[str]) -> tuple[list[str], str]:
        """Ids of a text's learnt segments, and the text that those ids decode to."""
        texts = segments if self.odd.keys().isdisjoint(segments) else [self.odd.get(s, s) for s in segments]
        return [self.cache[s] for s in segments], "".join(texts).replace(SPACE, " ").removeprefix(" ")

    def check(self, text: str, ids: list[str], decoded: str) -> None:
        """Holds a whole text's ids, and what they decode to, against the library."""
        theirs = self.library.encode(text)
        if theirs != [int(i) for part in ids for i in part.split()]:
            raise RuntimeError(f"the library encodes {text[:60]!r}... in another way")
        if self.library.decode(theirs) != decoded:
            raise RuntimeError(f"the library decodes the ids of {text[:60]!r}... in another way")


def codec(model_path: str) -> PieceCodec:
    """One codec for each model and worker process."""
    if (key := (model_path,)) not in _CODECS:
        _CODECS[key] = PieceCodec(model_path)
    return _CODECS[key]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", add_bos: bool = False, add_eos: bool = True) -> DataFrame:
    """Encodes every whole text and decodes its ids: id_col, ids (decimal, one space between), n_tokens, decoded."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("pieces")
        c = codec(model_path)
        head, tail = ([str(c.bos)] if add_bos else []), ([str(c.eos)] if add_eos else [])
        for batch in chunks(batches, limit=2 << 20):
            segmented = [c.segments(t or "") for t in batch.column(1).to_pylist()]
            c.learn(segmented)
            ids, counts, decoded = [], [], []
            for k, segments in enumerate(segmented):
                found, text = c.both_ways(segments)
                if not k:
                    c.check(batch.column(1)[0].as_py() or "", found, text)
                ids.append(" ".join([*head, *found, *tail]))
                counts.append(ids[-1].count(" ") + bool(ids[-1]))
                decoded.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.string()), pa.array(counts, pa.int64()), pa.array(decoded, pa.string())], [id_col, "ids", "n_tokens", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(kernel, f"`{id_col}` {id_type}, ids string, n_tokens long, decoded string")


def decode_ids(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of rows of decimal ids, one space between: id_col, decoded. Null: empty."""
    id_type = df.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("pieces")
        c = codec(model_path)
        for batch in chunks(batches):
            texts = [c.decode([int(i) for i in (ids or "").split()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "decoded"])

    return df.select(id_col, ids_col).mapInArrow(kernel, f"`{id_col}` {id_type}, decoded string")
