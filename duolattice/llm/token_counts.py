"""Exact token counts of byte-level BPE vocabularies by dynamic programming over prefixes.

For every prefix of a pre-token exactly one token can end its encoding: the token t that starts where a shorter prefix ends and
that may stand after that prefix's own last token. So count[e] = count[e - len(t)] + 1 gives the token count of all prefixes
in one pass, and truncation or budget questions are answered from these counts. Two tokens may stand together if merging
their bytes afresh gives the same two tokens; this is decided on the merge tree and kept in a bounded cache.

Defined results: null and empty texts have 0 bytes and 0 tokens; every row is kept, repeated rows and null ids too; special
strings inside texts are one token each, as the tokenizers library handles them by default; other columns are not read.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMORIES, chunks, forget_others

#: Fixed value: the pre-token pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pattern's contractions.
CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
#: Characters of the longest piece that is remembered.
LONGEST_KEPT = 200
_COUNTERS: dict[str, "PrefixCounter"] = MEMORIES.setdefault("counters", {})


def _byte_symbols() -> dict[str, int]:
    """Printable stand-ins of bytes in such vocabularies: printable Latin-1 characters stand for themselves, other bytes for 256, 257, ..."""
    own = [b for b in range(256) if chr(b).isprintable() and b != 32 and b != 0xAD]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Counts of one vocabulary file (.json). cache_limit bounds the pre-tokens and pairs kept in memory."""

    def __init__(self, path: str, cache_limit: int = 500_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        symbols = _byte_symbols()
        raw = lambda piece: bytes(symbols[c] for c in piece)
        # Tokens are numbered here by time of merging: single bytes first, then in order of the merges.
        self.token: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joined: dict[int, int] = {}
        for m in model["merges"]:
            left, right = map(raw, m.split(" ") if isinstance(m, str) else m)
            a, b = self.token[left], self.token[right]
            if left + right in self.token:
                raise ValueError("two merges make the same token")
            self.joined[a << 20 | b] = self.token[left + right] = len(self.halves)
            self.halves.append((a, b))
        self.longest = max(map(len, self.token))
        added = [a["content"] for a in spec["added_tokens"]]
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in spec["added_tokens"]):
            raise ValueError("added tokens with special matching rules are not supported")
        self.split = regex.compile(PATTERN)
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.marks = frozenset(added)
        self.blank = regex.compile(r"\s+").fullmatch
        self.pairs: dict[int, bool] = {}
        self.limit = cache_limit
        outer = self

        class Counts(dict):
            def __missing__(self, piece: str) -> int:
                n = outer.prefixes(piece.encode())[-1]
                if len(piece) <= LONGEST_KEPT:
                    self[piece] = n
                return n

        self.counts = Counts()

    def together(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a and b afresh gives a and b again: no merge across the border comes before those that finish both sides."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        halves, joined = self.halves, self.joined
        # Go back in time: bound is the first merge that has been undone, the later of the two sides is undone next.
        left, right, bound, fits = a, b, len(halves), True
        while True:
            across = joined.get(left << 20 | right)
            if across is not None and across < bound:
                fits = False
                break
            if left < 256 and right < 256:
                break
            if left > right:
                bound, left = left, halves[left][1]
            else:
                # A right side that was merged at the same time still comes after a merge to its left.
                bound, right = right + 1, halves[right][0]
        if len(self.pairs) > 2 * self.limit:
            self.pairs.clear()
        self.pairs[key] = fits
        return fits

    def prefixes(self, piece: bytes) -> list[int]:
        """Token counts of all prefixes of a pre-token's bytes, the empty one first."""
        token, together, longest = self.token.get, self.together, self.longest
        last, count = [-1], [0]
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                t = token(piece[start:end])
                if t is not None and (start == 0 or together(last[start], t)) and (start or self.whole(t)):
                    last.append(t)
                    count.append(count[start] + 1)
                    break
        return count

    def whole(self, t: int) -> bool:
        """Whether a token's bytes, merged alone, give the token."""
        key = -t - 1
        known = self.pairs.get(key)
        if known is None:
            a, b = self.halves[t]
            known = self.pairs[key] = t < 256 or (self.whole(a) and self.whole(b) and self._meets(a, b, t))
        return known

    def _meets(self, a: int, b: int, t: int) -> bool:
        # a and b must both be complete, with nothing merged across them, before merge t.
        halves, joined, bound = self.halves, self.joined, t
        left, right = a, b
        while left >= 256 or right >= 256:
            if left > right:
                bound, left = left, halves[left][1]
            else:
                bound, right = right + 1, halves[right][0]
            across = joined.get(left << 20 | right)
            if across is not None and across < bound:
                return False
        return True

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text; special strings stand for themselves."""
        if not any(m in text for m in self.marks):
            return self.split.findall(text)
        out, at = [], 0
        for m in self.added.finditer(text):
            out += [*self.split.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.split.findall(text[at:])

    def ready(self, text: str) -> list[str]:
        """The pieces of a text, after the memory has been kept within its bound."""
        if len(self.counts) > self.limit:
            self.counts.clear()
        if not self.counts:
            self.counts.update(dict.fromkeys(self.marks, 1))
        return self.pieces(text)

    def count(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.ready(text)))

    def walk(self, pieces: list[str], k: int, done: int, last: int) -> Iterator[int]:
        """Token counts of the text cut after each character of the pieces from k to before `last`, where `done` tokens stand before k.

        Cutting a text changes pre-tokens only at its end. White space at the end is one piece, however the whole text splits it and
        though its last space may belong to the next word; a contraction falls apart; a part of a special string joins the piece
        before it. In all other pieces the counts of their own prefixes hold. k must not be within a run of white space."""
        begun = 0  # characters of piece k that the run of white space before it has given out already
        while k < last:
            piece = pieces[k]
            if piece in self.marks:
                before = pieces[k - 1] if k and pieces[k - 1] not in self.marks else ""
                base = done - self.plain_count(before)
                yield from (base + self.plain_count(before + piece[:j]) for j in range(1, len(piece)))
                yield done + 1
            elif piece in CONTRACTIONS:
                yield from (done + self.plain_count(piece[:j]) for j in range(1, len(piece)))
                yield done + self.counts[piece]
            elif self.blank(piece):
                end = k
                while end < len(pieces) and pieces[end] not in self.marks and self.blank(pieces[end]):
                    end += 1
                borrowed = end < len(pieces) and pieces[end] not in self.marks and pieces[end][0] == " "
                run = "".join(pieces[k:end]) + " " * borrowed
                yield from (done + n for n in self.by_character(run)[1:])
                done += sum(self.counts[p] for p in pieces[k:end])
                k, begun = end, int(borrowed)
                continue
            else:
                yield from (done + n for n in self.by_character(piece)[1 + begun :])
            done, k, begun = done + self.counts[piece], k + 1, 0

    def by_character(self, piece: str) -> list[int]:
        """Token counts of a pre-token's prefixes, by characters."""
        raw = self.prefixes(piece.encode())
        return raw if len(raw) == len(piece) + 1 else [raw[0], *(raw[e] for e in accumulate(len(c.encode()) for c in piece))]

    def plain_count(self, text: str) -> int:
        """Tokens of a text without special strings."""
        return sum(map(self.counts.__getitem__, self.split.findall(text)))

    def at_prefixes(self, text: str) -> list[int]:
        """Exact token count of text[:k] encoded by itself, for k = 0 .. len(text), in one pass."""
        pieces = self.ready(text)
        return [0, *self.walk(pieces, 0, 0, len(pieces))]

    def fitting(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of the whole text, and the length of its longest prefix, in characters, that alone has at most so many tokens (-1
        if even none is too many, which a negative budget says).

        Of all pieces only those around the one in which the budget ends are gone through."""
        pieces = self.ready(text)
        before = [0, *accumulate(map(self.counts.__getitem__, pieces))]
        if before[-1] <= budget:
            return before[-1], len(text)
        if budget < 0:
            return before[-1], -1
        # The last piece before which the budget isn't used up; white space that goes on from there may take fewer tokens as one run.
        k = max(0, bisect_left(before, max(1, budget)) - 1)
        while k and (self.blank(pieces[k]) or pieces[k][0] == " ") and pieces[k] not in self.marks and pieces[k - 1] not in self.marks and self.blank(pieces[k - 1]):
            k -= 1
        at = sum(map(len, pieces[:k]))
        fits = [at + j for j, n in enumerate(self.walk(pieces, k, before[k], min(len(pieces), k + 5)), 1) if n <= budget]
        return before[-1], max(fits, default=at)

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of the text, in characters, that alone has at most so many tokens; empty if the budget is negative."""
        return text[: max(0, self.fitting(text, budget)[1])]


def counter(path: str) -> PrefixCounter:
    """One counter for each vocabulary and worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", budget: int | None = None) -> DataFrame:
    """Token counts of whole texts: id_col, n_bytes (UTF-8), n_tokens; with a budget also keep_chars, the characters of the longest
    prefix that alone has at most so many tokens (-1 if the budget is negative)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "n_tokens", *(["keep_chars"] if budget is not None else [])]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("counters")
        c = counter(path)
        for batch in chunks(batches):
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).cast(pa.int64())
            texts = batch.column(1).to_pylist()
            counts = zip(*[c.fitting(t or "", budget) for t in texts]) if budget is not None else [[c.count(t or "") for t in texts]]
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, *(pa.array(n, pa.int64()) for n in counts)], names)

    return docs.select(id_col, text_col).mapInArrow(kernel, f"`{id_col}` {id_type}, n_bytes long, n_tokens long" + (", keep_chars long" if budget is not None else ""))


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and counts: the token count of every prefix of the text, by characters, the empty one first."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("counters")
        c = counter(path)
        for batch in chunks(batches, limit=1 << 20):
            counts = [c.at_prefixes(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.list_(pa.int32()))], [id_col, "counts"])

    return docs.select(id_col, text_col).mapInArrow(kernel, f"`{id_col}` {id_type}, counts array<int>")


def within_budget(counts: DataFrame, budget: int, counts_col: str = "counts") -> DataFrame:
    """Adds fits (the whole text has at most so many tokens) and keep_chars (the longest prefix that has), from stored prefix counts alone."""
    n = F.element_at(counts_col, -1)
    kept = F.aggregate(F.transform(counts_col, lambda c, k: F.when(c <= budget, k).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return counts.withColumns({"fits": n <= budget, "keep_chars": kept})
