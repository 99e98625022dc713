"""Edit distance and global alignment of token sequences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON = "-"


def edit_distance(source: Column, target: Column, sub_cost: int = 1) -> Column:
    """Edit distance of two arrays as one fold over the source, whose state is a row of the table: insertions and deletions cost 1.

    Equal tokens take the diagonal, which is never worse. Tokens that are all single characters, with substitutions at 1, are left to
    Spark's own function on strings, as a fold makes an array for every cell."""
    first = F.sequence(F.lit(0), F.size(target))

    def row(above: Column, token: Column) -> Column:
        # Best cost of cell j from above and diagonal; then a running minimum from the left adds insertions.
        start = F.array(above[0] + 1)
        return F.aggregate(
            F.sequence(F.lit(1), F.size(target)),
            start,
            lambda acc, j: F.concat(acc, F.array(F.when(F.get(target, j - 1) == token, F.get(above, j - 1)).otherwise(F.least(F.get(above, j - 1) + sub_cost, F.get(above, j) + 1, F.element_at(acc, -1) + 1)))),
        )

    whole = F.element_at(F.aggregate(source, first, row), -1)
    found = F.when(F.size(target) == 0, F.size(source)).when(F.size(source) == 0, F.size(target))
    if sub_cost == 1:
        single = [F.forall(side, lambda t: F.char_length(t) == 1) for side in (source, target)]
        found = found.when(single[0] & single[1], F.levenshtein(F.array_join(source, ""), F.array_join(target, "")))
    return found.otherwise(whole)


def align_tokens(s: list[str], t: list[str], sub_cost: int = 1) -> tuple[int, list[str], list[str]]:
    """Cost and both sequences filled up with epsilons. Equal tokens go together; otherwise a substitution is taken unless a gap in
    the source, or else one in the target, is cheaper."""
    n, m = len(s), len(t)
    cost = [list(range(m + 1))]
    came = [["t"] * (m + 1)]
    for i in range(1, n + 1):
        cost.append([i])
        came.append(["s"])
        for j in range(1, m + 1):
            options = [(cost[i - 1][j - 1], "b")] if s[i - 1] == t[j - 1] else [(cost[i - 1][j - 1] + sub_cost, "b"), (cost[i][j - 1] + 1, "t"), (cost[i - 1][j] + 1, "s")]
            best = min(options, key=lambda o: o[0])
            cost[i].append(best[0])
            came[i].append(best[1])
    left, right, i, j = [], [], n, m
    while i or j:
        step = came[i][j]
        left.append(s[i - 1] if step in "bs" else EPSILON)
        right.append(t[j - 1] if step in "bt" else EPSILON)
        i, j = i - (step in "bs"), j - (step in "bt")
    return cost[n][m], left[::-1], right[::-1]


def align(pairs: DataFrame, sub_cost: int = 3) -> DataFrame:
    """Adds aligned_source, aligned_target, longest and edit_distance to pairs of source and target; all four are null where a side is null."""
    added = [T.StructField(n, t) for n, t in (("aligned_source", T.ArrayType(T.StringType())), ("aligned_target", T.ArrayType(T.StringType())), ("longest", T.IntegerType()), ("edit_distance", T.IntegerType()))]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, t = b.column("source").to_pylist(), b.column("target").to_pylist()
            done = [(None, None, None) if x is None or y is None else align_tokens(x, y, sub_cost) for x, y in zip(s, t)]
            strings = pa.list_(pa.string())
            longest = [None if x is None or y is None else max(len(x), len(y)) for x, y in zip(s, t)]
            columns = [pa.array([d[1] for d in done], strings), pa.array([d[2] for d in done], strings), pa.array(longest, pa.int32()), pa.array([d[0] for d in done], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *(f.name for f in added)])

    return pairs.mapInArrow(kernel, T.StructType([*pairs.schema.fields, *added]))


def has_markers(aligned: Column) -> Column:
    """Whether the first and the last token that aren't epsilons are the begin and the end marker."""
    full = F.filter(aligned, lambda t: t != EPSILON)
    return F.coalesce((F.get(full, F.lit(0)) == "^") & (F.get(full, F.size(full) - 1) == "$"), F.lit(False))


def hash_string(source: Column, target: Column) -> Column:
    """Key of a pair: tokens joined by _, sides by ~."""
    return F.concat_ws("~", F.array_join(source, "_"), F.array_join(target, "_"))


def pair_size(source: Column, target: Column, markers: bool = False) -> Column:
    """Length of the longer side, without markers."""
    return F.greatest(F.size(source), F.size(target)) - (2 if markers else 0)


_HEAD = re.compile(r"Alignment \d+ \( weight = .* \):")


def format_alignment(rank: int, weight: float, ops: list[str], source: list[str], target: list[str]) -> str:
    """The printed block of an alignment: headline, operations, then both sides between bars (epsilons as spaces)."""
    line = lambda parts: "|" + "|".join(" " if p == EPSILON else p for p in parts)
    return f"Alignment {rank} ( weight = {weight:g} ):\n{''.join(o + ' ' for o in ops)}\n{line(source)}\n{line(target)}\n"


def parse_alignments(text: str) -> list[tuple[list[str], list[str], int]]:
    """Aligned sides of printed blocks, and the number of their epsilons as the edit distance."""
    lines, out = text.split("\n"), []
    for k, line in enumerate(lines):
        if _HEAD.match(line) and k + 3 < len(lines):
            s, t = ([EPSILON if p == " " else p for p in side.split("|")[1:]] for side in (lines[k + 2], lines[k + 3]))
            n = max(len(s), len(t))
            s, t = s + [EPSILON] * (n - len(s)), t + [EPSILON] * (n - len(t))
            out.append((s, t, s.count(EPSILON) + t.count(EPSILON)))
    return out
