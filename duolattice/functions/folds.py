"""Dynamic programs over pairs of arrays as column expressions: one fold over the diagonals of the table, whose state is two of them.

They cover machines of order 0 whose weights depend on the kind of edit alone; `operators.lattice` has the general case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(source: Column, target: Column, delete: float, insert: float, substitute: float, match: float, join: Callable[[Column], Column]) -> Column:
    """Value of the last cell; join takes an array of the three values that reach a cell (null where there is none), weights are added along paths.

    Cells of a diagonal (i + j = d) need the two diagonals before it only, so each is made in one pass and nothing is copied."""
    n, m = F.size(source), F.size(target)

    def diagonal(state: Column, d: Column) -> Column:
        before, last = state["before"], state["last"]
        # First j of the diagonal and of the two before it.
        low, low1, low2 = (F.greatest(d - n - k, F.lit(0)) for k in range(3))

        def reaching(j: Column) -> Column:
            weight = F.when(F.get(source, d - j - 1) == F.get(target, j - 1), match).otherwise(substitute)
            return F.array(F.get(last, j - low1) + delete, F.get(before, j - 1 - low2) + weight, F.get(last, j - 1 - low1) + insert)

        cells = F.transform(F.transform(F.sequence(low, F.least(d, m)), reaching), join)
        return F.struct(last.alias("before"), cells.alias("last"))

    first = F.struct(F.array().cast("array<double>").alias("before"), F.array(F.lit(0.0)).alias("last"))
    whole = F.aggregate(F.sequence(F.lit(1), n + m), first, diagonal, lambda state: F.get(state["last"], F.lit(0)))
    return F.when(n + m == 0, 0.0).otherwise(whole)


def _log_sum(values: Column) -> Column:
    """Log of the summed exponentials of three values, of which some may be null."""
    top = F.array_max(values)
    return top + F.log(sum((F.coalesce(F.exp(F.get(values, F.lit(k)) - top), F.lit(0.0)) for k in range(1, 3)), F.coalesce(F.exp(F.get(values, F.lit(0)) - top), F.lit(0.0))))


def fold_log_partition(source: Column, target: Column, delete: float = 0.0, insert: float = 0.0, substitute: float = 0.0, match: float = 0.0) -> Column:
    """Log of the summed weights of all alignments; with zero weights the log of their number."""
    return _fold(source, target, delete, insert, substitute, match, _log_sum)


def fold_viterbi(source: Column, target: Column, delete: float, insert: float, substitute: float, match: float) -> Column:
    """Weight of the best alignment."""
    return _fold(source, target, delete, insert, substitute, match, F.array_max)
