"""Edit operations and the finite-state machines that say which may follow which.

An operation consumes some source and target tokens and leads to a state; a machine lists, for each state, the operations that
may be applied there, in the order that breaks ties. Orders 0, 1 and 2 remember none, one or two operations.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Operation:
    """kind: Del, Ins, Sub (phrases differ), Mat (phrases are the same), Rep (either) or None."""

    name: str
    kind: str
    n_source: int
    n_target: int

    def applies(self, source: list[str], target: list[str], i: int, j: int, allowed: "Allowed | None" = None) -> bool:
        a, b = source[i : i + self.n_source], target[j : j + self.n_target]
        if len(a) < self.n_source or len(b) < self.n_target:
            return False
        if self.kind == "Mat" and a != b or self.kind == "Sub" and a == b:
            return False
        return allowed is None or allowed.fits(a, b)


NO_OP = Operation("None", "None", 0, 0)


@dataclass(frozen=True)
class Allowed:
    """What operations may consume: a pattern that all tokens must (or must not) match, which then stands alone, or lexicons that
    phrases of more than one token must be in."""

    pattern: str | None = None
    accept: bool = True
    source_lexicon: frozenset[str] | None = None
    target_lexicon: frozenset[str] | None = None

    def fits(self, a: list[str], b: list[str]) -> bool:
        if self.pattern is not None:
            return all(bool(re.fullmatch(self.pattern, t)) == self.accept for t in [*a, *b])
        known = lambda phrase, lexicon: len(phrase) < 2 or lexicon is None or "+".join(phrase) in lexicon
        return known(a, self.source_lexicon) and known(b, self.target_lexicon)


@dataclass
class Machine:
    """states[0] is the start; moves[state] lists (operation, next state)."""

    order: int
    states: list[str] = field(default_factory=list)
    moves: list[list[tuple[Operation, int]]] = field(default_factory=list)

    def state(self, name: str) -> int:
        if name not in self.states:
            self.states.append(name)
            self.moves.append([])
        return self.states.index(name)

    def allow(self, op: Operation, to: str, accept: Callable[[str], bool] = lambda s: True) -> None:
        for k, s in enumerate(self.states):
            if accept(s):
                self.moves[k].append((op, self.states.index(to)))

    @property
    def operations(self) -> list[Operation]:
        return list(dict.fromkeys(op for m in self.moves for op, _ in m))

    def table(self, spark: SparkSession) -> DataFrame:
        """The transitions as rows: src_state, op, kind, n_source, n_target, dst_state, rank."""
        rows = [(self.states[k], op.name, op.kind, op.n_source, op.n_target, self.states[to], r) for k, m in enumerate(self.moves) for r, (op, to) in enumerate(m)]
        return spark.createDataFrame(rows, "src_state string, op string, kind string, n_source int, n_target int, dst_state string, rank int")


def operation_list(max_source: int, max_target: int, exact_match: bool, identical_unigrams: bool) -> list[Operation]:
    """Deletions, insertions, then the two-sided operations by source and target length."""
    out = [Operation(f"Del{s}", "Del", s, 0) for s in range(1, max_source + 1)]
    out += [Operation(f"Ins{t}", "Ins", 0, t) for t in range(1, max_target + 1)]
    for s in range(1, max_source + 1):
        for t in range(1, max_target + 1):
            if not exact_match:
                out.append(Operation(f"Rep{s}{t}", "Rep", s, t))
                continue
            if not (identical_unigrams and s == t == 1):
                out.append(Operation(f"Sub{s}{t}", "Sub", s, t))
            if s == t:
                out.append(Operation(f"Mat{s}{t}", "Mat", s, t))
    return out


def build(order: int = 0, max_source: int = 1, max_target: int = 1, exact_match: bool = False, allow_redundant: bool = False, identical_unigrams: bool = False) -> Machine:
    """The machine of an order. From order 1 on no deletion follows an insertion, unless allow_redundant is set."""
    ops, m = operation_list(max_source, max_target, exact_match, identical_unigrams), Machine(order)
    m.state("sta")
    if order == 0:
        for op in ops:
            m.allow(op, "sta")
    elif order == 1:
        own = lambda op: op.kind.lower() + ("".join(str(n) for n in (op.n_source, op.n_target) if n) if op.kind in ("Sub", "Rep") else str(op.n_source or op.n_target))
        for kind in ("Ins", "Del", "Mat", "Sub", "Rep"):
            for op in ops:
                if op.kind == kind:
                    m.state(own(op))
        for op in ops:
            m.allow(op, own(op), lambda s, op=op: allow_redundant or op.kind != "Del" or not s.startswith("ins"))
    elif order == 2:
        if (max_source, max_target) != (1, 1):
            raise ValueError("order 2 knows single tokens only")
        kinds = [k for k in ("ins", "del", "mat", "sub", "rep") if any(op.kind.lower() == k for op in ops)]
        for to in kinds:
            m.state(f"sta/{to}")
            for last in kinds:
                if allow_redundant or (last, to) != ("ins", "del"):
                    m.state(f"{last}/{to}")
        for kind in ("Del", "Ins", "Sub", "Rep", "Mat"):
            for op in ops:
                if op.kind == kind:
                    # The match operation has a shorter name here than in the other machines.
                    named = Operation("Mat1", "Mat", 1, 1) if kind == "Mat" else op
                    for to in [s for s in m.states if s.endswith(f"/{kind.lower()}")]:
                        m.allow(named, to, lambda s, to=to: s.endswith(to[:3]))
    else:
        raise ValueError("the order must be 0, 1 or 2")
    return m
