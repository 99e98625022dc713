"""Alignment lattices of many pairs at once, and semiring inference over them.

A lattice is a directed acyclic graph over (source position, target position, state); its edges are edit operations with the
features that they show. A batch puts the lattices of its pairs side by side and sorts all edges by level (how many tokens have
been consumed), so that each step of a dynamic program is one vectorised operation over the batch, whatever the pairs' number. The
lattices are built in the same way, level by level; names of features are made once for each different history of steps.
Structure and features don't depend on weights: a batch is built once and weighed again for each label and each iteration.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .alignment import format_alignment
from .machine import NO_OP, Allowed, Machine

NEG_INF = -np.inf


@dataclass(frozen=True)
class LatticeOptions:
    """start_arc and final_features let "None" steps at the ends show features; markers say that sequences carry begin and end marks."""

    start_arc: bool = False
    final_features: bool = True
    markers: bool = False


@dataclass(slots=True)
class Edge:
    src: int
    dst: int
    level: int
    op: str
    source: str
    target: str


def _segments(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _log_sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    top = np.maximum.reduceat(values, starts)
    safe = np.where(np.isfinite(top), top, 0.0)
    sizes = np.diff(np.append(starts, len(values)))
    with np.errstate(divide="ignore"):
        return np.log(np.add.reduceat(np.exp(values - np.repeat(safe, sizes)), starts)) + safe


START = ("None", "-", "-")


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges (start, size), one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class _Side:
    """The tokens of all pairs on one side: numbers (equal tokens of both sides have equal ones), and where each pair's begin."""

    def __init__(self, sequences: list[list[str]], numbers: dict[str, int], longest: int):
        self.length = np.array([len(s) for s in sequences], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.tokens = [t for s in sequences for t in s]
        flat = np.array([numbers.setdefault(t, len(numbers)) for t in self.tokens], np.int64)
        self.flat = np.concatenate([flat, np.full(longest + 1, -1)])
        self.phrases: dict[tuple[int, ...], int] = {(): 0}
        #: By length, the phrase that begins at each token (whether or not it ends in the same sequence).
        self.phrase = [np.zeros(len(flat) + 1, np.int64)]
        for n in range(1, longest + 1):
            windows = np.stack([self.flat[k : len(flat) + 1 + k] for k in range(n)], axis=1)
            different, which = np.unique(windows, axis=0, return_inverse=True)
            ids = np.array([self.phrases.setdefault(tuple(w), len(self.phrases)) for w in different.tolist()], np.int64)
            self.phrase.append(ids[which.ravel()])
        self.words = list(numbers)

    def texts(self, words: list[str]) -> list[str]:
        return ["+".join(words[t] if t >= 0 else "" for t in phrase) or "-" for phrase in self.phrases]

    def fitting(self, allowed: Allowed | None, n: int, side: int, words: list[str]) -> np.ndarray | None:
        """By first token: whether a phrase of n tokens may be consumed (None: all may)."""
        if allowed is None:
            return None
        fits = [allowed.fits(*([[words[t] for t in p], []] if side == 0 else [[], [words[t] for t in p]])) if len(p) == n and -1 not in p else False for p in self.phrases]
        return np.array(fits, bool)[self.phrase[n]]


class Batch:
    """Lattices of many pairs. index: feature name to base id; names that it lacks are dropped (gather=True: they are added)."""

    def __init__(self, pairs: list[tuple[list[str], list[str]]], machine: Machine, generator, index: dict[str, int], options: LatticeOptions = LatticeOptions(), allowed: Allowed | None = None, gather: bool = False):
        self.n, self.pairs, self.machine = len(pairs), pairs, machine
        self._grow(machine, options, allowed)
        size = np.maximum(self.sides[0].length, self.sides[1].length) - (2 if options.markers else 0)
        share = np.where(size > 0, 1.0 / np.maximum(size, 1), 1.0) if generator.normalize else np.ones(self.n)
        which, lists = self._named(generator, options, index, gather)
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = np.array([i for x in lists for i in x], np.int64)
        runs = sizes[which] if len(which) else np.zeros(0, np.int64)
        self.ptr = np.concatenate([[0], np.cumsum(runs)])
        self.ids = flat[_spread((np.cumsum(sizes) - sizes)[which], runs)] if len(which) else np.zeros(0, np.int64)
        self.edge_of_value = np.repeat(np.arange(self.n_edges), runs)
        self.values = share[self.pair[self.edge_of_value]]
        self.levels = int(self.level.max()) + 1 if self.n_edges else 0
        self._forward = self._plan(self.dst)
        self._backward = self._plan(self.src)
        # Places of (pair, feature): the sparse vectors of the pairs.
        width = int(self.ids.max()) + 1 if len(self.ids) else 1
        self.places, self.place_of_value = np.unique(self.pair[self.edge_of_value] * width + self.ids, return_inverse=True)
        self.place_pair, self.place_id = self.places // width, self.places % width

    @property
    def n_edges(self) -> int:
        return len(self.src)

    def _grow(self, machine: Machine, options: LatticeOptions, allowed: Allowed | None) -> None:
        """Nodes and edges of all pairs, level by level, so each node is complete before it is left. A node's edges stand in order
        of the machine's moves."""
        ops = machine.operations
        longest = [max((o.n_source for o in ops), default=0), max((o.n_target for o in ops), default=0)]
        numbers: dict[str, int] = {}
        s, t = self.sides = [_Side([p[k] for p in self.pairs], numbers, longest[k]) for k in (0, 1)]
        words = list(numbers)
        may = [[side.fitting(allowed, n, k, words) for n in range(longest[k] + 1)] for k, side in enumerate(self.sides)]
        high, wide, states = int(s.length.max(initial=0)) + 1, int(t.length.max(initial=0)) + 1, len(machine.states)
        key_of = lambda pair, i, j, state: ((pair * high + i) * wide + j) * states + state
        whole = np.arange(self.n)
        # For each level what arrives there: keys of nodes, and the edge that came first (-1: none).
        waiting: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(high + wide)]
        waiting[0].append((key_of(whole, 0, 0, 0), np.full(self.n, -1)))
        keys, came, edges, finals = [], [], [], []
        n_nodes = n_edges = 0
        for level, arrived in enumerate(waiting):
            if not arrived:
                continue
            key, first = np.unique(np.concatenate([k for k, _ in arrived]), return_index=True)
            keys.append(key)
            came.append(np.concatenate([e for _, e in arrived])[first])
            me = n_nodes + np.arange(len(key))
            n_nodes += len(key)
            rest, state = np.divmod(key, states)
            rest, j = np.divmod(rest, wide)
            pair, i = np.divmod(rest, high)
            done = (i == s.length[pair]) & (j == t.length[pair])
            finals.append((me[done], pair[done]))
            for k in range(states):
                here = np.flatnonzero((state == k) & ~done)
                if not len(here):
                    continue
                taken: dict[tuple[int, int, int], np.ndarray] = {}
                p, a, b = pair[here], i[here], j[here]
                for op, to in machine.moves[k]:
                    fits = (a + op.n_source <= s.length[p]) & (b + op.n_target <= t.length[p])
                    at_s, at_t = np.where(fits, s.first[p] + a, 0), np.where(fits, t.first[p] + b, 0)
                    if op.kind in ("Mat", "Sub"):
                        same = np.full(len(p), op.n_source == op.n_target)
                        for d in range(op.n_source if op.n_source == op.n_target else 0):
                            same &= s.flat[at_s + d] == t.flat[at_t + d]
                        fits &= same if op.kind == "Mat" else ~same
                    for side, at, n in ((0, at_s, op.n_source), (1, at_t, op.n_target)):
                        if may[side][n] is not None and (n or allowed.pattern is None):
                            fits &= may[side][n][at]
                    # Of moves that lead to the same node the first one counts.
                    way = (op.n_source, op.n_target, to)
                    if way in taken:
                        fits &= ~taken[way]
                    taken[way] = fits | taken.get(way, False)
                    go = np.flatnonzero(fits)
                    if not len(go):
                        continue
                    target = key_of(p[go], a[go] + op.n_source, b[go] + op.n_target, to)
                    edges.append((me[here[go]], target, np.full(len(go), level + 1), p[go], np.full(len(go), ops.index(op)), s.phrase[op.n_source][at_s[go]], t.phrase[op.n_target][at_t[go]], a[go], b[go]))
                    waiting[level + op.n_source + op.n_target].append((target, n_edges + np.arange(len(go))))
                    n_edges += len(go)
        empty = [np.zeros(0, np.int64)] * 9
        src, dst, lev, pair, op, sp, tp, i, j = (np.concatenate(c) for c in zip(*edges)) if edges else empty
        key, first = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, came))
        by = np.argsort(key)
        dst = by[np.searchsorted(key[by], dst)] if len(dst) else dst
        self._came = first
        # Steps: what an edge does, numbered; the last one does nothing.
        n_s, n_t = len(s.phrases), len(t.phrases)
        steps, self.step = np.unique((op * n_s + sp) * n_t + tp, return_inverse=True)
        texts = [side.texts(words) for side in self.sides]
        self.steps_known = [(ops[x // (n_s * n_t)].name, texts[0][x // n_t % n_s], texts[1][x % n_t]) for x in steps.tolist()] + [START]
        end, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*finals)) if finals else empty[:2]
        none = len(self.steps_known) - 1
        goal = n_nodes + whole
        n_nodes += self.n
        parts = [(src, end), (dst, goal[of]), (lev, s.length[of] + t.length[of] + 1), (pair, of), (self.step, np.full(len(of), none)), (i, s.length[of]), (j, t.length[of])]
        # The roots are the first nodes, one for each pair in order.
        root = whole
        if options.start_arc:
            arcs = (n_nodes + whole, whole, np.zeros(self.n, np.int64), whole, np.full(self.n, none), np.zeros(self.n, np.int64), np.zeros(self.n, np.int64))
            parts = [(*x, arc) for x, arc in zip(parts, arcs)]
            root, n_nodes = n_nodes + whole, n_nodes + self.n
        self.src, self.dst, self.level, self.pair, self.step, self._i, self._j = (np.concatenate(x).astype(np.int64) for x in parts)
        self.n_nodes, self.root, self.goal, self._n_moves = n_nodes, root, goal, len(src)

    def _named(self, generator, options: LatticeOptions, index: dict[str, int], gather: bool) -> tuple[np.ndarray, list[list[int]]]:
        """For each edge the number of a list of feature ids, and these lists."""
        none, moves = len(self.steps_known) - 1, self._n_moves
        # What the state of a node remembers: the last step or the last two; -1: there is none.
        node = np.arange(len(self._came))
        gone = self._came >= 0
        last, before = np.full(len(node), none), np.full(len(node), -1)
        last[gone] = self.step[self._came[gone]]
        if self.machine.order > 1:
            before[gone] = last[self.src[self._came[gone]]]
        m = none + 2
        inside = self.src < len(node)
        src = np.where(inside, self.src, 0)
        key = np.where(inside & (self.machine.order > 0), last[src] + 1, np.where(inside, none + 1, 0))
        key = (np.where(inside, before[src] + 1, 0) * m + key) * m + self.step + 1
        # Edges to the goal show features only if they are asked for; number 0 is the empty list.
        silent = np.zeros(self.n_edges, bool)
        if not options.final_features:
            silent[moves:] = np.isin(self.dst[moves:], self.goal)
        lists: list[list[int]] = [[]]
        which = np.zeros(self.n_edges, np.int64)

        def known(names: set[str]) -> list[int]:
            out = []
            for name in sorted(names):
                if gather and name not in index:
                    index[name] = len(index)
                if name in index:
                    out.append(index[name])
            return out

        shown = np.flatnonzero(~silent)
        kinds, first, kind = np.unique(key[shown], return_index=True, return_inverse=True)
        history_of = lambda k: [self.steps_known[x - 1] for x in (k // (m * m), k // m % m, k % m) if x]
        if not generator.positional:
            lists += [known(generator.names(history_of(k), [], [], 0, 0, 0, 0, shown[f] >= moves)) for k, f in zip(kinds.tolist(), first.tolist())]
            which[shown] = kind + 1
            return which, lists
        # Features that look at positions are made edge by edge.
        histories = [history_of(k) for k in kinds.tolist()]
        for e, k in zip(shown.tolist(), kind.tolist()):
            source, target = self.pairs[self.pair[e]]
            i, j = int(self._i[e]), int(self._j[e])
            _, a, b = self.steps_known[self.step[e]]
            width = [0, 0] if e >= moves else [0 if x == "-" else x.count("+") + 1 for x in (a, b)]
            lists.append(known(generator.names(histories[k], source, target, i, j, i + width[0], j + width[1], e >= moves)))
            which[e] = len(lists) - 1
        return which, lists

    @property
    def edges(self) -> list[Edge]:
        """All edges as objects."""
        return [Edge(int(self.src[e]), int(self.dst[e]), int(self.level[e]), *self.steps_known[self.step[e]]) for e in range(self.n_edges)]

    def _plan(self, by: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each level: its edges sorted by a node, where each node's edges start, and the nodes."""
        out = []
        order = np.lexsort((np.arange(len(by)), by, self.level))
        cuts = np.searchsorted(self.level[order], np.arange(self.levels + 1))
        for a, b in zip(cuts, cuts[1:]):
            e = order[a:b]
            starts = _segments(by[e])
            out.append((e, starts, by[e][starts]))
        return out

    # Edges of one node to the same level only: a node's outgoing edges may end on several levels, so passes go level by level
    # and add up what each level brings.

    def weigh(self, weights: np.ndarray) -> np.ndarray:
        """Log weight of every edge under weights of the base features."""
        return np.bincount(self.edge_of_value, weights[self.ids] * self.values, self.n_edges) if len(self.ids) else np.zeros(self.n_edges)

    def inside(self, w: np.ndarray) -> np.ndarray:
        """Log mass of all paths from each node to its goal."""
        beta = np.full(self.n_nodes, NEG_INF)
        beta[self.goal] = 0.0
        for e, starts, nodes in reversed(self._backward):
            if len(e):
                beta[nodes] = np.logaddexp(beta[nodes], _log_sum(w[e] + beta[self.dst[e]], starts))
        return beta

    def outside(self, w: np.ndarray) -> np.ndarray:
        """Log mass of all paths from its root to each node."""
        alpha = np.full(self.n_nodes, NEG_INF)
        alpha[self.root] = 0.0
        for e, starts, nodes in self._forward:
            if len(e):
                alpha[nodes] = np.logaddexp(alpha[nodes], _log_sum(w[e] + alpha[self.src[e]], starts))
        return alpha

    def log_partition(self, w: np.ndarray) -> np.ndarray:
        return self.inside(w)[self.root]

    def edge_posteriors(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log partition of every pair, and the probability of every edge."""
        beta, alpha = self.inside(w), self.outside(w)
        z = beta[self.root]
        with np.errstate(invalid="ignore"):
            p = np.exp(alpha[self.src] + w + beta[self.dst] - z[self.pair])
        return z, np.where(np.isfinite(z[self.pair]), np.nan_to_num(p), 0.0)

    def expected(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log partition, and the expectations at `places`."""
        z, p = self.edge_posteriors(w)
        return z, np.bincount(self.place_of_value, p[self.edge_of_value] * self.values, len(self.places)) if len(self.ids) else np.zeros(0)

    def viterbi(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of the best path of each pair, and for each node its best edge (-1: none); ties keep the first edge of the node."""
        best = np.full(self.n_nodes, NEG_INF)
        best[self.goal] = 0.0
        chosen = np.full(self.n_nodes, -1, np.int64)
        for e, starts, nodes in reversed(self._backward):
            if not len(e):
                continue
            score = w[e] + best[self.dst[e]]
            top = np.maximum.reduceat(score, starts)
            sizes = np.diff(np.append(starts, len(e)))
            hit = np.where(score == np.repeat(top, sizes), np.arange(len(e)), len(e))
            first = e[np.minimum.reduceat(hit, starts)]
            take = (top > best[nodes]) | ((top == best[nodes]) & np.isfinite(top) & (first < np.where(chosen[nodes] < 0, self.n_edges, chosen[nodes])))
            best[nodes[take]], chosen[nodes[take]] = top[take], first[take]
        return best[self.root], chosen

    def best_path(self, p: int, chosen: np.ndarray) -> list[int]:
        out, node = [], self.root[p]
        while node != self.goal[p]:
            e = chosen[node]
            if e < 0:
                return []
            out.append(int(e))
            node = self.dst[e]
        return out

    def path_vector(self, path: Iterable[int]) -> dict[int, float]:
        """Summed features of a path's edges."""
        out: dict[int, float] = {}
        for e in path:
            for k in range(self.ptr[e], self.ptr[e + 1]):
                out[int(self.ids[k])] = out.get(int(self.ids[k]), 0.0) + float(self.values[k])
        return out

    def max_features(self, w: np.ndarray) -> tuple[np.ndarray, list[dict[int, float]]]:
        score, chosen = self.viterbi(w)
        return score, [self.path_vector(self.best_path(p, chosen)) for p in range(self.n)]

    def k_best(self, w: np.ndarray, k: int) -> list[list[tuple[float, list[int]]]]:
        """The k best paths of each pair, best first. Going backward, every node keeps its k best ways to the goal; scores that agree
        to nine digits are ties, of which those come first that take earlier edges."""
        best = np.full((self.n_nodes, k), NEG_INF)
        best[self.goal, 0] = 0.0
        edge, rank = np.full((self.n_nodes, k), -1), np.zeros((self.n_nodes, k), np.int64)
        for e, starts, nodes in reversed(self._backward):
            if not len(e):
                continue
            owner = np.repeat(np.arange(len(nodes)), np.diff(np.append(starts, len(e))) * k)
            score = (w[e][:, None] + best[self.dst[e]]).ravel()
            # Edges and their ways are in order, and so they stay where scores are the same.
            order = np.lexsort((np.arange(len(score)), -np.round(score, 9), owner))
            place = np.arange(len(order)) - np.repeat(np.searchsorted(owner, np.arange(len(nodes))), np.bincount(owner, minlength=len(nodes)))
            kept = order[(place < k) & np.isfinite(score[order])]
            place = place[(place < k) & np.isfinite(score[order])]
            at = nodes[owner[kept]]
            best[at, place], edge[at, place], rank[at, place] = score[kept], e[kept // k], kept % k
        out: list[list[tuple[float, list[int]]]] = [[] for _ in range(self.n)]
        pair, r = np.nonzero(np.isfinite(best[self.root]))
        node, trails = self.root[pair], [[] for _ in range(len(pair))]
        scores, live = best[node, r], np.arange(len(pair))
        while (live := live[node[live] != self.goal[pair[live]]]).size:
            e = edge[node[live], r[live]]
            r[live] = rank[node[live], r[live]]
            node[live] = self.dst[e]
            for t, x in zip(live.tolist(), e.tolist()):
                trails[t].append(x)
        for p, score, trail in zip(pair.tolist(), scores.tolist(), trails):
            out[p].append((score, trail))
        return out

    def along(self, w: np.ndarray, f: np.ndarray) -> np.ndarray:
        """For each edge its probability times the expected sum of f (a number for each edge) over the paths that take it."""
        beta, alpha = self.inside(w), self.outside(w)
        _, p = self.edge_posteriors(w)
        before, after = np.zeros(self.n_nodes), np.zeros(self.n_nodes)
        with np.errstate(invalid="ignore"):
            share = np.nan_to_num(np.exp(alpha[self.src] + w - alpha[self.dst]))
            rest = np.nan_to_num(np.exp(w + beta[self.dst] - beta[self.src]))
        for e, starts, nodes in self._forward:
            if len(e):
                before[nodes] += np.add.reduceat(share[e] * (before[self.src[e]] + f[e]), starts)
        for e, starts, nodes in reversed(self._backward):
            if len(e):
                after[nodes] += np.add.reduceat(rest[e] * (after[self.dst[e]] + f[e]), starts)
        return p * (before[self.src] + f + after[self.dst])

    def cooccurrences(self, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each pair its active features and E[phi phi'] over them.

        Going forward, every node keeps the mean of what its incoming paths have collected; each edge pairs that with its own."""
        beta, alpha = self.inside(w), self.outside(w)
        z = beta[self.root]
        _, p = self.edge_posteriors(w)
        out = []
        for pair in range(self.n):
            mine = np.flatnonzero(self.pair == pair)
            active = np.unique(np.concatenate([self.ids[self.ptr[e] : self.ptr[e + 1]] for e in mine])) if len(mine) else np.zeros(0, np.int64)
            k = len(active)
            second = np.zeros((k, k))
            if not np.isfinite(z[pair]):
                out.append((active, second))
                continue
            mean: dict[int, np.ndarray] = {int(self.root[pair]): np.zeros(k)}
            for e in mine[np.argsort(self.level[mine], kind="stable")]:
                s, d = int(self.src[e]), int(self.dst[e])
                own = np.zeros(k)
                own[np.searchsorted(active, self.ids[self.ptr[e] : self.ptr[e + 1]])] = self.values[self.ptr[e] : self.ptr[e + 1]]
                before = mean.get(s, np.zeros(k))
                if p[e]:
                    cross = np.outer(before, own)
                    second += p[e] * (np.outer(own, own) + cross + cross.T)
                share = np.exp(alpha[s] + w[e] - alpha[d]) if np.isfinite(alpha[d]) else 0.0
                mean[d] = mean.get(d, np.zeros(k)) + share * (before + own)
            out.append((active, second))
        return out

    def steps(self, path: list[int]) -> list[tuple[str, str, str]]:
        return [self.steps_known[self.step[e]] for e in path]

    def blocks(self, w: np.ndarray, k: int = 1) -> list[list[str]]:
        """Printed alignments of each pair, best first; steps that consume nothing are left out."""
        out = []
        for found in self.k_best(w, k):
            texts = []
            for rank, (score, path) in enumerate(found):
                steps = [s for s in self.steps(path) if s[0] != NO_OP.name]
                texts.append(format_alignment(rank, score, *([s[i] for s in steps] for i in range(3))))
            out.append(texts)
        return out

    def graphviz(self, p: int, w: np.ndarray) -> str:
        """A pair's lattice as text for graph drawing."""
        mine = np.flatnonzero(self.pair == p)
        nodes = sorted({*self.src[mine].tolist(), *self.dst[mine].tolist()})
        lines = [f"{v};" for v in nodes] + [f'{self.src[e]} -> {self.dst[e]} [label="{self.steps_known[self.step[e]][0]} {w[e]:g}"];' for e in mine]
        return "digraph G {\n" + "\n".join(lines) + "\n}\n"


def topological_order(batch: Batch, p: int, reverse: bool = False) -> list[int]:
    """Nodes of a pair so that every edge goes forward."""
    mine = np.flatnonzero(batch.pair == p)
    level: dict[int, int] = {int(batch.root[p]): -1}
    for e in mine:
        level[int(batch.dst[e])] = int(batch.level[e])
    order = sorted(level, key=lambda v: (level[v], v))
    return order[::-1] if reverse else order


#: Columns of what inference gives, by mode.
MODES = {
    "log_partition": (("id", "long"), ("value", "double")),
    "viterbi": (("id", "long"), ("value", "double")),
    "expected_ops": (("id", "long"), ("op", "string"), ("value", "double")),
    "k_best": (("id", "long"), ("rank", "int"), ("value", "double"), ("ops", "array<string>")),
    "expected": (("id", "long"), ("feature", "string"), ("value", "double")),
    "max_features": (("id", "long"), ("feature", "string"), ("value", "double")),
    "cooccurrences": (("id", "long"), ("feature", "string"), ("other", "string"), ("value", "double")),
    "size": (("id", "long"), ("nodes", "long"), ("edges", "long")),
}
_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}


def infer(pairs: DataFrame, machine: Machine, generator, weights: dict[str, float], mode: str, options: LatticeOptions = LatticeOptions(), k: int = 2, per_batch: int = 128, allowed: Allowed | None = None) -> DataFrame:
    """Inference over pairs (id, source, target) with weights by feature name, in Arrow batches; features without a weight don't count.

    log_partition, viterbi: id, value. expected_ops: id, op, value (expected number of uses). k_best: id, rank, value, ops.
    expected, max_features: id, feature, value (expectation; sum over the best path). cooccurrences: id, feature, other, value
    (expected product). size: id, nodes, edges."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {tuple(MODES)}")
    columns, names = MODES[mode], list(weights)

    def rows_of(ids: list, batch: Batch, w: np.ndarray) -> list[tuple]:
        if mode == "log_partition":
            return list(zip(ids, batch.log_partition(w).tolist()))
        if mode == "viterbi":
            return list(zip(ids, batch.viterbi(w)[0].tolist()))
        if mode == "expected_ops":
            _, p = batch.edge_posteriors(w)
            kinds = sorted({op for op, _, _ in batch.steps_known} - {NO_OP.name})
            kind = np.array([kinds.index(op) if op != NO_OP.name else len(kinds) for op, _, _ in batch.steps_known])[batch.step]
            sums = np.bincount(batch.pair * (len(kinds) + 1) + kind, p, batch.n * (len(kinds) + 1)).reshape(batch.n, -1)
            seen = np.bincount(batch.pair * (len(kinds) + 1) + kind, minlength=sums.size).reshape(sums.shape) > 0
            return [(ids[i], kinds[o], float(sums[i, o])) for i, o in zip(*(x.tolist() for x in np.nonzero(seen[:, :-1])))]
        if mode == "expected":
            return [(ids[p], names[f], v) for p, f, v in zip(batch.place_pair.tolist(), batch.place_id.tolist(), batch.expected(w)[1].tolist())]
        if mode == "max_features":
            return [(i, names[f], v) for i, found in zip(ids, batch.max_features(w)[1]) for f, v in found.items()]
        if mode == "cooccurrences":
            return [(i, names[a], names[b], float(m[x, y])) for i, (active, m) in zip(ids, batch.cooccurrences(w)) for x, a in enumerate(active) for y, b in enumerate(active)]
        if mode == "size":
            edges = np.bincount(batch.pair, minlength=batch.n)
            nodes = [len(np.unique(np.concatenate([batch.src[batch.pair == p], batch.dst[batch.pair == p]]))) for p in range(batch.n)]
            return list(zip(ids, nodes, edges.tolist()))
        return [(i, r, score, [s[0] for s in batch.steps(path) if s[0] != NO_OP.name]) for i, found in zip(ids, batch.k_best(w, k)) for r, (score, path) in enumerate(found)]

    index = {name: i for i, name in enumerate(weights)}
    vector = np.array(list(weights.values()), float)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, per_batch):
                part = b.slice(a, per_batch)
                lattices = Batch(list(zip(part.column(1).to_pylist(), part.column(2).to_pylist())), machine, generator, index, options, allowed)
                rows = rows_of(part.column(0).to_pylist(), lattices, lattices.weigh(vector))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*rows), columns)], [n for n, _ in columns])

    return pairs.select("id", "source", "target").mapInArrow(kernel, ", ".join(f"{n} {t}" for n, t in columns))


def weigh_by(batch: Batch, f: Callable[[Edge], float]) -> np.ndarray:
    """Edge weights from a function of the edges."""
    return np.array([f(e) for e in batch.edges], float)
