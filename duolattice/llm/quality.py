"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting goes over the features again and again; each turn fits one shallow tree on a single feature's bins to the
gradient of the logistic loss and adds it to that feature's lookup table. Then the pairs of features whose joint bins explain
most of what is left get tables of their own in the same way. A document's score is the sigmoid of the sum of the table
entries of its bins, so scoring is a few vectorised look-ups and additions.

The model is fitted on at most `max_rows` labelled rows (a documented parameter; a hash of the id chooses them); features are
computed from whole texts, in the tasks. Defined results: null and empty texts have all-zero features and get the score of
those; without labelled rows the score is 0.5, with one class only it is that class's smoothed rate; rows with a null label or
a label other than 0 and 1, and ids whose labels disagree, are not learnt from; an id that several documents share is learnt from
once; ids may be of any type that can be ordered; every document row is kept, null ids too; other columns are not read by `score` and pass through `keep_good` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, forget_others, labelled_rows, text_bytes, word_hashes

FEATURES = ("log_bytes", "mean_word", "upper", "digits", "stops", "marks", "bars", "bangs", "spaces", "bare", "stutter", "distinct", "top_word", "pairs", "line_words", "log_words")
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "stops": b".,;:?", "marks": b"#$%&*@^~<>{}[]\\/=+_", "bars": b"|", "bangs": b"!", "spaces": b" \t\r\n\x0b\x0c"}


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text, from all of it."""
    flat, starts = text_bytes(texts)
    n = len(starts) - 1
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    size = np.diff(starts) - 1
    full = np.maximum(size, 1)
    column = {name: i for i, name in enumerate(FEATURES)}
    out[:, column["log_bytes"]] = np.log1p(size)
    sums = {}
    for name, chars in _CLASSES.items():
        member = np.zeros(256, np.uint8)
        member[list(chars)] = 1
        sums[name] = np.add.reduceat(member[flat], starts[:-1], dtype=np.int64)
        out[:, column[name]] = sums[name] / full
    blank = np.zeros(256, bool)
    blank[list(b" \t\r\n\x0b\x0c\0")] = True
    inside = ~blank[flat]
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return out
    doc = np.searchsorted(starts, begin, "right") - 1
    words = np.bincount(doc, minlength=n)
    some = np.maximum(words, 1)
    out[:, column["mean_word"]] = (size - sums["spaces"]) / some
    letter = np.zeros(256, np.uint8)
    letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    lettered = np.add.reduceat(letter[flat], begin, dtype=np.int64) > 0
    out[:, column["bare"]] = np.bincount(doc, ~lettered, n) / some
    h = word_hashes(np.where(inside, flat, 0), begin, end)
    with np.errstate(over="ignore"):
        key = h ^ (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        pair = key[1:] * np.uint64(0x9E3779B97F4A7C15) + key[:-1]
    same_doc = doc[1:] == doc[:-1]
    out[:, column["stutter"]] = np.bincount(doc[1:], same_doc & (h[1:] == h[:-1]), n) / some
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    out[:, column["distinct"]] = np.bincount(doc[first], minlength=n) / some
    top = np.zeros(n)
    np.maximum.at(top, doc[first], count)
    out[:, column["top_word"]] = top / some
    _, first = np.unique(pair[same_doc], return_index=True)
    out[:, column["pairs"]] = np.bincount(doc[1:][same_doc][first], minlength=n) / some
    breaks = np.add.reduceat((flat == 10).view(np.uint8), starts[:-1], dtype=np.int64)
    out[:, column["line_words"]] = words / (breaks + 1)
    out[:, column["log_words"]] = np.log1p(words)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _cut(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, int]:
    """Best gain of a cut of bins into those before i and the rest, and i (0: no cut)."""
    if len(g) < 2:
        return 0.0, 0
    cg, ch = np.cumsum(g), np.cumsum(h)
    left_g, left_h = cg[:-1], ch[:-1]
    gain = left_g**2 / (left_h + l2) + (cg[-1] - left_g) ** 2 / (ch[-1] - left_h + l2) - cg[-1] ** 2 / (ch[-1] + l2)
    i = int(np.argmax(gain))
    return (float(gain[i]), i + 1) if gain[i] > 1e-9 else (0.0, 0)


def tree_1d(g: np.ndarray, h: np.ndarray, depth: int, l2: float) -> np.ndarray:
    """Values for the bins of one feature by a tree of the given depth."""
    gain, i = _cut(g, h, l2) if depth else (0.0, 0)
    if not i:
        return np.full(len(g), g.sum() / (h.sum() + l2))
    return np.concatenate([tree_1d(g[:i], h[:i], depth - 1, l2), tree_1d(g[i:], h[i:], depth - 1, l2)])


def tree_2d(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """Values for the joint bins of two features: a cut on one, then a cut on the other on either side."""
    best = None
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, i = _cut(a.sum(1), b.sum(1), l2)
        out = np.empty_like(a)
        gain = 0.0
        for rows in (slice(0, i), slice(i, None)):
            ga, ha = a[rows].sum(0), b[rows].sum(0)
            values = tree_1d(ga, ha, 1, l2)
            out[rows] = values
            gain += float((values * ga).sum())
        if best is None or gain > best[0]:
            best = (gain, out.T if turned else out)
    return best[1]


@dataclass
class AdditiveModel:
    """Intercept, cut points and tables of the features, and tables of the pairs (over coarser bins)."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            out += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cut points between distinct values, about equally many rows between them."""
    return np.unique((lambda q: (q[1:] + q[:-1]) / 2)(np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)))))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 6, bins: int = 48, coarse_bins: int = 10, depth: int = 2, rate: float = 0.1, l2: float = 2.0) -> AdditiveModel:
    """Cyclic boosting of the single features, then of the strongest pairs."""
    model = AdditiveModel()
    if not len(y):
        return model
    p = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return model
    k = x.shape[1]
    model.edges = [_edges(x[:, j], bins) for j in range(k)]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    margin = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j in range(k):
            p = _sigmoid(margin)
            g = np.bincount(at[j], y - p, len(model.tables[j]))
            h = np.bincount(at[j], p * (1 - p), len(model.tables[j]))
            step = rate * tree_1d(g, h, depth, l2)
            model.tables[j] += step
            margin += step[at[j]]
    model.coarse = [_edges(x[:, j], coarse_bins) for j in range(k)]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    shape = [len(e) + 1 for e in model.coarse]

    def joint(a: int, b: int, w: np.ndarray) -> np.ndarray:
        return np.bincount(at[a] * shape[b] + at[b], w, shape[a] * shape[b]).reshape(shape[a], shape[b])

    p = _sigmoid(margin)
    strength = []
    for a in range(k):
        for b in range(a + 1, k):
            g, h = joint(a, b, y - p), joint(a, b, p * (1 - p))
            strength.append((float((tree_2d(g, h, l2) * g).sum()), a, b))
    model.pairs = [(a, b) for _, a, b in sorted(strength, reverse=True)[:n_pairs]]
    model.pair_tables = [np.zeros((shape[a], shape[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            p = _sigmoid(margin)
            step = rate * tree_2d(joint(a, b, y - p), joint(a, b, p * (1 - p)), l2)
            table += step
            margin += step[at[a], at[b]]
    return model


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", usable: Column | None = None, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """A model of label_col, learnt from at most max_rows of the usable label rows (all of them if they are fewer)."""
    rows = labelled_rows(docs, labels, label_col, usable, max_rows, id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in chunks(batches):
            x = features(batch.column(1))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), flat], ["id", "y", "x"])

    found = rows.mapInArrow(kernel, f"id {id_type}, y int, x array<double>").orderBy("id").toArrow()
    if not found.num_rows:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0))
    return train(np.array(found.column("x").to_pylist()), found.column("y").to_numpy().astype(float))


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id_col, score (0 to 1)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in chunks(batches, limit=3 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.predict(features(batch.column(1))))], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(kernel, f"`{id_col}` {id_type}, score double")


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents whose score is at least the threshold, all columns as they are."""
    at = docs.columns.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in chunks(batches, text_at=at, limit=3 << 20):
            yield batch.filter(pa.array(model.predict(features(batch.column(at))) >= threshold))

    return docs.mapInArrow(kernel, docs.schema)
