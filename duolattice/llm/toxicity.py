"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all words of a text (runs of digits, letters and non-ASCII characters, A-Z lower-cased) and the beginnings (5 characters)
of its words, each with its number of occurrences; they are known by 64-bit hashes. A term weighs occurrences x IDF x relevance: document frequencies are counted over all documents, and the relevance
r = FLOOR + (g / (g + RATIO))^2 rises with the log-likelihood ratio g that ties the term to either label among the training rows.
So every word counts, and words that tell the labels apart count most. All training rows are examples.

Examples that share their weightiest terms stand together in blocks. Each term has postings, the examples that have it and their
weights; those of common terms stand as a row of all examples, with the largest weight of each block. For a text the postings of
its rarer terms are added up; a block's largest sum and its common terms' block maxima bound its cosines. The blocks of the largest
bounds are scored in whole, then all others whose bound reaches the k-th cosine found. Texts are scored some at a time, block by
block. The k nearest examples
vote with weights that fall with their distance; votes are made probabilities by a monotone map fitted to the examples' own
leave-one-out votes, which tasks share. The evidence of a score is all examples that voted. Texts that have no term in common with
any example get the smoothed rate of the training rows without words.

Defined results: null and empty texts are texts without terms; without usable labels every score is 0; ties between neighbours
go to the smaller example id; rows with null labels, labels other than 0 and 1 or labels that disagree are not learnt from; an id
that several documents share is learnt from once; every document row is kept, repeated rows and null ids too; ids may be of any
type that can be ordered; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, chunks, labelled_rows, materialized, text_bytes, word_hashes, word_spans

#: Characters of a word's beginning.
BEGINNING = 5
#: Labelled rows that are learnt from, at most; the log-likelihood ratio at which relevance is a quarter, and what every term has at least.
LABELLED, RATIO, FLOOR = 3_000, 15.0, 0.03
#: Examples of a block, blocks that are scored before the others are held against the k-th cosine, texts that are scored side by side.
BLOCK, FIRST, AT_ONCE = 64, 3, 64
#: Cosines that agree to so many digits are ties; bounds are taken for reached if they fall short by less than that.
DIGITS, SLACK = 9, 2e-9
#: Terms that more than one in so many examples has are kept as rows of all examples.
COMMON = 12
FLUSH = 2_000_000


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The terms of all texts as 64-bit hashes, one for each occurrence, and the number of each one's text."""
    flat, starts = text_bytes(texts)
    low, begin, end = word_spans(flat)
    text = np.searchsorted(starts, begin, "right") - 1
    whole = word_hashes(low, begin, end)
    # Where characters begin; between words every byte does.
    chars = np.flatnonzero((low & 0xC0) != 0x80)
    past = chars[np.minimum(np.searchsorted(chars, begin) + BEGINNING, len(chars) - 1)] if len(chars) else begin
    long = past <= end
    with np.errstate(over="ignore"):
        first = word_hashes(low, begin[long], past[long]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    return np.concatenate([whole, first]).view(np.int64), np.concatenate([text, text[long]])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges (start, size), one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def find(texts: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the (sorted) vocabulary of all texts' terms, text after text and in order, their occurrences, and where each text's
    terms begin (n + 1 places)."""
    size = max(1, len(vocabulary))
    key = np.zeros(0, np.int64)
    if len(vocabulary):
        term, text = terms(texts)
        met, which = np.unique(term, return_inverse=True)
        place = np.minimum(np.searchsorted(vocabulary, met), size - 1)
        known = (vocabulary[place] == met)[which]
        key = text[known] * size + place[which][known]
    key, n = np.unique(key, return_counts=True)
    return key % size, n, np.searchsorted(key, np.arange(len(texts) + 1) * size)


@dataclass
class Model:
    """rows: terms and occurrences of each example; weight: IDF x relevance of each term."""

    vocabulary: np.ndarray
    weight: np.ndarray
    ids: list
    labels: np.ndarray
    rows: list[tuple[np.ndarray, np.ndarray]]
    none_rate: float
    k: int = 15
    calibrated: bool = True  # else calibrate() is called when the votes are known

    def __post_init__(self):
        scaled = [n * self.weight[t] for t, n in self.rows]
        # Examples that share their weightiest terms stand together, which makes block maxima telling.
        heavy = [t[np.lexsort((t, -v))][:4].tolist() for (t, _), v in zip(self.rows, scaled)]
        order = sorted(range(len(self.rows)), key=lambda i: (heavy[i], self.ids[i]))
        self.ids, self.labels, self.rows = [self.ids[i] for i in order], np.asarray(self.labels, float)[order], [self.rows[i] for i in order]
        self.steps, self.rates = np.array([0.0]), np.array([0.0])
        self._index()
        if self.calibrated:
            self.calibrate(np.array(self.own_votes(list(range(len(self.rows))))))

    def _index(self) -> None:
        """Postings by term and example; entries: one for each term and block, with its range of postings and its largest value."""
        n, self.n_blocks = len(self.rows), -(-len(self.rows) // BLOCK)
        self.by_id = np.empty(n, np.int64)  # examples' ranks in order of id
        self.by_id[sorted(range(n), key=lambda i: self.ids[i])] = np.arange(n)
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in self.rows)])
        owner = np.repeat(np.arange(n), [len(t) for t, _ in self.rows])
        value = np.concatenate([np.zeros(0), *(m for _, m in self.rows)]) * self.weight[term]
        norms = np.sqrt(np.bincount(owner, value**2, n))
        value /= np.where(norms > 0, norms, 1.0)[owner]
        by = np.lexsort((owner, term))
        term, owner, value = term[by], owner[by], value[by]
        # Common terms: a row of all examples' weights each, and one of all blocks' maxima.
        often = np.bincount(term, minlength=len(self.vocabulary)) > n / COMMON
        self.column = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((int(often.sum()), self.n_blocks * BLOCK))
        self.dense[self.column[term[often[term]]], owner[often[term]]] = value[often[term]]
        self.dense_most = self.dense.reshape(len(self.dense), self.n_blocks, BLOCK).max(2) if n else np.zeros((len(self.dense), 0))
        # Others: postings by term.
        rare = ~often[term]
        self.owner, self.value = owner[rare], value[rare]
        self.postings = np.searchsorted(term[rare], np.arange(len(self.vocabulary) + 1))

    def __getstate__(self) -> dict:
        """What tasks need to build the index again, as few bytes as that takes."""
        flat = [np.concatenate([np.zeros(0, np.int32), *(r[k] for r in self.rows)]).astype(np.int32) for k in (0, 1)]
        kept = ("vocabulary", "weight", "ids", "labels", "none_rate", "k", "calibrated", "steps", "rates")
        return {"flat": flat, "sizes": [len(t) for t, _ in self.rows], **{name: getattr(self, name) for name in kept}}

    def __setstate__(self, state: dict) -> None:
        flat, cuts = state.pop("flat"), np.cumsum(state.pop("sizes"))[:-1]
        self.__dict__.update(state)
        self.rows = list(zip(*(np.split(f.astype(np.int64), cuts) for f in flat))) if len(self.ids) else []
        self._index()

    def nearest(self, found: np.ndarray, n: np.ndarray, cuts: np.ndarray, skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text (terms found[a:b], so many times each) its k nearest examples and their cosines, nearest first; examples
        without a common term are no neighbours, nor is the example `skip` of a text."""
        texts, width = len(cuts) - 1, self.n_blocks * BLOCK
        if not texts or not width:
            return [(np.zeros(0, np.int64), np.zeros(0))] * texts
        owner = np.repeat(np.arange(texts), np.diff(cuts))
        q = n * self.weight[found]
        norms = np.sqrt(np.bincount(owner, q**2, texts))
        q = q / np.where(norms > 0, norms, 1.0)[owner]
        column = self.column[found]
        common = np.zeros((texts, len(self.dense)))
        common[owner[column >= 0], column[column >= 0]] = q[column >= 0]
        # What the postings of the other terms add up to is known for all examples; for common terms a block's maxima bound it.
        runs = self.postings[found + 1] - self.postings[found]
        p = spread(self.postings[found], runs)
        acc = np.bincount(np.repeat(owner * width, runs) + self.owner[p], np.repeat(q, runs) * self.value[p], texts * width).reshape(texts, width)
        bound = common @ self.dense_most + acc.reshape(texts, self.n_blocks, BLOCK).max(2)
        chosen, least = np.zeros(bound.shape, bool), np.zeros(texts)
        np.put_along_axis(chosen, np.argpartition(-bound, min(FIRST, self.n_blocks) - 1, axis=1)[:, :FIRST], True, axis=1)
        whole = np.zeros((texts, self.n_blocks, BLOCK))  # cosines of blocks that are scored
        self.scored = 0
        for last in (False, True):
            for b in np.flatnonzero(chosen.any(0)):
                who = np.flatnonzero(chosen[:, b])
                part = slice(b * BLOCK, (b + 1) * BLOCK)
                whole[who, b] = acc[who, part] + common[who] @ self.dense[:, part]
            self.scored += chosen.sum(1)
            if skip is not None:
                own = np.flatnonzero(skip >= 0)
                whole.reshape(texts, width)[own, skip[own]] = 0
            if not last:
                # The k-th cosine of the first blocks; all others that reach it may hold a neighbour.
                if FIRST * BLOCK > self.k:
                    some = whole[chosen].reshape(texts, -1)
                    if some.shape[1] > self.k:
                        least = np.partition(some, some.shape[1] - self.k, axis=1)[:, some.shape[1] - self.k]
                chosen = ~chosen & (bound > 0) & (bound >= least[:, None] - SLACK)
        acc = whole.reshape(texts, width)
        out = []
        if width > self.k:
            least = np.partition(acc, width - self.k, axis=1)[:, width - self.k]
        for row, limit in zip(acc, least):
            at = np.flatnonzero((row > 0) & (row >= limit - SLACK))
            order = np.lexsort((self.by_id[at], -np.round(row[at], DIGITS)))[: self.k]
            out.append((at[order], row[at[order]]))
        return out

    def votes(self, found: np.ndarray, n: np.ndarray, cuts: np.ndarray, skip: np.ndarray | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For each text the share of toxic among its neighbours, by weights that fall with the distance (-1 without neighbours), and these."""
        out = []
        for a in range(0, len(cuts) - 1, AT_ONCE):
            part = cuts[a : a + AT_ONCE + 1]
            for best, cosines in self.nearest(found[part[0] : part[-1]], n[part[0] : part[-1]], part - part[0], None if skip is None else skip[a : a + AT_ONCE]):
                w = 1 / (1 - np.minimum(cosines, 1.0) + 0.05)
                out.append((float((w * self.labels[best]).sum() / w.sum()) if len(best) else -1.0, best, cosines))
        return out

    def own_votes(self, examples: list[int]) -> list[float]:
        """The votes of examples for each other: what it would have been without itself among them."""
        t, n = (np.concatenate([np.zeros(0, np.int64), *(self.rows[i][k] for i in examples)]) for k in (0, 1))
        return [v for v, _, _ in self.votes(t, n, np.cumsum([0, *(len(self.rows[i][0]) for i in examples)]), np.array(examples, np.int64))]

    def calibrate(self, votes: np.ndarray) -> None:
        """Isotonic regression of the labels on the leave-one-out votes (pool adjacent violators), lightly smoothed."""
        use = votes >= 0
        values, which = np.unique(np.round(votes[use], 3), return_inverse=True)
        n, toxic = np.bincount(which, minlength=len(values)), np.bincount(which, self.labels[use], len(values))
        groups: list[list[float]] = []  # lowest vote, rows, toxic rows
        for g in zip(values.tolist(), n.tolist(), toxic.tolist()):
            groups.append(list(g))
            while len(groups) > 1 and groups[-2][2] * groups[-1][1] >= groups[-1][2] * groups[-2][1]:
                _, m, t = groups.pop()
                groups[-1][1] += m
                groups[-1][2] += t
        if groups:
            g = np.array(groups)
            self.steps, self.rates = g[:, 0], np.maximum.accumulate((g[:, 2] + 0.05) / (g[:, 1] + 0.5))

    def score(self, found: np.ndarray, n: np.ndarray, cuts: np.ndarray) -> list[tuple[float, list, list[float]]]:
        """For each text its score, and ids and cosines of all examples that voted."""
        out = []
        for vote, best, cosines in self.votes(found, n, cuts):
            at = max(0, int(np.searchsorted(self.steps, round(vote, 3), "right")) - 1)
            out.append((self.none_rate, [], []) if vote < 0 else (float(self.rates[at]), [self.ids[b] for b in best], cosines.tolist()))
        return out


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", usable: Column | None = None, labelled: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Vocabulary, document frequencies, examples and calibration; at most `labelled` of the usable label rows are learnt from."""
    rows = materialized(labelled_rows(docs, labels, label_col, usable, labelled, id_col, text_col), "labelled")

    def label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            met, which = np.unique(np.concatenate([np.zeros(0, np.int64), *(t for t, _ in held)]), return_inverse=True)
            y = np.concatenate([np.zeros(0), *(y for _, y in held)])
            return pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(np.bincount(which, y == k, len(met)).astype(np.int64)) for k in (0, 1))], ["term", "n0", "n1"])

        for batch in chunks(batches, limit=2 << 20):
            term, text = terms(batch.column(1))
            # Each term once for each text.
            by = np.lexsort((term, text))
            term, text = term[by], text[by]
            once = np.append(True, (term[1:] != term[:-1]) | (text[1:] != text[:-1]))[: len(term)]
            held.append((term[once], batch.column(2).to_numpy()[text[once]]))
            size += int(once.sum())
            if size > FLUSH:
                yield out()
                held, size = [], 0
        yield out()

    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rows_of = np.array([totals.get(0, 0), totals.get(1, 0)], float)
    if not rows_of.sum():
        return Model(np.zeros(0, np.int64), np.zeros(0), [], np.zeros(0), [], 0.0)
    # All terms of at most `labelled` texts.
    seen = rows.mapInArrow(label_counts, "term long, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).orderBy("term").toArrow()
    vocabulary = seen.column("term").to_numpy()
    relevance = FLOOR + (lambda g: (g / (g + RATIO)) ** 2)(likelihood_ratio(np.stack([seen.column(c).to_numpy() for c in ("n0", "n1")]).astype(float), rows_of))
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def all_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, texts = np.zeros(len(sent.value), np.int64), 0
        for batch in chunks(batches, text_at=0, limit=2 << 20):
            n += np.bincount(find(batch.column(0), sent.value)[0], minlength=len(n))
            texts += batch.num_rows
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1), pa.int32()), pa.array(np.append(n[met], texts), pa.int64())], ["term", "n"])

    met = docs.select(text_col).mapInArrow(all_counts, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n = met.column("term").to_numpy(), met.column("n").to_numpy()
    df = np.zeros(len(vocabulary))
    df[at[at >= 0]] = n[at >= 0]
    idf = np.log((1 + n[at < 0].sum()) / (1 + df)) + 1

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=2 << 20):
            t, n, cuts = find(batch.column(1), sent.value)
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int32())) for x in (t, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], ["id", "y", "t", "n"])

    id_type = docs.schema[id_col].dataType.simpleString()
    # Bounded by `labelled`, too.
    vectors = rows.mapInArrow(found, f"id {id_type}, y int, t array<int>, n array<int>").orderBy("id").toArrow()
    sent.destroy()
    ids, y = vectors.column("id").to_pylist(), vectors.column("y").to_numpy().astype(float)
    pairs = [(t.values.to_numpy().astype(np.int64), n.values.to_numpy().astype(np.int64)) for t, n in zip(vectors.column("t"), vectors.column("n"))]
    wordless = np.array([not len(t) for t, _ in pairs], bool)
    model = Model(vocabulary, idf * relevance, ids, y, pairs, float((y[wordless].sum() + 0.05) / (wordless.sum() + 0.5)), calibrated=False)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def own_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.own_votes(batch.column(0).to_pylist()), pa.float64())], ["id", "vote"])

    votes = docs.sparkSession.range(0, len(ids), 1, max(1, len(ids) // 300)).mapInArrow(own_votes, "id long, vote double")
    model.calibrate(np.array([r.vote for r in sorted(votes.collect())]))
    shared.destroy()
    return model


def likelihood_ratio(with_term: np.ndarray, rows_of: np.ndarray) -> np.ndarray:
    """How surely each term is tied to a label: twice the log-likelihood ratio of the table of label and presence. with_term: rows of each label (2 x terms)."""
    total, has = rows_of.sum(), with_term.sum(0)
    out = np.zeros(with_term.shape[1])
    for seen, margin in ((with_term, has), (rows_of[:, None] - with_term, total - has)):
        expected = rows_of[:, None] * margin[None, :] / total
        out += 2 * np.where(seen > 0, seen * np.log(np.where(seen > 0, seen, 1) / np.where(expected > 0, expected, 1)), 0).sum(0)
    return np.maximum(out, 0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id_col, score (0 to 1), evidence (ids and cosines of the examples that voted, nearest first)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    example_type = arrow_type(docs, id_col)
    # The model is bounded by the rows that it has learnt from.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memory: dict[bytes, tuple] = {}
        for batch in chunks(batches, limit=2 << 20):
            texts = batch.column(1).to_pylist()
            # Equal texts are scored once while they are remembered.
            digests = [hashlib.blake2b((t or "").encode(), digest_size=16).digest() for t in texts]
            new = {d: t for d, t in zip(digests, texts) if d not in memory}
            fresh = dict(zip(new, model.score(*find(pa.array(list(new.values()), pa.string()), model.vocabulary))))
            rows = [fresh.get(d) or memory[d] for d in digests]
            if len(memory) > 5_000:
                memory.clear()
            memory.update(fresh)
            pairs = pa.StructArray.from_arrays([pa.array(list(chain.from_iterable(r[k] for r in rows)), t) for k, t in ((1, example_type), (2, pa.float64()))], ["example", "cosine"])
            evidence = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[1]) for r in rows)]), pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.float64()), evidence], [id_col, "score", "evidence"])

    return docs.select(id_col, text_col).mapInArrow(kernel, f"`{id_col}` {id_type}, score double, evidence array<struct<example:{id_type},cosine:double>>")
