"""Feature dictionaries: dense base ids by name, and vectors of feature ids for each label."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .latent import WordAlignment
from .numbering import with_dense_index


#: Names that go to every task when features are looked up, at most; and names of a partition, at least.
SENT, PER_PARTITION = 100_000, 10_000


@dataclass
class Dictionary:
    """features: base_id, feature (base ids in byte order of the names). The id for a label is base_id + slot * number of base features."""

    features: DataFrame
    labels: list[int]
    size: int

    @property
    def dim(self) -> int:
        return self.size * len(self.labels)

    @classmethod
    def fit(cls, values: DataFrame, labels: list[int]) -> "Dictionary":
        """From rows with a feature column; features are distinct before they are numbered."""
        # Kept, as counts, boundaries and numbers are taken from it one after the other.
        names = values.select("feature").distinct().persist()
        size = names.count()
        return cls(with_dense_index(names.coalesce(size // PER_PARTITION + 1), "feature", "base_id").select("base_id", "feature"), sorted(labels), size)

    @classmethod
    def union(cls, parts: list["Dictionary"]) -> "Dictionary":
        names = parts[0].features.select("feature")
        for p in parts[1:]:
            names = names.unionByName(p.features.select("feature"))
        return cls.fit(names, sorted({y for p in parts for y in p.labels}))

    def index(self, base_id: int, label: int) -> int:
        return base_id + self.size * self.labels.index(label)

    def transform(self, values: DataFrame) -> DataFrame:
        """id, indices, values: sparse vectors; features that the dictionary lacks are dropped."""
        # Few names go to the values: a frequent feature's rows stay where they lie.
        joined = values.join(F.broadcast(self.features) if self.size <= SENT else self.features, "feature")
        entries = F.array_sort(F.collect_list(F.struct("base_id", "value")))
        return joined.groupBy("id").agg(entries.alias("e")).select("id", F.col("e.base_id").alias("indices"), F.col("e.value").alias("values"))

    def lookup(self, names: DataFrame) -> DataFrame:
        """feature, base_id (-1: unknown)."""
        return names.join(self.features, "feature", "left").select("feature", F.coalesce("base_id", F.lit(-1)).alias("base_id"))

    def reverse_lookup(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.features, "base_id", "left")


def init_weights(kind: str, dictionary: Dictionary, noise: float = 0.01, seed: int = 0) -> np.ndarray:
    """zero, noise (a Gaussian whose standard deviation is `noise`), heuristic, or heuristic+noise."""
    if kind not in ("zero", "noise", "heuristic", "heuristic+noise"):
        raise ValueError(f"unknown kind of weights: {kind}")
    out = np.zeros(dictionary.dim)
    if "heuristic" in kind:
        for r in dictionary.features.toLocalIterator():
            for y in dictionary.labels:
                out[dictionary.index(r.base_id, y)] = WordAlignment.default_weight(r.feature, y)
    if "noise" in kind:
        out += np.random.default_rng(seed).normal(0, noise, len(out))
    return out


def transfer_weights(old: Dictionary, old_weights: np.ndarray, new: Dictionary) -> np.ndarray:
    """Weights for a new dictionary: those of features and labels that the old one has, else 0."""
    out = np.zeros(new.dim)
    both = new.features.join(old.features.withColumnRenamed("base_id", "old_id"), "feature").select("base_id", "old_id")
    for r in both.toLocalIterator():
        for y in set(new.labels) & set(old.labels):
            out[new.index(r.base_id, y)] = old_weights[old.index(r.old_id, y)]
    return out
