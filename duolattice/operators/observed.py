"""Features of whole pairs: substring pairs, alignment phrases, mismatches, normalised edit distance and bias.

Each generator takes pairs (id, source, target and what it needs besides) and gives rows (id, feature, value).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latent import class_patterns

#: Names and marks of features.
EPSILON, BIAS, NED, MISMATCH = "-", "Bias", "NED", "MM:"


def _size(pairs: DataFrame, markers: bool) -> Column:
    return F.greatest(F.size("source"), F.size("target")) - (2 if markers else 0)


def _normalized(counts: DataFrame, pairs: DataFrame, normalize: bool, markers: bool) -> DataFrame:
    """counts: id, feature, size, cnt."""
    value = F.col("cnt") / F.col("size") if normalize else F.col("cnt").cast("double")
    return counts.select("id", "feature", value.cast("double").alias("value"))


def substrings(tokens: Column, size: int, ignore_epsilon: bool = False) -> Column:
    """array<struct<pos, sub>>: from every position (from 0) all substrings of up to size tokens, joined by +."""
    lengths = F.sequence(F.lit(1), F.lit(size))

    def at(p: Column) -> Column:
        made = F.transform(F.filter(lengths, lambda k: p + k <= F.size(tokens)), lambda k: F.struct(p.alias("pos"), F.slice(tokens, p + 1, k).alias("t")))
        if ignore_epsilon:
            made = F.filter(made, lambda x: F.element_at(x["t"], -1) != EPSILON)
        joined = lambda t: F.array_join(F.filter(t, lambda y: y != EPSILON), "+") if ignore_epsilon else F.array_join(t, "+")
        return F.transform(made, lambda x: F.struct(x["pos"].alias("pos"), joined(x["t"]).alias("sub")))

    return F.when(F.size(tokens) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(tokens) - 1), at))).otherwise(F.expr("cast(array() as array<struct<pos:int,sub:string>>)"))


def substring_pairs(pairs: DataFrame, size: int = 2, offset: int = 1, encode_offset: bool = False, ignore_epsilon: bool = False, vowels: str = "", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, feature, cnt: substrings of the shorter side (of equal sides the source) with those of the longer one that start at most offset away; the source's comes first.

    The positions are joined within each row, so only the counts are shuffled."""
    turned = F.size("source") > F.size("target")
    short, long = F.when(turned, F.col("target")).otherwise(F.col("source")), F.when(turned, F.col("source")).otherwise(F.col("target"))
    made = pairs.select(*keys, turned.alias("turned"), short.alias("s"), long.alias("l"))
    made = made.select(*keys, "turned", substrings(F.col("s"), size, ignore_epsilon).alias("s"), substrings(F.col("l"), size, ignore_epsilon).alias("l"))
    made = made.withColumn("s", F.explode("s"))
    made = made.withColumn("l", F.explode(F.filter("l", lambda x: F.abs(x["pos"] - F.col("s.pos")) <= offset)))
    away = F.col("l.pos") - F.col("s.pos")
    other = F.when(away != 0, F.concat(F.col("l.sub"), F.lit("["), away.cast("string"), F.lit("]"))).otherwise(F.col("l.sub")) if encode_offset else F.col("l.sub")
    name = F.when(F.col("turned"), F.concat(other, F.lit(","), F.col("s.sub"))).otherwise(F.concat(F.col("s.sub"), F.lit(","), other))
    made = made.select(*keys, name.alias("feature"))
    if vowels:
        consonant, vowel = class_patterns(vowels)
        classes = F.regexp_replace(F.regexp_replace("feature", f"(?i){consonant}", "[C]"), f"(?i){vowel}", "[V]")
        made = made.select(*keys, F.explode(F.array("feature", classes)).alias("feature"))
    return made.groupBy(*keys, "feature").agg(F.count("*").alias("cnt"))


def _with_bias(values: DataFrame, pairs: DataFrame, bias: bool, normalize: bool, markers: bool) -> DataFrame:
    if not bias:
        return values
    one = (F.lit(1.0) / _size(pairs, markers)) if normalize else F.lit(1.0)
    return values.unionByName(pairs.select("id", F.lit(BIAS).alias("feature"), one.cast("double").alias("value")))


def kr_word(pairs: DataFrame, normalize: bool = True, bias: bool = True, markers: bool = False, **options) -> DataFrame:
    sized = pairs.withColumn("size", _size(pairs, markers))
    counts = substring_pairs(sized, keys=("id", "size"), **options)
    return _with_bias(_normalized(counts, pairs, normalize, markers), pairs, bias, normalize, markers)


def kr_sentence(pairs: DataFrame, normalize: bool = True, bias: bool = True, markers: bool = False, **options) -> DataFrame:
    """As kr_word for every indicator of tokens word~f1~f2...; the word itself is passed over."""
    parts = lambda c: F.transform(c, lambda t: F.filter(F.split(t, "~"), lambda f: f != ""))
    sized = pairs.withColumn("size", _size(pairs, markers)).withColumns({"sp": parts("source"), "tp": parts("target")})
    n = F.size(F.coalesce(F.get("sp", F.lit(0)), F.get("tp", F.lit(0))))
    exploded = sized.filter(n > 1).withColumn("k", F.explode(F.sequence(F.lit(1), n - 1)))
    sides = exploded.select("id", "size", F.transform("sp", lambda t: F.get(t, F.col("k"))).alias("source"), F.transform("tp", lambda t: F.get(t, F.col("k"))).alias("target"))
    counts = substring_pairs(sides, keys=("id", "size"), **options)
    return _with_bias(_normalized(counts, pairs, normalize, markers), pairs, bias, normalize, markers)


def bias(pairs: DataFrame, normalize: bool = True, markers: bool = False) -> DataFrame:
    return _with_bias(empty(pairs), pairs, True, normalize, markers)


def empty(pairs: DataFrame) -> DataFrame:
    return pairs.filter("false").select("id", F.lit("").alias("feature"), F.lit(0.0).alias("value"))


def phrase_pairs(s: list[str], t: list[str], source_size: int, target_size: int) -> list[str]:
    """Phrases of exactly these sizes that an alignment links: windows of tokens that hold a match, and no match that the other window lacks.

    s and t are aligned: equally long, equal tokens at a place are a match. For each source window the target window starts at
    the size that ends with the first match, then moves right until a match outside the source window comes."""
    n, match = len(s), [a == b for a, b in zip(s, t)]
    left, right = ([k for k in range(n) if side[k] != EPSILON] for side in (s, t))
    out = []
    for a in range(len(left) - source_size + 1):
        window = left[a : a + source_size]
        linked = [k for k in window if match[k]]
        if not linked:
            continue
        end = right.index(linked[0]) + 1
        begin = max(0, end - target_size)
        end = max(end, min(len(right), begin + target_size))
        while True:
            other = right[begin:end]
            held = {k for k in other if match[k]}
            if held and held == set(linked):
                out.append("+".join(s[k] for k in window) + "," + "+".join(t[k] for k in other))
            if end >= len(right) or any(match[k] and k not in window for k in range(other[-1] + 1, right[end] + 1)):
                break
            begin, end = begin + 1, end + 1
    return out


def mismatches(s: list[str], t: list[str], collapse: bool = True) -> list[str]:
    """Runs of mismatches that a match ends, with one token of context on either side, and without it.

    A mismatch at the first place has itself as its left context, and one that no match ends is not given."""
    context = [s[0], t[0]]
    run: list[list[str]] = [[], []]
    out, matched = [], s[0] == t[0]
    for a, b in zip(s, t):
        if a != b:
            for side, token in enumerate((a, b)):
                if not collapse or token != EPSILON:
                    run[side].append(token)
        else:
            if not matched:
                full = ["".join([context[k], *run[k], a]) for k in (0, 1)]
                # The short form loses one character at either end.
                short = [f[1:-1] or EPSILON for f in full]
                out += [f"{MISMATCH}{full[0]},{full[1]}", f"{MISMATCH}{short[0]},,{short[1]}"]
            context, run = [a, b], [[], []]
        matched = a == b
    return out


def _kernel_counts(pairs: DataFrame, count, columns: list[str]) -> DataFrame:
    """id, size, edit_distance, feature, cnt by a function of an aligned row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, size, d, f, n) for i, size, d, *rest in zip(*(c.to_pylist() for c in b.columns)) for f, n in count(*rest).items()]
            if out:
                types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["id", "size", "edit_distance", "feature", "cnt"])

    return pairs.select("id", "size", "edit_distance", *columns).mapInArrow(kernel, "id long, size int, edit_distance int, feature string, cnt long")


def _aligned_values(pairs: DataFrame, counts: DataFrame, add_bias: bool, ned: bool, normalize: bool, markers: bool) -> DataFrame:
    values = _with_bias(_normalized(counts, pairs, normalize, markers), pairs, add_bias, normalize, markers)
    if ned:
        # Divided by the length once, whether or not the other features are.
        distance = pairs.filter("edit_distance > 0").select("id", F.lit(NED).alias("feature"), (F.col("edit_distance") / F.col("size")).alias("value"))
        values = values.unionByName(distance)
    return values


def bk_word(pairs: DataFrame, size: int = 2, add_mismatches: bool = True, collapse: bool = True, bias: bool = True, ned: bool = False, normalize: bool = True, markers: bool = False) -> DataFrame:
    """Phrase pairs of all sizes up to size, and mismatches. pairs come from `alignment.align`."""

    def count(s: list[str], t: list[str]) -> Counter:
        found = Counter(p for a in range(1, size + 1) for b in range(1, size + 1) for p in phrase_pairs(s, t, a, b))
        if add_mismatches and s:
            found.update(mismatches(s, t, collapse))
        return found

    sized = pairs.withColumn("size", F.col("longest") - (2 if markers else 0))
    return _aligned_values(sized, _kernel_counts(sized, count, ["aligned_source", "aligned_target"]), bias, ned, normalize, markers)


def bk_phrase_pairs(pairs: DataFrame, add_mismatches: bool = True, bias: bool = True, ned: bool = False, normalize: bool = True, markers: bool = False) -> DataFrame:
    """Counts of the phrases that came with the pairs, and collapsed mismatches."""

    def count(s: list[str], t: list[str], phrases: list[str]) -> Counter:
        return Counter([*(phrases or []), *(mismatches(s, t, True) if add_mismatches and s else [])])

    sized = pairs.withColumn("size", F.col("longest") - (2 if markers else 0))
    return _aligned_values(sized, _kernel_counts(sized, count, ["aligned_source", "aligned_target", "phrase_pairs"]), bias, ned, normalize, markers)


#: Generators by name.
OBSERVED = {"Bias": bias, "Empty": lambda pairs, **_: empty(pairs), "KRWord": kr_word, "KRSentence": kr_sentence, "BKWord": bk_word, "BKPhrasePairs": bk_phrase_pairs}


def observed_features(pairs: DataFrame, generator: str, **options) -> DataFrame:
    if generator not in OBSERVED:
        raise ValueError(f"unknown generator {generator}; known: {sorted(OBSERVED)}")
    return OBSERVED[generator](pairs, **options)
