"""Readers of labelled pairs of token sequences, lexicons, dictionaries and weights, and the text sinks.

Texts are read as Latin-1 where tokens are single bytes. Ids are the line numbers, from first_id on: dense and in file order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.alignment import align

#: Separators and markers of the formats.
BEGIN, END, EPSILON, PHRASE, WORD_PART = "^", "$", "-", "+", "~"


def numbered_lines(spark: SparkSession, path: str, first_id: int = 0, encoding: str = "UTF-8") -> DataFrame:
    """id, value: the lines of the files that aren't empty, numbered in order by a count of each partition and an offset."""
    lines = spark.read.option("encoding", encoding).option("lineSep", "\n").text(path) if encoding == "UTF-8" else spark.read.format("csv").option("sep", "\u0001").option("encoding", encoding).option("quote", "").schema("value string").load(path)
    lines = lines.filter(F.col("value").isNotNull() & (F.col("value") != ""))
    marked = lines.withColumn("mono", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    counts = {r.part: r.n for r in marked.groupBy("part").agg(F.count("*").alias("n")).collect()}
    offsets, total = {}, first_id
    for part in sorted(counts):
        offsets[part] = total
        total += counts[part]
    if not offsets:
        return marked.select(F.lit(0).cast("long").alias("id"), "value")
    offset = F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv))
    # Numbers of monotonically_increasing_id have the place within the partition in their lower 33 bits.
    return marked.select((offset[F.col("part")] + F.col("mono").bitwiseAND((1 << 33) - 1)).cast("long").alias("id"), "value")


def _tokens(text: Column, sep: str) -> Column:
    return F.filter(F.split(text, sep), lambda t: t != "")


def _with_markers(tokens: Column, markers: bool) -> Column:
    return F.concat(F.array(F.lit(BEGIN)), tokens, F.array(F.lit(END))) if markers else tokens


def parse_word_pairs(lines: DataFrame, markers: bool = False) -> DataFrame:
    """label TAB tokens TAB tokens."""
    f = F.filter(F.split("value", "\t"), lambda t: t != "")
    return lines.select("id", _with_markers(_tokens(f[1], " "), markers).alias("source"), _with_markers(_tokens(f[2], " "), markers).alias("target"), f[0].cast("int").alias("y"))


def parse_sentence_pairs(lines: DataFrame, markers: bool = False) -> DataFrame:
    if markers:
        raise ValueError("begin and end markers are not for sentence pairs")
    return parse_word_pairs(lines)


def parse_cognate_pairs(lines: DataFrame, markers: bool = False) -> DataFrame:
    """sign, source word, target word; every character is a token."""
    f = _tokens(F.split("value", "\t")[0], " ")
    chars = lambda w: F.filter(F.split(w, ""), lambda t: t != "")
    return lines.select("id", _with_markers(chars(f[1]), markers).alias("source"), _with_markers(chars(f[2]), markers).alias("target"), F.when(f[0] == "+", 1).otherwise(0).alias("y"))


def parse_aligned_pairs(lines: DataFrame, markers: bool = False) -> DataFrame:
    """As cognate pairs, aligned with substitutions at 3."""
    return align(parse_cognate_pairs(lines, markers), 3)


def parse_phrase_pairs(lines: DataFrame, markers: bool = False) -> DataFrame:
    """As aligned pairs; phrase pairs stand after a tab with bars between them."""
    phrases = lines.select("id", _tokens(F.split("value", "\t")[1], "\\|").alias("phrase_pairs"))
    return parse_aligned_pairs(lines, markers).join(phrases, "id")


#: Readers by name.
READERS = {"WordPair": parse_word_pairs, "SentencePair": parse_sentence_pairs, "CognatePair": parse_cognate_pairs, "CognatePairAligner": parse_aligned_pairs, "PhrasePairs": parse_phrase_pairs}


def read_pairs(spark: SparkSession, path: str, reader: str, markers: bool = False, first_id: int = 0) -> DataFrame:
    """id, source, target, y (and what the reader adds)."""
    if reader not in READERS:
        raise ValueError(f"unknown reader {reader}; known: {sorted(READERS)}")
    encoding = "UTF-8" if reader in ("WordPair", "SentencePair") else "ISO-8859-1"
    return READERS[reader](numbered_lines(spark, path, first_id, encoding), markers)


def lexicon_rows(lines: DataFrame) -> DataFrame:
    """ngram: the tokens of a line without its last one (the count), sentence marks as begin and end markers, joined by +."""
    t = _tokens(F.regexp_replace("value", "\t", " "), " ")
    marks = F.transform(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), lambda x: F.when(x == "<s>", BEGIN).when(x == "</s>", END).otherwise(x))
    return lines.select(F.array_join(marks, PHRASE).alias("ngram")).filter("ngram <> ''").distinct()


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return lexicon_rows(spark.read.text(path))


def read_weights(spark: SparkSession, path: str, offset: int = 0) -> DataFrame:
    """idx, weight; what stands more than once at an index adds up."""
    f = F.split(F.trim("value"), "\\s+")
    rows = spark.read.text(path).filter("value <> ''").select((f[0].cast("int") + offset).alias("idx"), f[1].cast("double").alias("weight"))
    return rows.groupBy("idx").agg(F.sum("weight").alias("weight"))


def write_weights(weights: np.ndarray, spark: SparkSession, path: str) -> None:
    rows = [(i, float(w)) for i, w in enumerate(weights)]
    df = spark.createDataFrame(rows, "idx int, weight double")
    df.orderBy("idx").select(F.concat_ws(" ", "idx", F.col("weight").cast("string"))).coalesce(1).write.mode("overwrite").text(path)


def write_dictionary(dictionary: DataFrame, labels: list[int], path: str) -> None:
    """First the label slots (-1: no such label), then index and name of every feature."""
    slots = [labels.index(y) if y in labels else -1 for y in range(max(labels, default=-1) + 1)]
    spark = dictionary.sparkSession
    head = spark.createDataFrame([(-1, " ".join(map(str, slots)))], "k long, line string")
    body = dictionary.select(F.col("base_id").cast("long").alias("k"), F.concat_ws(" ", "base_id", "feature").alias("line"))
    head.unionByName(body).orderBy("k").select("line").coalesce(1).write.mode("overwrite").text(path)


def read_dictionary(spark: SparkSession, path: str) -> tuple[DataFrame, list[int]]:
    lines = numbered_lines(spark, path)
    slots = [int(s) for s in lines.filter("id = 0").first().value.split()]
    labels = [y for _, y in sorted((s, y) for y, s in enumerate(slots) if s >= 0)]
    f = F.split("value", " ", 2)
    return lines.filter("id > 0").select(f[0].cast("int").alias("base_id"), f[1].alias("feature")), labels


def prediction_lines(scores: DataFrame) -> DataFrame:
    """scores: id, y, yhat, label, score, one row per label. value: id y Y yHat H scores L S ..."""
    pairs = F.array_sort(F.collect_list(F.struct("label", "score")))
    grouped = scores.groupBy("id", "y", "yhat").agg(pairs.alias("s"))
    text = F.array_join(F.transform("s", lambda s: F.concat_ws(" ", s["label"].cast("string"), s["score"].cast("string"))), " ")
    return grouped.select("id", F.concat_ws(" ", F.col("id").cast("string"), F.lit("y"), F.col("y").cast("string"), F.lit("yHat"), F.col("yhat").cast("string"), F.lit("scores"), text).alias("value"))


def write_predictions(scores: DataFrame, path: str) -> None:
    prediction_lines(scores).orderBy("id").select("value").write.mode("overwrite").text(path)


def parse_predictions(lines: DataFrame) -> DataFrame:
    """id, y, yhat, scores (label to score) from lines of predictions."""
    f = F.split("value", " ")
    rest = F.slice(f, 7, F.size(f))
    labels = F.filter(rest, lambda x, i: i % 2 == 0).cast("array<int>")
    values = F.filter(rest, lambda x, i: i % 2 == 1).cast("array<double>")
    return lines.select(f[0].cast("long").alias("id"), f[2].cast("int").alias("y"), f[4].cast("int").alias("yhat"), F.map_from_arrays(labels, values).alias("scores"))


def write_alignments(alignments: DataFrame, path: str) -> None:
    """alignments: id, y, label, block. A headline for each example and label, then its block."""
    text = F.concat(F.format_string("%d (yi = %d)  y = %d\n", "id", "y", "label"), F.col("block"))
    alignments.orderBy("id", "label").select(text.alias("value")).write.mode("overwrite").text(path)
