"""Line deduplication over overlapping windows of three lines, with DataFrame functions only.

Every three consecutive lines of a document that are not blank are a window, known by 128 bits of hash. Of each window's
occurrences in all documents the first, in order of document id and line, stays; all lines from the first to the last line of
a later occurrence are covered, and covered lines go (those of overlapping occurrences once). Occurrences are reduced to their
first one before they are joined, and hot windows are left to the skew handling of adaptive execution.

Lines are what stands between line feeds, compared exactly; a line of spaces alone is blank: it takes no part in windows and
goes only between covered lines. Defined results: documents of fewer than three lines that are not blank stay as they are, null
and empty texts too; null ids come last; rows that repeat an id and a text are one document and lose the same lines, rows that
repeat an id with another text are told apart by the text's hash; ids may be numbers, strings or dates; every row and all columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialized, row_key

KEY = ("no_id", "k1", "k2")


def numbered_lines(text: Column) -> Column:
    """The lines that are not blank: their number and two hashes."""
    numbered = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("at"), line.alias("line")))
    full = F.filter(numbered, lambda x: F.replace(x["line"], F.lit(" "), F.lit("")) != "")
    return F.transform(full, lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit(1), x["line"]).alias("b")))


def windows(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per window: the document's key, number of the first and of the last line, two hashes."""
    keyed = docs.select(*(c.alias(n) for n, c in zip(KEY, row_key(docs, id_col, text_col))), numbered_lines(F.col(text_col)).alias("lines"))
    keyed = keyed.filter(F.size("lines") >= size)
    part = lambda i, name: [F.col("lines")[i + k - 1][name] for k in range(size)]
    made = F.transform(F.sequence(F.lit(1), F.size("lines") - size + 1), lambda i: F.struct(part(i, "at")[0].alias("first"), part(i, "at")[-1].alias("last"), F.xxhash64(*part(i, "a")).alias("a"), F.xxhash64(*part(i, "b")).alias("b")))
    return keyed.select(*KEY, F.explode(made).alias("w")).select(*KEY, "w.*")


def covered_lines(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with later occurrences: their key, and the numbers of all covered lines."""
    all_windows = windows(docs, size, id_col, text_col)
    place = F.struct(*KEY, "first")
    # Written, so that the join is a plain one of two shuffles, whose hot windows can be split.
    kept = materialized(all_windows.groupBy("a", "b").agg(F.min(place).alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n"), "windows")
    later = all_windows.join(kept, ["a", "b"]).filter(place > F.col("kept"))
    lines = later.select(*KEY, F.explode(F.sequence("first", "last")).alias("at"))
    return lines.groupBy(*KEY).agg(F.collect_set("at").alias("covered"))


def deduplicate_lines(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """The documents without their covered lines; removed_col, if given, holds how many lines went."""
    names = [free_name(docs, f"__{c}") for c in KEY]
    hit, merged = free_name(docs, "__covered"), free_name(docs, "__merged")
    covered = covered_lines(docs, size, id_col, text_col).toDF(*names, hit)
    joined = docs.withColumns(dict(zip(names, row_key(docs, id_col, text_col)))).join(covered, names, "left")
    # A covered line is sorted right after the entry that says so.
    mark = F.transform(hit, lambda at: F.struct(at.alias("at"), F.lit(0).alias("kind"), F.lit("").alias("line")))
    lines = F.transform(F.split(text_col, "\n"), lambda line, i: F.struct(i.alias("at"), F.lit(1).alias("kind"), line.alias("line")))
    joined = joined.withColumn(merged, F.when(F.col(hit).isNotNull(), F.sort_array(F.concat(mark, lines))))
    left = F.filter(merged, lambda x, i: (x["kind"] == 1) & ((i == 0) | (F.get(F.col(merged), i - 1)["at"] != x["at"])))
    text = F.when(F.col(hit).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda x: x["line"]), "\n"))
    columns = [text.alias(text_col) if c == text_col else F.col(c) for c in docs.columns]
    if removed_col:
        columns.append(F.coalesce(F.size(hit), F.lit(0)).cast("long").alias(removed_col))
    return joined.select(*columns)
