"""N-gram lexicons: distinct words, counts, cumulative counts, and selection by cut, number or probability mass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_words(pairs: DataFrame, side: str) -> DataFrame:
    """word: the different token sequences of a side, tokens with spaces between."""
    return pairs.select(F.array_join(side, " ").alias("word")).distinct()


def spaced(word: Column) -> Column:
    """The characters of a word with spaces between."""
    return F.array_join(F.filter(F.split(word, ""), lambda c: c != ""), " ")


def ngram_counts(words: DataFrame, low: int, high: int, word: str = "word") -> DataFrame:
    """n, ngram, cnt of all token n-grams (low <= n <= high) of spaced words between the marks <s> and </s>."""
    t = F.concat(F.array(F.lit("<s>")), F.filter(F.split(word, " "), lambda c: c != ""), F.array(F.lit("</s>")))
    rows = words.select(t.alias("t"), F.explode(F.sequence(F.lit(low), F.lit(high))).alias("n")).filter(F.size("t") >= F.col("n"))
    grams = F.transform(F.sequence(F.lit(1), F.size("t") - F.col("n") + 1), lambda i: F.array_join(F.slice("t", i, F.col("n")), " "))
    return rows.select("n", F.explode(grams).alias("ngram")).groupBy("n", "ngram").agg(F.count("*").alias("cnt"))


def count_cdf(counts: DataFrame) -> DataFrame:
    """n, cnt, types, cumulative: how many n-grams have a count, and how many at most that count."""
    w = Window.partitionBy("n").orderBy("cnt").rowsBetween(Window.unboundedPreceding, 0)
    return counts.groupBy("n", "cnt").agg(F.count("*").alias("types")).withColumn("cumulative", F.sum("types").over(w))


def min_count(counts: DataFrame, cut: float) -> DataFrame:
    """n, min_count: the first count whose share of n-grams at most that frequent is above cut."""
    cdf = count_cdf(counts).withColumn("total", F.sum("types").over(Window.partitionBy("n")))
    return cdf.filter(F.col("cumulative") / F.col("total") > cut).groupBy("n").agg(F.min("cnt").alias("min_count"))


def select_ngrams(counts: DataFrame, cut: float | None = None, top: int | None = None, mass: float | None = None) -> DataFrame:
    """n, ngram, cnt of the selected n-grams. Of several ways the number counts first, then the cut, then the mass.

    cut: those at least as frequent as min_count. top: the most frequent ones, ties from the last n-gram down. mass: the same
    order, as long as the running sum of probabilities stays at most mass."""
    order = Window.partitionBy("n").orderBy(F.desc("cnt"), F.desc("ngram"))
    if top is not None:
        return counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).drop("r")
    if cut is not None:
        # One row for each n.
        return counts.join(F.broadcast(min_count(counts, cut)), "n").filter(F.col("cnt") >= F.col("min_count")).drop("min_count")
    if mass is None:
        raise ValueError("give cut, top or mass")
    # Counts above the first one that doesn't fit in whole are selected in whole; only n-grams of that one count are ranked.
    by_count = counts.groupBy("n", "cnt").agg(F.count("*").alias("types"))
    down = Window.partitionBy("n").orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, 0)
    sums = by_count.withColumn("through", F.sum(F.col("cnt") * F.col("types")).over(down)).withColumn("total", F.sum(F.col("cnt") * F.col("types")).over(Window.partitionBy("n")))
    limits = sums.withColumn("before", F.col("through") - F.col("cnt") * F.col("types"))
    fitting = limits.withColumn("k", F.floor((mass * F.col("total") - F.col("before")) / F.col("cnt")).cast("long")).filter("k > 0")
    joined = counts.join(fitting.select("n", "cnt", "k", "types"), ["n", "cnt"])
    whole = joined.filter("k >= types").select("n", "ngram", "cnt")
    part = joined.filter("k < types").withColumn("r", F.row_number().over(order)).filter("r <= k").select("n", "ngram", "cnt")
    return whole.unionByName(part)


def lexicon_pipeline(pairs: DataFrame, low: int = 2, high: int = 3, cut: float | None = None, top: int | None = None, mass: float | None = 0.10) -> dict[str, DataFrame]:
    """Lexicons (ngram, tokens joined by +) of both sides."""
    out = {}
    for side in ("source", "target"):
        chosen = select_ngrams(ngram_counts(distinct_words(pairs, side), low, high), cut, top, mass)
        marks = F.regexp_replace(F.regexp_replace("ngram", "</s>", "\\$"), "<s>", "^")
        out[side] = chosen.select(F.regexp_replace(marks, " ", "+").alias("ngram"))
    return out


def in_lexicon(rows: DataFrame, lexicon: DataFrame, column: str = "ngram") -> DataFrame:
    """Rows whose n-gram is in the lexicon; single tokens always are."""
    single = rows.filter(~F.col(column).contains("+"))
    return single.unionByName(rows.filter(F.col(column).contains("+")).join(lexicon.select(F.col("ngram").alias(column)), column, "left_semi").select(*rows.columns))
