"""Quality rules, with DataFrame functions only.

Base rules count words, symbols, repeated lines and words in repeated windows. The
verdict is a log-likelihood ratio: hashed word unigrams and bigrams are counted over all
documents and over the trusted ones, which gives two multinomials over ``buckets``
buckets; a document's score is the mean over its n-grams of log p(target) - log p(raw),
and it is kept if it passes the base rules and its score is at least ``threshold``.

All work on a text stays in its row. Only the counts are shuffled, after partial
aggregation, and the text once, to meet the labels in a merge join, which can spill and is
the same at every size. The table of ratios has ``buckets`` entries at any size of the input,
and reaches the tasks as a literal array.

Defined results: a null text is empty (all counts 0, base_failed); a null doc_id is
scored like any other, it is just never trusted; repeated rows each get a row; an empty
table gives an empty result; without trusted documents all ratios are 0 and the base
rules decide; extra columns pass through quality_rules(), computed names are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, total, unused, words

BUCKETS = 1 << 14
#: The target multinomial is drawn to the raw one by as many n-grams as this times the buckets, so ratios of little evidence stay near 0.
SMOOTHING = 8.0
#: Mean log ratio from which a document is kept.
THRESHOLD = -0.1
WINDOW = 8
COMPUTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def hashed(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def bigrams(h: Column) -> Column:
    return F.when(F.size(h) > 1, F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)))).otherwise(F.array().cast("array<long>"))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def covered(windows: Column) -> Column:
    """Words in windows whose hash comes twice or more: the windows are sorted by hash, those
    equal to a neighbour keep their positions, and the positions, sorted, tell the words covered."""

    def positions(s: Column) -> Column:
        same = lambda x, j: F.get(s, j)["h"] == x["h"]
        twice = F.filter(s, lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    at = lambda p: total(F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(WINDOW), F.get(p, j + 1) - x), F.lit(WINDOW))), F.lit(0))
    return let(pairs, lambda s: let(positions(s), at))


def repeated_words(h: Column) -> Column:
    """h: the hashes of the words."""
    windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    some = let(windows, lambda a: F.when(F.size(F.array_distinct(a)) == F.size(a), F.lit(0)).otherwise(covered(a)))
    return F.when(F.size(h) <= WINDOW, F.lit(0)).otherwise(some).cast("long")


def gram_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, raw, target: n-grams of all documents and of the trusted ones, at most a row per bucket.

    trusted: rows with a doc_id. Documents without an id are dealt out by their text.
    """
    ids = trusted.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id")).distinct().withColumn("_deal", F.lit(0)).withColumn("_trusted", F.lit(1))
    no_id = F.col("doc_id").isNull()
    keyed = docs.select(
        "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"),
        F.when(no_id, 1 + F.pmod(F.xxhash64("text"), F.lit(1 << 20))).otherwise(0).cast("int").alias("_deal")
    )
    joined = keyed.join(ids.hint("merge"), ["_id", "_deal"], "left")
    grams = joined.select(F.coalesce("_trusted", F.lit(0)).alias("t"), F.explode(let(hashed(F.col("text")), lambda h: F.concat(h, bigrams(h)))).alias("g"))
    return grams.groupBy(F.pmod("g", F.lit(buckets)).cast("int").alias("bucket")).agg(F.count("*").alias("raw"), F.sum("t").alias("target"))


def ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """The log ratio of each bucket, in order; the driver holds ``buckets`` numbers at any size of the input."""
    raw, target = [0] * buckets, [0] * buckets
    for bucket, r, t in counts.collect():
        raw[bucket], target[bucket] = r, t
    if not sum(target):
        return [0.0] * buckets
    prior, of_raw, sum_target = smoothing * buckets, sum(raw), sum(target)
    return [round(math.log((t * of_raw / r + prior) / (sum_target + prior)), 4) if r else 0.0 for r, t in zip(raw, target, strict=True)]


def quality_rules(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the base counts, base_failed, score and kept."""
    found = ratios(gram_counts(docs.select("doc_id", "text"), trusted, buckets), buckets, smoothing)
    table_of = F.split(F.lit(",".join(map(str, found))), ",").cast("array<double>")  # folded to a literal by the optimizer

    def score(h: Column) -> Column:
        slot = lambda g: F.pmod(g, F.lit(buckets)).cast("int")
        summed = let(table_of, lambda r: F.aggregate(F.concat(h, bigrams(h)), F.lit(0.0), lambda acc, g: acc + F.get(r, slot(g))))
        return F.when(F.size(h) > 0, summed / (2 * F.size(h) - 1)).otherwise(F.lit(0.0))

    def measures(w: Column) -> Column:
        return let(
            F.transform(w, lambda x: F.xxhash64(x)),
            lambda h: F.struct(
                F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(h).alias("n_repeat_words"), score(h).alias("score")
            ),
        )

    text = F.coalesce(F.col("text"), F.lit(""))
    measured = unused("_m", docs.columns)
    m = F.col(measured)
    rows = docs.drop(*COMPUTED).withColumn(measured, let(words(F.col("text")), measures))
    rows = rows.withColumns({
        "n_words": m["n_words"], "word_chars": m["word_chars"], "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": duplicate_lines(F.col("text")), "n_repeat_words": m["n_repeat_words"], "score": m["score"],
    })
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= F.lit(threshold))).drop(measured)


def trusted_of(labels: DataFrame) -> DataFrame:
    """The trusted target: documents labelled good and not toxic."""
    return labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_rules(docs, trusted_of(table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
