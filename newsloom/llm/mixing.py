"""Mixing sources to target weights, with DataFrame functions only.

Tokens (words) are summed per source, a repetition rate is derived for each source, and
each document is emitted floor(rate) times plus once more with a probability equal to
the fraction, decided by a hash of the document's id and a seed. Nothing is drawn at
random, so reruns agree. What a source's taken words miss its target by has the standard
deviation sqrt(f (1 - f) sum(size^2)) for a fraction f: some percent for a source of a hundred
documents, nothing to speak of for a large one.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; a null doc_id is hashed by its text, so equal rows get equal decisions; repeated
rows are decided alike, each emitted on its own; an empty table gives an empty result;
extra columns pass through, and those that clash with the computed names are replaced
in the plan. A source of size 0 has rate 0 and is not emitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, unused, words

#: Weights dealt to the sources in code point order, over and over.
WEIGHTS = (5, 2, 1)
#: All targets together are this share of all sizes.
SHARE = 1.5
#: A target stops at so many times the size of its source.
MOST = 2
#: The windows over one row per source are one task, which a million sources don't strain. Up to so many sources the table of rates is broadcast; beyond, it is joined with salted keys.
BROADCAST_SOURCES = 10_000
SALTS = 64


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, target, rate. sizes: source, size.

    Shares proportional to weight, those over ``most`` times their size cut to it and the
    excess dealt to the rest again until none is above, end where every uncapped source gets
    level * weight. The capped ones are those with the smallest cap to weight, so one pass
    over the sources in that order finds the level. The windows are over one row per source.
    """
    sizes = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("ord"), F.lit(len(weights))) + 1).cast("long")
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "ord")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("ord", F.row_number().over(in_order) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("below", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(onward))
        .withColumn("level", (F.col("budget") - F.col("below")) / F.col("rest"))
    )
    level = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("ord_ratio", "level"))).over(everything)["level"]
    ranked = ranked.withColumn("ord_ratio", F.row_number().over(by_ratio)).withColumn("level", level)
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double"))
    return ranked.select(
        "source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate")
    )


def hashed_id(doc_id: Column, text: Column, seed: int) -> Column:
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null "), F.coalesce(text, F.lit(""))))
    return F.md5(F.concat(key, F.lit(f":{seed}")))


def copies_of(rate: Column, hashed: Column) -> Column:
    """floor(rate), and one more if the document's number, from 0 up to 1, is under the fraction."""
    uniform = F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return F.floor(rate) + (uniform < rate - F.floor(rate)).cast("long")


def with_sources(rows: DataFrame, sources: DataFrame, n: int, salt: Column) -> DataFrame:
    """rows with the columns of their source: broadcast if n sources are few, else joined with salted keys."""
    s, k, dealt = (unused(c, rows.columns) for c in ("_s", "_k", "_salt"))
    named = sources.withColumnRenamed("source", s)
    if n <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(named), F.col("source").eqNullSafe(F.col(s))).drop(s)
    named = named.withColumn(dealt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(k, F.pmod(salt, F.lit(SALTS))).join(named, F.col("source").eqNullSafe(F.col(s)) & (F.col(k) == F.col(dealt))).drop(s, k, dealt)


def mixing_plan(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes each document."""
    size = size_of(F.col("text"))
    targets = stored(source_targets(docs.select("source", size.alias("size")), weights, share, most), "mix-targets")
    h, rate = (unused(c, docs.columns) for c in ("_h", "_rate"))
    rows = docs.drop("size", "source_size", "target", "copies").withColumn(h, hashed_id(F.col("doc_id"), F.col("text"), seed))
    out = with_sources(rows, targets.withColumnRenamed("rate", rate), targets.count(), F.hash(h))
    return out.withColumn("size", size).withColumn("copies", copies_of(F.col(rate), F.col(h))).drop(h, rate)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the plan says."""
    rows = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    plan = mixing_plan(rows, **how).where("copies > 0")
    return plan.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    plan = mixing_plan(docs)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixing_sql(docs: str, columns: str = "doc_id, size, source_size, target, size * copies AS taken", seed: int = 17) -> str:
    """The same in SQL over the relation ``docs``."""
    return f"""
WITH mix_sized AS (
  SELECT d.*, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM {docs} d
), mix_sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS ord
  FROM mix_sized GROUP BY source
), mix_levels AS (
  SELECT *, 2 * source_size AS cap,
         (sum(source_size) OVER () * 1.5::DOUBLE
          - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / sum(weight) OVER (ORDER BY 2 * source_size / weight, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level,
         row_number() OVER (ORDER BY 2 * source_size / weight, ord) AS ord_ratio
  FROM mix_sources
), mix_level AS (
  SELECT arg_min(level, ord_ratio) FILTER (WHERE cap >= level * weight) AS level FROM mix_levels
), mix_targets AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, l.level * weight), cap::DOUBLE) AS target
  FROM mix_levels, mix_level l
), mix_rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM mix_targets
), mix_plan AS (
  SELECT d.*, r.source_size, r.target,
         floor(rate)::BIGINT + (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null ' || coalesce(text, '')) || ':{seed}'), 1, 13))::BIGINT
           / 4503599627370496.0::DOUBLE < rate - floor(rate))::BIGINT AS copies
  FROM mix_sized d JOIN mix_rates r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT {columns} FROM mix_plan"""
