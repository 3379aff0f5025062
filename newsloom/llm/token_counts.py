"""Token counts by an exact length histogram.

Each text is encoded by a public tokenizer and only its length is kept. Documents are
counted per length; sums from the longest length down then answer, for any context limit,
how many documents exceed it, how many tokens remain if texts are truncated to it, and
which length a quantile has. The sums are made in two steps, within ranges of lengths and
over the ranges, so no task goes through the whole histogram.

The vocabulary file's path is a parameter. The driver reads it and broadcasts its bytes,
whose size is checked against VOCABULARY_BYTES.

Defined results: a null or empty text has length 0; null ids don't matter; repeated rows
count each; an empty table gives an empty histogram, for which all answers are 0 and
quantiles null; extra columns are left out.
"""

from __future__ import annotations

import base64
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbuf as T
from .common import stored, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARY_BYTES = 64 << 20
#: How the tokenizer parts a text before merging (a fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANGE = 512
LIMITS = (512, 1024, 2048, 4096, 8192, 32768)
QUANTILES = (0.5, 0.9, 0.99)


def encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("newsloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """The encoded length of each row's text."""
    vocabulary = Path(vocabulary_path).read_bytes()
    if len(vocabulary) > VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary_path} has {len(vocabulary)} bytes; at most {VOCABULARY_BYTES} are broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        encode = encoder(shared.value).encode_ordinary
        for batch in T.batches_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(x)) if x else 0 for x in batch.column("text").to_pylist()], pa.int64())], ["length"])

    return docs.select("text").mapInArrow(count, "length long")


def histogram(docs: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """length, n_docs: how many documents have the length."""
    return lengths(docs, vocabulary_path).groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """For each length as a context limit: documents of at most it (over total_docs: the quantile that it is), documents
    and tokens of at least it, all tokens, and tokens left by truncation.

    truncated_tokens(L) = tokens of shorter documents + L * documents of at least L. counts is read twice.
    """
    tokens = F.col("length") * F.col("n_docs")
    ranged = counts.withColumn("range", F.floor(F.col("length") / RANGE))
    by_range = ranged.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    tops = by_range.select(
        "range",
        F.coalesce(F.sum("d").over(above), zero).alias("docs_above"),
        F.coalesce(F.sum("t").over(above), zero).alias("tokens_above"),
        F.sum("t").over(Window.partitionBy()).alias("total_tokens"), F.sum("d").over(Window.partitionBy()).alias("total_docs")
    )
    within = Window.partitionBy("range").orderBy(F.desc("length"))
    own = ranged.withColumn("d", F.sum("n_docs").over(within)).withColumn("t", F.sum(tokens).over(within))
    sums = own.join(tops, "range").select(
        "length", "n_docs", (F.col("d") + F.col("docs_above")).alias("docs_at_least"),
        (F.col("t") + F.col("tokens_above")).alias("tokens_at_least"), "total_docs", "total_tokens"
    )
    sums = sums.withColumn("docs_at_most", F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs"))
    return sums.withColumn("truncated_tokens", F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least"))


def answers(sums: DataFrame, limits: tuple = LIMITS) -> DataFrame:
    """limit, docs_over, tokens_kept for each limit, of which none need be a length that occurs."""
    wanted = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    over = F.col("length") > F.col("limit")
    first_over = F.min_by(F.struct("docs_at_least", "tokens_at_least"), "length")
    crossed = sums.join(F.broadcast(wanted), over, "right").groupBy("limit").agg(first_over.alias("s"))
    total = sums.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total")).first()[0]
    docs, tokens = F.coalesce("s.docs_at_least", F.lit(0)), F.coalesce("s.tokens_at_least", F.lit(0))
    return crossed.select("limit", docs.alias("docs_over"), (F.lit(total) - tokens + F.col("limit") * docs).alias("tokens_kept"))


def quantiles(sums: DataFrame, wanted: tuple = QUANTILES) -> dict[float, int | None]:
    """The least length that at least the share q of the documents don't exceed."""
    row = sums.agg(*[F.min(F.when(F.col("docs_at_most") >= F.ceil(F.col("total_docs") * q), F.col("length"))).alias(f"q{i}") for i, q in enumerate(wanted)]).first()
    return dict(zip(wanted, row, strict=True))


def op6_token_counts(spark: SparkSession, sf_dir: str, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """Each length that occurs, with the sums; the histogram is written, so that texts are encoded once."""
    return suffix_sums(stored(histogram(table(spark, sf_dir, "documents"), vocabulary_path), "lengths"))
