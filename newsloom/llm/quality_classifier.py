"""Quality classifier: supervised subword embeddings.

Every word and every run of 3 and 5 characters of a word (a space next to it may be an end
of the run) is hashed to one of ``buckets`` vectors. A document is the mean of its vectors,
a softmax over two classes makes the output, and both layers are learned by stochastic
gradient descent in numpy, one document at a time.

It learns from a bounded sample: of each label the ``per_label`` labelled documents of the
table that come first by a hash of their id, one row of each (the least of its texts), as far as
they have ``SAMPLE_BYTES`` and the one that goes over it. They fit in one task, whose result is the table of the
vectors' contributions to the output: the mean is linear, so each vector counts by its
product with the difference of the two output rows. Scoring is then a map over all rows.

Defined results: a null or empty text has no vectors, so its score is 0.5; a null doc_id
is never learned from; repeated rows each get a row, and repeated labels of a document
count once; an empty table gives an empty result; without labels all scores are 0.5,
with one label only they are what the one-sided training gives; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbuf as T
from .common import table

BUCKETS = 1 << 18
DIM = 16
RUNS = (3, 5)
#: Documents of each label to learn from, at most.
PER_LABEL = 1500
#: And so many bytes of text of each label; the document that goes over them is the last.
SAMPLE_BYTES = 32 << 20
EPOCHS = 8
RATE = 20.0
THRESHOLD = 0.7
SEED = 29


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features in the texts, and the text of each."""
    data = np.where(T.IS_SPACE[data], np.uint8(32), data)
    hashes, words = T.hash_bytes(data, offsets)
    found = [(hashes & T.U(buckets - 1)).astype(np.int32)]
    texts = [np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(words))]
    first = np.flatnonzero((data & 0xC0) != 0x80)  # the bytes where characters begin
    edges = np.append(first, len(data))
    space = data[first] == 32
    owner = (np.searchsorted(offsets, first, "right") - 1).astype(np.int32)
    for n in RUNS:
        m = len(first) - n + 1
        if m <= 0:
            continue
        usable = owner[:m] == owner[n - 1 :]
        for k in range(1, n - 1):
            usable &= ~space[k : k + m]
        at = np.flatnonzero(usable)
        runs = T.span_hashes(data, edges[at], edges[at + n])
        found.append((T.mix(runs ^ T.U(n << 56)) & T.U(buckets - 1)).astype(np.int32))
        texts.append(owner[at])
    return np.concatenate(found), np.concatenate(texts)


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE) -> np.ndarray:
    """rows: distinct buckets, their shares and the label. Returns each bucket's contribution to the logit of label 1."""
    random = np.random.default_rng(SEED)
    vectors = random.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out = np.zeros((2, dim), np.float32)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            at, share, label = rows[i]
            pace = np.float32(rate * (1 - step / steps))
            step += 1
            own = vectors[at]
            mean = share @ own
            logits = out @ mean
            p = np.exp(logits - logits.max())
            slope = p / p.sum()
            slope[label] -= 1
            back = slope @ out
            out -= min(pace, np.float32(1)) * np.outer(slope, mean)
            vectors[at] = own - pace * np.outer(share, back)
    return (vectors @ (out[1] - out[0])).astype(np.float32)


def train(texts: pa.Array, labels: np.ndarray, **how) -> np.ndarray:
    rows = []
    for i, label in enumerate(labels):
        data, offsets = T.buffers(texts.slice(i, 1))
        found, counts = np.unique(features(data, offsets)[0], return_counts=True)
        if len(found):
            rows.append((found, (counts / counts.sum()).astype(np.float32), int(label)))
    return learn(rows, **how)


def score_texts(texts, weights: np.ndarray) -> np.ndarray:
    data, offsets = T.buffers(texts)
    found, text = features(data, offsets, len(weights))
    n = len(offsets) - 1
    count = np.bincount(text, minlength=n)
    logit = np.bincount(text, weights=weights[found], minlength=n) / np.maximum(count, 1)
    return 1 / (1 + np.exp(-logit.clip(-500, 500)))


def labelled_sample(docs: DataFrame, labels: DataFrame, held_out: Column, per_label: int = PER_LABEL, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """text, quality and rank of at most per_label documents, and about most_bytes, of each label; held_out is of labels' doc_id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out)
    usable = usable.select(F.col("doc_id").alias("_id"), "quality", F.md5(F.col("doc_id").cast("string")).alias("rank")).distinct()
    usable = usable.join(docs.select(F.col("doc_id").alias("_id")), "_id", "left_semi")
    first = [usable.where(F.col("quality") == label).orderBy("rank").limit(per_label) for label in (0, 1)]
    found = docs.select("doc_id", "text").join(F.broadcast(first[0].unionByName(first[1])), F.col("doc_id") == F.col("_id"))
    once = found.groupBy("_id", "quality", "rank").agg(F.min("text").alias("text"))
    order = Window.partitionBy("quality").orderBy("rank", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    return once.withColumn("before", F.sum(size).over(order) - size).where(F.col("before") < most_bytes).select("text", "quality", "rank")


def fit(sample: DataFrame, **how) -> np.ndarray:
    """The contributions, learned in one task from a bounded sample."""

    def one(batches):
        whole = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), ("quality", pa.int32()), ("rank", pa.string())]))
        whole = whole.sort_by([("rank", "ascending"), ("quality", "ascending")])
        weights = train(whole.column("text").combine_chunks(), whole.column("quality").to_numpy(), **how)
        yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()]})

    rows = sample.select("text", F.col("quality").cast("int").alias("quality"), "rank").repartition(1).mapInArrow(one, "weights binary").collect()
    return np.frombuffer(rows[0][0], np.float32) if rows else np.zeros(how.get("buckets", BUCKETS), np.float32)


def classify(docs: DataFrame, weights: np.ndarray, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches):
        for batch in T.batches_of(batches, size=1 << 20):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score_texts(batch.column("text"), shared.value))],
                ["doc_id", "held_out", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    out = rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out_by(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = held_out_by(F.col("doc_id"))
    return classify(docs, fit(labelled_sample(docs, labels, held_out)), held_out)
