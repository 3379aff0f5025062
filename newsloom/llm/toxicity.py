"""Toxicity by multiple-instance learning: a text is toxic if one of its sentences is.

A sentence's score is a logistic function of the sum of its features' weights: its words and their
beginnings of ``STEMS`` bytes, which inflected and compound words share, hashed. A text's is the noisy-or of its sentences', 1 - prod(1 - score). Weights
are learned from labels of texts alone, by gradient descent on the log-loss of the noisy-or over all texts of the sample
at once, so the blame for a label goes to the sentences that explain it; which they are is what
``offending`` then tells.

Words are runs of letters and digits (bytes from 0x80 on are letters), with A-Z in lower case; sentences end
at a full stop, exclamation or question mark before white space or the end, and at line ends. A sentence of more
than ``MOST`` words is taken in stretches of so many. Features that tell labels apart by chance, as far as one can say
(a log-likelihood ratio under ``SIGNIFICANT``), weigh nothing; else rare words would explain the labels of the sample.

It learns from a bounded sample: of each label the ``PER_LABEL`` labelled documents that come first by a hash of
their id, one row of each, as far as they have ``SAMPLE_BYTES`` and the one that goes over it; one task learns.
All rows are scored in a map that gets the weights, a table of fixed size.

Defined results: a text without words, null or empty, has score 0; a null doc_id is never learned from; repeated rows each get a row, repeated labels of a
document count once; an empty table gives an empty result; without labels all scores are those of the bias alone, next to 0;
extra columns pass through, those named ``toxicity`` and ``sentences`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import textbuf as T
from .common import table
from .quality_classifier import labelled_sample

BUCKETS = 1 << 20
STEMS = (4, 5, 6, 7)
MOST = 40
SIGNIFICANT = 15.0
#: Documents of each label to learn from, at most, and bytes of their text; the document that goes over them is the last.
PER_LABEL = 3000
SAMPLE_BYTES = 16 << 20
ROUNDS = 300
RATE = 0.5
#: Texts that a feature's step is smoothed by, the pull of weights to 0, and the log-odds of a sentence without features.
SMOOTH, PULL, BIAS = 5.0, 0.05, -6.0
MOMENTUM = 0.9
THRESHOLD = 0.5
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SENTENCE = S.StructType([S.StructField("start", S.LongType()), S.StructField("end", S.LongType()), S.StructField("score", S.DoubleType())])


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word the hashes of it and its beginnings (a row each, 0 for none), its start and end (bytes), and the number of its sentence, ascending over all texts."""
    hashes, rest = [np.zeros((0, 1 + len(STEMS)), T.U)], [np.zeros((4, 0), np.int64)]
    begin, n, stops = 0, len(data), 0
    while begin < n:
        end = T.cut(data, begin, n)
        piece = T.LOWER[data[begin:end]]
        is_word = IS_WORD[piece]
        breaks = np.zeros(len(piece) + 1, bool)
        breaks[[0, -1]] = True
        breaks[offsets[np.searchsorted(offsets, begin, "left") : np.searchsorted(offsets, end, "right")] - begin] = True
        first, last = is_word.copy(), is_word.copy()
        first[1:] &= ~is_word[:-1] | breaks[1:-1]
        last[:-1] &= ~is_word[1:] | breaks[1:-1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        spaced = np.append(T.IS_SPACE[piece[1:]], True)
        stop = np.isin(piece, (10, 13)) | (np.isin(piece, (33, 46, 63)) & spaced)
        passed = np.concatenate([[0], np.cumsum(stop)]) + stops
        stops = int(passed[-1])
        own = [T.span_hashes(piece, a, b)]
        own += [np.where(b - a > k, T.mix(T.span_hashes(piece, a, np.minimum(a + k, b)) ^ T.U(k << 56)), T.U(0)) for k in STEMS]
        hashes.append(np.stack(own, axis=1))
        rest.append(np.stack([a + begin, b + begin, passed[a], passed[b]]))
        begin = end
    a, b, before, after = np.concatenate(rest, axis=1)
    new = np.ones(len(a), bool)
    new[1:] = (before[1:] > after[:-1]) | (np.searchsorted(offsets, a[1:], "right") > np.searchsorted(offsets, a[:-1], "right"))
    at = np.arange(len(a))
    place = at - np.maximum.accumulate(np.where(new, at, 0)) if len(a) else at
    return np.concatenate(hashes), a, b, np.cumsum(new | (place % MOST == 0)) - 1


def features(hashes: np.ndarray, sentence: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the different words of a sentence and of their beginnings, and the sentence of each."""
    once = np.unique((hashes[:, 0] & T.U(0xFFFFFFFF)) | sentence.astype(T.U) << T.U(32), return_index=True)[1]
    hashes, sentence = hashes[once], sentence[once]
    there = hashes.ravel() != 0
    return (hashes.ravel()[there] & T.U(buckets - 1)).astype(np.int32), np.repeat(sentence, hashes.shape[1])[there]


def noisy_or(logits: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The log of the chance that none of an owner's sentences is toxic."""
    return np.bincount(owner, weights=-np.logaddexp(0, logits), minlength=n)


def tells(texts: np.ndarray, toxic: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Features of which the share of toxic texts differs from that of all by a log-likelihood ratio of ``SIGNIFICANT``."""
    base = labels.mean() if len(labels) else 0.0
    part = lambda k, p: np.where(k > 0, k * np.log(np.maximum(k, 1) / np.maximum(texts * p, 1e-12)), 0)
    return (2 * (part(toxic, base) + part(texts - toxic, 1 - base)) >= SIGNIFICANT) & (texts > 0)


def learn(found: np.ndarray, sentence: np.ndarray, owner: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """found, sentence: features; owner: each sentence's text; labels: each text's. Returns the weights of features and the bias."""
    n = len(labels)
    weights, bias = np.zeros(int(found.max(initial=-1)) + 1), BIAS
    pairs = np.unique(owner[sentence].astype(np.int64) << 32 | found)
    texts = np.bincount(pairs & 0xFFFFFFFF, minlength=len(weights))
    toxic = np.bincount(pairs[labels[pairs >> 32] == 1] & 0xFFFFFFFF, minlength=len(weights))
    use = tells(texts, toxic, labels)[found]
    found, sentence = found[use], sentence[use]
    share = n / np.maximum(np.bincount(labels, minlength=2), 1) / 2  # both labels weigh the same
    pace = np.zeros_like(weights)
    for _ in range(rounds if len(found) else 0):
        logits = bias + np.bincount(sentence, weights=weights[found], minlength=len(owner))
        chance = 1 / (1 + np.exp(-logits.clip(-500, 500)))
        none = noisy_or(logits, owner, n)
        some = np.maximum(-np.expm1(none), 1e-12)
        blame = chance * np.where(labels == 1, -share[1] * (1 - some) / some, share[0])[owner]
        slope = np.bincount(found, weights=blame[sentence], minlength=len(weights)) + PULL * weights
        pace = MOMENTUM * pace - rate * slope / (texts + SMOOTH)
        weights += pace
        bias = min(bias - rate * blame.sum() / n, BIAS / 2)
    return weights, bias


def train(texts: pa.Array, labels: np.ndarray, buckets: int = BUCKETS, **how) -> np.ndarray:
    """A weight for each bucket, and the bias last."""
    data, offsets = T.buffers(texts)
    hashes, starts, _, sentence = words_of(data, offsets)
    out = np.zeros(buckets + 1, np.float32)
    out[-1] = BIAS
    if len(hashes):
        first = np.flatnonzero(np.diff(sentence, prepend=-1))
        owner = np.searchsorted(offsets, starts[first], "right") - 1
        found, of = features(hashes, sentence, buckets)
        weights, out[-1] = learn(found, of, owner, labels, **how)
        out[: len(weights)] = weights
    return out


def sentence_scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each sentence its log-odds, its text, and its first and last byte's places, the end exclusive."""
    hashes, starts, ends, sentence = words_of(data, offsets)
    found, of = features(hashes, sentence, len(weights) - 1)
    first = np.flatnonzero(np.diff(sentence, prepend=-1))
    logits = weights[-1] + np.bincount(of, weights=weights[found], minlength=len(first))
    last = np.append(first[1:], len(sentence)) - 1
    return logits, np.searchsorted(offsets, starts[first], "right") - 1, starts[first], ends[last] if len(first) else starts[first]


def score_texts(texts, weights: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, list[list[dict]]]:
    """Of each text its score, and its sentences of at least the threshold: start and end in code points, and score."""
    data, offsets = T.buffers(texts)
    n = len(offsets) - 1
    logits, owner, starts, ends = sentence_scores(data, offsets, weights)
    out = -np.expm1(noisy_or(logits, owner, n)) if len(logits) else np.zeros(n)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    listed: list[list[dict]] = [[] for _ in range(n)]
    for k in np.flatnonzero(logits >= np.log(threshold / (1 - threshold))):
        i = owner[k]
        at = points[offsets[i]]
        listed[i].append({"start": int(points[starts[k]] - at), "end": int(points[ends[k]] - at), "score": float(1 / (1 + np.exp(-logits[k])))})
    return out, listed


def fit(sample: DataFrame, **how) -> np.ndarray:
    """The weights, learned in one task from a bounded sample: text, quality (the label) and rank."""

    def one(batches):
        whole = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), ("quality", pa.int32()), ("rank", pa.string())]))
        whole = whole.sort_by([("rank", "ascending"), ("quality", "ascending")])
        yield pa.RecordBatch.from_pydict({"weights": [train(whole.column("text").combine_chunks(), whole.column("quality").to_numpy(), **how).tobytes()]})

    rows = sample.select("text", F.col("quality").cast("int").alias("quality"), "rank").repartition(1).mapInArrow(one, "weights binary").collect()
    return np.frombuffer(rows[0][0], np.float32) if rows else np.append(np.zeros(how.get("buckets", BUCKETS), np.float32), np.float32(BIAS))


def offending(docs: DataFrame, weights: np.ndarray, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with ``toxicity``, the score of each whole text, and ``sentences``, those of at least the threshold: start, end (code points, end exclusive), score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kept = [c for c in docs.columns if c not in ("toxicity", "sentences")]
    out = S.StructType([docs.schema[c] for c in kept] + [S.StructField("toxicity", S.DoubleType()), S.StructField("sentences", S.ArrayType(SENTENCE))])
    listed = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def score(batches):
        for batch in T.batches_of(batches, size=1 << 20, column=text):
            scores, found = score_texts(batch.column(text), shared.value, threshold)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(scores, pa.float64()), pa.array(found, listed)], names=out.names)

    return docs.mapInArrow(score, out)


def held_out_by(doc_id: Column, modulus: int = 5, remainder: int = 0) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def toxic_sample(docs: DataFrame, labels: DataFrame, held_out: Column, **bounds) -> DataFrame:
    """The sample that ``fit`` takes, by the column ``toxic`` of labels."""
    bounds = {"per_label": PER_LABEL, "most_bytes": SAMPLE_BYTES} | bounds
    return labelled_sample(docs, labels.select("doc_id", F.col("toxic").alias("quality")), held_out, **bounds)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = held_out_by(F.col("doc_id"))
    scored = offending(docs.select("doc_id", "text"), fit(toxic_sample(docs, labels, held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
