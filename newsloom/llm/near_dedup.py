"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Shingles of five words are hashed. With S the sum over all documents of their distinct
   shingles, a shingle is frequent if it is in S / ``FREQUENT`` documents or more, at least 2.
   There are at most FREQUENT of those at any size of the corpus, and their document frequencies
   are counted exactly, in two passes: all shingles by bucket, then those of the buckets that
   can hold a frequent one.
2. A shingle weighs its count in the document times 1 + ln(n / df) / ln(n / rare), with
   df at least rare = S / FREQUENT: so once for what all documents have, twice for what is not frequent.
   As S grows with n, the share of the documents that makes a shingle frequent, and so
   every weight, is alike at every size.
3. Improved consistent weighted sampling draws ``BANDS * ROWS`` samples per document: for
   weight w and the Gamma(2,1) variates r, c and the uniform b of shingle and sample,
   t = floor(ln w / r + b) and the shingle with the least ln c - r (t - b + 1) is drawn. Equal
   draws have the probability of the weighted Jaccard similarity. The least value itself
   tells the draw. The draws of a band make its bucket.
4. Exact copies share a representative. In each bucket every representative is paired
   with the most popular one (that shares most buckets with others; in a group of edits
   that is the text they come from), and so in the finer buckets of two bands; in other
   finer buckets with one taken by hash, for groups that have no middle. So pairs grow with
   the documents, not with the square of a bucket. Pairs whose draws agree too seldom for
   the threshold are left out.
5. The rest are verified by their weighted Jaccard similarity, and classes are the
   connected components of the verified links.
6. That settles the buckets whose texts are all of one class. In the others all texts of
   different classes are compared, in blocks of bounded size: first their draws, then, of
   those that agree often enough, the texts, each sent once to a block and not once a pair.
   The largest class of a bucket has blocks of its own with the other texts only, so that its texts
   are not compared with each other. Of the links found those that join classes not yet joined
   are put out.

Defined results: a null text is empty; texts of fewer than five words have one shingle of
all their words; texts without words are alike only if they are equal; a null doc_id gets
the class of its text; repeated rows each get a row; an empty table gives an empty
result; extra columns are left out by near_classes() and kept by one_of_each().
The class id is the smallest doc_id in the class (null if none has one).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.components import components

from . import textbuf as T
from .common import stored, table

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 4
#: So many shingles are frequent at most; shingles are first counted in BUCKETS.
FREQUENT, BUCKETS = 1 << 16, 1 << 18
FILTER_BITS = 20
#: Of the draws so many less than the threshold says may agree by chance (four deviations).
SLACK = 0.21
SEED = 41
CELLS = 1 << 12
#: A block of an unsettled bucket has about so many texts and bytes at most; blocks are compared in bins of so many bytes.
CHUNK, CHUNK_BYTES, BIN_BYTES = 256, 4 << 20, 16 << 20
U = T.U


def gamma2(p: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2,1), whose distribution is 1 - (1 + x) exp(-x), by bisection."""
    low, high = np.zeros_like(p), np.full_like(p, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        less = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return (low + high) / 2


def variates() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r and 1 / r at CELLS quantiles, ln c at CELLS * 16."""
    at = lambda n: (np.arange(n) + 0.5) / n
    r = gamma2(at(CELLS)).astype(np.float32)
    return r, 1 / r, np.log(gamma2(at(CELLS * 16))).astype(np.float32)


def shingles(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts, and the offsets by text."""
    hashes, offsets = T.hash_words(texts)
    runs, offsets = T.grams(hashes, offsets, SHINGLE)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((runs, text))
    runs = runs[order]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:] != runs[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(at, append=len(runs))
    return runs[at], counts, np.searchsorted(text[at], np.arange(len(offsets)))


def bucket_of(runs: np.ndarray) -> np.ndarray:
    return (runs >> U(40)).astype(np.int64) & (BUCKETS - 1)


class Weights:
    """What a shingle weighs, once: 2, and less if it is frequent. keys: the frequent shingles, counts: their document frequencies."""

    def __init__(self, documents: int, least: int, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.documents, self.least, self.keys, self.counts = documents, least, keys[order], counts[order]
        rare = least - 1
        self.values = 1 + np.log(documents / self.counts.clip(rare, documents)) / np.log(max(documents, rare + 1) / rare)
        self.may = np.zeros(1 << FILTER_BITS, bool)
        self.may[self.keys >> U(64 - FILTER_BITS)] = True

    def of(self, runs: np.ndarray) -> np.ndarray:
        out = np.full(len(runs), 2.0, np.float32)
        if len(self.keys):
            some = np.flatnonzero(self.may[(runs >> U(64 - FILTER_BITS)).view(np.int64)])
            at = np.searchsorted(self.keys, runs[some]).clip(max=len(self.keys) - 1)
            same = self.keys[at] == runs[some]
            out[some[same]] = self.values[at[same]]
        return out


def weights_of(docs: DataFrame, frequent: int = FREQUENT) -> Weights:
    """Counts the documents and the frequent shingles; the driver holds tables of fixed size."""

    def by_bucket(batches):
        total, texts = np.zeros(BUCKETS, np.int64), 0
        for batch in T.batches_of(batches, size=2 << 20):
            total += np.bincount(bucket_of(shingles(batch.column("text"))[0]), minlength=BUCKETS)
            texts += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], texts))], ["bucket", "n"])

    texts = docs.select("text")
    found = texts.mapInArrow(by_bucket, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    documents, real = int(n[bucket < 0].sum()), bucket >= 0
    least = max(2, math.ceil(int(n[real].sum()) / frequent))
    full = np.zeros(BUCKETS, bool)
    full[bucket[real]] = n[real] >= least
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(full))

    def by_shingle(batches):
        full = np.unpackbits(shared.value).view(bool)
        for batch in T.batches_of(batches, size=8 << 20):
            runs = shingles(batch.column("text"))[0]
            keys, n = np.unique(runs[full[bucket_of(runs)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    counts = texts.mapInArrow(by_shingle, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    return Weights(documents, least, counts.column("key").to_numpy().view(U), counts.column("n").to_numpy())


def draw(runs: np.ndarray, weights: np.ndarray, offsets: np.ndarray, tables, step: int = 2048) -> np.ndarray:
    """The draws of each text, one row per text; texts without shingles have zeros."""
    r_of, inverse_of, lnc_of = tables
    k = BANDS * ROWS
    odd = T.mix(np.arange(1, k + 1, dtype=U) * T.M3 + U(SEED)) | U(1)
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, k), np.float32)
    if not len(full):
        return out
    lnw = np.log(weights).astype(np.float32)
    least = np.full((k, len(offsets) - 1), np.inf, np.float32)
    with np.errstate(over="ignore"):
        for a in range(0, len(runs), step):
            b = min(a + step, len(runs))
            x = odd[:, None] * runs[a:b]
            cell = (x >> U(52)).astype(np.intp)
            r = r_of[cell]
            t = inverse_of[cell]
            t *= lnw[a:b]
            beta = ((x >> U(36)) & U(0xFFFF)).astype(np.float32)
            beta *= np.float32(1 / 65536)
            t += beta
            np.floor(t, out=t)
            t -= beta
            t += np.float32(1)
            t *= r
            value = lnc_of[((x >> U(20)) & U(CELLS * 16 - 1)).astype(np.intp)]
            value -= t
            i, j = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
            own = [d for d in range(i, j) if offsets[d + 1] > offsets[d]]
            starts = np.maximum(offsets[own], a) - a
            least[:, own] = np.minimum(least[:, own], np.minimum.reduceat(value, starts, axis=1))
    out[full] = least.T[full]
    return out


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, text_hash (two longs), size (bytes), draws (binary) and bands (longs) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def sign(batches):
        tables = variates()
        for batch in T.batches_of(batches, size=1 << 20):
            runs, tf, offsets = shingles(batch.column("text"))
            draws = draw(runs, tf * shared.value.of(runs), offsets, tables)
            words = np.diff(offsets) > 0
            marks = draws.view(np.uint32).astype(U).reshape(len(draws), BANDS, ROWS)
            bands = np.zeros((len(draws), BANDS), U)
            with np.errstate(over="ignore"):
                for i in range(ROWS):
                    bands = T.mix(bands * T.M3 + marks[:, :, i] + U(i))
                bands = T.mix(bands + np.arange(BANDS, dtype=U)).view(np.int64)
            short = (T.mix(draws.view(np.uint32).astype(U)) >> U(48)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h1"), batch.column("h2"), pc.binary_length(batch.column("text")).cast(pa.int64()), pa.array([x.tobytes() for x in short], pa.binary()), pa.array([x if w else [] for x, w in zip(bands, words, strict=True)], pa.list_(pa.int64()))],
                ["doc_id", "h1", "h2", "size", "draws", "bands"],
            )

    return hashed(docs).mapInArrow(sign, "doc_id long, h1 long, h2 long, size long, draws binary, bands array<long>")


def hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(SEED), text).alias("h2"))


def candidates(reps: DataFrame) -> DataFrame:
    """Distinct pairs (node, anchor) of representatives; reps: node, bands."""
    held = reps.select("node", F.explode("bands").alias("bucket"))
    sizes = held.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    popular = held.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("popularity"))
    other = lambda i, step: F.get(F.col("bands"), F.pmod(i + step, F.lit(BANDS)))
    keyed = lambda key, by_chance: F.struct(key.alias("key"), F.lit(by_chance).alias("by_chance"))
    keys = F.flatten(F.transform("bands", lambda x, i: F.array(keyed(x, False), keyed(F.xxhash64(x, other(i, 1)), False), keyed(F.xxhash64(x, other(i, 3), F.lit(SEED)), True))))
    rows = reps.join(popular, "node").select("node", "popularity", F.explode(keys).alias("k")).select(
        "node", "k.key",
        F.when(F.col("k.by_chance"), F.pmod(F.xxhash64("node", "k.key"), F.lit(1 << 31))).otherwise(F.col("popularity")).alias("rank")
    )
    top = rows.groupBy("key").agg(F.max(F.struct("rank", (-F.col("node")).alias("last"), "node"))["node"].alias("anchor"), F.count("*").alias("n")).where("n > 1")
    return rows.join(top, "key").where("node <> anchor").select(F.greatest("node", "anchor").alias("node"), F.least("node", "anchor").alias("anchor")).distinct()


def likely(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose draws agree often enough; reps: node, draws."""
    least = (similarity - SLACK) * BANDS * ROWS

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("draws", "anchor_draws"))
                yield batch.select(["node", "anchor"]).filter(pa.array((a == b).sum(axis=1) >= least))

    of_anchor = reps.select(F.col("node").alias("anchor"), F.col("draws").alias("anchor_draws"))
    return pairs.join(reps.select("node", "draws"), "node").join(of_anchor, "anchor").mapInArrow(keep, "node long, anchor long")


def similarity_of(a: tuple, b: tuple) -> float:
    """Weighted Jaccard of two sorted lists of shingles with weights."""
    both = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    x, y = a[1][both[1]], b[1][both[2]]
    least = float(np.minimum(x, y).sum())
    most = float(a[1].sum()) + float(b[1].sum()) - least
    return least / most if most else 0.0


def verified(pairs: DataFrame, texts: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """The pairs (a, b) of at least the similarity; texts: node, text for each node of a pair.

    Ends of pairs fetch their texts in one join, then meet by pair.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(weights)
    ends = pairs.select("node", "anchor", F.explode(F.array("node", "anchor")).alias("end"))
    with_text = ends.join(texts.withColumnRenamed("node", "end"), "end")
    met = with_text.groupBy("node", "anchor").agg(
        F.max(F.when(F.col("end") == F.col("node"), F.col("text"))).alias("a"),
        F.max(F.when(F.col("end") == F.col("anchor"), F.col("text"))).alias("b")
    )

    def check(batches):
        for batch in batches:
            for part in T.batches_of([batch], rows=256, size=1 << 20, column="a"):
                lists = []
                for column in ("a", "b"):
                    runs, tf, offsets = shingles(part.column(column))
                    w = (tf * shared.value.of(runs)).astype(np.float64)
                    lists.append([(runs[i:j], w[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)])
                yes = [similarity_of(x, y) >= similarity for x, y in zip(*lists, strict=True)]
                yield part.select(["node", "anchor"]).filter(pa.array(yes, pa.bool_()))

    return met.mapInArrow(check, "node long, anchor long").select(F.col("node").alias("a"), F.col("anchor").alias("b"))


def unsettled(rooted: DataFrame) -> DataFrame:
    """node, root, size, band, key, main, main_n, main_bytes, n and bytes for each member of a bucket with more than one class.

    rooted: node, root, size, bands. main tells the members of the largest class; n and bytes are of the others,
    main_n and main_bytes of that class.
    """
    held = rooted.select("node", "root", F.greatest("size", F.lit(1024)).alias("size"), F.posexplode("bands").alias("band", "key"))
    mixed = stored(held.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"), "mixed")
    held = stored(held.join(mixed, "key"), "unsettled")
    sides = held.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    sides = sides.groupBy("key").agg(F.max(F.struct("n", "bytes", "root")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    sides = stored(
        sides.select(
            "key", (F.col("n") - F.col("top.n")).alias("n"), (F.col("bytes") - F.col("top.bytes")).alias("bytes"), F.col("top.n").alias("main_n"),
            F.col("top.bytes").alias("main_bytes"), F.col("top.root").alias("main_root")
        ),
        "sides"
    )
    return held.join(sides, "key").withColumn("main", F.col("root") == F.col("main_root")).drop("main_root")


def block_partners(group: pa.Table, least: float) -> dict[int, list[int]]:
    """Of the blocks of a bin, each node's partners: of another class, with enough equal draws.

    A pair counts only in the bucket of the first band that it shares.
    """
    key, i, j, c, band, node, root = (group.column(x).to_numpy() for x in ("key", "i", "j", "c", "band", "node", "root"))
    draws = np.frombuffer(b"".join(group.column("draws").to_pylist()), np.uint16).reshape(len(node), -1)
    bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    order = np.lexsort((c, j, i, key))
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (key, i, j)], axis=0)
    found: dict[int, list[int]] = {}
    for rows in np.split(order, np.flatnonzero(new)[1:]):
        whole = i[rows[0]] == j[rows[0]]
        left = rows if whole else rows[c[rows] == i[rows[0]]]
        for k, x in enumerate(left):
            rest = rows[k + 1 :] if whole else rows[len(left) :]
            rest = rest[root[rest] != root[x]]
            rest = rest[(draws[rest] == draws[x]).sum(axis=1) >= least]
            if not len(rest):
                continue
            own = (bands[rest] == bands[x]).argmax(axis=1) == band[x]
            for y in node[rest[own]].tolist():
                found.setdefault(int(node[x]), []).append(y)
                found.setdefault(y, [])
    return found


def more_links(rooted: DataFrame, texts_of, weights: Weights, similarity: float, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) of the roots of classes that share a bucket. rooted: node, root, size, draws, bands;
    texts_of(nodes): node, text, once or more."""
    spark = rooted.sparkSession
    least = (similarity - SLACK) * BANDS * ROWS
    shared = spark.sparkContext.broadcast(weights)
    chunks = lambda n, octets: F.greatest(F.ceil(F.col(n) / chunk), F.ceil(F.col(octets) / CHUNK_BYTES)).cast("int")
    members = unsettled(rooted.select("node", "root", "size", "bands")).withColumns({"mains": chunks("main_n", "main_bytes"), "others": chunks("n", "bytes")})
    # the largest class has the first chunks, which meet only those of the others
    place = lambda of: F.pmod(F.xxhash64("node", "key"), of).cast("int")
    members = members.withColumn("c", F.when(F.col("main"), place(F.col("mains"))).otherwise(F.col("mains") + place(F.col("others"))))
    met = F.sequence(F.when(F.col("main"), F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("others") - 1)
    dealt = members.select("key", "band", "node", "root", "size", "c", F.explode(met).alias("d"))
    dealt = stored(dealt.select("key", "band", "node", "root", "size", "c", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j")), "blocks")
    octets = dealt.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bins = max(1, math.ceil(octets / BIN_BYTES), min(2 * spark.sparkContext.defaultParallelism, math.ceil(octets / (1 << 20))))

    def partners(group: pa.Table) -> pa.Table:
        found = block_partners(group, least)
        return pa.table(
            {
                "bin": pa.array([group.column("bin")[0].as_py()] * len(found), pa.int32()), "node": pa.array(list(found), pa.int64()),
                "partners": pa.array(list(found.values()), pa.list_(pa.int64()))
            }
        )

    def check(group: pa.Table) -> pa.Table:
        lists, nodes, roots = [], group.column("node").to_pylist(), group.column("root").to_pylist()
        joined = {r: r for r in roots}

        def class_of(r: int) -> int:
            while joined[r] != r:
                joined[r] = joined[joined[r]]
                r = joined[r]
            return r

        for batch in T.batches_of(group.to_batches(), rows=256, size=1 << 20):
            runs, tf, offsets = shingles(batch.column("text"))
            w = (tf * shared.value.of(runs)).astype(np.float64)
            lists += [(runs[x:y], w[x:y]) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
        sums, at = [float(w.sum()) for _, w in lists], {n: k for k, n in enumerate(nodes)}
        pairs = []
        for k, others in enumerate(group.column("partners").to_pylist()):
            for n in others:
                y = at[n]
                one, other = class_of(roots[k]), class_of(roots[y])
                # the similarity is at most the ratio of the sums
                if one != other and min(sums[k], sums[y]) >= similarity * max(sums[k], sums[y]) * (1 - 1e-9) and similarity_of(lists[k], lists[y]) >= similarity:
                    joined[one] = other
                    pairs.append((roots[k], roots[y]))
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})

    blocks = dealt.withColumn("bin", F.pmod(F.xxhash64("key", "i", "j"), F.lit(bins)).cast("int")).join(rooted.select("node", "draws", "bands"), "node")
    near = stored(blocks.groupBy("bin").applyInArrow(partners, "bin int, node long, partners array<long>"), "partners")
    texts = texts_of(near.select("node").distinct()).dropDuplicates(["node"])  # of repeated rows any one
    return near.join(texts, "node").join(rooted.select("node", "root"), "node").groupBy("bin").applyInArrow(check, "a long, b long")


def classes_of(docs: DataFrame, similarity: float = SIMILARITY, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, node (a hash of the text), root (the class) and class_id for every row."""
    weights = weights_of(docs, frequent)
    signed = stored(signatures(docs, weights), "draws")
    # a representative for each text: the copy with the smallest id
    reps = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("draws").alias("draws"), F.first("bands").alias("bands"))
    all_reps = stored(reps.withColumn("node", F.xxhash64("h1", "h2")).drop("h1", "h2"), "texts")
    reps = all_reps.where(F.size("bands") > 0)
    pairs = stored(likely(candidates(reps), reps, similarity), "pairs")
    keyed = hashed(docs).select("doc_id", "text", F.xxhash64("h1", "h2").alias("node"))

    def texts_of(nodes: DataFrame) -> DataFrame:
        first = reps.select("node", F.col("doc_id").alias("rep")).join(nodes, "node")
        return keyed.join(first, (keyed["node"] == first["node"]) & keyed["doc_id"].eqNullSafe(first["rep"])).select(keyed["node"], "text")

    links = verified(pairs, texts_of(pairs.select(F.explode(F.array("node", "anchor")).alias("node")).distinct()), weights, similarity)
    roots = components(links)
    rooted = stored(reps.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "size", "draws", "bands"), "rooted")
    merged = components(more_links(rooted, texts_of, weights, similarity)).select(F.col("node").alias("root"), F.col("root").alias("final"))
    # written, so that joins with rows are of two plain shuffles, of which a hot text or class can be split
    final = stored(rooted.select("node", "root").join(merged, "root", "left").select("node", F.coalesce("final", "root").alias("root")), "roots")
    classes = stored(all_reps.select("node", "doc_id").join(final, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")), "classes")
    least = stored(classes.groupBy("root").agg(F.min("doc_id").alias("class_id")), "least")
    classes = stored(classes.join(least, "root").select("node", "root", "class_id"), "classes")
    return signed.select("doc_id", F.xxhash64("h1", "h2").alias("node")).join(classes, "node").select("doc_id", "node", "root", "class_id")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id for every row."""
    return classes_of(docs, similarity).select("doc_id", "class_id")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class: that of the smallest id (rows without one come last), then of the least hash of its text.

    Of rows with the same id and text, any one stays; they are looked at only if there are some.
    """
    found = stored(classes_of(docs, similarity).select("root", "doc_id", "node"), "found")
    rows = stored(found.groupBy("root", "doc_id", "node").agg(F.count("*").alias("n")), "rows")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    stays = stored(rows.groupBy("root").agg(F.min(rank).alias("stay")), "stays")
    others = rows.join(stays, "root").where(rank != F.col("stay")).select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"))
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(whole, F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.xxhash64(text), F.xxhash64(F.lit(SEED), text)).alias("key"))
    same = lambda d: (keyed["key"] == d["_node"]) & keyed["id"].eqNullSafe(d["_id"])
    kept = keyed.join(others, same(others), "left_anti")
    again = rows.where("n > 1").select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"))
    if again.isEmpty():
        return kept.select("row.*")
    marked = stored(kept.join(again.withColumn("again", F.lit(True)), same(again), "left").select("row", "id", "key", "again"), "kept")
    return marked.where("again IS NULL").select("row.*").unionByName(marked.where("again").dropDuplicates(["id", "key"]).select("row.*"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
