"""Language-model scoring with a weighted backoff automaton of trigrams.

Probabilities are smoothed towards the next lower order:

    p(w)       = (c(w) + 1) / (N + V + 1)
    p(w | v)   = (c(v w) + s1 p(w)) / (c(v) + s1)
    p(w | u v) = (c(u v w) + s2 p(w | v)) / (c(u v) + s2)

As an automaton: the root, each word and each pair of words that occurred are states. A state
has an arc for each w that followed it, of weight log p(w | state), which leads to the longest
suffix that is a state; and a failure arc of weight log(s / (c(state) + s)) to the state of its
last word, or to the root, which has an arc of weight log p(w) for each word. A text is read left
to right: at each token it takes failure arcs until there is an arc, adds up the weights, and
carries the state on. A text begins in the state of the start.

No task sees the whole model. Documents are dealt to blocks of bounded size by a hash.
A block lists its distinct n-grams with their counts in its own training documents;
lists of all blocks meet by ranges of the n-gram's hash, where counts are added up; and
a block gets back what other blocks have of its n-grams. With that and
its own counts it builds the part of the automaton that its texts can reach.
Lists travel as sorted, delta-coded arrays, answers as arrays in the order of the lists.
With more than ``FAN`` blocks, lists are first merged over groups of FAN blocks, and answers
come back the same way, so that no group reads more than FAN lists and no list is cut
finer than its size allows: a very common n-gram is summed up level by level.

Keys of words have 62 bits of a hash. Keys of pairs and triples have 20 bits more than it takes to
number the tokens, so one in a million of them, at any size, has the count of another added.

Defined results: a null text is empty (one token, the end); a null doc_id counts as the
empty text for crc32, so it is learned from; repeated rows each get a row, and are dealt to
blocks by input partition; an empty table gives an empty result; extra columns are left out; a
text longer than a block is a block mostly of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbuf as T
from .common import stored, table

BLOCK_BYTES = 12 << 20
#: Blocks are not made smaller than this to occupy more cores.
LEAST_BYTES = 1 << 20
#: A range of hashes has about as many n-grams as this many bytes of text.
RANGE_BYTES = 4 << 20
#: So many lists meet in a group at most.
FAN = 4096
#: Of words after a word, and after two: how much the lower order counts. Best or near it on held-out texts of the driver's tables.
STRENGTHS = (300.0, 10.0)
#: Bits of a key beyond those that number the tokens.
SPARE_BITS = 20
#: A task that lists its words holds about so many.
WORDS = 1 << 22
#: Tokens scored at once.
SLICE = 1 << 18
U = T.U
END, START = U(0x5851F42D4C957F2C), U(0x14057B7EF767814E)
LISTS = "range int, block int, kind int, keys binary, counts binary"
ANSWERS = "block int, range int, kind int, more binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def schema_of(ddl: str) -> pa.Schema:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([(name, types[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


def planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes first, so that those of no use compress away."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def pack(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as the first one and the differences, four bits at a time, all lowest ones first; two to a byte."""
    steps = np.diff(keys)
    nibbles = (int(steps.max()).bit_length() + 3) // 4 if len(steps) else 0
    steps = np.append(steps, U(0)) if len(steps) % 2 else steps
    low, high = steps[0::2], steps[1::2]
    parts = [(((low >> U(4 * k)) & U(15)) | (((high >> U(4 * k)) & U(15)) << U(4))).astype(np.uint8).tobytes() for k in range(nibbles)]
    return b"".join([keys[:1].tobytes(), *parts]), planes(counts.astype(U))


def unpack(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = from_planes(counts, np.int64)
    half = len(numbers) // 2
    steps = np.zeros(2 * half + 1, U)
    steps[:1] = np.frombuffer(keys[:8], U)
    for k, at in enumerate(range(8, len(keys), max(half, 1))):
        part = np.frombuffer(keys, np.uint8, half, at).astype(U)
        steps[1::2] |= (part & U(15)) << U(4 * k)
        steps[2::2] |= (part >> U(4)) << U(4 * k)
    return np.cumsum(steps[: len(numbers)]), numbers


def with_ends(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens, an end after the words of each text, and the offsets by text."""
    hashes, offsets = T.hash_words(texts, lower=True)
    offsets = offsets + np.arange(len(offsets))
    tokens, is_word = np.empty(offsets[-1], U), np.ones(offsets[-1], bool)
    is_word[offsets[1:] - 1] = False
    tokens[is_word] = hashes
    tokens[offsets[1:] - 1] = END
    return tokens, offsets


def unigrams(hashes: np.ndarray) -> np.ndarray:
    return hashes & ~U(3)


def follow(context: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes of contexts with a token after them."""
    with np.errstate(over="ignore"):
        return T.mix(context * T.M3 + hashes)


def ngrams(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of width bits: odd ones of each token and the one before or the start, and, but for first tokens, even ones
    of each token and the two before. The second result is where the even ones belong."""
    first = offsets[:-1]
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[first] = START
    pairs = follow(before, hashes)
    deep = np.ones(len(hashes), bool)
    deep[first] = False
    deep = np.flatnonzero(deep)
    triples = follow(pairs[deep - 1], hashes[deep])
    spare = U(64 - width)
    return np.concatenate([(pairs >> spare) | U(1), (triples >> spare) & ~U(1)]), deep


def counted(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how many of each are to be learned, and the place of each token's key. Spends keys: they are sorted in place."""
    order = np.argsort(keys)
    keys[:] = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new)
    distinct = keys[starts]
    counts = np.add.reduceat(learn[order], starts, dtype=np.int64) if len(keys) else np.zeros(0, np.int64)
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return distinct, counts, place


class Automaton:
    """The part that the texts of a block can reach.

    States are numbered: the root, the words, the start, the pairs. A state that training
    hasn't seen has no arcs and a failure arc that costs nothing.
    """

    def __init__(self, words: np.ndarray, grams: np.ndarray, size: dict, strengths: tuple):
        """words, grams: the counts behind the arcs, by place."""
        self.words, self.grams, self.strengths = words, grams, strengths
        self.root = np.log10((words + 1.0) / (size["tokens"] + size["types"] + 1.0))  # the root's arcs, by word
        self.start = len(words) + 1
        low, high = strengths
        seen = np.concatenate([words, [size["texts"]]]) + low
        pairs = grams + high
        self.total = np.concatenate([[1.0], seen, pairs])
        self.failure = np.concatenate([[0.0], np.log10(low / seen), np.log10(high / pairs)])

    def pair(self, place: np.ndarray) -> np.ndarray:
        return place + (len(self.words) + 2)

    def traverse(self, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probabilities of each text by the root's arcs alone and by the automaton.

        words, pairs, triples: places of each token's keys. The state after a token depends on it and the one before only,
        so all states that a text is carried through are known, and slices of texts are read side by side.
        """
        alone, score = np.empty(len(offsets) - 1), np.empty(len(offsets) - 1)
        first = 0
        while first < len(alone):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
            a, b, starts = offsets[first], offsets[last], offsets[first:last] - offsets[first]
            root, weights = self.read(words[a:b], pairs[a:b], triples[a:b], starts)
            alone[first:last] = np.add.reduceat(root, starts)
            score[first:last] = np.add.reduceat(weights, starts)
            first = last
        return alone, score

    def read(self, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token the weight of the root's arc, and the sum of weights from the state before it."""
        root = self.root[words]
        state = np.empty(len(words), np.int64)  # the words before: what the state of a pair fails to
        state[1:] = words[:-1] + np.int64(1)
        state[starts] = self.start
        low, high = self.strengths
        followed = self.grams[pairs]
        arc = np.log10((followed + low * 10.0**root) / self.total[state])
        weight = np.where(followed > 0, arc, self.failure[state] + root)
        deep = np.ones(len(words), bool)
        deep[starts] = False  # the start has no pair before it
        deep = np.flatnonzero(deep)
        state = self.pair(pairs[deep - 1])
        followed, lower = self.grams[triples[deep]], weight[deep]
        arc = np.log10((followed + high * 10.0**lower) / self.total[state])
        weight[deep] = np.where(followed > 0, arc, self.failure[state] + lower)
        return root, weight


def edges_of(keys: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Where each of 2^bits equal ranges of keys of width bits begins, the end included."""
    return np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=U) << U(width - bits)), len(keys))


def by_range(keys: np.ndarray, counts: np.ndarray, width: int, bits: int) -> list[tuple[int, bytes, bytes]]:
    """Sorted keys and their counts, packed by ranges."""
    edges = edges_of(keys, width, bits)
    return [(int(r), *pack(keys[edges[r] : edges[r + 1]], counts[edges[r] : edges[r + 1]])) for r in np.flatnonzero(np.diff(edges))]


def widths(width: int) -> tuple[int, int]:
    """Of keys by kind: words, and pairs and triples."""
    return 64, width


def block_keys(texts, train: np.ndarray, width: int):
    """Of both kinds distinct keys, own counts and the places of the tokens; offsets, and which tokens have a triple."""
    hashes, offsets = with_ends(texts)
    learn = np.repeat(train, np.diff(offsets))
    keys, deep = ngrams(hashes, offsets, width)
    return counted(unigrams(hashes), learn), counted(keys, np.concatenate([learn, learn[deep]])), offsets, deep


def block_lists(block: int, texts, train: np.ndarray, width: int, bits: int) -> list[dict]:
    kinds = block_keys(texts, train, width)[:2]
    return [
        {"range": r, "block": block, "kind": k, "keys": a, "counts": b} for k, (keys, counts, _) in enumerate(kinds) for r,
        a, b in by_range(keys, counts, widths(width)[k], bits)
    ]


def merged(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their totals, and the place of each list's keys, one list after another."""
    keys, place = np.unique(np.concatenate([k for k, _ in lists]), return_inverse=True)
    totals = np.zeros(len(keys), np.int64)
    np.add.at(totals, place, np.concatenate([c for _, c in lists]))
    return keys, totals, place


def by_kind(group: pa.Table):
    """The kinds in a group of lists: kind, blocks and unpacked lists."""
    rows = list(zip(*(group.column(c).to_pylist() for c in ("kind", "block", "keys", "counts")), strict=True))
    for kind in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == kind]
        yield kind, [r[1] for r in own], [unpack(*r[2:]) for r in own]


def answers(group: pa.Table, beyond: dict | None = None) -> pa.Table:
    """For each list of a group of one range what the others of the group have of its keys, and beyond:
    by kind what other groups have, in the order of the group's distinct keys."""
    place_of_range, out = group.column("range")[0].as_py() if len(group) else 0, []
    for kind, blocks, lists in by_kind(group):
        _, totals, place = merged(lists)
        if beyond and kind in beyond:
            totals = totals + beyond[kind]
        at = 0
        for block, (keys, counts) in zip(blocks, lists, strict=True):
            more = totals[place[at : at + len(keys)]] - counts
            at += len(keys)
            if more.any():
                out.append({"block": block, "range": place_of_range, "kind": kind, "more": planes(more)})
    return pa.Table.from_pylist(out, schema_of(ANSWERS))


def exchange(lists: DataFrame, blocks: int, width: int, bits: int, top: int, fan: int) -> DataFrame:
    """ANSWERS for LISTS, whose ranges have the given bits; at the top they have ``top`` bits."""
    if blocks <= fan:
        return lists.repartition(1 << bits, "range").groupBy("range").applyInArrow(lambda group: answers(group), ANSWERS)
    groups = -(-blocks // fan)
    finer = top if groups <= fan else min(top, bits + (fan - 1).bit_length())
    lists = stored(lists.withColumn("group", F.floor(F.col("block") / fan).cast("int")), "lists")
    parts = min(groups << bits, 1 << 20)

    def merge(group: pa.Table) -> pa.Table:
        out = []
        for kind, _, parts_of in by_kind(group):
            keys, totals, _ = merged(parts_of)
            out += [{"range": r, "block": group.column("group")[0].as_py(), "kind": kind, "keys": a, "counts": b} for r, a, b in by_range(keys, totals, widths(width)[kind], finer)]
        return pa.Table.from_pylist(out, schema_of(LISTS))

    def down(group: pa.Table, got: pa.Table) -> pa.Table:
        beyond: dict = {}
        answered = {(k, r): m for k, r, m in zip(*(got.column(c).to_pylist() for c in ("kind", "range", "more")), strict=True)}
        for kind, _, parts_of in by_kind(group):
            keys = merged(parts_of)[0]
            edges = edges_of(keys, widths(width)[kind], finer)
            beyond[kind] = np.zeros(len(keys), np.int64)
            for r in np.flatnonzero(np.diff(edges)).tolist():
                if (kind, r) in answered:
                    beyond[kind][edges[r] : edges[r + 1]] = from_planes(answered[kind, r], np.int64)
        return answers(group, beyond)

    dealt = lists.repartition(parts, "range", "group")
    up = dealt.groupBy("range", "group").applyInArrow(merge, LISTS)
    got = exchange(up, groups, width, finer, top, fan)
    got = got.select(F.shiftright("range", finer - bits).alias("coarse"), F.col("block").alias("group"), "range", "kind", "more").repartition(parts, "coarse", "group")
    return dealt.groupBy("range", "group").cogroup(got.groupBy("coarse", "group")).applyInArrow(down, ANSWERS)


def score_block(texts, train: np.ndarray, got: list[tuple[int, int, bytes]], size: dict, strengths: tuple, width: int, bits: int) -> dict:
    """got: kind, range and answer."""
    words, grams, offsets, deep = block_keys(texts, train, width)
    for kind, (keys, counts, _) in enumerate((words, grams)):
        edges = edges_of(keys, widths(width)[kind], bits)
        for _, r, more in (x for x in got if x[0] == kind):
            counts[edges[r] : edges[r + 1]] += from_planes(more, np.int64)
    model = Automaton(words[1], grams[1], size, strengths)
    n = int(offsets[-1])
    triples = np.zeros(n, np.int32)
    triples[deep] = grams[2][n:]
    known = np.add.reduceat((words[1] > 0)[words[2]], offsets[:-1], dtype=np.int64)
    alone, score = model.traverse(words[2], grams[2][:n], triples, offsets)
    return {"n_tokens": np.diff(offsets), "n_known": known, "base_score": alone, "score": score}


def corpus_size(docs: DataFrame, bits: int) -> dict:
    """Training texts, tokens and distinct tokens; docs: text, train. Each task lists its words before they are dealt out."""

    schema = pa.schema([("range", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def listed(parts: list) -> pa.RecordBatch:
        keys, n, _ = merged(parts)
        return pa.RecordBatch.from_pylist([{"range": r, "keys": a, "counts": b} for r, a, b in by_range(keys, n, 64, bits)], schema)

    def count(batches):
        parts, held = [], 0
        for batch in T.batches_of(batches, rows=1 << 20, size=16 << 20):
            hashes, _ = with_ends(batch.filter(batch.column("train")).column("text"))
            parts.append(np.unique(unigrams(hashes), return_counts=True))
            held += len(parts[-1][0])
            if held > WORDS:
                parts = [merged(parts)[:2]]
                held = len(parts[0][0])
            if held > WORDS // 2 and len(parts) == 1:  # of these many words most are distinct
                yield listed(parts)
                parts, held = [], 0
        if held:
            yield listed(parts)

    def add(group: pa.Table) -> pa.Table:
        keys, n, _ = merged([unpack(*x) for x in zip(group.column("keys").to_pylist(), group.column("counts").to_pylist(), strict=True)])
        return pa.table({"types": [len(keys)], "tokens": [int(n.sum())], "texts": [int(n[keys == (END & ~U(3))].sum())]})

    lists = docs.select("text", "train").mapInArrow(count, "range int, keys binary, counts binary")
    sums = lists.groupBy("range").applyInArrow(add, "types long, tokens long, texts long")
    return sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "tokens", "texts")]).first().asDict()


def lm_scores(docs: DataFrame, held_out, strengths: tuple = STRENGTHS, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """Scores every row of docs (doc_id, text); held_out: a boolean column, true for those not to learn from."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~held_out).alias("train"))
    octets = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # blocks of bounded size, and of small inputs enough for all cores
    slots = 2 * docs.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(octets / block_bytes), min(slots, math.ceil(octets / LEAST_BYTES)))
    top = math.ceil(octets / range_bytes).bit_length()
    bits = top if blocks <= fan else min(top, (fan - 1).bit_length())
    size = corpus_size(keyed, min(bits, 10))
    width = min(62, (octets + 1).bit_length() + SPARE_BITS)
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).cast("int")).repartition(2 * blocks, "block")

    def lists(group: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(block_lists(group.column("block")[0].as_py(), group.column("text"), group.column("train").to_numpy(), width, bits), schema_of(LISTS))

    def scores(group: pa.Table, got: pa.Table) -> pa.Table:
        train = group.column("train").to_numpy()
        if not len(train):
            return pa.Table.from_pylist([], schema_of(SCORES))
        rows = list(zip(*(got.column(c).to_pylist() for c in ("kind", "range", "more")), strict=True))
        found = score_block(group.column("text"), train, rows, size, strengths, width, bits)
        pa.default_memory_pool().release_unused()
        return pa.table({"doc_id": group.column("doc_id"), "held_out": ~train} | found)

    shared = exchange(keyed.groupBy("block").applyInArrow(lists, LISTS), blocks, width, bits, top, fan).repartition(2 * blocks, "block")
    out = keyed.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(scores, SCORES)
    return out.withColumn("train_tokens", F.lit(size["tokens"]).cast("long"))


def held_out_by(doc_id, modulus: int = 7, remainder: int = 2):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = lm_scores(docs, held_out_by(F.col("doc_id")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
