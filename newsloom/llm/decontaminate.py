"""Benchmark decontamination by q-gram lemma filtering.

A text within k edits of a benchmark item of m bytes shares at least m - q + 1 - k q of its
q-grams with it, on diagonals (place in the text less place in the item) that lie within
k of each other. So for each text and item the shared q-grams are counted in overlapping
bands of 2 (k + 1) diagonals, one beginning every k + 1, and bands with enough are verified
by an alignment within the band. k is ``budget`` of the item's length, less where the item is
too short for the lemma to ask for a q-gram at all.

Texts are compared as bytes of UTF-8, with A-Z in lower case and any white space as a space;
lengths and edits are counted in bytes too, so changing an accented letter may take two.
The benchmark is written to the shared folder in blocks of bounded size. One map over the
documents, without a shuffle, takes bounded groups of texts through all blocks, one
index at a time; a worker keeps its last index. Neither the driver nor a task holds more of the
benchmark than a block. Only whole items count, not parts of them.

A q-gram of very many items would multiply the work: those with more than ``COMMON`` places in a
block are left out of the count for items that need fewer shared q-grams then but still one,
which loses no match, as the lemma's number goes down by as many as are left out.

Defined results: a null or empty text, and a null or empty item, match nothing; an item of
fewer than q bytes must occur exactly; null ids are carried as null; repeated documents and
repeated items each get their rows; an empty table gives an empty result; extra columns pass
through marked(), a column of the name ``leaks`` is replaced. Several matches of an item in
a text are told apart if they don't overlap.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbuf as T
from .common import shared_path, table
from .warc import filesystem

Q = 9
BUDGET = 0.09
BLOCK_BYTES = 4 << 20
TABLE_BITS = 21
#: Q-grams with more places in a block are common.
COMMON = 64
#: So many bytes of text at a time go through the blocks, if there are several; hits are told apart in runs of so many.
GROUP_BYTES = 64 << 20
HITS = 1 << 22
U = T.U
FOLD = np.where(T.IS_SPACE, np.uint8(32), T.LOWER).astype(np.uint8)
LEAK = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
LEAKS_DDL = "array<struct<item_id: bigint, start: bigint, end: bigint, edits: int>>"


def fold(text: str | None) -> np.ndarray:
    return FOLD[np.frombuffer((text or "").encode(), np.uint8)]


def qgrams(data: np.ndarray) -> np.ndarray:
    """A hash of each run of Q bytes: of its first eight and its last eight."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, U)
    data = np.ascontiguousarray(data)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        keys = eight[:n] * T.M1
        keys += eight[Q - 8 :] * T.M2
    return keys


class Index:
    """The q-grams of a block of items: sorted, each with the items and places it has, behind a table of bits."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        self.items = [fold(t) for _, t in items]
        self.size = np.array([len(t) for t in self.items], np.int64)
        self.edits = np.clip(np.minimum((BUDGET * self.size).astype(np.int64), (self.size - Q) // Q), 0, None)
        self.needed = self.size - Q + 1 - self.edits * Q
        self.short = [i for i, n in enumerate(self.size) if 0 < n < Q]
        grams = [qgrams(t) for t in self.items]
        keys = np.concatenate([np.zeros(0, U), *grams])
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in grams]])
        _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
        common = count[which] > COMMON
        left_out = np.bincount(item[common], minlength=len(items))
        spared = self.needed > left_out  # items that can do without their common q-grams
        self.needed = self.needed - np.where(spared, left_out, 0)
        stays = ~(common & spared[item]) if len(item) else np.zeros(0, bool)
        keys, item, place = keys[stays], item[stays], place[stays]
        order = np.argsort(keys, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << TABLE_BITS, bool)
        self.bits[self.keys >> U(64 - TABLE_BITS)] = True

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in data with a q-gram of the items, and which."""
        keys = qgrams(data)
        at = np.flatnonzero(self.bits[(keys >> U(64 - TABLE_BITS)).view(np.int64)])
        found = keys[at]
        which = np.searchsorted(self.keys, found).clip(max=max(len(self.keys) - 1, 0))
        same = self.keys[which] == found if len(self.keys) else np.zeros(len(at), bool)
        return at[same], which[same]

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Text, item and first diagonal of the bands that have enough of the item's q-grams, in runs of about HITS hits of whole texts."""
        at, which = self.hits(data)
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + Q <= offsets[text + 1]
        at, which, text = at[inside], which[inside], text[inside]
        if not len(at):
            return
        run = np.cumsum(self.count[which]) // HITS
        ends = np.searchsorted(text, text[np.flatnonzero(np.diff(run))], "right")  # a run ends with a text
        edges = np.unique(np.concatenate([[0], ends, [len(at)]]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield self.bands(at[a:b], which[a:b], text[a:b], offsets)

    def bands(self, at: np.ndarray, which: np.ndarray, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.count[which]
        pick = np.repeat(self.first[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        item, place, text, at = self.item[pick], self.place[pick], np.repeat(text, n), np.repeat(at, n)
        stride = self.edits[item] + 1
        diagonal = at - offsets[text] - place
        band = diagonal // stride
        # each hit counts in the band that begins at its stride and in the one before
        text, item, place, band = np.tile(text, 2), np.tile(item, 2), np.tile(place, 2), np.concatenate([band, band - 1])
        order = np.lexsort((place, band, item, text))
        text, item, place, band = text[order], item[order], place[order], band[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
        distinct = new.copy()
        distinct[1:] |= place[1:] != place[:-1]
        starts = np.flatnonzero(new)
        enough = np.add.reduceat(distinct.astype(np.int64), starts) >= self.needed[item[starts]]
        keep = starts[enough]
        return text[keep], item[keep], band[keep] * (self.edits[item[keep]] + 1)


def banded(item: np.ndarray, text: np.ndarray, low: int, width: int, free: bool) -> np.ndarray:
    """Edit distances of the item to pieces of the text, by the diagonal where they end.

    Column j of the band is the diagonal low + j. free: a piece may begin on any diagonal;
    else it begins at place 0.
    """
    steps = np.arange(width)
    row = np.zeros(width, np.int64) if free else np.where(steps + low < 0, 1 << 40, steps + low)
    padded = np.full(len(item) + width + 1, -1, np.int64)
    a, b = max(low, 0), min(low + len(item) + width, len(text))
    if b > a:
        padded[a - low : b - low] = text[a:b]
    for i, byte in enumerate(item):
        step = row + (padded[i : i + width] != byte)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - steps) + steps
    return row


def verify(item: np.ndarray, text: np.ndarray, low: int, edits: int) -> tuple[int, int, int] | None:
    """Start, end and edits of the best match of the item in a band of diagonals, if within the edits."""
    width = 2 * (edits + 1)
    begin, end = max(0, low - edits), min(len(text), low + width + len(item) + edits)
    exact = text[begin:end].tobytes().find(item.tobytes())
    if exact >= 0:
        return begin + exact, begin + exact + len(item), 0
    if not edits:
        return None
    row = banded(item, text, low - edits, width + 2 * edits, True)
    best = int(row.min())
    if best > edits:
        return None
    stop = min(len(text), int(np.flatnonzero(row == best)[0]) + low - edits + len(item))
    back = banded(item[::-1], text[:stop][::-1], -edits, 2 * edits + 1, False)  # backwards from the end
    return max(0, stop - len(item) - int(back.argmin()) + edits), stop, best


def find_leaks(texts, index: Index) -> list[list[dict]]:
    """The leaks of each text, by place; places in code points."""
    data, offsets = T.buffers(texts)
    data = FOLD[data]
    found: list[list[tuple]] = [[] for _ in range(len(offsets) - 1)]
    for bands in index.candidates(data, offsets):
        for text, item, low in zip(*bands, strict=True):
            own = data[offsets[text] : offsets[text + 1]]
            if match := verify(index.items[item], own, int(low), int(index.edits[item])):
                found[text].append((item, *match))
    for item in index.short:
        needle = index.items[item].tobytes()
        for text in range(len(found)):
            own, at = data[offsets[text] : offsets[text + 1]].tobytes(), -len(needle)
            while (at := own.find(needle, at + len(needle))) >= 0:
                found[text].append((item, at, at + len(needle), 0))
    out = []
    for text, leaks in enumerate(found):
        kept: list[tuple] = []
        for leak in sorted(leaks, key=lambda x: (x[0], x[3], x[1])):
            if all(leak[0] != x[0] or leak[1] >= x[2] or leak[2] <= x[1] for x in kept):
                kept.append(leak)
        if kept:
            lead = np.cumsum((data[offsets[text] : offsets[text + 1]] & 0xC0) != 0x80)
            points = lambda at, lead=lead: int(lead[at - 1]) if at else 0
        out.append([{"item_id": index.ids[i], "start": points(a), "end": points(b), "edits": e} for i, a, b, e in sorted(kept, key=lambda x: (x[1], x[0]))])
    return out


def write_blocks(benchmark: DataFrame, block_bytes: int) -> tuple[str, int]:
    """Writes the items that have a text in blocks of about block_bytes each; the folder and how many."""
    items = benchmark.where("length(text) > 0").select(F.col("item_id").cast("long").alias("item_id"), "text")
    octets = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = math.ceil(octets / block_bytes)
    path = shared_path(benchmark.sparkSession, "benchmark")
    if blocks:
        # dealt out in turn, so that repeated items spread as well
        dealt = items.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int"))
        dealt.repartition(min(blocks, 200), "block").write.partitionBy("block").parquet(path)
    return path, blocks


@functools.lru_cache(1)
def index_of(path: str, block: int) -> Index:
    """The index of a block; a worker keeps the last."""
    import pyarrow.dataset as dataset

    system, root = filesystem(f"{path}/block={block}")
    rows = dataset.dataset(root, filesystem=system, format="parquet", partitioning=None).to_table(["item_id", "text"])
    return Index(sorted(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1])))


def grouped(batches, size: int) -> Iterator[list[pa.RecordBatch]]:
    """Record batches in groups of about so many bytes."""
    group, held = [], 0
    for batch in T.batches_of(batches):
        group.append(batch)
        held += batch.nbytes
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def marked(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """docs with leaks: the items found in each text, with their places and edits."""
    path, blocks = write_blocks(benchmark, block_bytes)
    out = docs.drop("leaks").withColumn("leaks", F.array().cast(LEAKS_DDL))
    if not blocks:
        return out

    def mark(batches):
        for group in grouped(batches, group_bytes if blocks > 1 else 0):
            leaks = [[[] for _ in range(batch.num_rows)] for batch in group]
            for block in range(blocks):
                index = index_of(path, block)
                for found, batch in zip(leaks, group, strict=True):
                    for own, more in zip(found, find_leaks(batch.column("text"), index), strict=True):
                        own += more
            for found, batch in zip(leaks, group, strict=True):
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(LEAK))], batch.schema.names)

    return out.mapInArrow(mark, out.schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold an item of the benchmark."""
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return marked(rows, benchmark).where(F.size("leaks") == 0).select("row.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = marked(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return leaks.select("doc_id", "leak.item_id", "leak.start", "leak.end", "leak.edits")
