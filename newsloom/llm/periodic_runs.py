"""Periodic runs: stretches of a text's words that repeat with a period, four times or more.

A run is a stretch of consecutive words whose smallest period is q (words q apart are the same), of
at least ``SHORTEST`` words and ``POWER`` periods, which no neighbouring word extends.

Runs are found in two steps, both within one map over the texts, without a shuffle:

- Words outside of all runs are told by their n-grams: within a run every three words come three
  times at least and every five words twice, so words that no such n-gram covers are left out, and
  again within what is left, until nothing more falls. It's done on hashes of words, of all texts of a batch at once;
  that two words share a hash can only keep more.
- What is left is cut where words were left out. The pieces, joined by separators of which each comes once,
  get Ukkonen's suffix tree, and one of their reversal. The depths between neighbouring leaves on the
  Euler tour, with a sparse table of their minima, answer the longest common extension of
  any two places at once. The longest Lyndon word at each place, in the order of the leaves and in
  that of the reversed alphabet, is a candidate for a root; it's extended in both directions, and it's a run
  if that is long enough. By the runs theorem each run has such a root.

A worker holds one batch of texts and the trees of one group of pieces: some 500 bytes a word of the longest
piece or of ``GROUP`` words.

Defined results: a null or empty text has no words, no runs and an empty ``collapsed``; equal words are
those with equal bytes; repeated rows each get a row; an empty table gives an empty result; extra
columns pass through, and those named ``runs`` or ``collapsed`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import textbuf as T
from .common import table, words

SHORTEST, POWER = 6, 4
#: Words of pieces that share a tree.
GROUP = 1 << 15
#: What every run has of each n-gram in it, by the n-gram's size: the least number of times.
LEAST = {5: 2, 3: 3}
RUN = S.StructType([S.StructField(c, S.LongType()) for c in ("start", "length", "period")])


def tree(s: list[int], symbols: int) -> tuple[dict[int, int], list[int], list[int], list[int]]:
    """Ukkonen's suffix tree of s, whose last symbol comes once; symbols are under ``symbols``.

    Returns the child of node * symbols + first symbol of an edge; where an edge's label starts, and
    ends, by its child; and the suffix of a leaf, -1 for inner nodes, the root among them (0).
    """
    n = len(s)
    child: dict[int, int] = {}
    start, end, link, suffix = [0], [0], [0], [-1]
    node = edge = length = pending = leaves = 0
    for i, c in enumerate(s):
        unlinked = 0
        pending += 1
        while pending:
            if not length:
                edge = i
            key = node * symbols + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                suffix.append(leaves)
                leaves += 1
                if unlinked:
                    link[unlinked] = node
                    unlinked = 0
            else:
                at = start[below]
                long = end[below] - at
                if length >= long:
                    node = below
                    edge += long
                    length -= long
                    continue
                if s[at + length] == c:
                    length += 1
                    if unlinked:
                        link[unlinked] = node
                    break
                inner = len(start)
                child[key] = inner
                start += (at, i)
                end += (at + length, n)
                link += (0, 0)
                suffix += (-1, leaves)
                leaves += 1
                start[below] = at + length
                child[inner * symbols + c] = inner + 1
                child[inner * symbols + s[at + length]] = below
                if unlinked:
                    link[unlinked] = inner
                unlinked = inner
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - pending + 1
    return child, start, end, suffix


def tour(made: tuple, symbols: int, first: int, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in the order of the leaves, and the depth that the Euler tour comes up to before each.

    Symbols under ``first`` come first, the others by number or, backwards, from the largest down.
    """
    child, start, end, suffix = made
    keys, below = np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child))
    parent, symbol = np.divmod(keys, symbols)
    order = np.lexsort((np.where(symbol < first, symbol, 2 * symbols - symbol) if backwards else symbol, parent))
    listed, at = below[order].tolist(), np.searchsorted(parent[order], np.arange(len(start) + 1)).tolist()
    leaves, depths = [], []
    depth = [0] * len(start)
    stack, up = [~x for x in listed[at[0] : at[1]][::-1]], 0
    above = [0] * len(start)
    while stack:
        x = stack.pop()
        if x < 0:  # ~node: not the first child of its parent, which the tour has come up to
            x = ~x
            up = depth[above[x]]
        if suffix[x] >= 0:
            leaves.append(suffix[x])
            depths.append(up)
            continue
        depth[x] = depth[above[x]] + end[x] - start[x]
        own = listed[at[x] : at[x + 1]]
        for y in own:
            above[y] = x
        stack += [~y for y in own[:0:-1]]
        stack.append(own[0])
    return np.array(leaves, np.int64), np.array(depths, np.int32)


class Extensions:
    """Longest common extensions in a text, by the lowest common ancestors of the leaves in its suffix tree."""

    def __init__(self, leaves: np.ndarray, depths: np.ndarray):
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        self.minima = [depths]
        size = 1
        while 2 * size < len(depths):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-size], last[size:]))
            size *= 2

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For different suffixes a[k], b[k]: how many symbols they have in common."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k)])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one of a smaller rank; the end if there is none."""
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank.tolist()):
        while stack and stack[-1][0] > r:
            out[stack.pop()[1]] = i
        stack.append((r, i))
    return np.array(out, np.int64)


def runs_of(pieces: list[list], power: int = POWER, shortest: int = SHORTEST) -> list[tuple[int, int, int, int]]:
    """piece, start, length, period of each run in lists of hashable words, with places counted in the piece."""
    codes: dict = {}
    for piece in pieces:
        for w in piece:
            codes.setdefault(w, len(codes))
    first, text, begins = len(pieces), [], []
    for k, piece in enumerate(pieces):
        begins.append(len(text))
        text += [first + codes[w] for w in piece]
        text.append(k)
    n, symbols = len(text), first + len(codes)
    made = tree(text, symbols)
    leaves, depths = tour(made, symbols, first)
    forward = Extensions(leaves, depths)
    other = np.empty(n, np.int64)
    other[tour(made, symbols, first, True)[0]] = np.arange(n)
    del made
    found = []
    for rank in (forward.rank, other):
        at = np.arange(n)
        period = next_smaller(rank) - at
        fits = at + period < n  # roots before the last separator
        at, period = at[fits], period[fits]
        right = forward.of(at, at + period)
        enough = right >= (power - 2) * period  # the first root of a run begins within its first period
        found.append(np.stack([at[enough], period[enough], right[enough]]))
    at, period, right = np.concatenate(found, axis=1)
    if not len(at):
        return []
    backward = Extensions(*tour(tree(text[-2::-1] + [text[-1]], symbols), symbols, first))
    left, inner = np.zeros(len(at), np.int64), at > 0
    left[inner] = backward.of(n - 1 - at[inner], n - 1 - at[inner] - period[inner])
    start, length = at - left, left + period + right
    good = length >= np.maximum(shortest, power * period)
    edges = np.array(begins)
    piece = np.searchsorted(edges, start[good], "right") - 1
    rows = zip(piece.tolist(), (start[good] - edges[piece]).tolist(), length[good].tolist(), period[good].tolist(), strict=True)
    return sorted(set(rows))


def covered(hashes: np.ndarray, group: np.ndarray, size: int, least: int) -> np.ndarray:
    """Which words lie in an n-gram that its group has ``least`` times or more. group: ascending."""
    n = len(hashes)
    out = np.zeros(n, bool)
    if n < size:
        return out
    acc = T.mix(group[: n - size + 1].astype(T.U))
    with np.errstate(over="ignore"):
        for k in range(size):
            acc = T.mix(acc * T.M3 + hashes[k : n - size + 1 + k])
    places = np.flatnonzero(group[: n - size + 1] == group[size - 1 :])
    order = places[np.argsort(acc[places], kind="stable")]
    if not len(order):
        return out
    new = np.concatenate([[True], acc[order][1:] != acc[order][:-1]])
    counts = np.diff(np.append(np.flatnonzero(new), len(order)))
    often = order[counts[np.cumsum(new) - 1] >= least]
    step = np.zeros(n + 1, np.int32)
    step[often] += 1
    step[often + size] -= 1
    return np.cumsum(step[:-1]) > 0


def pieces_of(hashes: np.ndarray, owner: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Where words lie that may be in runs: starts and ends of stretches, each of one owner."""
    places, group = np.arange(len(hashes)), owner
    while len(places):
        stay = np.ones(len(places), bool)
        for size, least in LEAST.items():
            stay &= covered(hashes[places], group, size, least)
        kept = places[stay]
        parted = np.ones(len(kept), bool)
        parted[1:] = (np.diff(kept) != 1) | (np.diff(owner[kept]) != 0)
        group = np.cumsum(parted)
        sizes = np.bincount(group, minlength=1)
        long = sizes[group] >= shortest
        kept, group = kept[long], group[long]
        if len(kept) == len(places):
            break
        places = kept
    if not len(places):
        return []
    edges = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0, [True]]))
    return [(int(places[a]), int(places[b - 1]) + 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def grouped(pieces: list[tuple[int, int]], most: int):
    """Lists of consecutive pieces with at most so many words, or of one longer piece."""
    out, size = [], 0
    for a, b in pieces:
        if out and size + b - a > most:
            yield out
            out, size = [], 0
        out.append((a, b))
        size += b - a
    if out:
        yield out


def of_batch(texts: pa.Array, group: int = GROUP) -> tuple[list[list[dict]], list[str]]:
    """For each text its runs, by start and then period, and the text without the repetitions."""
    hashes, first = T.hash_words(texts)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    split: dict[int, list[bytes]] = {}
    data, offsets = T.buffers(texts)
    for i in range(len(first) - 1):
        split[i] = data[offsets[i] : offsets[i + 1]].tobytes().split()  # bytes part at just the six characters of the contract
    found: list[list[tuple]] = [[] for _ in split]
    for some in grouped(pieces_of(hashes, owner), group):
        of = [int(owner[a]) for a, _ in some]
        begin = [a - int(first[i]) for (a, _), i in zip(some, of, strict=True)]
        listed = [split[i][at : at + b - a] for i, at, (a, b) in zip(of, begin, some, strict=True)]
        for piece, start, length, period in runs_of(listed):
            found[of[piece]].append((begin[piece] + start, length, period))
    collapsed = []
    for i, runs in enumerate(found):
        runs.sort()
        if runs:
            keep = np.ones(len(split[i]), bool)
            for start, length, period in runs:
                keep[start + period : start + length] = False
            split[i] = [w for w, k in zip(split[i], keep.tolist(), strict=True) if k]
        collapsed.append(b" ".join(split[i]).decode())
    return [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found], collapsed


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``runs`` (array of start, length, period, in words from 0), by start and then period, and ``collapsed``:
    the words joined by single spaces, without those that a run contains after its first period."""
    kept = [c for c in docs.columns if c not in ("runs", "collapsed")]
    out = S.StructType([docs.schema[c] for c in kept] + [S.StructField("runs", S.ArrayType(RUN)), S.StructField("collapsed", S.StringType())])
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches):
        for batch in T.batches_of(batches, size=2 << 20, column=text):
            runs, collapsed = of_batch(batch.column(text))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(runs, run), pa.array(collapsed, pa.string())], names=out.names)

    return docs.mapInArrow(find, out)


def with_planted(text: Column, doc_id: Column) -> Column:
    """The contract's texts: of ids with crc32 % 10 = 0, the words from place a on repeat the p words there; a null id's text stays."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    listed = words(text)
    n = F.size(listed)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(listed, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.concat(F.slice(listed, F.lit(1), a), F.slice(cycle, F.lit(1), n - a))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(planted, " ")).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_planted(F.col("text"), F.col("doc_id")).alias("text"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast(RUN), better)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    rows = periodic_runs(docs).select("doc_id", "runs", "collapsed", best.alias("best"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
