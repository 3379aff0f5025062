"""All pairs of titles that are near in time, counted in tiles.

Titles of a feed lie in bands of time as long as the window, so a title meets those of its own band and of the one before. A band is
dealt to blocks of some hundred titles; a tile is two blocks, and a task counts what the titles of a tile share from their tokens
at once. No candidate is a row, and a task holds one tile however many titles a band or a token has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.shared import stored

#: Titles and tokens of a block, about; tiles that a task counts, about, and the most tasks.
TITLES, TOKENS, TILES, MOST_TASKS = 1024, 1 << 19, 4, 4096
#: Pairs of a token that are listed at once; a token of more than this share of a tile's cells is counted by a product of matrices, so many tokens at once.
LISTED, DENSE, COLUMNS = 1 << 22, 1 / 16, 512
TILE = ("feed", "band", "lag", "x", "y")
PAIR = "feed string, anchor string, link string, shared int, rare_shared int, rare_least int, dice double"


def dealt(rows: DataFrame) -> DataFrame:
    """TILE, side, link, at, tokens: each title in every tile of its block. lag is 0 for two blocks of a band, then x is not after y, and 1 for x of the band and y of
    the one before; side is 0 for x, 1 for y, 2 for both."""
    size = F.greatest(F.count("*") / TITLES, F.sum(F.size("tokens")) / TOKENS)
    bands = stored(rows.groupBy("feed", "band").agg(F.ceil(size).alias("k")), "bands")
    at = lambda shift, name: bands.select("feed", (F.col("band") + shift).alias("band"), F.col("k").alias(name))
    near = stored(bands.join(at(1, "before"), ["feed", "band"], "left").join(at(-1, "after"), ["feed", "band"], "left"), "near").na.fill(0)
    tiles = near.agg(F.sum(F.expr("k * (k + 1) / 2 + k * before"))).first()[0] or 0
    placed = rows.join(near, ["feed", "band"]).withColumn("block", F.pmod(F.xxhash64("link"), "k"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    tile = lambda band, lag, x, y, side: F.struct(band.alias("band"), F.lit(lag).alias("lag"), x.alias("x"), y.alias("y"), side.alias("side"))
    band, block = F.col("band"), F.col("block")
    side = lambda other: F.when(block == other, 2).when(block < other, 0).otherwise(1)
    own = F.transform(upto(F.col("k")), lambda o: tile(band, 0, F.least(block, o), F.greatest(block, o), side(o)))
    newer = F.transform(upto(F.col("before")), lambda o: tile(band, 1, block, o, F.lit(0)))
    older = F.transform(upto(F.col("after")), lambda o: tile(band + 1, 1, o, block, F.lit(1)))
    told = placed.select("feed", F.unix_micros("published").alias("at"), "link", "tokens", F.explode(F.concat(own, newer, older)).alias("_t"))
    tasks = max(1, min(MOST_TASKS, -(-int(tiles) // TILES)))
    return told.select("feed", "_t.*", "link", "at", "tokens").repartition(tasks, *TILE)


def pairs_of(rows: DataFrame, hours: int, least_shared: int) -> DataFrame:
    """PAIR for all pairs of titles within hours, newer first, with least_shared tokens in common or two rare ones.

    rows: feed, link, published, band (of that many hours), tokens (token, weight, rare). What tasks run is nested here, so that it goes to them by value.
    """
    seconds = hours * 3600

    def listed(a: np.ndarray, b: np.ndarray, tokens: int):
        """Place in a and place in b of all pairs of one token, some at once. a, b: tokens, b in order."""
        start = np.searchsorted(b, np.arange(tokens + 1))
        many = np.diff(start)[a]
        upto = np.cumsum(many)
        first = 0
        while first < len(a):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + LISTED, side="right")))
            n = many[first:last]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(np.arange(first, last), n), np.repeat(start[a[first:last]], n) + within
            first = last

    def shared(a: tuple, b: tuple, shape: tuple, kinds: np.ndarray) -> np.ndarray:
        """For each of kinds, a matrix of what titles of two blocks share, summed over their tokens. a, b: places of titles and tokens, each once and in order of tokens."""
        (at_a, token_a), (at_b, token_b) = a, b
        tokens, cells = kinds.shape[1], shape[0] * shape[1]
        out = np.zeros((len(kinds), cells))
        common = np.bincount(token_a, minlength=tokens) * np.bincount(token_b, minlength=tokens) > max(DENSE * cells, 1)
        few_a, few_b = ~common[token_a], ~common[token_b]
        row, column, token = at_a[few_a], at_b[few_b], token_a[few_a]
        for i, j in listed(token, token_b[few_b], tokens):
            cell, of = row[i] * shape[1] + column[j], token[i]
            for k, worth in enumerate(kinds):
                out[k] += np.bincount(cell, worth[of], cells)
        wide = np.flatnonzero(common)
        for first in range(0, len(wide), COLUMNS):
            these = wide[first : first + COLUMNS]
            has = []
            for at, token, n in ((at_a, token_a, shape[0]), (at_b, token_b, shape[1])):
                column = np.searchsorted(these, token)
                met = these[np.minimum(column, len(these) - 1)] == token
                has.append(np.zeros((n, len(these))))
                has[-1][at[met], column[met]] = 1
            for k, worth in enumerate(kinds):
                if worth[these].any():
                    out[k] += ((has[0] * worth[these]) @ has[1].T).ravel()
        return out

    def counted(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        lists, n = tile["tokens"].chunk(0), tile.num_rows
        row = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        field = lambda name: pc.struct_field(flat, name).to_numpy(zero_copy_only=False)
        words = pc.struct_field(flat, "token").dictionary_encode()
        token, tokens = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
        weight, rare = field("weight"), field("rare").astype(float)
        total, rares = np.bincount(row, weight, n), np.bincount(row, rare, n)
        kinds = np.ones((3, tokens))
        kinds[1, token], kinds[2, token] = rare, weight
        token, row = np.divmod(np.unique(token * n + row), n)  # each once
        side, lag, two = tile["side"].to_numpy(), tile["lag"][0].as_py(), tile["x"][0] != tile["y"][0]
        sides = [np.flatnonzero(side != other) for other in (1, 0)]
        entries = [(np.searchsorted(at, row[side[row] != other]), token[side[row] != other]) for at, other in zip(sides, (1, 0))]
        alike, scarce, weighed = shared(*entries, (len(sides[0]), len(sides[1])), kinds) if len(sides[0]) and len(sides[1]) else np.zeros((3, 0))
        cell = np.flatnonzero((alike >= least_shared - 0.5) | (scarce >= 1.5))
        one, other = sides[0][cell // max(len(sides[1]), 1)], sides[1][cell % max(len(sides[1]), 1)]
        if not lag and two:  # of one band, so either can be the newer
            one, other, cell = np.concatenate([one, other]), np.concatenate([other, one]), np.concatenate([cell, cell])
        at, place = tile["at"].to_numpy(), pc.rank(tile["link"], tiebreaker="dense").to_numpy()
        apart = at[one] // 1_000_000 - at[other] // 1_000_000
        kept = (apart >= 0) & (apart <= seconds) & ((at[one] > at[other]) | (place[one] < place[other]))
        one, other, cell = one[kept], other[kept], cell[kept]
        whole = lambda values: pa.array(np.rint(values).astype(np.int32))
        links = tile["link"].chunk(0)
        return pa.table({
            "feed": tile["feed"].chunk(0).take(np.zeros(len(one), np.int64)), "anchor": links.take(pa.array(one)), "link": links.take(pa.array(other)), "shared": whole(alike[cell]),
            "rare_shared": whole(scarce[cell]), "rare_least": whole(np.minimum(rares[one], rares[other])), "dice": pa.array(2 * weighed[cell] / (total[one] + total[other]))
        })

    return dealt(rows).groupBy(*TILE).applyInArrow(counted, PAIR)
