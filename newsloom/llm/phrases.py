"""Phrase collocations: phrases of up to four words that come together more often than their parts would.

Words come in pieces of text; the words of each language are counted, those of ``LEAST`` times or more are numbered,
and texts become runs of these numbers (phrases of that many times hold no other words).
Every place becomes a window of four words at once, and windows are dealt by the hash of their first two to shards of some
``WINDOWS``, summed by each task before. There are as many shards as the words ask for, and a window goes to one of them, so the work
grows with the texts. A task has all windows of its shard's phrases:

- Candidates are Apriori-safe: a phrase is one only if it goes on from one of those that are one word shorter; those of ``LEAST`` stay.
- It makes double-array tries of them (tries.py), of at most ``SHARD`` each. Its windows go through them at once, word by word;
  the states that they end in are counted, and the counts of alike windows summed.

These counts are the phrases'. Scores, and which phrases longer ones stand for, are joins of the counts.

Defined results: a null or empty text has no words; a null language is ``und``; every row counts, repeated ones too; ties are
told by the rest of the order; an empty table, and a language without a candidate, give no rows; columns other than text and lang aren't read.
Words are told apart by 64-bit hashes; if two frequent ones met in one, that would be an error.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.operators.order import numbered

from . import textbuf as T
from .common import shared_path, stored, table
from .tries import built, walked
from .warc import filesystem

LEAST, MOST_WORDS, SHARE, TOP = 30, 4, 80, 2000
#: Candidates in a trie, at most, and numbered words in a block that tasks read.
SHARD, BLOCK = 1 << 19, 1 << 22
#: Windows that a task sums before it sends them on, those of a shard, about, and those that are walked at a time; bytes of texts that are read at a time.
KEYS, WINDOWS, WALKED, TEXTS = 1 << 19, 1 << 20, 1 << 17, 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENDS_PIECE = np.zeros(256, bool)
ENDS_PIECE[[*b".,;:!?", *range(10, 14)]] = True
#: Bytes as words see them: lower case, and a blank for all that isn't in words.
AS_WORDS = np.where(ENDS_PIECE | np.isin(np.arange(256), (9, 32)), np.uint8(32), T.LOWER).astype(np.uint8)


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, word, f for every word."""
    pieces = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), r"[\x20\x09.,;:!?\x0A-\x0D]+")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.explode(pieces).alias("word"))
    return rows.where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("f"))


def code_of_lang(lang: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((lang or "").encode(), digest_size=8).digest(), "little")


def coded(words: DataFrame) -> DataFrame:
    """words with code, the hash of word and language."""
    schema = words.select("lang", "word", "f").schema.add("code", "long")

    def add(batches):
        for batch in batches:
            data, offsets = T.buffers(batch.column("word"))
            langs = np.array([code_of_lang(x) for x in batch.column("lang").to_pylist()], T.U)
            code = T.mix(T.span_hashes(data, offsets[:-1], offsets[1:]) ^ langs) if len(langs) else langs
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("lang", "word", "f")], pa.array(code.view(np.int64))], names=["lang", "word", "f", "code"])

    return words.mapInArrow(add, schema)


def vocabulary(words: DataFrame, least: int = LEAST) -> tuple[DataFrame, str, int]:
    """Frequent words with their id, the place in the order of codes; the folder of their blocks, and how many blocks there are."""
    spark = words.sparkSession
    ids = stored(numbered(coded(words.where(F.col("f") >= least)), F.asc("code")).withColumnRenamed("rank", "id"), "vocabulary")
    n, codes = ids.agg(F.count("*"), F.count_distinct("code")).first()
    if n != codes:
        raise ValueError("two frequent words have one hash")
    if n >= 1 << 31:
        raise ValueError("more frequent words than 31 bits tell apart")
    path = shared_path(spark, "codes")
    ids.select("id", "code", F.floor(F.col("id") / BLOCK).alias("block")).repartition("block").write.partitionBy("block").parquet(path)
    return ids, path, -(-n // BLOCK)


@functools.lru_cache(1)
def block_of(path: str, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes, ascending as unsigned numbers, and the ids of a block."""
    files, at = filesystem(f"{path}/block={block}")
    rows = ds.dataset(at, filesystem=files, format="parquet").to_table(["code", "id"])
    codes, ids = rows.column("code").to_numpy().view(T.U), rows.column("id").to_numpy()
    order = np.argsort(codes)
    return codes[order], ids[order]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its hash, its text's place among the offsets, and whether it begins a piece."""
    hashes, owners, new = [np.zeros(0, T.U)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    begin, n, ends, last, owned = 0, len(data), 0, -1, -1
    while begin < n:
        end = T.cut(data, begin, n)
        piece = AS_WORDS[data[begin:end]]
        starts, stops = T.bounds(piece, offsets, begin, end)
        passed = np.concatenate([[0], np.cumsum(ENDS_PIECE[data[begin:end]])]) + ends
        ends = int(passed[-1])
        if len(starts):
            owner = np.searchsorted(offsets, starts + begin, "right") - 1
            before = np.append(last, passed[stops[:-1]])
            hashes.append(T.span_hashes(piece, starts, stops))
            owners.append(owner)
            new.append((passed[starts] > before) | (owner != np.append(owned, owner[:-1])))
            last, owned = passed[stops[-1]], owner[-1]
        begin = end
    return np.concatenate(hashes), np.concatenate(owners), np.concatenate(new)


def ids_of(batch: pa.RecordBatch, path: str, blocks: int) -> np.ndarray:
    """The frequent words of a batch's texts (lang, text), with -1 where a piece ends or another word stands."""
    langs = {x: code_of_lang(x) for x in batch.column("lang").unique().to_pylist()}
    data, offsets = T.buffers(batch.column("text"))
    hashes, owner, new = words_of(data, offsets)
    codes = T.mix(hashes ^ np.array([langs[x] for x in batch.column("lang").to_pylist()], T.U)[owner])
    ids = np.full(len(codes), -1, np.int32)
    for b in range(blocks):
        known, of = block_of(path, b)
        at = np.searchsorted(known, codes)
        at[at == len(known)] = 0
        ids = np.where(known[at] == codes, of[at], ids).astype(np.int32)
    ids = np.insert(ids, np.flatnonzero(new), np.int32(-1))
    doubled = np.zeros(len(ids), bool)
    doubled[1:] = (ids[1:] < 0) & (ids[:-1] < 0)
    return ids[~doubled]


def windows_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place where two numbered words stand: both in one number, and the two after them in another (0: the piece ends, or another word stands)."""
    ahead = np.concatenate([ids, np.full(MOST_WORDS - 1, -1, ids.dtype)]).astype(np.int64)
    at = np.flatnonzero((ahead[:-3] >= 0) & (ahead[1:-2] >= 0))
    third, fourth = ahead[at + 2] + 1, ahead[at + 3] + 1
    return ahead[at] << 32 | ahead[at + 1], third << 32 | np.where(third > 0, fourth, 0)


def merged(pairs: np.ndarray, rest: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window once, with its count, ordered by the hash of its pair."""
    order = np.lexsort((rest, T.mix(pairs.view(T.U))))
    pairs, rest = pairs[order], rest[order]
    first = np.flatnonzero(starts_of(pairs, rest))
    return pairs[first], rest[first], np.add.reduceat(counts[order], first) if len(first) else counts


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before."""
    first = np.ones(len(columns[0]), bool)
    first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return first


def summed(found, most: int = KEYS):
    """Windows with their counts, from arrays of windows: each once, but for those that come after more than ``most`` were held."""
    held, n = [], 0

    def taken():
        columns = [*map(np.concatenate, zip(*held, strict=True)), np.ones(n, np.int64)]
        held.clear()  # they aren't kept beside what is made of them
        return merged(*columns)

    for some in found:
        held.append(some)
        n += len(some[0])
        del some
        if n > most:
            yield taken()
            n = 0
    if n:
        yield taken()


DEALT = "shard int, pairs binary, rest binary, counts binary"


def dealt(docs: DataFrame, path: str, blocks: int, shards: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """The windows of the texts by shard: all of a pair of words are in one, so that every phrase is. Tasks have summed them, and send them as arrays.

    A task numbers the words of some texts and makes windows of them at once, so numbered texts go to no disk and through no other process.
    """

    def deal(batches):
        found = (windows_of(ids_of(batch, path, blocks)) for batch in T.batches_of(batches, size=TEXTS))
        for pairs, rest, counts in summed(found):
            shard = ((T.mix(pairs.view(T.U)) >> T.U(32)) * T.U(shards) >> T.U(32)).astype(np.int64)  # in order, as the windows are
            edges = np.append(np.flatnonzero(starts_of(shard)), len(shard))
            columns = [pa.array(shard[edges[:-1]], pa.int32())]
            for x in (pairs, rest, counts):
                columns.append(pa.array([x[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "pairs", "rest", "counts"])

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(deal, DEALT)


def candidates(pairs: np.ndarray, rest: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The phrases (a row each, with -1 after the last word) that merged windows have ``least`` times, and the windows that begin with one.

    A phrase is looked for only where the one that is a word shorter has come often enough.
    """
    found, stay = [np.zeros((0, MOST_WORDS), np.int64)], np.ones(len(pairs), bool)
    at = np.arange(len(pairs))
    for size in range(2, MOST_WORDS + 1):
        after = rest[at] >> 32 if size == 3 else rest[at]
        if size > 2:
            there = after > 0 if size == 3 else after & 0xFFFFFFFF > 0
            at, after = at[there], after[there]
        if not len(at):
            break
        first = starts_of(pairs[at], after) if size > 2 else starts_of(pairs[at])
        begin = np.flatnonzero(first)
        often = np.add.reduceat(counts[at], begin) >= least
        one = at[begin[often]]
        words = np.stack([pairs[one] >> 32, pairs[one] & 0xFFFFFFFF, (rest[one] >> 32) - 1, (rest[one] & 0xFFFFFFFF) - 1], axis=1)
        words[:, size:] = -1
        found.append(words)
        at = at[often[np.cumsum(first) - 1]]
        if size == 2:
            stay[:] = False
            stay[at] = True
    return np.concatenate(found), stay


COUNTED = "w0 long, w1 long, w2 long, w3 long, n long"


def counted(windows: DataFrame, least: int, shard: int) -> DataFrame:
    """w0 to w3 (null after the last), n: the phrases of ``least`` times or more, as the states of tries count them.

    A task makes tries of its shard's candidates, of at most ``shard`` each, and all its windows go through them, from their first words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            for some, name in zip(held, ("pairs", "rest", "counts"), strict=True):
                some.extend(np.frombuffer(x, np.int64) for x in batch.column(name).to_pylist())
        columns = [np.concatenate(x) for x in held]
        held.clear()
        pairs, rest, counts = merged(*columns)
        del columns
        listed, stay = candidates(pairs, rest, counts, least)
        pairs, rest, counts = pairs[stay], rest[stay], counts[stay]
        for k in range(0, len(listed), shard):
            trie, order = built(listed[k : k + shard])
            total = np.zeros(len(trie.accept))
            for i in range(0, len(pairs), WALKED):
                a, b = pairs[i : i + WALKED], rest[i : i + WALKED]
                ids = np.stack([a >> 32, a & 0xFFFFFFFF, (b >> 32) - 1, (b & 0xFFFFFFFF) - 1, np.full(len(a), -1)], axis=1).ravel()
                width = MOST_WORDS + 1
                for size, at, state in walked(trie, ids, MOST_WORDS, np.arange(0, len(ids), width)):
                    if size > 1:
                        total += np.bincount(state, weights=counts[i + at // width], minlength=len(total))
            ended = np.flatnonzero(trie.accept >= 0)
            rows = listed[k : k + shard][order[trie.accept[ended]]]
            n = total[ended].astype(np.int64)
            for i in range(0, len(n), 1 << 15):
                columns = [pa.array(rows[i : i + (1 << 15), j], mask=rows[i : i + (1 << 15), j] < 0) for j in range(MOST_WORDS)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n[i : i + (1 << 15)])], names=["w0", "w1", "w2", "w3", "n"])

    return windows.groupBy("shard").applyInArrow(count, COUNTED)


def phrase_counts(docs: DataFrame, least: int = LEAST, shard: int = SHARD, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """All words (lang, word, f), and lang, phrase, size, f of the words and phrases of at most four that come ``least`` times or more."""
    words = stored(word_counts(docs, text, lang), "words")
    ids, path, blocks = vocabulary(words, least)
    places = ids.agg(F.sum("f")).first()[0] or 0
    windows = dealt(docs, path, blocks, max(1, -(-places // WINDOWS)), text, lang)
    found = stored(counted(windows, least, shard), "counted")
    name = lambda k: ids.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"_w{k}"))
    several = found.join(name(0).join(ids.select(F.col("id").alias("w0"), "lang"), "w0"), "w0").join(name(1), "w1").join(name(2), "w2", "left").join(name(3), "w3", "left")
    words_in = [F.col(f"_w{k}") for k in range(MOST_WORDS)]
    size = functools.reduce(Column.__add__, [w.isNotNull().cast("int") for w in words_in])
    several = several.select("lang", F.concat_ws(" ", *words_in).alias("phrase"), size.alias("size"), F.col("n").alias("f"))
    single = words.where(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f")
    return words, stored(single.unionByName(several), "frequent")


def scored(frequent: DataFrame, share: int = SHARE) -> DataFrame:
    """lang, phrase, a, l, r, score of phrases that no longer one stands for; frequent: lang, phrase, size, f."""
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    candidates = frequent.where("size > 1")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', cut)"), "rest": F.expr("substring_index(phrase, ' ', cut - size)")})
    part = lambda name, f: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    both = both.withColumn("score", F.expr("CAST(CAST(2000000 AS DECIMAL(38,0)) * a div (CAST(l AS DECIMAL(38,0)) + r) AS BIGINT)"))
    best = both.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    listed = "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"
    within = frequent.where("size > 2").select("lang", "f", F.explode(F.expr(listed)).alias("phrase"))
    longest = within.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * exact("longer") < share * exact("a")))
    return kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, shard: int = SHARD, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases."""
    words, frequent = phrase_counts(docs, least, shard, text, lang)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored(frequent, share).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def phrases_sql(docs: str = "documents", least: int = LEAST, share: int = SHARE, top: int = TOP) -> str:
    """The same in SQL over the relation ``docs``."""
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws
  FROM (SELECT lang, unnest(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM {docs})
), frequent AS (
  SELECT lang, phrase, size, count(*)::HUGEINT AS f
  FROM (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
        FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS size))
  GROUP BY ALL HAVING count(*) >= {least}
), totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang
), cuts AS (
  SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS cut FROM frequent WHERE size > 1
), parts AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, cut, (2000000 * c.a) // (x.f + y.f) AS score
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ') JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')
), best AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, f, size, m, ws, unnest(range(1, size - m + 2)) AS i FROM (SELECT lang, f, size, string_split(phrase, ' ') AS ws, unnest(range(2, size)) AS m FROM frequent WHERE size > 2))
  GROUP BY ALL
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.longer IS NULL OR 100 * g.longer < {share} * a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {top}"""
