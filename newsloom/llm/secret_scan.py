"""Secret scans, with DataFrame functions only.

Base rules find assignments, access keys and hex strings by pattern. The method adds runs
of 20 or more characters of key material that are told to be random. What is tested is that
a run is ordinary: words, slugs, paths, names in mixed case, numbers. Three tests per candidate,
in the alphabet inferred for it, each with a deviate that is negative where chance looks likelier:

- chi-squared: the statistic against uniformity is linear in the number of pairs of equal
  symbols, which ordinary strings have with a probability of ``REPEATS`` at least, and 1.6 times as
  often as by chance; for short strings a count of pairs has power where 62 cells have none;
- runs: ordinary strings change between lower case, upper case, digits and the rest less than half
  as often as by chance (a capital before a small letter is no change), patterns halfway to always;
- serial correlation: neighbours of ordinary strings have a correlation of ``SERIAL`` or more.

The three deviates, each at least -4, are added up and make one p-value: small if random. Over
all candidates of a length class the Benjamini-Hochberg procedure rejects "ordinary" at a false
discovery rate of ``rate``; what is rejected is reported, so the rate is that of false secrets.
Classes of length are kept apart, as long strings tell much more than short ones. P-values are
rounded up to 20 levels a decade, so that the procedure needs only counts per class and level,
whose number doesn't grow with the input.

Defined results: a null text is empty (no spans, the hash of nothing); null ids and
repeated rows each get a row; an empty table gives an empty result; extra columns pass
through secret_spans(), computed names are replaced there and kept by redact(). A candidate that
meets a base span is neither counted nor reported on its own. Spans of a kind never overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, total

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of hex digits are maximal, so the length may stand in the pattern.
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
SMALL, CAPITAL, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets by the pattern of the strings in them, the narrowest first.
ENCODINGS = (
    ("^[0-9a-f]+$", DIGIT + SMALL[:6]),
    ("^[A-Z2-7]+$", CAPITAL + DIGIT[2:8]),
    ("^[a-z0-9]+$", SMALL + DIGIT),
    ("^[A-Z0-9]+$", DIGIT + CAPITAL),
    ("^[A-Za-z0-9]+$", DIGIT + CAPITAL + SMALL),
    ("^[A-Za-z0-9+/]+$", CAPITAL + SMALL + DIGIT + "+/"),
    ("", CAPITAL + SMALL + DIGIT + "-_+/="),
)
REPEATS, SERIAL, LEAST = 0.05, 0.4, -4.0
CLASSES = (32, 48, 96)
RATE = 0.05
LEVELS = 400
MASK = "[SECRET]"
RUN = 512
SPAN = "array<struct<start: int, kind: int, end: int, value: string>>"


def matches(text: Column, pattern: str, kind: int, value: int = 0, least: int = 0) -> Column:
    """Spans of the matches whose value (the group) has ``least`` characters.

    The text is the pieces between the matches and the matches in turn, so their lengths tell the places.
    """

    def places(pieces: Column, whole: Column, values: Column) -> Column:
        n = F.size(whole)

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(pieces, i))
            end = start + F.length(F.get(whole, i))
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.get(values, i).alias("value"))
            return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

        # in runs of RUN matches, so that appending to an array doesn't cost the square of all matches
        run = lambda c: F.sequence(c * RUN, F.least((c + 1) * RUN, n) - 1)
        length = lambda c: F.aggregate(run(c), F.lit(0), lambda acc, i: acc + F.length(F.get(pieces, i)) + F.length(F.get(whole, i)))
        begins = F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int")), F.array(F.lit(0)), lambda acc, c: F.array_append(acc, F.element_at(acc, -1) + length(c)))
        one = lambda begin, c: F.aggregate(run(c), F.struct(begin.alias("at"), F.array().cast(SPAN).alias("spans")), step, lambda acc: acc["spans"])
        return let(begins, lambda b: F.flatten(F.transform(F.slice(b, F.lit(1), F.size(b) - 1), one)))

    parts = F.struct(
        F.split(text, pattern, -1).alias("pieces"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(value)).alias("values")
    )
    found = let(parts, lambda p: places(p["pieces"], p["whole"], p["values"]))
    if least:
        found = F.filter(found, lambda s: F.length(s["value"]) >= least)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(matches(text, ASSIGN, 0, 2, 12), matches(text, ACCESS, 1, 0, 18), matches(text, HEX, 2)))


def tail(z: Column) -> Column:
    """Of the standard normal distribution, what lies above z."""
    x = F.abs(z) / F.lit(2**0.5)
    t = 1 / (1 + 0.3275911 * x)
    half = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, half).otherwise(1 - half)


def change_rate(alphabet: str) -> float:
    """How often neighbours in a random string of the alphabet differ in class, a capital before a small letter left out."""
    n = len(alphabet)
    shares = {c: sum(x in c for x in alphabet) / n for c in (SMALL, CAPITAL, DIGIT)}
    rest = 1 - sum(shares.values())
    return 1 - rest * rest - sum(x * x for x in shares.values()) - shares[CAPITAL] * shares[SMALL]


def encoding_of(text: Column) -> Column:
    """Place in ENCODINGS, from 0."""
    out = F.lit(len(ENCODINGS) - 1)
    for i, (pattern, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
        out = F.when(text.rlike(pattern), F.lit(i)).otherwise(out)
    return out


def chi_squared(text: Column, symbols: Column, size: Column) -> Column:
    """Pairs of equal symbols, their root against that of an ordinary string's."""
    n = F.length(text).cast("double")
    squares = total(F.transform(F.array_distinct(symbols), lambda c: F.pow((n - F.length(F.replace(text, c, F.lit("")))), 2)), F.lit(0.0))
    ordinary = n * (n - 1) / 2 * F.greatest(F.lit(REPEATS), 1.6 / size)
    root = lambda x: F.sqrt(x + 0.375)
    return 2 * (root((squares - n) / 2) - root(ordinary)) / F.sqrt(1 + n / 20)


def runs(text: Column, rate: Column) -> Column:
    """Changes of class, against half as many as by chance and against halfway from that to always."""
    classes = F.translate(text, SMALL + CAPITAL + DIGIT + "-_+/=", "a" * 26 + "A" * 26 + "0" * 10 + "-" * 5)
    steps = F.length(text).cast("double") - 1
    turns = F.regexp_count(classes, F.lit("a(?=[A0-])|A(?=[0-])|0(?=[aA-])|-(?=[aA0])"))
    below = lambda q: (steps * q - turns) / F.sqrt(steps * q * (1 - q))
    return F.greatest(below(rate / 2), -below((1 + rate) / 2))


def serial(codes: Column) -> Column:
    def test(x: Column) -> Column:
        n = F.size(x).cast("double")
        return let(total(x, F.lit(0)) / n, lambda m: of(x, n, m))

    def of(x: Column, n: Column, m: Column) -> Column:
        variance = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m))
        joint = total(F.transform(x, lambda v, i: F.coalesce((v - m) * (F.get(x, i - 1) - m), F.lit(0.0))), F.lit(0.0))
        correlation = F.when(variance > 0, F.abs(joint / variance + 1 / n)).otherwise(F.lit(1.0))
        return (correlation - SERIAL) * F.sqrt(n)

    return let(codes, test)


def level_of(value: Column) -> Column:
    """-20 log10 of a candidate's p-value, rounded down (so the p-value is rounded up) and within 0 and LEVELS."""
    alphabets, rates = F.array(*[F.lit(a) for _, a in ENCODINGS]), F.array(*[F.lit(change_rate(a)) for _, a in ENCODINGS])

    def battery(s: Column) -> Column:
        text, alphabet = s["text"], F.get(alphabets, s["encoding"])
        symbols = F.split(text, "")
        codes = F.transform(symbols, lambda c: F.call_function("instr", alphabet, c))
        deviates = (chi_squared(text, symbols, F.length(alphabet).cast("double")), runs(text, F.get(rates, s["encoding"])), serial(codes))
        added = sum((F.greatest(z, F.lit(LEAST)) for z in deviates), F.lit(0.0)) / 3**0.5
        return F.floor(-20 * F.log10(F.greatest(let(added, lambda z: tail(-z)), F.lit(1e-30)))).cast("int")

    text = F.regexp_replace(value, "=+$", "")
    folded = F.when(text.rlike("^[0-9a-fA-F]+$"), F.lower(text)).otherwise(text)
    level = let(let(folded, lambda t: F.struct(t.alias("text"), encoding_of(t).alias("encoding"))), battery)
    return F.when(F.length(text) > 1, F.greatest(F.least(level, F.lit(LEVELS)), F.lit(0))).otherwise(F.lit(0))


def length_class(n: Column) -> Column:
    return sum(((n >= edge).cast("int") for edge in CLASSES), F.lit(0))


def apart(span: Column, base: Column) -> Column:
    return ~F.exists(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))


def candidates(text: Column, base: Column) -> Column:
    """Spans that meet none of base, with their length class and level."""
    found = F.filter(matches(text, CANDIDATE, 3), lambda s: apart(s, base))
    return F.transform(found, lambda s: F.struct(s.alias("span"), length_class(F.length(s["value"])).alias("class"), level_of(s["value"]).alias("level")))


def reported_from(docs: DataFrame, rate: float = RATE) -> list[int]:
    """For each length class the level from which candidates are reported; LEVELS + 1 for none."""
    text = F.coalesce("text", F.lit(""))
    some = docs.select(text.alias("text")).where(F.col("text").rlike(CANDIDATE)).withColumn("base", base_spans(F.col("text")))
    each = some.select(F.explode(candidates(F.col("text"), F.col("base"))).alias("c"))
    counts = {(c, level): n for c, level, n in each.groupBy("c.class", "c.level").agg(F.count("*")).collect()}
    out = []
    for c in range(len(CLASSES) + 1):
        m = sum(n for (k, _), n in counts.items() if k == c)
        fits, above = LEVELS + 1, 0
        for level in range(LEVELS, -1, -1):
            above += counts.get((c, level), 0)
            if above and 10 ** (-level / 20) <= rate * above / m:
                fits = level
        out.append(fits)
    return out


def secret_spans(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """docs with base and all: sorted spans (start, kind, end, value), places in code points."""
    limits = F.array(*[F.lit(x) for x in reported_from(docs, rate)])
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.drop("base", "all").withColumn("base", base_spans(text))
    added = F.filter(candidates(text, F.col("base")), lambda c: c["level"] >= F.get(limits, c["class"]))
    return rows.withColumn("all", F.array_sort(F.concat("base", F.transform(added, lambda c: c["span"]))))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rate: float = RATE, mask: str = MASK) -> DataFrame:
    """docs with their secrets replaced in the text, and n_chars, if there is one, of the new text."""

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.when(fresh, more).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    rewritten = F.aggregate("all", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, rest)
    rows = secret_spans(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), rate)
    rows = rows.select("row", F.when(F.size("all") > 0, rewritten).alias("fresh"))

    def column(c: str) -> Column:
        old = F.col("row")[c]
        new = {"text": F.col("fresh"), "n_chars": F.length("fresh").cast(docs.schema[c].dataType)}.get(c)
        return (old if new is None else F.when(F.col("fresh").isNotNull(), new).otherwise(old)).alias(c)

    return rows.select(*[column(c) for c in docs.columns])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans")
    )
