"""Text functions as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

WORD_CHAR = "[A-Za-z0-9_]"
#: White space as feeds use it: also no-break space, which Java's class leaves out.
BLANK = r"[\s ﻿]"


def escape(needle: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|#/-])", r"\\\1", needle)


def bounded(needle: str) -> str:
    """Pattern of a needle at ASCII word boundaries; beside a non-word character a boundary asks for a word character."""
    if not needle:
        raise ValueError("an empty needle would match everything")
    word = lambda c: re.match(WORD_CHAR, c) is not None
    before = f"(?<!{WORD_CHAR})" if word(needle[0]) else f"(?<={WORD_CHAR})"
    after = f"(?!{WORD_CHAR})" if word(needle[-1]) else f"(?={WORD_CHAR})"
    return f"{before}{escape(needle)}{after}"


def any_of(needles: list[str]) -> str:
    """One case-insensitive pattern for whole-word matches of any needle; for no needles one that never matches."""
    return "(?iu)(?:" + "|".join(bounded(n) for n in needles) + ")" if needles else r"(?!)"


def prefix_of(labels: list[str]) -> str:
    """Pattern of any label before a colon at the start."""
    return rf"(?iu)^{BLANK}*(?:" + "|".join(escape(x) for x in labels) + rf"){BLANK}*:"


def ascii_words(text: Column) -> Column:
    """The different words of ASCII letters, digits and underscores, in lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), "[^a-z0-9_]+")), "")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text, so that it needn't be copied for each of its words."""
    return F.struct(F.xxhash64(text), F.xxhash64(F.lit(1), text))


def keyed_names(names: DataFrame, name: str) -> DataFrame:
    """names with _word, the longest of a name's words, by which texts that hold the name can be met, and _pattern, the name at
    word boundaries as in bounded(). Names without a letter or digit of ASCII match nothing and are left out."""
    edge = lambda c, place: F.when(c.rlike(f"^{WORD_CHAR}"), place[0]).otherwise(place[1])
    start = edge(F.left(name, F.lit(1)), (f"(?<!{WORD_CHAR})", f"(?<={WORD_CHAR})"))
    end = edge(F.right(name, F.lit(1)), (f"(?!{WORD_CHAR})", f"(?={WORD_CHAR})"))
    longest = F.get(F.reverse(F.array_sort(F.transform(ascii_words(F.col(name)), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))), F.lit(0))["w"]
    rows = names.withColumns({"_word": longest, "_pattern": F.concat(F.lit("(?iu)"), start, F.lit("\\Q"), F.col(name), F.lit("\\E"), end)})
    return rows.where("_word IS NOT NULL")


def contains_any(text: Column, needles: list[str]) -> Column:
    return F.coalesce(text, F.lit("")).rlike(any_of(needles))


def squash(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.regexp_replace(F.regexp_replace(text, f"{BLANK}+", " "), "^ | $", "")


def trim_blanks(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(squash(text), F.lit(""))


# The character references by name that feeds are decoded by; others stay as they are.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "\u2014", "ndash": "\u2013",
    "rsquo": "\u2019", "lsquo": "\u2018", "rdquo": "\u201d", "ldquo": "\u201c"
}
REFERENCE = re.compile(r"&(?:#(\d+)|#x([0-9a-f]+)|([a-z]+));", re.IGNORECASE | re.ASCII)


def decoded(m: re.Match) -> str:
    """What a reference stands for; itself if it is none."""
    if m[3]:
        return ENTITIES.get(m[3].lower(), m[0])
    code = int(m[1]) if m[1] else int(m[2], 16)
    return chr(code) if code < 0xD800 or 0xDFFF < code <= 0x10FFFF else m[0]


@pandas_udf(StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    """Character references by name, decimal and hexadecimal number, each once."""
    return text.map(lambda x: REFERENCE.sub(decoded, x), na_action="ignore")


def strip_tags(body: Column) -> Column:
    """Tags out, white space collapsed, trimmed, then references decoded, in that order."""
    return decode_entities(squash(F.regexp_replace(body, "<[^>]*>", " ")))


def first_image(body: Column) -> Column:
    return F.nullif(F.regexp_extract(body, r"""(?is)<img\b[^>]*?\bsrc\s*=\s*["']([^"']+)["']""", 1), F.lit(""))


def singular(token: Column) -> Column:
    """Plural folded minimally, for tokens of five characters or more."""
    cut = lambda n: F.left(token, F.length(token) - n)
    long = F.length(token) >= 5
    return (
        F.when(long & token.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(long & token.rlike("(?:s|x|z|ch|sh)es$"), cut(2))
        .when(long & token.endswith("s") & ~token.endswith("ss"), cut(1))
        .otherwise(token)
    )


def title_tokens(title: Column, source: Column | None = None, stopwords=(), prefixes=()) -> Column:
    """Tokens of a title: folded, without label prefix and the source's own signature after a hyphen, bar or colon.

    Dashes part words, hyphens don't; letters are those of any script. Tokens of one character and stopwords are dropped before plurals are folded.
    """
    folded = F.lower(title)
    folded = F.regexp_replace(F.regexp_replace(folded, "[\u2018\u2019\u02bc]", "'"), "[\u2013\u2014]", " ")
    folded = F.regexp_replace(folded, "[\u201c\u201d]", '"')
    if prefixes:
        folded = F.regexp_replace(folded, prefix_of(list(prefixes)), "")
    if source is not None:
        folded = trim_blanks(folded)
        head = trim_blanks(F.left(folded, F.length(folded) - F.length(source)))
        signed = folded.endswith(F.lower(source)) & F.right(head, F.lit(1)).isin("-", "|", ":")
        folded = F.when(signed, F.left(head, F.length(head) - 1)).otherwise(folded)
    possessive = F.regexp_replace(F.regexp_replace(folded, r"'s(?![a-z0-9])", ""), r"s'(?![a-z0-9])", "s")
    plain = F.regexp_replace(possessive, r"[^\p{L}\p{N}-]+", " ")
    tokens = F.transform(F.split(plain, " +"), lambda t: F.regexp_replace(t, "^-+|-+$", ""))
    tokens = F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*stopwords) if stopwords else F.length(t) > 1)
    return F.transform(tokens, singular)


def strip_quotes(text: Column) -> Column:
    """Quoted passages out: double quotes around three characters or more, single quotes at word edges."""
    out = F.regexp_replace(text, '["“][^"”]{3,}["”]', " ")
    return F.regexp_replace(out, r"(?<![A-Za-z0-9])['‘][^'’]{3,}['’](?![A-Za-z0-9])", " ")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def aliased(name: Column, aliases: dict[str, str]) -> Column:
    """The slug of a name, led through the table of aliases."""
    out = slug(name)
    for short, full in sorted(aliases.items()):
        out = F.when(out == short, F.lit(full)).otherwise(out)
    return out


def drops_a_word(alias: Column, name: Column) -> Column:
    """Is the alias the name's slug short of its first or last words?"""
    a, b = F.split(alias, "-"), F.split(name, "-")
    less = F.size(a) < F.size(b)
    return less & ((F.slice(b, 1, F.size(a)) == a) | (F.slice(b, F.size(b) - F.size(a) + 1, F.size(a)) == a))


def expansions(name: Column) -> Column:
    """The name, and with a trailing St spelled out."""
    return F.when(name.rlike(r"\bSt\.?$"), F.array(name, F.regexp_replace(name, r"\bSt\.?$", "State"))).otherwise(F.array(name))


def plain_url(url: Column) -> Column:
    return F.regexp_replace(url, "[^A-Za-z0-9]+", " ")


def truncated(text: Column, limit: int = 300) -> Column:
    """Cut at the last space within the limit if that is past its half, without white space at its end, with an ellipsis."""
    head = F.substring(text, 1, limit)
    at = limit - F.length(F.regexp_extract(head, " ([^ ]*)$", 1)) - 1
    has_space = F.instr(head, " ") > 0
    cut = F.when(has_space & (at > limit // 2), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, f"{BLANK}+$", ""), F.lit("…")))


def cache_key(title: Column, version: str = "v1") -> Column:
    return F.concat(F.lit(f"{version}:"), F.sha2(squash(F.lower(title)), 256))


def operator_of(url: Column, families: dict[str, str]) -> Column:
    """Which operator serves a url: by the pattern of a family, else its host."""
    out = F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1)
    for name, pattern in reversed(families.items()):
        out = F.when(url.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def nickname_candidates(mascot: Column) -> Column:
    """Base, singular, last word and its singular, each once."""
    base = F.lower(squash(mascot))
    last = F.element_at(F.split(base, " "), -1)
    fold = lambda t: F.when((F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss"), F.left(t, F.length(t) - 1)).otherwise(t)
    return F.array_distinct(F.array(base, fold(base), last, fold(last)))


def mentions_loosely(names: Column, team: Column) -> Column:
    """Does a name hold the team's, or the team's hold it, whatever the case?"""
    return F.exists(names, lambda n: F.contains(F.lower(n), F.lower(team)) | F.contains(F.lower(team), F.lower(n)))


def trim_periods(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"\.+$", "")


def favorite_key(league_id: Column, team_id: Column) -> Column:
    return F.concat_ws(":", league_id, team_id)


def favorite_parts(key: Column) -> Column:
    """league_id and team_id, parted at the first colon."""
    parts = F.split(key, ":", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("league_id"), F.get(parts, F.lit(1)).alias("team_id"))


# Formations that a play's text may begin with.
FORMATIONS = ("no huddle", "shotgun", "pistol", "under center")


def play_text(text: Column) -> Column:
    """A play's text without the formations in parentheses at its start and the names of tacklers in parentheses at its end; others stay.

    At the start all that the parentheses list must be formations; at the end the first that they list must be a name with an initial.
    """
    said = trim_blanks(text)
    inside = F.get(F.split(F.substring(said, F.lit(2), F.length(said)), "[)]"), F.lit(0))
    opens = said.startswith("(") & said.contains(")") & F.forall(F.split(inside, ","), lambda x: F.lower(F.trim(x)).isin(*FORMATIONS))
    said = F.when(opens, F.substring(said, F.length(inside) + 3, F.length(said))).otherwise(said)
    closed = F.when(said.endswith(".") & F.rtrim(F.left(said, F.length(said) - 1)).endswith(")"), F.left(said, F.length(said) - 1)).otherwise(said)
    closed = trim_blanks(closed)
    tail = F.element_at(F.split(closed, "[(]"), -1)  # after the last opening
    listed = F.get(F.split(tail, "[,;]"), F.lit(0))
    initial = F.get(F.split(listed, "[.]"), F.lit(0))
    named = listed.contains(".") & initial.rlike("^[A-Z]") & ~F.translate(initial, "'-", "").rlike("[^A-Za-z]")
    ends = closed.endswith(")") & closed.contains("(") & (F.instr(tail, ")") == F.length(tail)) & named
    head = trim_blanks(F.left(closed, F.length(closed) - F.length(tail) - 1))
    stopped = F.when(head.endswith("."), head).otherwise(F.concat(head, F.lit(".")))
    return trim_blanks(F.when(ends, stopped).otherwise(said))


def migrated_favorites(entries: Column, fallback_league: str) -> Column:
    """Stored favourites as keys: blanks and nulls dropped, bare ids under the fallback league, each key once, in order."""
    bare = lambda x: ~x.rlike("^[^:]+:.+$")
    kept = F.filter(F.transform(entries, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.array_distinct(F.transform(kept, lambda x: F.when(bare(x), F.concat(F.lit(f"{fallback_league}:"), x)).otherwise(x)))


def site_path(sport: Column, league_path: Column) -> Column:
    return F.concat_ws("/", sport, league_path)


def core_path(sport: Column, league_path: Column) -> Column:
    return F.concat_ws("/", sport, F.lit("leagues"), league_path)


def entity_key(sport: Column, league_path: Column, entity_id: Column) -> Column:
    """Identifiers are unique within a sport only."""
    return F.concat_ws(":", site_path(sport, league_path), entity_id)


def pool_key(league_id: Column, sport: Column, league_path: Column, team_id: Column) -> Column:
    return F.concat_ws(":", league_id, entity_key(sport, league_path, team_id))


def board_filter(group: Column) -> Column:
    """The query of a scoreboard: by group, or none."""
    return F.coalesce(F.concat(F.lit("?groups="), group.cast("string")), F.lit(""))
