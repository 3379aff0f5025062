"""Claim classification of headlines: reported, rumor or take, with the basis of the label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T

#: The lists of phrases that a lexicon has; callers bring them.
LISTS = ("takes", "evaluative", "completed", "rumors", "service")


def features(lexicon: dict) -> dict[str, Column]:
    """Boolean columns that the label is decided by; quoted passages count only where said."""
    title = F.coalesce("title", F.lit(""))
    bare, description = T.strip_quotes(title), F.coalesce("description", F.lit(""))
    has = lambda c, name: T.contains_any(c, list(lexicon[name]))
    return {
        "is_take": has(bare, "takes"),
        "is_evaluative": has(bare, "evaluative"),
        "is_completed": has(bare, "completed"),
        "is_rumor": has(bare, "rumors") | has(description, "rumors"),
        "is_question": F.rtrim(title).endswith("?") & ~F.rtrim(title).rlike("""[?]["'”’]$""") & ~has(title, "service"),
    }


def local_claim(lexicon: dict) -> Column:
    """struct(type, basis): a take, else completed and unjudged, else a rumor, else a question, else reported by default."""
    f = features(lexicon)
    label = lambda kind, basis="evidence": F.struct(F.lit(kind).alias("type"), F.lit(basis).alias("basis"))
    return (
        F.when(f["is_take"], label("take")).when(~f["is_evaluative"] & f["is_completed"], label("reported")).when(f["is_rumor"], label("rumor")).when(f["is_question"], label("take")).otherwise(label("reported", "default"))
    )


def merged_claim(remote: Column, lexicon: dict) -> Column:
    """Local evidence wins, else the remote label, else unlabeled."""
    local = local_claim(lexicon)
    return F.when(local["basis"] == "evidence", local["type"]).otherwise(F.coalesce(remote, F.lit("unlabeled")))


def of_claim(articles: DataFrame, wanted: str) -> DataFrame:
    return articles if wanted == "all" else articles.where(F.col("claim_type") == wanted)


def label_of(code: Column, labels: dict) -> Column:
    out = F.lit("Unlabeled")
    for k, v in labels.items():
        out = F.when(code == F.lit(k), F.lit(v)).otherwise(out)
    return out


def disagreement(verdict_kind: Column, kept_locally: Column) -> Column:
    """Which way a verdict and the local rules part; null if they agree or there is no verdict."""
    return F.when(verdict_kind.isNull(), None).when(
        (verdict_kind == "news") & ~kept_locally, F.lit("verdict keeps")
    ).when((verdict_kind != "news") & kept_locally, F.lit("verdict drops"))
