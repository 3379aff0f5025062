"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, license_scan, lm_score, mixing, near_dedup, periodic_runs, phrases, quality_classifier, quality_rules, secret_scan, token_counts, toxicity, warc


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_warc": warc.op2_warc,
        "op3_lm_score": lm_score.op3_lm_score,
        "op4_license_scan": license_scan.op4_license_scan,
        "op5_mixing": mixing.op5_mixing,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_quality_classifier": quality_classifier.op9_quality_classifier,
        "op10_secret_scan": secret_scan.op10_secret_scan,
        "op11_periodic_runs": periodic_runs.op11_periodic_runs,
        "op12_toxicity": toxicity.op12_toxicity,
        "op13_phrases": phrases.op13_phrases,
    }


def oracle_sql() -> dict:
    return {
        "op2_warc": warc.SQL,
        "op5_mixing": mixing.mixing_sql("documents"),
        "op13_phrases": phrases.phrases_sql(),
    }
