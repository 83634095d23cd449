"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import (
    bpe,
    decontamination,
    extraction,
    fill_in_middle,
    line_dedup,
    neighbours,
    ngram_join,
    periodic_runs,
    quality,
    quality_rules,
    secrets,
    toxicity,
    wordpiece,
)

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_secret_scan": secrets.query,
    "op2_neighbours": neighbours.query,
    "op3_bpe": bpe.query,
    "op4_line_dedup": line_dedup.query,
    "op5_quality": quality.query,
    "op6_toxicity": toxicity.query,
    "op7_token_counts": wordpiece.query,
    "op8_extraction": extraction.query,
    "op9_decontamination": decontamination.query,
    "op10_ngram_join": ngram_join.query,
    "op11_quality_rules": quality_rules.query,
    "op12_fill_in_middle": fill_in_middle.query,
    "op13_periodic_runs": periodic_runs.query,
}
ORACLES: dict[str, str] = {
    "op4_line_dedup": line_dedup.ORACLE,
    "op11_quality_rules": quality_rules.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
}
