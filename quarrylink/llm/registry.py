"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from quarrylink.llm import decontam, linededup, lm, media, packing, quality, simhash, toxicity, urls, warc

QUERIES = {
    "op1_lm_scoring": lm.query,
    "op2_line_dedup": linededup.query,
    "op3_decontamination": decontam.query,
    "op4_media_columns": media.query,
    "op5_packing": packing.query,
    "op6_url_filters": urls.query,
    "op7_simhash": simhash.query,
    "op8_toxicity": toxicity.query,
    "op9_quality": quality.query,
    "op10_warc": warc.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_lm_scoring": lm.ORACLE,
    "op2_line_dedup": linededup.ORACLE,
    "op3_decontamination": decontam.ORACLE,
}
