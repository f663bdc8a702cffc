"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontamination, langid, license_scan, line_dedup, media, mixing, ngram_join, sharding, suffix_dedup, toxicity


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_mixing": mixing.op1,
        "op2_ngram_join": ngram_join.op2,
        "op3_line_dedup": line_dedup.op3,
        "op4_toxicity": toxicity.op4,
        "op5_language": langid.op5,
        "op6_media": media.op6,
        "op7_suffix_dedup": suffix_dedup.op7,
        "op8_license": license_scan.op8,
        "op9_sharding": sharding.op9,
        "op10_decontamination": decontamination.op10,
        "pipeline": pipeline,
    }


def oracle_sql():
    return {"op1_mixing": mixing.SQL, "op3_line_dedup": line_dedup.SQL}
