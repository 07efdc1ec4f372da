"""The corpus queries, one for each operator, over whole tables."""

from __future__ import annotations

from tabloom.llm import decontaminate, langid, linededup, lmscore, merkle, mixing, oracle, pii, simhash, tokenids, toxicity
from tabloom.llm._base import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


QUERIES = {
    "op1_language_id": lambda spark, d: langid.query(_docs(spark, d)),
    "op2_pii_pseudonyms": lambda spark, d: pii.query(_docs(spark, d)),
    "op3_token_ids": lambda spark, d: tokenids.query(_docs(spark, d)),
    "op4_decontamination": lambda spark, d: decontaminate.query(_docs(spark, d), table(spark, d, "benchmark")),
    "op5_simhash_near_dedup": lambda spark, d: simhash.query(_docs(spark, d)),
    "op6_toxicity": lambda spark, d: toxicity.query(_docs(spark, d), table(spark, d, "labels")),
    "op7_source_mixing": lambda spark, d: mixing.query(_docs(spark, d)),
    "op8_merkle_fingerprints": lambda spark, d: merkle.query(_docs(spark, d)),
    "op9_lm_scoring": lambda spark, d: lmscore.query(_docs(spark, d)),
    "op10_line_dedup": lambda spark, d: linededup.query(_docs(spark, d)),
}

#: The others need trained models, a tokenizer's file, XXH64 or keyed hashes chained per character, which SQL has not.
SQL: dict[str, str] = {
    "op4_decontamination": oracle.DECONTAMINATION,
    "op7_source_mixing": oracle.MIXING,
    "op8_merkle_fingerprints": oracle.MERKLE,
    "op10_line_dedup": oracle.LINES,
}
