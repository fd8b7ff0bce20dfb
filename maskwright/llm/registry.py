"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from maskwright.llm import bpe, decontam, embeddings, langid, licenses, secrets, sharding, simhash, substrings, toxicity

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_repeats": substrings.op2_repeats,
    "op3_licenses": licenses.op3_licenses,
    "op4_language": langid.op4_language,
    "op5_decontamination": decontam.op5_decontamination,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_bpe": bpe.op7_bpe,
    "op8_embeddings": embeddings.op8_embeddings,
    "op9_secrets": secrets.op9_secrets,
    "op10_byte_shards": sharding.op10_byte_shards,
}
SQL = decontam.SQL | licenses.SQL | secrets.SQL | sharding.SQL
