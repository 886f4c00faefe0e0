"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from assaylake.llm import alignment, bytebpe, decontam, fingerprint, hardneg, langid, minhash, mixing, quality, secrets, tokens, toxicity, warc

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_langid": langid.op2_langid,
    "op3_minhash": minhash.op3_minhash,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_tokens": tokens.op5_tokens,
    "op6_fingerprint": fingerprint.op6_fingerprint,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_warc": warc.op8_warc,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality": quality.op10_quality,
    "op11_bytebpe": bytebpe.op11_bytebpe,
    "op12_hardneg": hardneg.op12_hardneg,
    "op13_alignment": alignment.op13_alignment,
}

ORACLE_SQL = {
    "op1_secrets": secrets.ORACLE,
    "op3_minhash": minhash.ORACLE,
    "op8_warc": warc.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op12_hardneg": hardneg.ORACLE,
}
