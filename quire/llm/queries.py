"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from quire.llm import bpe, langid, linededup, lm, neardup, packing, quality, rangecoder, secrets, topk


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_quality": quality.op2_quality,
        "op3_token_ids": rangecoder.op3_token_ids,
        "op4_linededup": linededup.op4_linededup,
        "op5_langid": langid.op5_langid,
        "op6_minhash": neardup.op6_minhash,
        "op7_secrets": secrets.op7_secrets,
        "op8_topk": topk.op8_topk,
        "op9_lm": lm.op9_lm,
        "op10_packing": packing.op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_linededup": linededup.SQL, "op7_secrets": secrets.sql()}
