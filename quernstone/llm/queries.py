"""The thin opN queries and their SQL, where SQL can express them."""

from __future__ import annotations

from quernstone.llm import audit, chat, decontam, langid, mixing, phrases, pieces, pii, quality, sharding, simhash, toxicity, urlfilter


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_quality": quality.op2_quality,
        "op3_mixing": mixing.op3_mixing,
        "op4_decontamination": decontam.op4_decontamination,
        "op5_pii": pii.op5_pii,
        "op6_chat": chat.op6_chat,
        "op7_url_filters": urlfilter.op7_url_filters,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_language_id": langid.op9_language_id,
        "op10_simhash": simhash.op10_simhash,
        "op11_collocations": phrases.op11_collocations,
        "op12_filter_audit": audit.op12_filter_audit,
        "op13_sentencepiece": pieces.op13_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality": quality.ORACLE_SQL,
        "op3_mixing": mixing.ORACLE_SQL,
        "op6_chat": chat.ORACLE_SQL,
        "op7_url_filters": urlfilter.ORACLE_SQL,
        "op11_collocations": phrases.ORACLE_SQL,
        "op12_filter_audit": audit.ORACLE_SQL,
    }
