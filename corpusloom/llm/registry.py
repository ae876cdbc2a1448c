"""The queries of this package and their SQL counterparts."""

from __future__ import annotations

from corpusloom.llm import bpe, chat, decontaminate, fim, hotjoin, langid, media, minhash, sharding, suffix_dedup, tokencount, urlfilter, warc


def queries() -> dict:
    return {
        "op1_urlfilter": urlfilter.op1_urlfilter,
        "op2_minhash": minhash.op2_minhash,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_bpe": bpe.op4_bpe,
        "op5_langid": langid.op5_langid,
        "op6_chat": chat.op6_chat,
        "op7_sharding": sharding.op7_sharding,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_warc": warc.op9_warc,
        "op10_media": media.op10_media,
        "op11_tokencount": tokencount.op11_tokencount,
        "op12_hotjoin": hotjoin.op12_hotjoin,
        "op13_fim": fim.op13_fim,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_urlfilter": urlfilter.ORACLE, "op3_decontaminate": decontaminate.ORACLE, "op6_chat": chat.ORACLE, "op9_warc": warc.ORACLE, "op12_hotjoin": hotjoin.ORACLE, "op13_fim": fim.ORACLE}
