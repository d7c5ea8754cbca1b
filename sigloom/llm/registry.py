"""The training-data operators as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from sigloom.llm import align, bpe, chat, decontaminate, langid, linededup, pii, quality, shards, simhash, tiff, toxicity, trie


def queries():
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_langid": langid.op2_langid,
        "op3_bpe": bpe.op3_bpe,
        "op4_pii": pii.op4_pii,
        "op5_shards": shards.op5_shards,
        "op6_tiff": tiff.op6_tiff,
        "op7_quality": quality.op7_quality,
        "op8_linededup": linededup.op8_linededup,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_trie": trie.op11_trie,
        "op12_chat": chat.op12_chat,
        "op13_align": align.op13_align,
    }


def oracle_sql():
    return {
        "op5_shards": shards.OP5_SQL, "op8_linededup": linededup.OP8_SQL, "op9_decontaminate": decontaminate.OP9_SQL,
        "op11_trie": trie.OP11_SQL, "op12_chat": chat.OP12_SQL,
    }
