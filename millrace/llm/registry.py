"""Queries of the corpus operators, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, chat, decontaminate, forest, language, oracles, passages, perplexity, pieces, pii, quality, ranked, secrets, simhash

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_pieces": pieces.op2_pieces,
    "op3_secrets": secrets.op3_secrets,
    "op4_passages": passages.op4_passages,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_language": language.op6_language,
    "op7_perplexity": perplexity.op7_perplexity,
    "op8_quality": quality.op8_quality,
    "op9_chat": chat.op9_chat,
    "op10_simhash": simhash.op10_simhash,
    "op11_ranked": ranked.op11_ranked,
    "op12_forest": forest.op12_forest,
    "op13_alignment": alignment.op13_alignment,
}
#: The others are held against brute-force versions in tests/llm.
ORACLES: dict[str, str] = {"op4_passages": passages.ORACLE, "op5_decontaminate": oracles.leaks(), "op8_quality": oracles.quality(), "op9_chat": chat.ORACLE, "op11_ranked": ranked.ORACLE}
