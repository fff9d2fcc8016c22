"""The queries of this subpackage by name, and their DuckDB SQL."""

from __future__ import annotations

from quarry.llm import bpe, decontaminate, html, jaccard, katz, langid, rollups, secrets, topk, warc

_QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_secret_scans": secrets.op2_secret_scans,
    "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
    "op4_warc": warc.op4_warc,
    "op5_html_extraction": html.op5_html_extraction,
    "op6_language_id": langid.op6_language_id,
    "op7_exact_topk": topk.op7_exact_topk,
    "op8_bpe": bpe.op8_bpe,
    "op9_lm_scoring": katz.op9_lm_scoring,
    "op10_token_counts": rollups.op10_token_counts,
}
_ORACLES: dict[str, str] = {"op3_ngram_jaccard": jaccard.OP3_SQL, "op4_warc": warc.OP4_SQL, "op7_exact_topk": topk.OP7_SQL, "op10_token_counts": rollups.OP10_SQL}


def queries() -> dict:
    import corpus_pipeline

    return {**_QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return {**_ORACLES, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
