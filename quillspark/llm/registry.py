"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from quillspark.llm import bpe, decontaminate, embed_dedup, line_dedup, secret_scan, simhash, substring_dedup, token_count, token_files, toxicity


def queries() -> dict:
    """One query for each operator, over its whole table."""
    return {
        "op1_token_counts": token_count.op1_token_counts,
        "op6_token_files": token_files.op6_token_files,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op4_secret_scan": secret_scan.op4_secret_scan,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op3_embedding_dedup": embed_dedup.op3_embedding_dedup,
        "op2_toxicity": toxicity.op2_toxicity,
        "op10_simhash": simhash.op10_simhash,
        "op7_decontamination": decontaminate.op7_decontamination,
    }


def oracle_sql() -> dict:
    """DuckDB SQL by query name."""
    return {
        "op3_embedding_dedup": embed_dedup.OP3_SQL,
        "op4_secret_scan": secret_scan.OP4_SQL,
        "op5_substring_dedup": substring_dedup.OP5_SQL,
        "op7_decontamination": decontaminate.OP7_SQL,
        "op9_line_dedup": line_dedup.OP9_SQL,
    }
