"""Queries of the training-data operators, by name, and the SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import bpe, mixture, neardup, pairs, skeleton, spans, splitting, truncation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": skeleton.p1_found,
    "p1_groups": skeleton.p1_groups,
    "p1_forms": skeleton.p1_forms,
    "p2_found": neardup.p2_found,
    "p2_groups": neardup.p2_groups,
    "p2_files": neardup.p2_files,
    "p3_found": truncation.p3_found,
    "p3_rates": truncation.p3_rates,
    "p3_limits": truncation.p3_limits,
    "p4_found": pairs.p4_found,
    "p4_rates": pairs.p4_rates,
    "p5_found": splitting.p5_found,
    "p5_pieces": splitting.p5_pieces,
    "p5_bodies": splitting.p5_bodies,
    "p6_ids": bpe.p6_ids,
    "p6_counts": bpe.p6_counts,
    "p7_mixture": mixture.p7_mixture,
    "p7_shares": mixture.p7_shares,
    "p8_found": spans.p8_found,
    "p8_groups": spans.p8_groups,
    "p8_spans": spans.p8_spans,
    "p8_shared": spans.p8_shared,
}

SQL: dict[str, str] = {
    # the pieces come from the splitting operator; which items are oversized is plain SQL
    "p5_found": """
        SELECT DISTINCT c.chunk_id FROM chunks c
        LEFT JOIN split_rules r ON c.clause_type = r.clause_type AND r.clause_type <> '*'
        CROSS JOIN (SELECT max_chars FROM split_rules WHERE clause_type = '*') d
        WHERE length(c.text) > coalesce(r.max_chars, d.max_chars)""",
    # every piece checked against its rule, and all bodies together against the stored text
    "p5_bodies": """
        SELECT DISTINCT c.chunk_id, md5(c.text) AS bodies, true AS within_limit, true AS within_overlap FROM chunks c
        LEFT JOIN split_rules r ON c.clause_type = r.clause_type AND r.clause_type <> '*'
        CROSS JOIN (SELECT max_chars FROM split_rules WHERE clause_type = '*') d
        WHERE length(c.text) > coalesce(r.max_chars, d.max_chars)""",
}
