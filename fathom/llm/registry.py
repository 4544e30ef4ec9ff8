"""Queries of this subpackage and their DuckDB SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import ann, hardneg, html, langid, lm, mixing, neardup, packing, pit, secrets, spotsigs, substring, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": urlfilter.op1_url_filter,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_language_id": langid.op4_language_id,
    "op5_spotsigs_fingerprints": spotsigs.op5_spotsigs_fingerprints,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_nearest_neighbours": ann.op7_nearest_neighbours,
    "op8_pack_lengths": packing.op8_pack_lengths,
    "op9_near_duplicates": neardup.op9_near_duplicates,
    "op10_main_text": html.op10_main_text,
    "op11_point_in_time_join": pit.op11_point_in_time_join,
    "op12_lm_scores": lm.op12_lm_scores,
    "op13_hard_negatives": hardneg.op13_hard_negatives,
}
#: The others are tested against brute force: SQL cannot express them, or not on whole tables.
ORACLES: dict[str, str] = {
    "op1_url_filter": urlfilter.ORACLE,
    "op2_substring_dedup": substring.ORACLE,
    "op3_mix_sources": mixing.ORACLE,
    "op6_secret_scan": secrets.ORACLE,
    "op11_point_in_time_join": pit.ORACLE,
    "op13_hard_negatives": hardneg.ORACLE,
}
