"""Queries against their SQL, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from slipmill.plans import queries, records  # noqa: F401  records adds its queries

FAST = ["v2_fields", "v2_noisy_fields", "v2_items", "v2_deductions", "quality_fields", "quality_deductions", "quality_items", "quality_item_forms", "quality_vouchers", "supplier_spend", "receipts_published_twice", "batch_counters", "header_diffs", "best_values", "voted_attempts", "suggested_crops", "calibration", "streamed_counters", "clean_blanks", "v1_fields", "base_items", "region_deductions", "deduplicated_deductions", "compared_modes", "structure_quality", "neighbour_model", "fixed_names", "split_merged_dates", "corrected_lines", "suggested_sizes", "last_patterns", "recovered", "supplier_contexts", "validated_fields", "region_items", "backup_fields", "replaced_items", "reprocessed_batch", "shown_vouchers", "validated_totals", "kept_items", "deduction_examples", "feedback_examples", "image_quality", "cross_checked", "error_tallies", "duplicate_files", "last_feedback", "crop_annotations", "streamed_once", "text_quality", "applied_substitutions", "line_votes", "batch_vouchers", "unbroken_vouchers", "replayed_stream", "checked_totals", "frequent_tokens", "receipt_coverage", "best_parser", "small_boxes", "rule_cases", "amount_forms", "correction_steps", "page_after_page", "learned_items", "learned_deductions", "reprocessed_learned", "voucher_suggestions", "validated_items", "robust_path", "corrected_terms", "corrected_decimals", "anchors", "enhanced_totals", "backup_noisy_fields", "field_confidence_cases"]


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    r = con.execute(queries.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted(str([plain(row[names.index(c)]) for c in cols]) for row in r.fetchall())
    assert sorted(str([plain(row[c]) for c in cols]) for row in df.collect()) == want
