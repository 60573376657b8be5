from .jobs import (
    audit_document,
    audit_report,
    evaluate_mapping,
    execute_matching,
    execute_validation,
    profile_table,
    skipped_columns,
    validation_detail_counts,
    validation_details,
)

__all__ = [
    "audit_document", "audit_report", "evaluate_mapping", "execute_matching",
    "execute_validation", "profile_table", "skipped_columns", "validation_detail_counts", "validation_details",
]
