from .folding import ascii_fold
from .missing import NULL_TEXT, NULL_TOKENS, fold_nan, is_float, is_missing, null_tokens_to_null
from .names import field, fields, quoted, typed
from .numeric import (
    INTEGER_TEXT,
    NUMBER_TEXT,
    PASS_THRESHOLD,
    fixed_text,
    is_close,
    percentage,
    percentage_text,
    text_to_double,
    threshold_status,
    to_numeric,
)
from .regex import java_pattern, match_at_start
from .text import stringify, strip, text_equal_ci, text_or_null

__all__ = [
    "INTEGER_TEXT", "NULL_TEXT", "NULL_TOKENS", "NUMBER_TEXT", "PASS_THRESHOLD", "ascii_fold",
    "field", "fields", "fixed_text", "fold_nan", "is_close", "is_float", "is_missing", "java_pattern", "match_at_start",
    "null_tokens_to_null", "percentage", "percentage_text", "quoted", "stringify", "strip",
    "text_equal_ci", "text_or_null", "text_to_double", "threshold_status", "to_numeric",
    "typed",
]
