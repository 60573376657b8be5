from .csv import header_catalogue, header_of, normalize_headers, read_csv, read_parts, scan_csv, union_all, unique_headers
from .files import admit_files, delimiter_of, detect_delimiters
from .sinks import export_cast, export_csv, export_json
from .column_types import apply_types, common_types, infer_types, inferred_types
from .heads import file_heads

__all__ = [
    "admit_files", "apply_types", "common_types", "delimiter_of", "detect_delimiters", "export_cast",
    "export_csv", "export_json", "file_heads", "header_catalogue", "header_of", "infer_types", "inferred_types",
    "normalize_headers", "read_csv", "read_parts", "scan_csv", "union_all", "unique_headers",
]
