from docloom.sources.documents import DOCUMENT_SCHEMA, scan_documents, scan_label_map
from docloom.sources.json_array import scan_json_array
from docloom.sources.position import with_file_position
from docloom.sources.published import published_headers, scan_pairs, scan_published
from docloom.sources.tables import scan_table
from docloom.sources.text_files import scan_text_lines, scan_tsv, scan_tsv_pair

__all__ = [
    "DOCUMENT_SCHEMA",
    "published_headers",
    "scan_documents",
    "scan_json_array",
    "scan_label_map",
    "scan_pairs",
    "scan_published",
    "scan_table",
    "scan_text_lines",
    "scan_tsv",
    "scan_tsv_pair",
    "with_file_position",
]
