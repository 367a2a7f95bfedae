from docloom.sinks.files import write_gzip, write_json_arrays, write_metrics_json, write_text_lines, write_tsv_pair
from docloom.sinks.publish import header_rows, publish_layout, publish_view, single_files

__all__ = [
    "header_rows",
    "publish_layout",
    "publish_view",
    "single_files",
    "write_gzip",
    "write_json_arrays",
    "write_metrics_json",
    "write_text_lines",
    "write_tsv_pair",
]
