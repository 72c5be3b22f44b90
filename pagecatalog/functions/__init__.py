from pagecatalog.functions.arrays import array_to_json, join_array, split_text
from pagecatalog.functions.text import clean
from pagecatalog.functions.urls import (
    capture_key,
    host_of,
    query_url,
    record_id,
    resolve_url,
    site_root,
)

__all__ = [
    "array_to_json", "capture_key", "clean", "host_of",
    "join_array", "query_url", "record_id", "resolve_url", "site_root", "split_text",
]
