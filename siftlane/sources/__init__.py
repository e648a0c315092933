"""Readers with fixed schemas, for batch and for streams."""

from siftlane.sources.checked import bad_lines, counted, good_rows, read_checked, split_batches, stream_checked
from siftlane.sources.readers import (
    read_calls, read_capture, read_html_files, read_listeners, read_mutations, read_pages,
    read_storage, read_stylesheets, spread, stream_capture, stream_pages,
)

__all__ = [
    "bad_lines", "counted", "good_rows", "read_calls", "read_capture", "read_checked", "read_html_files", "read_listeners", "read_mutations",
    "read_pages", "read_storage", "read_stylesheets", "split_batches", "spread",
    "stream_capture", "stream_checked", "stream_pages",
]
