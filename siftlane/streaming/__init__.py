"""The operators on Structured Streaming."""

from siftlane.streaming.event_time import late_events, ordered_pages_stream
from siftlane.streaming.lineage import lineage_stream, settle_lineage
from siftlane.streaming.online import (
    catalog_stream, changed_pages_stream, drain, drop_late, settle_catalog, use_rocksdb,
)
from siftlane.streaming.samples import first_samples_stream, response_samples_stream, settle_samples

__all__ = ["catalog_stream", "changed_pages_stream", "drain", "drop_late",
           "first_samples_stream", "late_events", "lineage_stream", "ordered_pages_stream", "response_samples_stream",
           "settle_catalog", "settle_lineage", "settle_samples", "use_rocksdb"]
