"""Writers.  All overwrite their target in full."""

from siftlane.sinks.documents import read_documents, read_manifest, write_lines
from siftlane.sinks.writers import (
    write_catalogs, write_dom, write_edges, write_endpoint_map, write_listeners, write_network_log,
    write_openapi, write_pages, write_report, write_traces,
)

__all__ = [
    "read_documents", "read_manifest", "write_catalogs", "write_dom", "write_edges", "write_endpoint_map", "write_lines",
    "write_listeners", "write_network_log", "write_openapi", "write_pages", "write_report",
    "write_traces",
]
