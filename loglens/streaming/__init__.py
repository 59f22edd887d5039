"""The same event work as Structured Streaming."""

from .enrich import corrected, enrich_arriving
from .jobs import (
    append_partials,
    first_copies,
    latest_windows,
    merge_copies,
    merge_partials,
    read_stream,
    run_to_files,
    stream_dedupe,
    stream_enrich,
    window_totals,
    windowed_counts,
    workgroup_cells,
    write_windows,
)
from .merged import MergedTable, cells_by, counts_by

__all__ = [name for name in dir() if not name.startswith("_")]
