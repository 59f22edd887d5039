"""Sinks: CSV and text reports, log lines, summary and event tables."""

from .reports import (
    csv_rows,
    metric_log_lines,
    workgroup_report_lines,
    write_lines,
    write_workgroup_csv,
)
from .tables import dated_path, write_event_tables, write_summary_cells, write_summary_tables

__all__ = [
    "csv_rows",
    "dated_path",
    "metric_log_lines",
    "workgroup_report_lines",
    "write_event_tables",
    "write_lines",
    "write_summary_cells",
    "write_summary_tables",
    "write_workgroup_csv",
]
