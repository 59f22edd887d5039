"""Sources: audit files, export bundles, execution statistics."""

from .audit_files import ORG_ACCOUNT, audit_file_problems, audit_paths, read_audit_files
from .audit_scan import audit_problems, audit_records, scan_audit_files, scan_org_audit_files
from .bundles import read_bundle_members, read_export_bundles
from .execution_stats import read_execution_stats
from .zip_index import bundle_index, read_indexed_members

__all__ = [
    "ORG_ACCOUNT", "audit_file_problems", "audit_paths", "audit_problems", "audit_records", "bundle_index", "read_audit_files", "read_bundle_members", "read_export_bundles", "read_execution_stats",
    "read_indexed_members", "scan_audit_files", "scan_org_audit_files",
]
