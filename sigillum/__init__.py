"""Integrity of published artifacts, checked with Spark."""

from .functions import digest, digest_of_path
from .operators import audit, audit_summary, crosscheck
from .plans import audit_files, audit_inventory
from .sources import digest_files, entries, list_files, parse_manifest, read_manifest

__all__ = [
    "audit",
    "audit_files",
    "audit_inventory",
    "audit_summary",
    "crosscheck",
    "digest",
    "digest_files",
    "digest_of_path",
    "entries",
    "list_files",
    "parse_manifest",
    "read_manifest",
]
