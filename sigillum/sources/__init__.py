from .files import digest_files, list_files
from .manifest import entries, parse_manifest, read_manifest

__all__ = ["digest_files", "entries", "list_files", "parse_manifest", "read_manifest"]
