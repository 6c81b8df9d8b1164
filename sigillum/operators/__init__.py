from .audit import audit, audit_summary
from .crosscheck import crosscheck, published_digests

__all__ = ["audit", "audit_summary", "crosscheck", "published_digests"]
