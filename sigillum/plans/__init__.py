from .release import audit_files, audit_inventory

__all__ = ["audit_files", "audit_inventory"]
