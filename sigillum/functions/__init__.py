from .digests import digest, digest_of_path, sha256

__all__ = ["digest", "digest_of_path", "sha256"]
