"""Column functions."""

from .columns import bucket_hash, combiners, edge_parts, range_owner

__all__ = ["bucket_hash", "combiners", "edge_parts", "range_owner"]
