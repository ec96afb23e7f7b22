"""Cutting lineage through the shared folder, as the rest of the library does."""

from ..store import shared_dir, written

__all__ = ["shared_dir", "written"]
