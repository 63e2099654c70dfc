"""Shared storage, as in the rest of the library."""

from rankloom.storage import kept, new_path, remove, shared_dir, small, written

__all__ = ["kept", "new_path", "remove", "shared_dir", "small", "written"]
