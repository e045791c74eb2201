"""Errors of a store."""


class StoreError(Exception):
    """Any failure of a store."""


class SegmentOpenError(StoreError):
    """A segment file is missing or unreadable."""

    def __init__(self, path: str, reason: str) -> None:
        super().__init__(f"segment {path}: {reason}")
        self.path, self.reason = path, reason


class SegmentError(StoreError):
    """A segment's content is not what its format asks for."""


class InvalidRootPath(StoreError):
    """The store's root is not a usable directory."""


class SegmentPathError(StoreError):
    """A manifest names a segment outside the store."""


class StoreIOError(StoreError):
    """The file system refused an operation."""


class ManifestError(StoreError):
    """The manifest is broken or an operation on it is not allowed."""


class LogError(StoreError):
    """A write-ahead log is damaged before its end."""


class LockedError(StoreError):
    """Another writer has the store open."""
