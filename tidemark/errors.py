"""Typed errors of the engine."""


class SyncError(Exception):
    """Any failure of the engine."""


class IoError(SyncError):
    """Storage is missing or unreadable, or holds what it shouldn't."""


class ConflictError(SyncError):
    """Someone else changed the resource."""


class ConflictNeedsResolution(ConflictError):
    """Both sides changed and the policy is to ask."""


class CorruptError(SyncError):
    """Bytes don't hash to their address."""


class RetryExhausted(SyncError):
    """Every attempt to append collided."""


class SerdeError(SyncError):
    """Stored data can't be decoded."""
