"""What can go wrong. Path and offset errors are ValueErrors, volume state errors are IOErrors."""


class ArchiveError(Exception):
    """Base of all."""


class SnapshotError(ArchiveError):
    """The source no longer matches its recorded snapshot."""


class ArchiveNotFoundError(ArchiveError, FileNotFoundError):
    """There is no recorded archive."""


class PathLimitError(ArchiveError, ValueError):
    """A path can't be stored."""


class PathReportError(PathLimitError):
    """All paths of a source that can't be stored."""


class OffsetError(ArchiveError, ValueError):
    """A byte offset or window outside the stream."""


class VolumeStateError(ArchiveError, IOError):
    """I/O on a closed volume."""


class VerificationError(ArchiveError):
    """An unexpected error while verifying."""
