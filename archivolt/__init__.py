"""Deterministic, resumable archive streams planned as Spark queries."""

from .errors import (  # noqa: F401
    ArchiveError,
    ArchiveNotFoundError,
    OffsetError,
    PathLimitError,
    PathReportError,
    SnapshotError,
    VerificationError,
    VolumeStateError,
)
from .tape import Tape, TapeVolume, Volume, create, discover, exists, get_catalog, get_tape  # noqa: F401
