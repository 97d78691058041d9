"""Fixed values of the format and the defaults."""

# Fixed values
BLOCK = 512
FOOTER = 1024
MAX_OCTAL_SIZE = 8589934591
NAME_BYTES = 100
PREFIX_BYTES = 155
PATH_BYTES = 255
TRUNCATE_BYTES = 85
TRUNCATE_HASH = 14
DEFAULT_EXCLUDES = [".DS_Store", "Thumbs.db", "__pycache__", "*.db-wal", "*.db-shm", "*.sock"]
SAMPLE_ROWS = 15
CACHE_MAX_FILES = 10
CACHE_MAX_BYTES = 1024 * 1024 * 1024
CACHE_FLUSH_BYTES = 100 * 1024 * 1024
READ_BYTES = 64 * 1024
# Our own
META_DIR = ".archivolt"
#: Longest piece of a body in one block row.
PIECE = 4 << 20
REPORT_ROWS = 50
