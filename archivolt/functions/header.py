"""The 512-byte entry header as a hex Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MAX_OCTAL_SIZE
from .paths import ustar_split


def _or_error(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def octal_field(value: Column, width: int) -> Column:
    """width - 1 zero-filled octal digits and a NUL, in hex; a negative or too large value is an error."""
    v = value.cast("long")
    text = F.concat(F.hex(F.lpad(F.conv(v.cast("string"), 10, 8), width - 1, "0")), F.lit("00"))
    return _or_error((v >= 0) & (v < 8 ** (width - 1)), text, f"number does not fit an octal field of {width} bytes")


def size_field(size: Column) -> Column:
    """Octal up to 8 GiB - 1, beyond that a marker byte and eleven big-endian bytes."""
    return F.when(size.cast("long") <= MAX_OCTAL_SIZE, octal_field(F.least(size.cast("long"), F.lit(MAX_OCTAL_SIZE)), 12)).otherwise(F.concat(F.lit("80"), F.lpad(F.hex(size.cast("long")), 22, "0")))


def text_field(text: Column, width: int) -> Column:
    ok = F.octet_length(text) <= width
    return _or_error(ok, F.rpad(F.hex(F.encode(text, "UTF-8")), 2 * width, "0"), f"text too long for field of {width} bytes")


def set_bytes(block: Column, offset: int, data: Column) -> Column:
    """A block (hex) with data (hex) written over it from a byte offset on; what would reach beyond the block is an error."""
    fits = (F.lit(offset) >= 0) & (2 * offset + F.char_length(data) <= F.char_length(block))
    return _or_error(fits, F.overlay(block, data, F.lit(2 * offset + 1)), "bytes reach beyond the block")


def byte_sum(hexed: Column) -> Column:
    """Sum of the bytes of a non-empty hex string."""
    return F.aggregate(F.sequence(F.lit(1), F.char_length(hexed), F.lit(2)), F.lit(0).cast("long"), lambda a, i: a + F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long"))


def stored_path(arc_path: Column, is_dir: Column) -> Column:
    return F.when(is_dir, F.concat(arc_path, F.lit("/"))).otherwise(arc_path)


def header_parts(e: dict[str, Column]) -> tuple[Column, Column]:
    """The hex before and after the checksum field."""
    name, prefix = ustar_split(stored_path(e["arc_path"], e["is_dir"]))
    name = F.coalesce(name, F.raise_error(F.lit("path cannot be split")).cast("string"))
    before = F.concat(text_field(name, 100), octal_field(e["mode"], 8), octal_field(e["uid"], 8), octal_field(e["gid"], 8), size_field(e["size"]), octal_field(e["mtime"], 12))
    kind = F.when(e["is_dir"], "35").when(e["is_symlink"], "32").otherwise("30")
    link = F.when(e["is_symlink"], e["linkname"]).otherwise(F.lit(""))
    after = F.concat(kind, text_field(link, 100), F.lit("7573746172003030"), text_field(e["uname"], 32), text_field(e["gname"], 32), F.lit("00" * 16), text_field(prefix, 155), F.lit("00" * 12))
    return before, after


HEADER_COLUMNS = ("arc_path", "size", "mtime", "mode", "uid", "gid", "uname", "gname", "is_dir", "is_symlink", "linkname")


def filled_bytes(e: dict[str, Column]) -> Column:
    """The hex of a header's fields without their padding, which adds nothing to the checksum."""
    name, prefix = ustar_split(stored_path(e["arc_path"], e["is_dir"]))
    link = F.when(e["is_symlink"], e["linkname"]).otherwise(F.lit(""))
    kind = F.when(e["is_dir"], "35").when(e["is_symlink"], "32").otherwise("30")
    texts = [F.hex(F.encode(x, "UTF-8")) for x in (name, prefix, link, e["uname"], e["gname"])]
    numbers = [octal_field(e["mode"], 8), octal_field(e["uid"], 8), octal_field(e["gid"], 8), size_field(e["size"]), octal_field(e["mtime"], 12)]
    return F.concat(*texts, *numbers, kind, F.lit("7573746172003030"))


def header_checksum(e: dict[str, Column]) -> Column:
    """Sum of the header's bytes, the checksum field read as eight spaces."""
    return F.transform(F.array(filled_bytes(e)), byte_sum)[0] + 8 * 32


def header_hex(e: dict[str, Column]) -> Column:
    before, after = header_parts(e)

    def whole(p: Column) -> Column:
        total = byte_sum(p["filled"]) + 8 * 32
        return F.lower(F.concat(p["before"], F.hex(F.lpad(F.conv(total.cast("string"), 10, 8), 6, "0")), F.lit("0020"), p["after"]))

    return F.transform(F.array(F.struct(before.alias("before"), after.alias("after"), filled_bytes(e).alias("filled"))), whole)[0]


def entry_columns(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(prefix + c) for c in HEADER_COLUMNS}
