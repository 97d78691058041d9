"""Path expressions: byte limits, truncation, the two-part split, glob exclusion."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import META_DIR, NAME_BYTES, PATH_BYTES, PREFIX_BYTES, TRUNCATE_BYTES, TRUNCATE_HASH


def components(path: Column) -> Column:
    return F.split(path, "/", -1)


def truncate_component(part: Column, most: int = NAME_BYTES) -> Column:
    """A component of over `most` bytes becomes its longest whole-character prefix, an underscore and a digest of it all."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(TRUNCATE_BYTES)), lambda k: F.octet_length(F.left(part, k)) <= TRUNCATE_BYTES)
    short = F.concat(F.left(part, F.array_max(fits)), F.lit("_"), F.left(F.md5(F.encode(part, "UTF-8")), F.lit(TRUNCATE_HASH)))
    return F.when(F.octet_length(part) > most, short).otherwise(part)


def truncate_path(path: Column) -> Column:
    return F.array_join(F.transform(components(path), lambda c: truncate_component(c)), "/")


def split_cuts(path: Column) -> Column:
    """1-based places of the slashes that part a path into a prefix and a name that fit."""
    return F.filter(
        F.sequence(F.lit(1), F.greatest(F.char_length(path), F.lit(1))),
        lambda i: (F.substring(path, i, F.lit(1)) == "/") & (i < F.char_length(path)) & (F.octet_length(F.left(path, i - 1)) <= PREFIX_BYTES) & (F.octet_length(F.substring(path, i + 1, F.char_length(path))) <= NAME_BYTES),
    )


def ustar_split(path: Column) -> tuple[Column, Column]:
    """(name, prefix): whole where it fits, else cut at the rightmost possible slash; both null where there is none."""
    cut = F.try_element_at(split_cuts(path), F.lit(-1))
    whole = F.octet_length(path) <= NAME_BYTES
    return F.when(whole, path).otherwise(F.substring(path, cut + 1, F.char_length(path))), F.when(whole, F.lit("")).otherwise(F.left(path, cut - 1))


def path_violation(path: Column, is_dir: Column | None = None) -> Column:
    """Why a path can't be stored, or null: total length first, then a component, then the split of what the header holds."""
    stored = path if is_dir is None else F.when(is_dir, F.concat(path, F.lit("/"))).otherwise(path)
    return (
        F.when(F.octet_length(path) > PATH_BYTES, "path too long")
        .when(F.exists(components(path), lambda c: F.octet_length(c) > NAME_BYTES), "component too long")
        .when(ustar_split(stored)[0].isNull(), "path cannot be split")
    )


def glob_regex(pattern: str) -> str:
    """A regex for a shell pattern matched against the last components of a relative path; * and ? stay inside a component."""
    out, i, p = "", 0, pattern
    while i < len(p):
        c = p[i]
        if c == "*":
            while i + 1 < len(p) and p[i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (j := p.find("]", i + 2)) > 0:
            body = p[i + 1 : j].replace("\\", "\\\\")
            out += "[" + ("^/" + body[1:] if body[0] == "!" else body.replace("^", "\\^", 1) if body[0] == "^" else body) + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return ("^" if pattern.startswith("/") else "(^|/)") + out + "$"


def excluded_itself(rel_path: Column, patterns: Sequence[str]) -> Column:
    hit = F.array_contains(components(rel_path), META_DIR)
    for p in patterns:
        hit = hit | rel_path.rlike(glob_regex(p))
    return hit


def excluded(rel_path: Column, patterns: Sequence[str]) -> Column:
    """Whether a path or any folder above it is excluded; the root ('') never is."""
    parts = components(rel_path)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return (rel_path != "") & F.exists(above, lambda p: excluded_itself(p, patterns))


def as_patterns(exclude) -> list[str]:
    """A pattern or any sequence of them as a list."""
    return [exclude] if isinstance(exclude, str) else list(exclude)
