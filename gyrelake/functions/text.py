"""Path, name and identifier rules as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File names that some systems reserve.
RESERVED = ["CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".tif", ".tiff"]


def path_problem(path: Column) -> Column:
    """Why a relative path is unsafe, null when it is safe; rules on the whole path come first."""
    p = F.trim(path)
    parts = F.split(p, "/")
    reason = F.when(p.isNull() | (p == ""), "empty")
    reason = reason.when(p.contains("\\"), "backslash").when(p.startswith("/"), "absolute").when(p.rlike("^[A-Za-z]:"), "drive")
    reason = reason.when(F.exists(parts, lambda x: x.isin("", ".", "..")), "part")
    reason = reason.when(F.exists(parts, lambda x: x.endswith(" ") | x.endswith(".")), "trailing")
    reason = reason.when(F.exists(parts, lambda x: x.rlike('[<>:"|?*\\x00-\\x1F]')), "character")
    return reason.when(F.exists(parts, lambda x: F.upper(F.substring_index(x, ".", 1)).isin(*RESERVED)), "reserved")


def identifier_ok(value: Column) -> Column:
    return value.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z") & (F.length(value) <= 128)


def checksum_ok(value: Column) -> Column:
    return F.lower(value).rlike(r"\A[a-f0-9]{64}\z")


def template_pattern(template: str, digits: int) -> str:
    """The regular expression of a whole file name by a template with one {cycle}, of 128 characters at most, and one {position}."""
    if template.count("{cycle}") != 1 or template.count("{position}") != 1 or len(re.findall("[{}]", template)) != 4:
        raise ValueError("a template holds {cycle} and {position} once each and no other braces")
    body = "".join({"{cycle}": "([A-Za-z0-9][A-Za-z0-9._-]{0,127}?)", "{position}": f"([0-9]{{{digits}}})"}.get(p, re.escape(p)) for p in re.split(r"(\{cycle\}|\{position\})", template))
    return rf"(?i)\A{body}\z"


def match_template(name: Column, template: str, digits: int, frames: int = 16) -> Column:
    """struct(cycle, position) of a file name that fits the template and a position in 1..frames, else null."""
    pattern = template_pattern(template, digits)
    first, second = (1, 2) if template.index("{cycle}") < template.index("{position}") else (2, 1)
    position = F.regexp_extract(name, pattern, second).try_cast("int")
    found = F.struct(F.regexp_extract(name, pattern, first).alias("cycle"), position.alias("position"))
    return F.when(name.rlike(pattern) & position.between(1, frames), found)


def expected_name(template: str, cycle: Column, position: Column, digits: int) -> Column:
    """The file name of a cycle's position; digits are filled with zeros and never cut."""
    number = position.cast("string")
    filled = F.when(F.length(number) < digits, F.lpad(number, digits, "0")).otherwise(number)
    return F.replace(F.replace(F.lit(template), F.lit("{cycle}"), cycle), F.lit("{position}"), filled)


def leading_number(name: Column) -> Column:
    """The leading decimal digits of a file name as a number, null without any."""
    return F.regexp_extract(name, r"^(\p{Nd}+)", 1).try_cast("long")


def canonical_extension(kind: Column) -> Column:
    return F.when(kind == "JPEG", ".jpg").when(kind == "PNG", ".png").when(kind == "TIFF", ".tif")


def failure_code(code: Column, error_class: Column) -> Column:
    return F.substring(F.coalesce(code, error_class), 1, 128)


def contained_in(root: Column, path: Column) -> Column:
    """Whether an absolute path lies below a root."""
    return path.startswith(F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))) & ~path.rlike(r"(^|/)\.\.(/|$)")
