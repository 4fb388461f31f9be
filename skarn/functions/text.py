"""Column functions over names, paths and text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def glob_regex(glob: str) -> str:
    """A glob (* within a folder, ** across, ? one character) as an anchored pattern."""
    out = re.escape(glob).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{out}$"


def wildcard_regex(pattern: str) -> str:
    return "(?i)^" + re.escape(pattern).replace(r"\*", ".*") + "$"


def path_prefixes(c: Column, separator: str = "/") -> Column:
    parts = F.split(c, f"\\Q{separator}\\E")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))


def normalise_path(c: Column) -> Column:
    """Forward slashes, no ./ and no doubled slashes, a/../ resolved however often; a .. that nothing precedes stays."""
    parts = F.filter(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (last(acc) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.when(F.replace(c, F.lit("\\"), F.lit("/")).startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def split_camel(c: Column) -> Column:
    """Words of an identifier, split at case changes, digits' ends, underscores, dots and dashes, in lower case."""
    spaced = F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, r"[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")


def slug(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one dash, no dash at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def section_id(path: Column, ancestors: Column, title: Column, level: Column) -> Column:
    """``file::slug/slug#level`` from the file, the slugs of the ancestors, the title and the level."""
    return F.concat(path, F.lit("::"), F.array_join(F.concat(ancestors, F.array(slug(title))), "/"), F.lit("#"), level.cast("string"))


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounding half up towards positive infinity."""
    return F.floor(c * 10**digits + 0.5) / 10**digits if digits else F.floor(c + 0.5)


def identifiers(c: Column) -> Column:
    """Distinct identifiers in text: camelCase, PascalCase, snake_case and SCREAMING_CASE words, sorted."""
    found = F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z0-9_])((?:[a-z]+[a-z0-9]*(?:[A-Z][a-z0-9]*)+)|(?:[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+)|(?:[a-z][a-z0-9]*(?:_[a-z0-9]+)+)|(?:[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+))(?![A-Za-z0-9_])"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def backticked(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit("`([^`\\n]+)`"), F.lit(1)))


def first_sentence(c: Column, limit: int = 200) -> Column:
    """First sentence of the first line that is no heading, list rule or fence."""
    lines = F.filter(F.transform(F.split(c, "\n"), F.trim), lambda l: (l != "") & ~l.rlike(r"^(#{1,6}\s|```|~~~|[-=*_]{3,}$|>|\|)"))
    line = F.try_element_at(lines, F.lit(1))
    sentence = F.regexp_extract(line, r"^(.*?[.!?])(?:\s|$)", 1)
    return F.substring(F.when(sentence != "", sentence).otherwise(line), 1, limit)


def cyclomatic(c: Column) -> Column:
    """One plus the branching words and operators of code whose strings and comments are blanked."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?s)/\*.*?\*/|//[^\n]*|#[^\n]*", " "), r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`", "''")
    return (F.lit(1) + F.regexp_count(bare, F.lit(r"\b(?:if|for|while|case|catch|elif|except|when)\b|&&|\|\||\?(?![.?:])"))).cast("int")


def maintainability(volume: Column, complexity: Column, lines: Column) -> Column:
    raw = F.lit(171) - 5.2 * F.ln(F.greatest(volume, F.lit(1.0))) - 0.23 * complexity - 16.2 * F.ln(F.greatest(lines, F.lit(1)))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 1)


def nesting_depth(c: Column) -> Column:
    """Greatest depth of braces."""
    braces = F.split(F.regexp_replace(c, r"[^{}]", ""), "")
    step = lambda s, b: F.struct((s.d + F.when(b == "{", 1).when(b == "}", -1).otherwise(0)).alias("d"), F.greatest(s.m, s.d + F.when(b == "{", 1).otherwise(0)).alias("m"))
    return F.aggregate(braces, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), step, lambda s: s.m)


def version_key(c: Column) -> Column:
    """Sortable text of a version: numeric parts padded, a pre-release before its release."""
    bare = F.regexp_replace(F.trim(c), r"^[v^~=<>\s]+", "")
    numbers = F.transform(F.split(F.regexp_extract(bare, r"^([0-9]+(?:\.[0-9]+)*)", 1), r"\."), lambda p: F.lpad(p, 12, "0"))
    filled = F.slice(F.concat(numbers, F.array_repeat(F.lit("0" * 12), 4)), 1, 4)
    return F.concat(F.array_join(filled, "."), F.when(bare.rlike(r"^[0-9.]+-"), F.lit("a")).otherwise(F.lit("b")))


def replace_once(c: Column, old: Column, new: Column) -> Column:
    """The text with ``old`` replaced if it occurs exactly once; null otherwise."""
    once = (F.length(c) - F.length(F.replace(c, old, F.lit("")))) == F.length(old)
    return F.when((F.length(old) > 0) & once, F.replace(c, old, new))


def insert_at(c: Column, line: int, new: str) -> Column:
    """The text with a line put before line number ``line`` (from 1)."""
    lines = F.split(c, "\n")
    return F.array_join(F.concat(F.slice(lines, 1, line - 1), F.array(F.lit(new)), F.slice(lines, line, F.greatest(F.size(lines) - line + 1, F.lit(0)))), "\n")


def line_range(c: Column, first: int, last: int) -> Column:
    return F.array_join(F.slice(F.split(c, "\n"), first, last - first + 1), "\n")
