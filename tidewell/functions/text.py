"""Names, labels, tokens, and readable numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words a question carries that name no table.
STOP_WORDS = [
    "the", "and", "for", "with", "from", "this", "that", "show", "what", "get",
    "list", "give", "find", "all", "per", "over", "top", "last", "each", "are",
    "was", "were", "into", "onto", "our", "you", "your", "please", "how", "many",
]

# Byte units.
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


def label(name: str) -> str:
    """``total_price`` -> ``Total Price``, ``unitCost`` -> ``Unit Cost``."""
    spaced = re.sub(r"[_-]+", " ", name)
    spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", spaced)
    return re.sub(r"\b\w", lambda m: m.group().upper(), spaced, flags=re.ASCII).strip()


def label_col(name: Column) -> Column:
    """``label`` over a data column. Each word keeps its inner capitals."""
    spaced = F.regexp_replace(name, r"[_-]+", " ")
    spaced = F.regexp_replace(spaced, r"([a-z])([A-Z])", "$1 $2")
    words = F.transform(
        F.split(spaced, " "),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    return F.trim(F.array_join(words, " "))


def slug(*parts: str) -> str:
    return ":".join(re.sub(r"(^-|-$)", "", re.sub(r"[^a-z0-9]+", "-", p.lower())) for p in parts)


def safe_name(name: str) -> str:
    """Letters, digits and ``_`` only, no leading digit, at most 128 characters."""
    out = re.sub(r"[^a-zA-Z0-9_]", "_", name or "")
    if re.match(r"\d", out):
        out = "_" + out
    return out[:128] or "field"


def safe_names(names: list[str]) -> list[str]:
    """``safe_name`` for a whole schema; colliding names get ``_2``, ``_3`` ..."""
    taken: set[str] = set()
    out = []
    for name in names:
        base = safe_name(name)
        candidate, n = base, 1
        while candidate.lower() in taken:
            n += 1
            candidate = f"{base[:128 - len(str(n)) - 1]}_{n}"
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def display_name(header: str, position: int) -> str:
    """Lower-case safe column name for a file header; ``column_N`` if nothing is left."""
    out = re.sub(r"[^a-z0-9]+", "_", header.lower())
    return re.sub(r"^_|_$", "", out) or f"column_{position}"


def tokens(text: Column) -> Column:
    """Words of three or more characters without stop words; repeats are kept."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), 1)
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def _fixed(c: Column, digits: int) -> Column:
    """Ties go up; ``format_number`` alone would take them to the even digit."""
    return F.regexp_replace(F.format_number(F.round(c, digits), digits), ",", "")


def format_bytes(n: Column) -> Column:
    """``1536`` -> ``1.5 KB``; a trailing ``.0`` is dropped."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(BYTE_UNITS):
        if power:
            value = _fixed(n / F.lit(float(1024 ** power)), 1)
            text = F.concat(F.regexp_replace(value, r"\.0$", ""), F.lit(f" {unit}"))
            out = F.when(n >= 1024 ** power, text).otherwise(out)
    return F.when(n == 0, F.lit("0 B")).otherwise(out)


def format_count(n: Column) -> Column:
    return (F.when(n >= 1_000_000, F.concat(_fixed(n / 1e6, 1), F.lit("M")))
            .when(n >= 1_000, F.concat(_fixed(n / 1e3, 1), F.lit("K")))
            .otherwise(n.cast("string")))


def format_duration(ms: Column) -> Column:
    """Milliseconds as ``850ms``, ``2.5s`` or ``3m 20s``."""
    whole = ms.cast("long")
    return (F.when(whole < 1000, F.concat(whole.cast("string"), F.lit("ms")))
            .when(whole < 60_000, F.concat(_fixed(whole / 1000.0, 1), F.lit("s")))
            .otherwise(F.concat(
                F.floor(whole / 60_000).cast("string"), F.lit("m "),
                F.floor((whole % 60_000) / 1000).cast("string"), F.lit("s"))))


def format_seconds(s: Column) -> Column:
    whole = s.cast("long")
    return (F.when(whole < 60, F.concat(whole.cast("string"), F.lit("s")))
            .when(whole < 3600, F.concat(F.floor(whole / 60).cast("string"), F.lit("m "),
                                         (whole % 60).cast("string"), F.lit("s")))
            .otherwise(F.concat(F.floor(whole / 3600).cast("string"), F.lit("h "),
                                F.floor((whole % 3600) / 60).cast("string"), F.lit("m"))))


def format_ago(then: Column, as_of: Column) -> Column:
    """``just now``, ``5m ago``, ``3h ago``, ``2d ago``."""
    minutes = F.timestamp_diff("MINUTE", then, as_of)
    hours = F.floor(minutes / 60)
    return (F.when(minutes < 1, F.lit("just now"))
            .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
            .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
            .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago"))))


def format_until(due: Column, as_of: Column) -> Column:
    """``now``, ``in 5m``, ``in 3h``, ``in 2d``."""
    minutes = F.timestamp_diff("MINUTE", as_of, due)
    hours = F.floor(minutes / 60)
    return (F.when(due <= as_of, F.lit("now"))
            .when(minutes < 60, F.concat(F.lit("in "), minutes.cast("string"), F.lit("m")))
            .when(hours < 24, F.concat(F.lit("in "), hours.cast("string"), F.lit("h")))
            .otherwise(F.concat(F.lit("in "), F.floor(hours / 24).cast("string"), F.lit("d"))))
