"""Sinks: tables replaced by source, reports without NaN, flat headlines."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Mapping
from urllib.parse import quote

from pyspark.sql import DataFrame

from rankloom.storage import remove


def replace_source(df: DataFrame, path: str, sources: Iterable[str] | None = None) -> None:
    """Writes ``df`` so that only the partitions of its ``source`` values are replaced; other sources stay.

    ``sources`` names the sources that are replaced: one of them without a row in ``df``
    loses its old rows. A failed job leaves the old partitions, as files are moved into
    place on commit.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
    if sources is not None:
        there = {r["source"] for r in df.select("source").distinct().collect()}  # a row per source
        for name in set(sources) - there:
            remove(df.sparkSession, f"{path}/source={quote(name, safe=PLAIN)}")


#: Characters that partition folders keep as they are.
PLAIN = " !$&()+,-.;<>@_`|~"


def clean(value):
    """Nested values with NaN and infinities as null, ready for JSON."""
    if isinstance(value, Mapping):
        return {str(k): clean(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [clean(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def write_report(report: Mapping, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(clean(report), f, indent=1, default=str)


def headline(report: Mapping, levels: int = 3, prefix: str = "") -> dict:
    """Scalars of a nested report by dotted name, ``levels`` deep."""
    out: dict = {}
    for k, v in report.items():
        name = f"{prefix}{k}"
        if isinstance(v, Mapping):
            if levels > 1:
                out |= headline(v, levels - 1, f"{name}.")
        elif isinstance(v, int | float | str | bool) or v is None:
            out[name] = v
    return out


def different(a, b, tolerance: float = 1e-9, allowed: frozenset[str] = frozenset(), at: str = "") -> list[str]:
    """Dotted names at which two reports differ, but for those allowed."""
    if at.lstrip(".") in allowed:
        return []
    if isinstance(a, Mapping) and isinstance(b, Mapping):
        return [x for k in sorted({*a, *b}, key=str) for x in different(a.get(k), b.get(k), tolerance, allowed, f"{at}.{k}")]
    if isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
        return [x for i, (p, q) in enumerate(zip(a, b)) for x in different(p, q, tolerance, allowed, f"{at}.{i}")]
    if isinstance(a, float) and isinstance(b, float) and (math.isnan(a) and math.isnan(b) or abs(a - b) <= tolerance):
        return []
    return [] if a == b else [at.lstrip(".")]
