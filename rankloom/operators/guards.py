"""Checks on plans before they run: circular labels and planted truth.

A scorer that reads the citation graph may not be judged by labels mined from it, one
that reads the entity layer not by labels derived from that, and nothing on the retrieval
path may read planted truth. What a frame reads is taken from its files and its analysed
plan, not from its name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from rankloom import storage

GRAPH_LABELS = frozenset({"dag_mined"})
ENTITY_LABELS = frozenset({"multihop"})


class Circular(ValueError):
    """A scorer and its labels come from the same structure."""


class TruthLeak(ValueError):
    """A retrieval plan reads planted truth."""


def reads(df: DataFrame) -> set[str]:
    """Names of the tables and files below a frame, through the tables that were stored on the way."""
    out, open_, seen, known = set(), [df], set(), stored()
    while open_:
        at = open_.pop()
        plan = at._jdf.queryExecution().analyzed().toString()
        out |= set(re.findall(r"SubqueryAlias (?:\w+\.)*(\w+)", plan)) | set(re.findall(r"\b(true_\w+)#", plan))
        for f in at.inputFiles():
            parts = f.split("/")
            out |= {part.removesuffix(".parquet") for part in parts if part.endswith(".parquet") or part.startswith("true_")}
            key = next((p for p in parts if p in known), None)
            if key and key not in seen:
                seen.add(key)
                open_.append(known[key])
    return out


def stored() -> dict[str, DataFrame]:
    """What stored tables were made from, by the last part of their paths."""
    return {path.rsplit("/", 1)[-1]: df for path, df in storage.made.items()}


def check_circular(uses_graph: bool, uses_entities: bool, label_source: str) -> None:
    if uses_graph and label_source in GRAPH_LABELS or uses_entities and label_source in ENTITY_LABELS:
        raise Circular(f"labels {label_source!r} come from what the scorer reads")


def check_truth(df: DataFrame) -> None:
    if leaked := sorted(r for r in reads(df) if r.startswith("true_")):
        raise TruthLeak(f"reads planted truth: {', '.join(leaked)}")
