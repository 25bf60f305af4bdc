"""Class-label decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# NLI class ids and names.
LABEL_NAMES = {0: "entailment", 1: "neutral", 2: "contradiction"}


def label_name(col) -> Column:
    """Map a class id to its name via a literal map (no join, no shuffle)."""
    c = F.col(col) if isinstance(col, str) else col
    m = F.create_map(*[x for k, v in LABEL_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, c.cast("int"))


def label_name_sql(expr: str) -> str:
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in LABEL_NAMES.items())
    return f"CASE {expr} {cases} END"
