"""Query strings and number formats."""

from __future__ import annotations

import math
import re

TERM = re.compile(r"GO:\d{7}")
CLUSTER = re.compile(r"cluster_\d+")


def is_term_set(query: str) -> bool:
    q = query.strip()
    return q.startswith("(") or q.startswith("GO:")


def parse_term_set(query: str) -> tuple[str, ...]:
    """``(GO:1;GO:2)`` or with commas, parentheses optional but balanced: ids in order, without repeats."""
    q = query.strip()
    if q.startswith("(") != q.endswith(")"):
        raise ValueError(f"unbalanced parentheses: {query!r}")
    parts = [p.strip() for p in re.split("[;,]", q[1:-1] if q.startswith("(") else q) if p.strip()]
    if bad := [p for p in parts if not TERM.fullmatch(p)]:
        raise ValueError(f"not a term id: {', '.join(bad)}")
    if not parts:
        raise ValueError(f"no term ids: {query!r}")
    return tuple(dict.fromkeys(parts))


def kind(query: str) -> str:
    """set, cluster or accession"""
    return "set" if is_term_set(query) else "cluster" if CLUSTER.fullmatch(query.strip()) else "accession"


def number(x: float | None, digits: int = 4) -> str:
    """Fixed digits without trailing zeros; NA for None."""
    if x is None:
        return "NA"
    if math.isinf(x):
        return "inf"
    t = f"{x:.{digits}f}"
    return t.rstrip("0").rstrip(".") if "." in t else t


def odds(tp: int, fp: int, fn: int, tn: int) -> str:
    if fp * fn == 0:
        return "inf" if tp * tn else "NA"
    return number(tp * tn / (fp * fn), 3)


def similarity(x: float | None) -> str:
    """As cluster tables write it."""
    return "NA" if x is None else f"{x:7.5f}"
