"""Research queries: their texts and the weights of their dimensions."""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from folioscope.config import DIMENSIONS, WEIGHTS, FolioscopeError

MOST_CHARACTERS = 20_000


def query_text(value: str | None, name: str, most: int = MOST_CHARACTERS) -> str:
    """A normalised text; null is empty, and texts beyond ``most`` characters are refused."""
    if value is None:
        return ""
    if not isinstance(value, str):
        raise FolioscopeError("not_a_text", f"{name} must be a string")
    out = re.sub(r"[\x00-\x1f\x7f]", " ", unicodedata.normalize("NFKC", value))
    out = re.sub(r"\s+", " ", out).strip()
    if len(out) > most:
        raise FolioscopeError("query_too_long", f"{name} exceeds {most:,} characters")
    return out


def normalize_weights(weights: dict[str, float] | list[float] | None, available: list[str]) -> dict[str, float]:
    """Weights by dimension that sum to one over the available ones; a list stands for the five in order."""
    usable = [d for d in DIMENSIONS if d in available]
    if not usable:
        raise FolioscopeError("no_dimension", "no dimension is available")
    given = weights or {}
    if not isinstance(given, dict):
        if len(given) != len(DIMENSIONS):
            raise FolioscopeError("bad_weights", "a list of weights must hold five values")
        given = dict(zip(DIMENSIONS, given))
    if unknown := set(given) - set(DIMENSIONS):
        raise FolioscopeError("bad_weights", f"unknown dimensions: {', '.join(sorted(unknown))}")
    if any(not isinstance(w, (int, float)) or not math.isfinite(w) or w < 0 for w in given.values()):
        raise FolioscopeError("bad_weights", "weights must be finite and not negative")
    raw = {d: (given.get(d, WEIGHTS[d]) if d in usable else 0.0) for d in DIMENSIONS}
    total = sum(raw.values())
    if total <= 0:
        raise FolioscopeError("bad_weights", "the available weights must have a positive sum")
    return {d: w / total for d, w in raw.items()}


@dataclass(frozen=True)
class Query:
    """One query; ``title`` is matched with the theme of articles."""

    texts: dict[str, str]
    query_id: str = "q"
    weights: dict[str, float] = field(default_factory=dict)

    @property
    def available(self) -> list[str]:
        return [d for d in DIMENSIONS if self.texts.get(d)]


def prepare_query(title=None, purpose=None, method=None, data=None, context=None, weights=None, query_id: str = "q") -> Query:
    given = {"theme": ("title", title), "purpose": ("purpose", purpose), "method": ("method", method), "data": ("data", data), "context": ("context", context)}
    texts = {d: query_text(value, name) for d, (name, value) in given.items()}
    available = [d for d, t in texts.items() if t]
    if not available:
        raise FolioscopeError("empty_query", "at least one field must be filled")
    return Query(texts, query_id, normalize_weights(weights, available))


def query_table(spark: SparkSession, queries: list[Query]) -> DataFrame:
    """``query_id, dimension, text, weight`` of the filled dimensions."""
    rows = [(q.query_id, d, q.texts[d], float(q.weights.get(d, 0.0))) for q in queries for d in q.available]
    return spark.createDataFrame(rows, "query_id string, dimension string, text string, weight double")
