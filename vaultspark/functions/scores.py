"""Column expressions for weights, distances and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colours of entity types in graph exports.
TYPE_COLORS = {
    "person": "#3b82f6",
    "organization": "#22c55e",
    "project": "#f97316",
    "team": "#a855f7",
    "topic": "#eab308",
    "event": "#ec4899",
    "concept": "#06b6d4",
    "technology": "#14b8a6",
    "tool": "#f43f5e",
    "decision": "#8b5cf6",
}
DEFAULT_COLOR = "#6b7280"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, norm_b: Column | None = None) -> Column:
    """Cosine of two vectors of one length; 0 if one is zero."""
    below = norm(a) * (norm(b) if norm_b is None else norm_b)
    return F.when(below == 0, F.lit(0.0)).otherwise(dot(a, b) / below)


def relationship_weight(seen: Column, last_seen: Column, confidence: Column, as_of: Column) -> Column:
    """confidence * exp(-days/180) * log2(seen + 1); days since last_seen, 0 at least."""
    days = F.greatest(F.datediff(as_of, last_seen), F.lit(0))
    return confidence * F.exp(-days / F.lit(180.0)) * F.log2(seen + F.lit(1.0))


def recency(last_seen: Column, as_of: Column) -> Column:
    """exp(-days/90), above 1 for dates to come; 0 without a date."""
    return F.coalesce(F.exp(-F.datediff(as_of, last_seen) / F.lit(90.0)), F.lit(0.0))


def importance(degree: Column, betweenness: Column, mentions: Column, recent: Column) -> Column:
    return 0.30 * degree + 0.25 * betweenness + 0.25 * mentions + 0.20 * recent


def edge_cost(weight: Column) -> Column:
    return F.lit(1.0) / F.greatest(weight, F.lit(0.01))


def node_size(mentions: Column) -> Column:
    return F.greatest(F.lit(8.0), F.least(F.lit(25.0), 8.0 + 3.0 * F.log2(F.coalesce(mentions, F.lit(0)) + F.lit(1.0))))


def level_size(distance: Column) -> Column:
    """Size of a node by its distance from the centre of a neighbourhood."""
    return F.when(distance == 0, F.lit(20)).otherwise(F.greatest(F.lit(8), 16 - 4 * distance))


def type_color(kind: Column) -> Column:
    colors = F.create_map(*[F.lit(x) for pair in TYPE_COLORS.items() for x in pair])
    return F.coalesce(colors[kind], F.lit(DEFAULT_COLOR))


def clamped_confidence(value: Column) -> Column:
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), F.lit(0.5))
