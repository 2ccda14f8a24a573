"""Line maps and line sets. Spans are 1-based and inclusive at both ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NONE = "array<int>"


def to_relative(line: Column, start: Column, end: Column) -> Column:
    """Position in the span, null outside."""
    return F.when(line.between(start, end), line - start + 1)


def to_absolute(line: Column, start: Column) -> Column:
    return start + line - 1


def mask(lines: Column, start: Column, end: Column) -> Column:
    """0 or 1 for each line of the span."""
    return F.transform(F.sequence(start, end), lambda x: F.array_contains(lines, x).cast("int"))


def covered(start: Column, end: Column) -> Column:
    """start..end, none if end lies before start."""
    return F.when(end >= start, F.sequence(start, end)).otherwise(F.array().cast(_NONE))


def union_of(lists: Column) -> Column:
    """Sorted distinct lines of an array of arrays."""
    return F.array_sort(F.array_distinct(F.flatten(lists)))


def merged(*lists: Column) -> Column:
    """Sorted distinct lines of several arrays; null ones are empty."""
    out = F.coalesce(lists[0], F.array().cast(_NONE))
    for x in lists[1:]:
        out = F.array_union(out, F.coalesce(x, F.array().cast(_NONE)))
    return F.array_sort(out)


def flagged(nodes: Column) -> Column:
    """Lines of graph nodes (struct with line and static_flags) with any flag above 0."""
    hit = F.filter(nodes, lambda n: n["line"].isNotNull() & F.exists(F.map_values(n["static_flags"]), lambda v: v > 0))
    return F.array_sort(F.array_distinct(F.transform(hit, lambda n: n["line"])))


def hit(predicted: Column, truth: Column, k: int) -> Column:
    """1 if one of the first k predicted lines is true; k below 1 gives 0."""
    return F.coalesce(F.arrays_overlap(F.slice(predicted, 1, k), truth), F.lit(False)).cast("int") if k > 0 else F.lit(0)


def iou(predicted: Column, truth: Column) -> Column:
    """Intersection over union of two line sets, 0 if both are empty."""
    p, t = F.coalesce(predicted, F.array().cast(_NONE)), F.coalesce(truth, F.array().cast(_NONE))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(p, t)).cast("double"), F.size(F.array_union(p, t)).cast("double")), F.lit(0.0))
