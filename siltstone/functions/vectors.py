"""Fixed-width vectors of graph nodes and samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import crc_bucket, tokens

# Slots, flags and keys of the vectors, in order.
TYPE_SLOTS, TOKEN_SLOTS, LINE_SCALE = 16, 16, 100.0
FLAGS = ("is_alert_line", "is_trace_line", "is_source_like", "is_sink_like")
STATIC_KEYS = ("alert_count", "trace_line_count", "unique_query_count", "has_codeql_alert", "max_severity_score", "function_line_count", "graph_node_count", "graph_edge_count", "dangerous_api_count")


def node_vector(node_type: Column, code: Column, line_index: Column, flags: Column) -> Column:
    """37 doubles: type one-hot by hash, line position up to 1, four flags, hashed token shares."""
    slot = crc_bucket(F.coalesce(node_type, F.lit("UNKNOWN")), TYPE_SLOTS)
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(TYPE_SLOTS - 1)), lambda i: (i == slot).cast("double"))
    line = F.array(F.when(line_index.isNull(), 0.0).otherwise(F.least(line_index / F.lit(LINE_SCALE), F.lit(1.0))))
    flag = F.array(*[F.coalesce(F.try_element_at(flags, F.lit(k)).cast("double"), F.lit(0.0)) for k in FLAGS])
    # an array of the one array of slots: a lambda's variable is evaluated once, an expression in it for each of its calls
    slots = F.array(F.transform(tokens(code), lambda t: crc_bucket(t, TOKEN_SLOTS)))
    shares = lambda x: F.transform(F.sequence(F.lit(0), F.lit(TOKEN_SLOTS - 1)), lambda i: F.size(F.filter(x, lambda s: s == i)) / F.greatest(F.size(x), F.lit(1)).cast("double"))
    share = F.get(F.transform(slots, shares), F.lit(0))
    return F.concat(one_hot, line, flag, share)


def static_vector(features: Column) -> Column:
    """Nine doubles in fixed order from a map of numbers; missing ones are 0."""
    return F.array(*[F.coalesce(F.try_element_at(features, F.lit(k)).cast("double"), F.lit(0.0)) for k in STATIC_KEYS])
