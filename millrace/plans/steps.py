"""A declared list of steps applied to a frame: a fold over operators, nothing is planned here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..errors import need
from ..operators import aggregates, columns, filters, masking, nested, routing, sets, windows

STEPS = {
    name: getattr(module, name)
    for module, names in {
        columns: ("add_column", "derive", "transform_values", "keep", "drop", "rename", "cast_columns", "try_cast_columns", "trim",
                  "fill_nulls", "clean", "null_policy", "contract", "add_surrogate_key"),
        filters: ("filter_sql", "filter_conditions", "drop_null_rows", "filter_clauses", "filter_partition"),
        routing: ("label_routes", "route_tags"),
        aggregates: ("group_aggregate", "bucket_aggregate", "downsample", "derived_metrics"),
        windows: ("dedupe", "dedupe_priority", "rolling_rows", "rolling_days", "running_total", "rank_family", "lag_lead", "apply_specs"),
        sets: ("sort", "limit", "sample", "sql_chain"),
        nested: ("flatten_fields", "flatten_deep", "explode_array", "array_policy", "parse_json", "build_struct", "build_json"),
        masking: ("hash_columns", "redact", "last4", "format_preserving", "normalised_hash", "tokenize", "encrypt", "decrypt"),
    }.items()
    for name in names
}


def apply_steps(df: DataFrame, steps: Sequence[tuple[str, Mapping[str, object]]]) -> DataFrame:
    """Each step is ``(operator name, keyword arguments)``; the plan stays lazy from end to end."""
    for name, arguments in steps:
        need(name in STEPS, "UNKNOWN_STEP", name)
        df = STEPS[name](df, **arguments)
    return df
