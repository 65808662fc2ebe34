"""Scalar column functions (all JVM-side ``pyspark.sql.functions``)."""

from .columns import (  # noqa: F401
    as_date, edge_key, metric_column, normalise_type, percent_of, percent_text,
    recency_weight_col, sqrt_scale_col, to_number, display_label, display_type,
)
