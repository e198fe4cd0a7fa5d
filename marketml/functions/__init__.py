"""Scalar column functions (F1-F11).  All are built from
``pyspark.sql.functions`` so they stay JVM-side inside whole-stage codegen."""

from marketml.functions.scalar import (  # noqa: F401
    DIGITS_ONLY,
    elapsed_hms,
    is_missing,
    not_missing,
    round_to,
    to_double,
    zip_names,
)
