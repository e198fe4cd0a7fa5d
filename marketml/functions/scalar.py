"""Column helpers for casting dirty text, missing-value tests, rounding,
elapsed-time formatting and naming vector slots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the guard pattern the reference applies before casting text
# to double (digits and dots only; signs, exponents and blanks fail it).
DIGITS_ONLY = "^[0-9.]+$"

CAST_MODES = ("try_cast", "digits_only")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c, mode: str = "try_cast") -> Column:
    """Text or number -> double, NULL when it does not parse.

    ``try_cast`` (default) keeps negatives, exponents and large values and
    never raises under ANSI mode.  ``digits_only`` first applies the
    reference's guard ``^[0-9.]+$`` to the value's text (F2, F4), so a value
    like ``-2.5`` or ``1.2345678E7`` becomes NULL as it did there; values
    that pass the guard but do not parse (``1.2.3``, ``.``) are NULL rather
    than an error.
    """
    c = _col(c)
    if mode == "try_cast":
        return c.try_cast("double")
    if mode == "digits_only":
        return F.when(c.cast("string").rlike(DIGITS_ONLY), c.cast("string").try_cast("double"))
    raise ValueError(f"mode must be one of {CAST_MODES}")


def is_missing(c, dtype: T.DataType | None = None) -> Column:
    """NULL, or NaN for floating columns (what ``na.drop`` removes)."""
    c = _col(c)
    if dtype is None or isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def not_missing(c, dtype: T.DataType | None = None) -> Column:
    """Negation of :func:`is_missing`, written as ``IS NOT NULL AND NOT
    isnan`` so the ``IS NOT NULL`` half pushes down to the scan."""
    c = _col(c)
    if dtype is None or isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def round_to(c, places: int) -> Column:
    """Numeric rounding (F8) - half up, as SQL ``round``."""
    return F.round(_col(c), places)


def elapsed_hms(seconds) -> Column:
    """Seconds -> ``H:MM:SS`` after rounding to whole seconds.

    Hours keep counting past 24 (``25:00:00``) instead of switching to a
    day count.  NULL stays NULL.
    """
    s = F.round(_col(seconds)).cast("long")
    return F.when(s.isNotNull(), F.format_string(
        "%d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    ))


def zip_names(values, names: Sequence[str]) -> Column:
    """Array of values + fixed names -> array of ``struct(feature, value)``
    (F10); explode it to get one row per feature."""
    return F.arrays_zip(
        F.array(*[F.lit(n) for n in names]).alias("feature"), _col(values).alias("value")
    )
