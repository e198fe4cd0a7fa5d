"""Exact quantiles without gathering a group into one task.

Spark's ``percentile``/``median`` aggregates keep every distinct value of a
group in one buffer for the final merge, so a group holding a third of the
rows would land in a single task.  Two exact methods avoid that.

``method="sort"`` - distributed rank selection over all values:

1. stack the value columns into one long table ``(keys, metric, value)``;
2. ``repartitionByRange`` on ``(keys, metric, value, tiebreak)`` so a hot
   group spreads over many partitions (the tiebreak splits runs of equal
   values), sort within partitions and tag rows with
   ``monotonically_increasing_id`` (partition id in the high bits, so ids
   are contiguous inside each run);
3. write that table once to the shared checkpoint folder, which freezes the
   ids for the two passes below and cuts lineage;
4. pass 1 aggregates per (group, partition) segment: first id and row count;
   a window over this small table gives each segment its rank offset;
5. the wanted ranks become a small table of row ids, joined back in pass 2.

``method="bracket"`` - the same selection on a tiny subset:

1. one aggregation builds a ``percentile_approx`` sketch per group and reads
   two values around each wanted probability (``p -/+ delta``): a bracket
   whose ranks contain the wanted rank (the sketch's rank error is at most
   ``n / accuracy``);
2. one counting pass (combined map-side) gives, per group, the rows below
   and at each bracket end; a wanted rank that falls on a bracket end is
   answered from the counts alone, so runs of equal values never move;
3. only rows strictly inside a bracket (about ``4n / accuracy`` per group at
   most) go through the sort method above;
4. a group whose bracket does not hold its rank (not expected; the check is
   exact) is recomputed with the sort method.

The bracket method scans the data three times (column-pruned) and shuffles
sketches, counts and the bracket interiors, where the sort method shuffles
every value once.  ``sort`` is the default at every size, as it takes any mix of
group sizes; ``bracket``, which pays where groups are large, is chosen by
name only.  Helper tables are written first, so Catalyst knows their
bytes and picks broadcast or shuffle joins by them.

Interpolation matches Spark's ``percentile`` and SQL ``quantile_cont``:
``lo * (1 - d) + hi * d`` with ``d = pos - floor(pos)``.  NULLs are skipped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketml.session import materialize

METHODS = ("bracket", "sort")
# Bracket half-width in units of the sketch's rank error (1 / accuracy).
BRACKET_SLACK = 2.0


def _value_exprs(values) -> list[tuple[str, Column]]:
    if isinstance(values, Mapping):
        return [(name, expr if isinstance(expr, Column) else F.col(expr))
                for name, expr in values.items()]
    return [(name, F.col(name)) for name in values]


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                    how: str = "inner") -> DataFrame:
    """Join on ``keys`` treating NULL keys as equal.  ``right`` is the small
    side and should be materialised, so that Catalyst knows its bytes."""
    if not keys:
        raise ValueError("join keys required (an empty key list would be a cross join)")
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{k}" for k in keys])


def _rank_select(stacked: DataFrame, gkeys: Sequence[str], num_partitions: int | None,
                 probs: Sequence[float] | None = None, wanted: DataFrame | None = None):
    """Fetch values at given 0-based ranks within each group.

    ``stacked`` has ``(*gkeys, _v, _t)``.  The ranks are either the floor and
    ceil of ``(n-1)p`` for each of ``probs`` (computed on the segment rows
    themselves), or given by a small, materialised ``wanted`` table
    ``(*gkeys, _w, _r, ...)``.  Returns the wanted rows with ``_v`` added.
    """
    gkeys = list(gkeys)
    order = [*gkeys, "_v", "_t"]
    spread = (stacked.repartitionByRange(num_partitions, *order) if num_partitions
              else stacked.repartitionByRange(*order))
    ranked = materialize(
        spread.sortWithinPartitions(*order)
        .select(*gkeys, "_v", F.monotonically_increasing_id().alias("_rid")),
        "quantile-ranked",
    )
    # Pass 1: one row per (group, partition) segment, with its rank offset.
    seg = ranked.groupBy(*gkeys, F.shiftright("_rid", 33).alias("_pid")).agg(
        F.min("_rid").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    grp = Window.partitionBy(*gkeys)
    seg = seg.select(
        "*",
        F.coalesce(F.sum("_cnt").over(grp.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_cnt").over(grp).alias("_n"),
    )
    if probs is not None:
        hits = _wanted_ranks(seg, probs)
    else:
        hits = _null_safe_join(seg.drop("_n"), wanted, gkeys)
    hits = hits.where((F.col("_r") >= F.col("_off")) & (F.col("_r") < F.col("_off") + F.col("_cnt")))
    targets = materialize(
        hits.withColumn("_rid", F.col("_first") + F.col("_r") - F.col("_off"))
        .drop("_pid", "_first", "_cnt", "_off"),
        "quantile-targets")
    # Pass 2: fetch the wanted rows by id.
    return ranked.select("_rid", "_v").join(targets, "_rid").drop("_rid")


def _interpolate(picked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, _m, _p, _pos, _n, _w, _v)`` with lo/hi rows -> ``_q``."""
    lo = F.max(F.when(F.col("_w") == "lo", F.col("_v")))
    hi = F.max(F.when(F.col("_w") == "hi", F.col("_v")))
    out = picked.groupBy(*keys, "_m", "_p", "_pos", "_n").agg(lo.alias("_lo"), hi.alias("_hi"))
    frac = F.col("_pos") - F.floor("_pos")
    q = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(
        F.col("_lo") * (1 - frac) + F.col("_hi") * frac)
    return out.select(*keys, "_m", "_p", "_n", q.alias("_q"))


def _wanted_ranks(counts: DataFrame, probs: Sequence[float]) -> DataFrame:
    """``(..., _n)`` -> ``(..., _p, _pos, _w, _r)``: floor and ceil of (n-1)p."""
    return _rank_pairs(counts.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("_p")))


def _rank_pairs(counts: DataFrame) -> DataFrame:
    """``(..., _n, _p)`` -> ``(..., _n, _p, _pos, _w, _r)``."""
    pos = (F.col("_n") - 1).cast("double") * F.col("_p")
    return counts.select("*", pos.alias("_pos"), F.explode(F.array(
        F.struct(F.lit("lo").alias("w"), F.floor(pos).cast("long").alias("r")),
        F.struct(F.lit("hi").alias("w"), F.ceil(pos).cast("long").alias("r")),
    )).alias("_x")).select(*counts.columns, "_pos", F.col("_x.w").alias("_w"), F.col("_x.r").alias("_r"))


def _sort_method(stacked, keys, probs, num_partitions):
    picked = _rank_select(stacked, [*keys, "_m"], num_partitions, probs=probs)
    return _interpolate(picked, keys)


def _clip(x: float) -> float:
    return min(1.0, max(0.0, x))


def _bracket_method(stacked, keys, probs, accuracy, num_partitions):
    gk = [*keys, "_m"]
    # Half-widths to read around p.  A group needs at least 2/n (rank
    # discretisation: the sketch returns a ceil-based rank, the wanted ranks
    # are floor/ceil of (n-1)p) plus the sketch error, scaled by the slack;
    # each group takes the narrowest width from this ladder that covers it.
    base = BRACKET_SLACK / accuracy
    ladder = sorted({base, 1e-3, 3e-3, 1e-2, 3e-2, 0.1, 0.3, 1.0})
    ends = sorted({_clip(p + s * d) for p in probs for d in ladder for s in (-1, 1)})
    at = {e: i + 1 for i, e in enumerate(ends)}  # element_at is 1-based
    sketch = stacked.groupBy(*gk).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", ends, accuracy).alias("_e"))
    need = 2.0 / F.col("_n") + F.lit(base)
    k = None
    for i, d in enumerate(ladder):
        k = F.when(need <= d, i) if k is None else k.when(need <= d, i)
    k = k.otherwise(len(ladder) - 1)
    lo_e = hi_e = None
    for p in probs:
        for i, d in enumerate(ladder):
            hit = (F.col("_p") == F.lit(float(p))) & (F.col("_k") == i)
            a = F.element_at("_e", at[_clip(p - d)])
            b = F.element_at("_e", at[_clip(p + d)])
            lo_e = F.when(hit, a) if lo_e is None else lo_e.when(hit, a)
            hi_e = F.when(hit, b) if hi_e is None else hi_e.when(hit, b)
    ends_at = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("_p")
    bounds = sketch.withColumn("_k", k).select("*", ends_at).select(*gk, "_p", lo_e.alias("_a"), hi_e.alias("_b"))
    return _interpolate(_between(stacked, gk, bounds, probs, num_partitions), keys)


def _between(stacked: DataFrame, gk: Sequence[str], bounds: DataFrame, probs: Sequence[float], num_partitions: int | None) -> DataFrame:
    """The rows at the wanted ranks of every group, from brackets ``(*gk, _p, _a, _b)`` that should hold their
    values.  Counts decide: only rows inside a bracket are sorted, and a group whose bracket misses, whole."""
    bounds = materialize(bounds, "quantile-brackets")

    # Counting pass: where each wanted rank sits relative to its bracket.
    v = F.col("_v")
    cnt = _null_safe_join(stacked.select(*gk, "_v"), bounds, gk).groupBy(*gk, "_p", "_a", "_b").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(v < F.col("_a")).alias("_lt_a"), F.count_if(v <= F.col("_a")).alias("_le_a"),
        F.count_if(v < F.col("_b")).alias("_lt_b"), F.count_if(v <= F.col("_b")).alias("_le_b"))
    b2 = materialize(_rank_pairs(cnt), "quantile-bracket-ranks")
    r = F.col("_r")
    ok = (r >= F.col("_lt_a")) & (r < F.col("_le_b"))
    at_a = ok & (r < F.col("_le_a"))
    at_b = ok & ~at_a & (r >= F.col("_lt_b"))
    inside = ok & ~at_a & ~at_b
    parts = [b2.where(at_a | at_b).select(
        *gk, "_p", "_pos", "_n", "_w", F.when(at_a, F.col("_a")).otherwise(F.col("_b")).alias("_v"))]

    # Ranks strictly inside a bracket: select among the interior rows only.
    need = materialize(b2.where(inside).select(*gk, "_p", "_pos", "_n", "_w", "_a", "_b",
                                               (r - F.col("_le_a")).alias("_r")),
                       "quantile-inside")
    if need.count() > 0:
        ranges = need.select(*gk, "_p", "_a", "_b").dropDuplicates([*gk, "_p"])
        sub = _null_safe_join(stacked, ranges, gk).where(
            (F.col("_v") > F.col("_a")) & (F.col("_v") < F.col("_b"))).drop("_a", "_b")
        picked = _rank_select(sub, [*gk, "_p"], num_partitions,
                              wanted=need.select(*gk, "_p", "_pos", "_n", "_w", "_r"))
        parts.append(picked.select(*gk, "_p", "_pos", "_n", "_w", "_v"))

    # Groups whose bracket missed (not expected): the sort method for them.
    bad = b2.where(~ok).select(*gk).dropDuplicates()
    if bad.count() > 0:
        parts = [_null_safe_join(p, bad, gk, "left_anti") for p in parts]
        retry = _null_safe_join(stacked, bad, gk, "left_semi")
        full = _rank_select(retry, gk, num_partitions, probs=probs)
        parts.append(full.select(*gk, "_p", "_pos", "_n", "_w", "_v"))
    picked = parts[0]
    for p in parts[1:]:
        picked = picked.unionByName(p)
    return picked


def _stack_values(df: DataFrame, keys: Sequence[str], values, tiebreak: Column) -> DataFrame:
    """``(*keys, _t, _m, _v)``: a row for each value that is not NULL, by the place of its column."""
    return (
        df.select(
            *[F.col(k) for k in keys],
            tiebreak.alias("_t"),
            F.explode(F.array(*[
                F.struct(F.lit(i).alias("m"), e.cast("double").alias("v"))
                for i, (_, e) in enumerate(_value_exprs(values))
            ])).alias("_s"),
        )
        .select(*keys, "_t", F.col("_s.m").alias("_m"), F.col("_s.v").alias("_v"))
        .where(F.col("_v").isNotNull())
    )


def exact_medians_rolled_up(df: DataFrame, fine: Sequence[str], values, parents: DataFrame, roll_up, keys: Sequence[str], tiebreak: Column) -> tuple[DataFrame, DataFrame]:
    """Exact medians of the groups ``fine`` and of wider groups made of them, in wide form.

    ``roll_up(rows, columns)`` copies rows to their wider groups ``keys``; ``parents`` holds what it needs for
    each group of ``fine``, one row a pair.  Only the fine groups are sorted whole.  The median of a wider group lies between the
    least and the greatest median of its parts, so there only the rows between these are sorted, after one counting
    pass; a group that this bracket misses, whole."""
    fine, keys = list(fine), list(keys)
    picked = materialize(_rank_select(_stack_values(df, fine, values, tiebreak), [*fine, "_m"], None, probs=(0.5,)), "quantile-fine")
    ends = roll_up(_null_safe_join(parents, picked.select(*fine, "_m", "_v"), fine), ["_m", "_v"])
    ends = ends.groupBy(*keys, "_m").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b")).withColumn("_p", F.lit(0.5))
    rows = roll_up(df.withColumns({n: e for n, e in _value_exprs(values)} | {"_t": tiebreak}), ["_t", *[n for n, _ in _value_exprs(values)]])
    stacked = _stack_values(rows, keys, [n for n, _ in _value_exprs(values)], F.col("_t"))
    wider = _between(stacked, [*keys, "_m"], ends, (0.5,), None)
    wide = lambda long, by: long.groupBy(*by).agg(*[F.max(F.when(F.col("_m") == i, F.col("_q"))).alias(n) for i, (n, _) in enumerate(_value_exprs(values))])
    return wide(_interpolate(picked, fine), fine), wide(_interpolate(wider, keys), keys)


def exact_quantiles_long(
    df: DataFrame,
    keys: Sequence[str],
    values,
    probs: Sequence[float] = (0.5,),
    tiebreak: Column | None = None,
    num_partitions: int | None = None,
    method: str = "sort",
    accuracy: int = 10000,
) -> DataFrame:
    """Exact quantiles per group, long form.

    Returns ``(*keys, metric, prob, n, quantile)`` with one row per group,
    value column and probability (groups whose values are all NULL for a
    metric produce no row for it).

    ``values`` is a list of column names or a ``{name: Column}`` mapping.
    ``tiebreak`` should be a deterministic per-row expression (for example a
    hash of the row's natural key); it defaults to a hash of all columns.
    ``num_partitions`` fixes the range-partition count; by default the
    session's shuffle settings decide (``spark.sql.shuffle.partitions`` or
    AQE's initial partition number) and AQE merges small neighbours, which
    keeps the global order.  ``accuracy`` sizes the bracket sketches.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    keys = list(keys)
    exprs = _value_exprs(values)
    tb = tiebreak if tiebreak is not None else F.xxhash64(*[F.col(c) for c in df.columns])
    stacked = _stack_values(df, keys, values, tb)
    if method == "sort":
        out = _sort_method(stacked, keys, probs, num_partitions)
    else:
        out = _bracket_method(stacked, keys, probs, accuracy, num_partitions)
    names = F.element_at(F.array(*[F.lit(n) for n, _ in exprs]), F.col("_m") + 1)
    return out.select(
        *keys,
        names.alias("metric"),
        F.col("_p").alias("prob"),
        F.col("_n").alias("n"),
        F.col("_q").alias("quantile"),
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    values,
    probs: Sequence[float] = (0.5,),
    names: Mapping[tuple[str, float], str] | None = None,
    tiebreak: Column | None = None,
    num_partitions: int | None = None,
    method: str = "sort",
    accuracy: int = 10000,
) -> DataFrame:
    """Exact quantiles per group, wide form: one column per (value, prob).

    Column names default to the value name for a single probability and to
    ``{value}_p{100*prob}`` otherwise; ``names`` overrides them.
    """
    exprs = _value_exprs(values)
    long = exact_quantiles_long(df, keys, values, probs, tiebreak, num_partitions, method, accuracy)
    cols = []
    for name, _ in exprs:
        for p in probs:
            alias = (names or {}).get((name, p))
            if alias is None:
                alias = name if len(probs) == 1 else f"{name}_p{round(p * 100):d}"
            pick = (F.col("metric") == name) & (F.col("prob") == float(p))
            cols.append(F.max(F.when(pick, F.col("quantile"))).alias(alias))
    return long.groupBy(*keys).agg(*cols)


def exact_median(df: DataFrame, keys: Sequence[str], values, **kw) -> DataFrame:
    """Exact median per group for each value column (wide form)."""
    return exact_quantiles(df, keys, values, probs=(0.5,), **kw)
