"""Column expressions and grouped statistics that several operators use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.storage import by_part, numbered, release, shared_table


def clean(c: str, df: DataFrame) -> Column:
    """A numeric column as double, NaN as null."""
    d = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(d), d)


def safe_div(a: Column, b: Column) -> Column:
    """IEEE division: by zero it gives NaN or an infinity of the numerator's sign."""
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, zero).otherwise(a / b)


def stats(df: DataFrame, **exprs: Column) -> dict:
    """All statistics of a stage in one pass."""
    return df.agg(*[e.alias(k) for k, e in exprs.items()]).first().asDict()


def values_at(df: DataFrame, c: str, wanted) -> tuple[int, dict[int, float]]:
    """(number of values of column c, those at some places in sorted order); wanted: gives the places for the number.

    The column is counted by value and ranked by running counts over value ranges, so that no task sorts it whole. The
    counts are written, so that a computed column is computed once and not in each comparison with a range's bound.
    """
    counts = shared_table(df.select(clean(c, df).alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n")), "counts")
    try:
        return _values_at(counts, wanted)
    finally:
        release(counts)


def _values_at(counts: DataFrame, wanted) -> tuple[int, dict[int, float]]:
    cuts = sorted({float(x) for x in counts.approxQuantile("v", [i / 32 for i in range(1, 32)], 0.01)})
    bucket = reduce(lambda acc, x: acc + (F.col("v") > x).cast("int"), cuts, F.lit(0))
    dealt = counts.withColumn("bucket", bucket)
    sizes = sorted(tuple(r) for r in dealt.groupBy("bucket").agg(F.sum("n")).collect())  # at most 32 rows
    total, before = sum(n for _, n in sizes), 0
    if not total:
        return 0, {}
    places, inner = sorted({*wanted(total)}), {}
    for b, n in sizes:
        if own := [i - before for i in places if before <= i < before + n]:
            inner[b] = (before, own)
        before += n
    own = F.lit(None).cast("array<bigint>")
    for b, (_, at) in inner.items():
        own = F.when(F.col("bucket") == b, F.array(*[F.lit(i).cast("bigint") for i in at])).otherwise(own)
    ranked = dealt.where(F.col("bucket").isin(list(inner))).withColumn("upto", F.sum("n").over(Window.partitionBy("bucket").orderBy("v")))
    met = ranked.select("bucket", "v", F.explode(F.filter(own, lambda i: (i < F.col("upto")) & (i >= F.col("upto") - F.col("n")))).alias("i"))
    return total, {inner[b][0] + i: v for b, v, i in met.collect()}  # one row for each place asked for


def nearest_quantiles(df: DataFrame, columns: list[str], qs: list[float]) -> dict[str, list]:
    """Quantiles that are values of the column: the one at index floor(q (n - 1) + 1/2) in sorted order."""
    out: dict[str, list] = {}
    for c in columns:
        total, found = values_at(df, c, lambda n: [int(q * (n - 1) + 0.5) for q in qs])
        out[c] = [found[int(q * (total - 1) + 0.5)] if total else None for q in qs]
    return out


def linear_quantiles(df: DataFrame, columns: list[str], qs: list[float]) -> dict[str, list]:
    """Quantiles between the values around place q (n - 1), by interpolation; an empty list for a column of nulls."""
    out: dict[str, list] = {}
    for c in columns:
        total, found = values_at(df, c, lambda n: [i for q in qs for i in (int(q * (n - 1)), min(n - 1, int(q * (n - 1)) + 1))])
        out[c] = []
        for q in qs if total else ():
            at = q * (total - 1)
            low = int(at)
            a, b = found[low], found[min(total - 1, low + 1)]
            out[c].append(a + (b - a) * (at - low) if b != a else a)
    return out


def upper_break(x: Column, breaks: list[float]) -> Column:
    """The least break that is not below x, or infinity."""
    above = F.filter(F.array(*map(F.lit, map(float, breaks))), lambda b: x <= b) if breaks else F.array().cast("array<double>")
    return F.when(x.isNotNull(), F.coalesce(F.get(above, 0), F.lit(float("inf"))))


def average_ranks(df: DataFrame, c: str, name: str) -> DataFrame:
    """df with the average rank of column c, by way of value counts that are summed up range by range."""
    counts = df.groupBy(F.col(f"`{c}`").alias("v_")).agg(F.count(F.lit(1)).alias("n_"))
    placed = numbered(counts, [F.col("v_")])
    before, total = {}, 0
    for p, n in sorted(tuple(r) for r in placed.groupBy("part_").agg(F.sum("n_")).collect()):  # one row for each range
        before[p], total = total, total + n
    upto = F.sum("n_").over(Window.partitionBy("part_").orderBy("place_")) + by_part(before)
    ranked = placed.select("v_", (upto - (F.col("n_") - 1) / 2).alias(name))
    return df.join(ranked, F.col(f"`{c}`").eqNullSafe(F.col("v_"))).drop("v_")
