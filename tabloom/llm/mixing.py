"""Mixing sources to target weights by entropy balancing.

The mix is the one nearest to the corpus in relative entropy over its words whose words per source meet their
targets. Its dual is convex; Newton iterations run distributed over the constraint cells (documents of equal
features, added up before the shuffle and written, so that no iteration looks at documents again), with the multipliers
as a column: rate = exp(multiplier), so every word of a source is tilted alike and a document's rate never exceeds the
cap. Rates become whole copies by diffusing the rounding error from large to small documents within bounded buckets of
a source.

Edge cases: a null text has size 0 and is taken 0 times over, as is one without words; a null source is one source, the
last; a source without words has target 0; a very long text is one document, so it comes whole or not at all; an empty
table gives no row. Equal documents differ by doc_id, and repeated rows by place; sources of equal size differ by name.
Columns other than doc_id, text and source, whatever their names, play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm._base import plain, shared_table


@dataclass(frozen=True)
class MixParams:
    """weights repeat over the sources in code-point order; cap: most times a word may be taken;
    bucket_rows: documents that are rounded together, about; tolerance: of a constraint, relative."""

    weights: tuple[int, ...] = (1, 2, 3)
    cap: int = 3
    bucket_rows: int = 4096
    tolerance: float = 1e-9
    max_steps: int = 60


def size_of(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ words, by the places where one starts."""
    blank = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.regexp_count(blank, F.lit("[^ ]+")), F.lit(0)).cast("long")


def _placed(sources: DataFrame) -> DataFrame:
    """sources with place, from 0 on in code-point order, null last: places in sorted partitions, and what lies before."""
    order = F.col("source").asc_nulls_last()
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sources.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id())
    dealt = shared_table(dealt, "sources")
    part, offset, total = F.shiftright("at", 33), F.lit(0), 0
    for p, k in sorted(tuple(r) for r in dealt.groupBy(part).count().collect()):  # one row for each partition
        offset, total = F.when(part >= p, total).otherwise(offset), total + k
    return dealt.withColumn("place", F.col("at") - F.shiftleft(part, 33) + offset).drop("at")


def targets(sources: DataFrame, params: MixParams) -> DataFrame:
    """sources (source, source_size, ...) with target: shares by weight, held at cap times the size where they exceed
    it, and the excess reshared among the others by weight until none does."""
    n = len(params.weights)
    weight = F.element_at(F.array(*map(F.lit, params.weights)), (F.col("place") % n + 1).cast("int")).cast("long")
    given = shared_table(_placed(sources).withColumns({"weight": weight, "most": F.col("source_size") * params.cap}), "shares")
    total, held, level = given.agg(F.sum("source_size")).first()[0] or 0, -1, 0.0
    while True:  # the level of a weight's share only grows, and with it what is held
        over = F.col("most") < F.lit(level) * F.col("weight") if held >= 0 else F.lit(False)
        number, words, free = given.agg(F.count_if(over), F.sum(F.when(over, F.col("most")).otherwise(0)), F.sum(F.when(~over, F.col("weight")))).first()
        if number == held or not free:
            break
        held, level = number, (total - words) / free
    share = F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight"))
    return given.withColumn("target", share).drop("place", "weight", "most")


def balance(cells: DataFrame, params: MixParams) -> DataFrame:
    """cells (source_size, target, ...) with rate = exp(multiplier), by Newton steps on the dual.

    The dual of relative entropy under sum(size x rate) = target is sum(size x exp(m)) - m x target; its Hessian is
    diagonal over disjoint constraints. Steps are taken for all cells at once until the largest relative residual of
    any constraint is within the tolerance.
    """
    live = (F.col("source_size") > 0) & (F.col("target") > 0)
    now = cells.withColumn("multiplier", F.when(live, F.lit(0.0)))
    mass = F.col("source_size") * F.exp("multiplier")
    for step in range(params.max_steps):
        worst = now.agg(F.max(F.abs(mass - F.col("target")) / F.col("target"))).first()[0]
        if worst is None or worst <= params.tolerance:
            break
        now = now.withColumn("multiplier", F.col("multiplier") - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (mass - F.col("target")) / mass)))
        if step % 8 == 7:
            now = shared_table(now, "multipliers")
    return now.withColumn("rate", F.when(live, F.least(F.exp("multiplier"), F.lit(float(params.cap)))).otherwise(0.0)).drop("multiplier")


def _round(columns, frame):
    """copies of each row of a bucket: the floor or ceiling of the rate, whichever brings the words taken so far
    nearer to what the rate asks; from the largest document to the smallest."""
    frame = frame.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", na_position="last")
    rate = float(frame["rate"].iloc[0])
    low, owed, copies = int(rate), 0.0, []
    high = low if rate == low else low + 1
    for size in frame["size"].tolist():
        owed += size * rate
        take = high if owed - size * low > size * (high - low) / 2 else low
        owed -= take * size
        copies.append(take)
    frame["copies"] = copies
    return frame[columns]


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """Of each row of docs (doc_id, text, source): doc_id, size, source, source_size, target, rate and copies."""
    sized = shared_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of(F.col("text")).alias("size")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rated = shared_table(balance(shared_table(targets(sources, params), "targets"), params), "rates")
    # a source's documents are dealt over as many buckets as its rows ask for, so none grows with the source
    keyed = rated.withColumnRenamed("source", "s")
    drawn = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("size").cast("string"))), 1, 15), 16, 10).cast("long")
    bucket = drawn % F.ceil(F.col("n_docs") / params.bucket_rows).cast("long")
    rows = sized.join(keyed, F.col("source").eqNullSafe(F.col("s"))).withColumn("bucket", bucket).drop("s", "n_docs")
    columns = ["doc_id", "size", "source", "source_size", "target", "rate", "copies"]
    return rows.groupBy("source", "bucket").applyInPandas(lambda f: _round(columns, f), "doc_id long, size long, source string, source_size long, target double, rate double, copies int")


def query(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    out = mix(docs, params)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def resample(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """docs with each row as often as the mix takes it; rows equal in doc_id, size and source share the largest number."""
    renamed = plain(docs, "doc_id", "text", "source")
    given = mix(docs, params).groupBy(F.col("doc_id").alias("own_id"), F.col("size").alias("own_size"), F.col("source").alias("own_source")).agg(F.max("copies").alias("copies_"))
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (size_of(F.col("text")) == F.col("own_size")) & F.col("source").eqNullSafe(F.col("own_source"))
    taken = renamed.join(given.where("copies_ > 0"), same)
    return taken.withColumn("copy_", F.explode(F.array_repeat(F.lit(1), F.col("copies_")))).select(*renamed.columns).toDF(*docs.columns)
