"""Document fingerprints: Merkle trees over sections, paragraphs and runs of a paragraph, in built-in functions only.

Sections are parted by an empty line, paragraphs by a line end; a paragraph's leaves are runs of code points, short
ones at its beginning (`HEAD`), so that short paragraphs have several, and then of `run` each. A node's hash is the SHA-256 of its children's hashes, so roots test equality and unequal branches lead to
the edits. A fingerprint is `root|tree|leaves`: the root in full, per section its hash and its paragraphs with their
numbers of leaves, and the first 8 digits of each leaf's hash. The likeness of two fingerprints is 1 if the roots
agree, else twice their common (distinct) leaves by the sum of both.

Edge cases: a null text counts as empty (one section, one paragraph, no leaf); of two empty texts the likeness is 1; a
very long text is hashed whole, in one row. Rows of equal doc_id stand in the order of their text's hash, and in one
range; null doc_ids come last. With one row, the next document is itself; a table without rows gives none. All columns
of the input stay, whatever their names, but those that a result's name replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm._base import plain

#: Places (from 1) and widths of a paragraph's first leaves.
HEAD = ((1, 8), (9, 24), (33, 32))


def _sha(c: Column) -> Column:
    return F.sha2(c, 256)


def _nodes(df: DataFrame, text: str, name: str, run: int) -> DataFrame:
    """df with the fingerprint of column text as column name; the columns between hold one level each."""
    def cut(p: Column) -> Column:
        head = F.filter(F.array(*[F.substring(p, a, n) for a, n in HEAD]), lambda x: x != "")
        rest = F.substring(p, F.lit(sum(HEAD[-1])), F.length(p))
        return F.transform(F.concat(head, F.regexp_extract_all(rest, F.lit(f"(?s).{{1,{run}}}"), F.lit(0))), _sha)

    leaves = F.transform(F.split(text, "\n\n", -1), lambda section: F.transform(F.split(section, "\n", -1), cut))
    df = df.withColumn("leaves_", leaves)
    df = df.withColumn("paragraphs_", F.transform("leaves_", lambda section: F.transform(section, lambda p: F.struct(_sha(F.array_join(p, "")).alias("hash"), F.size(p).alias("n")))))
    df = df.withColumn("sections_", F.transform("paragraphs_", lambda section: _sha(F.array_join(F.transform(section, lambda p: p["hash"]), ""))))
    tree = F.transform("paragraphs_", lambda section: F.array_join(F.transform(section, lambda p: F.concat(F.substring(p["hash"], 1, 8), F.lit("*"), p["n"].cast("string"))), ","))
    branches = F.array_join(F.zip_with("sections_", tree, lambda s, t: F.concat(F.substring(s, 1, 8), F.lit(":"), t)), ";")
    ends = F.array_join(F.transform(F.flatten(F.flatten("leaves_")), lambda x: F.substring(x, 1, 8)), "")
    return df.withColumn(name, F.concat(_sha(F.array_join("sections_", "")), F.lit("|"), branches, F.lit("|"), ends)).drop("leaves_", "paragraphs_", "sections_")


def fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint", run: int = 64) -> DataFrame:
    """df with the fingerprint of column text as column name."""
    df = df.drop(name)
    named = plain(df)
    at = named.columns[df.columns.index(text)]
    return _nodes(named.withColumn("whole_", F.coalesce(F.col(at), F.lit(""))), "whole_", "fingerprint_", run).drop("whole_").toDF(*df.columns, name)


def likeness(a: Column, b: Column) -> Column:
    def ends(x: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.substring_index(x, "|", -1), F.lit(".{8}"), F.lit(0)))

    both = F.size(ends(a)) + F.size(ends(b))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).when(both == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(ends(a), ends(b))) / both)


def edits(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the sections whose branches differ between two fingerprints."""
    def sections(x: Column) -> Column:
        return F.split(F.substring_index(F.substring_index(x, "|", 2), "|", -1), ";")

    numbered = F.zip_with(sections(a), sections(b), lambda x, y: ~x.eqNullSafe(y))
    return F.filter(F.transform(numbered, lambda differs, i: F.when(differs, i)), lambda i: i.isNotNull())


def with_next(docs: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """docs (doc_id, text, ...) with next_<column> of the following row in descending doc_id order, cyclically.

    Ids are cut into ranges by quantiles; each range is sorted by itself and gets a copy of the row that follows it,
    so that no task sees more than a range. Null ids take places below all others by their text's hash.
    """
    given = docs.drop(*[f"next_{c}" for c in columns])
    docs = plain(given, "doc_id", "text")
    of = dict(zip(given.columns, docs.columns))
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    floor = -(1 << 63)
    placed = docs.withColumn("place_", F.coalesce(F.col("doc_id").cast("long"), F.lit(floor) + F.pmod(F.xxhash64("text"), F.lit(1 << 40))))
    cuts = sorted(set(placed.approxQuantile("place_", [i / buckets for i in range(1, buckets)], 0.2 / buckets)))
    bucket = F.lit(0)
    if cuts:
        limits = F.array(*[F.lit(int(c)) for c in cuts])
        bucket = F.size(F.filter(limits, lambda c: c <= F.col("place_"))) if len(cuts) < 8 else _bisect(limits, len(cuts))
    placed = placed.withColumn("bucket_", bucket)
    tops = sorted(((r[0], r[1]) for r in placed.groupBy("bucket_").agg(F.max("place_")).collect()), reverse=True)  # one row for each range
    schema = "edge_ long, receiver_ int"
    edges = [(top, tops[i - 1][0]) for i, (_, top) in enumerate(tops)]
    marked = placed.join(F.broadcast(docs.sparkSession.createDataFrame(edges, schema)), F.col("place_") == F.col("edge_"), "left")
    own = F.struct(F.col("bucket_").alias("b"), F.lit(0).alias("ghost"))
    ghost = F.when(F.col("receiver_").isNotNull(), F.struct(F.col("receiver_").alias("b"), F.lit(1).alias("ghost")))
    dealt = marked.withColumn("to_", F.explode(F.array_compact(F.array(own, ghost)))).select(*docs.columns, "place_", F.col("to_.b").alias("bucket_"), F.col("to_.ghost").alias("ghost_"))
    order = Window.partitionBy("bucket_").orderBy("ghost_", F.col("place_").desc(), F.xxhash64("text"))
    followed = dealt.select("*", *[F.lead(of[c]).over(order).alias(f"follows{i}_") for i, c in enumerate(columns)]).where("ghost_ = 0").drop("place_", "bucket_", "ghost_")
    return followed.toDF(*given.columns, *[f"next_{c}" for c in columns])


def _bisect(limits: Column, n: int) -> Column:
    """How many of the sorted limits are at most place_."""
    steps = F.sequence(F.lit(1), F.lit(n.bit_length()))
    state = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        over = (acc["low"] < acc["high"]) & (F.get(limits, middle) <= F.col("place_"))
        return F.struct(F.when(over, middle + 1).otherwise(acc["low"]).alias("low"), F.when(over | (acc["low"] >= acc["high"]), acc["high"]).otherwise(middle).alias("high"))

    return F.aggregate(steps, state, halve, lambda acc: acc["low"])


def query(docs: DataFrame, run: int = 64) -> DataFrame:
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = fingerprint(base, run=run)
    rows = with_next(base, ["text", "fingerprint"]).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))).drop("text", "next_text")
    out = fingerprint(edited, "edited", "edited_fingerprint", run)
    return out.select("doc_id", "n_chars", _sha(F.col("edited")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
