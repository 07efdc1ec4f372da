"""The registered queries of the library's own operators, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.core import Dataset, Feature, Role, union_all
from tabloom.functions import sampling
from tabloom.functions.profile import Profile
from tabloom.operators import operator
from tabloom.plans import pipelines, results
from tabloom.sources import beside

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, make, sql: str | None = None) -> None:
    """make: (spark, dir) to frame."""
    QUERIES[name] = make
    if sql:
        SQL[name] = sql


def _stage(name: str, stage: str, source: tuple[str, str], sql: str | None = None, target: str | None = None, inverse: bool = False, finish=None, **params) -> None:
    """A query that fits and applies one operator to a projection of a table, written as (table, projection)."""

    def make(spark, sf_dir):
        ds = Dataset(_table(spark, sf_dir, source[0]).selectExpr(*_split(source[1])), target=target)
        fitted = operator(stage)(**params)
        out = fitted.fit_transform(ds)
        out = fitted.inverse_transform(out).df if inverse else out.df
        return finish(out, fitted) if finish else out

    _add(name, make, sql)


def _split(projection: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(projection):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(projection[at:i])
            at = i + 1
    return [x.strip() for x in [*out, projection[at:]]]


# types
_stage("cast_float", "CastFloat", ("lineitem", "l_orderkey, l_linenumber, cast(l_quantity as float) AS qty, cast(l_tax as decimal(8,2)) AS tax"), "SELECT l_orderkey, l_linenumber, cast(cast(l_quantity AS float) AS double) AS qty, cast(cast(l_tax AS decimal(8,2)) AS double) AS tax FROM lineitem")
_stage("cast_int", "CastInt", ("lineitem", "l_orderkey, l_linenumber"), "SELECT l_orderkey, cast(l_linenumber AS bigint) AS l_linenumber FROM lineitem")
_stage("cast_uint", "CastUInt", ("part", "p_partkey, p_size"), "SELECT p_partkey, cast(p_size AS bigint) AS p_size FROM part")
_stage("cast_str", "CastStr", ("customer", "c_custkey, c_mktsegment"), "SELECT c_custkey, c_mktsegment FROM customer")
_DISC = ("lineitem", "l_orderkey, l_linenumber, l_discount > 0.05 AS is_disc")
for _n, _t in (("boolean_to_str", "BooleanToStr"), ("boolean_to_categorical", "BooleanToCategorical")):
    _stage(_n, _t, _DISC, "SELECT l_orderkey, l_linenumber, cast(l_discount > 0.05 AS varchar) AS is_disc FROM lineitem")
_stage("boolean_to_int", "BooleanToInt", _DISC, "SELECT l_orderkey, l_linenumber, cast(l_discount > 0.05 AS bigint) AS is_disc FROM lineitem")
_stage("temporal_to_int", "TemporalToInt", ("orders", "o_orderkey, o_orderdate, cast(o_orderdate as date) AS day"), "SELECT o_orderkey, epoch_us(o_orderdate) AS o_orderdate, cast(cast(o_orderdate AS date) - DATE '1970-01-01' AS bigint) AS day FROM orders")
_stage("str_to_temporal", "StrToTemporal", ("orders", "o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS d"), "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE cast(o_orderdate AS date) END AS d FROM orders", share=0.5, columns=["d"])
_stage("str_decode", "StrDecode", ("events", "event_id, CASE WHEN event_id % 5 = 0 THEN 'nan' ELSE cast(value as string) END AS v"), "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v FROM events", columns=["v"])
_stage("list_explode", "ListExplode", ("embeddings", "vec_id, embedding"), "SELECT vec_id, unnest(embedding) AS embedding FROM embeddings")
_stage("dict_unnest", "DictUnnest", ("nation", "n_nationkey, named_struct('k', n_regionkey, 'name', n_name) AS s"), "SELECT n_nationkey, n_regionkey AS k, n_name AS name FROM nation")
_stage("drop_unsupported_types", "DropUnsupportedTypes", ("embeddings", "vec_id, embedding, label"), "SELECT vec_id, label FROM embeddings")
# missing values
_NULLS = ("lineitem", "l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS qty, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_returnflag END AS flag, cast(NULL as double) AS none")
_N = "(SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS qty, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_returnflag END AS flag, cast(NULL AS double) AS none FROM lineitem)"
_stage("drop_unnamed_columns", "DropUnnamedColumns", ("nation", "n_nationkey, n_name AS _duplicated_0"), "SELECT n_nationkey FROM nation")
_stage("drop_none_columns", "DropNoneColumns", _NULLS, f"SELECT l_orderkey, l_partkey, l_linenumber, qty, flag FROM {_N}")
_stage("drop_none_rows", "DropNoneRows", ("lineitem", "nullif(l_linenumber, 1) AS n, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS qty"), "SELECT l_linenumber AS n, l_quantity AS qty FROM lineitem WHERE l_linenumber <> 1")
_stage("fill_nan_with_none", "FillNaNWithNone", ("events", "event_id, CASE WHEN event_id % 9 = 0 THEN double('NaN') ELSE value END AS value"), "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value FROM events")
_stage("encode_none", "EncodeNone", _NULLS, f"SELECT *, cast(qty IS NULL AS varchar) AS qty_missing, cast(flag IS NULL AS varchar) AS flag_missing, 'true' AS none_missing FROM {_N}")
_stage("drop_none", "DropNone", _NULLS, f"SELECT * FROM {_N} WHERE qty IS NOT NULL AND flag IS NOT NULL", columns=["qty", "flag"])
_stage("fill_none_numeric_value", "FillNoneNumericValue", _NULLS, f"SELECT * REPLACE (coalesce(qty, -1) AS qty, -1.0::double AS none) FROM {_N}")
_stage("fill_none_categorical_value", "FillNoneCategoricalValue", _NULLS, f"SELECT * REPLACE (coalesce(flag, '_missing_') AS flag) FROM {_N}")
_stage("fill_none_mean", "FillNoneMean", _NULLS, f"SELECT l_orderkey, l_linenumber, round(coalesce(qty, (SELECT avg(qty) FROM {_N})), 6) AS qty FROM {_N}", columns=["qty"], finish=lambda df, s: df.select("l_orderkey", "l_linenumber", F.round("qty", 6).alias("qty")))
_stage("fill_none_mode", "FillNoneMode", _NULLS, f"SELECT * REPLACE (coalesce(flag, (SELECT flag FROM {_N} WHERE flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, flag LIMIT 1)) AS flag) FROM {_N}", columns=["flag"])
_GAPS = ("events", "event_id, user_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value")
_G = "(SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value FROM events)"
_ORDER = {"columns": ["value"], "order_by": ["event_id"], "partition_by": ["user_id"]}
_stage("fill_none_forward", "FillNoneForward", _GAPS, f"SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS value FROM {_G}", **_ORDER)
_stage("fill_none_backward", "FillNoneBackward", _GAPS, f"SELECT event_id, user_id, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {_G}", **_ORDER)
_W = "OVER (PARTITION BY user_id ORDER BY event_id ROWS "
_WHOLE = {"columns": ["value"], "order_by": ["event_id"]}
_stage("fill_none_forward_whole", "FillNoneForward", _GAPS, f"SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS value FROM {_G}", **_WHOLE)
_stage("fill_none_backward_whole", "FillNoneBackward", _GAPS, f"SELECT event_id, user_id, first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {_G}", **_WHOLE)
_stage("fill_none_interpolation", "FillNoneInterpolation", _GAPS, f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM {_G}), w AS (SELECT *, last_value(value IGNORE NULLS) {_W} UNBOUNDED PRECEDING) AS a, first_value(value IGNORE NULLS) {_W} BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) {_W} UNBOUNDED PRECEDING) AS ia, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) {_W} BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib FROM p) SELECT event_id, user_id, round(CASE WHEN value IS NOT NULL THEN value ELSE a + (b - a) * (i - ia) / nullif(ib - ia, 0) END, 6) AS value FROM w", finish=lambda df, s: df.withColumn("value", F.round("value", 6)), **_ORDER)
# duplicates
_DUP = ("lineitem", "l_returnflag, l_linestatus, l_linenumber")
_stage("drop_duplicates", "DropDuplicates", _DUP, "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
_stage("aggregate_duplicates", "AggregateDuplicates", _DUP, "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS duplicate_count FROM lineitem GROUP BY ALL")
# encoding
_HOT = ", ".join(f"cast(o_orderstatus = '{v}' AS int) AS o_orderstatus_{v}" for v in "FOP")
for _n, _t in (("encode_one_hot", "EncodeOneHot"), ("encode_one_hot_or_hash", "EncodeOneHotOrHash")):
    _stage(_n, _t, ("orders", "o_orderkey, o_orderstatus"), f"SELECT o_orderkey, {_HOT} FROM orders")
_alike = lambda key, c: lambda df, s=None: df.withColumn(c, F.min(key).over(Window.partitionBy(c)))
_stage("encode_hash", "EncodeHash", ("customer", "c_custkey, c_mktsegment"), "SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_mktsegment) AS c_mktsegment FROM customer", finish=_alike("c_custkey", "c_mktsegment"))  # which rows share a hash
_CODE = "SELECT c_custkey, cast(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS bigint) AS c_mktsegment FROM customer"
_stage("encode_int", "EncodeInt", ("customer", "c_custkey, c_mktsegment"), _CODE)
_stage("encode_int_target", "EncodeIntTarget", ("customer", "c_custkey, c_mktsegment"), _CODE, target="c_mktsegment")
_stage("encode_int_inverse", "EncodeInt", ("customer", "c_custkey, c_mktsegment"), "SELECT c_custkey, c_mktsegment FROM customer", inverse=True)
# outliers
_NUM = ("lineitem", "l_orderkey, l_linenumber, l_quantity, l_extendedprice")
_stage("outliers_std", "RemoveOutliersSTD", _NUM, "WITH b AS (SELECT avg(l_quantity) AS m1, stddev_samp(l_quantity) AS s1, avg(l_extendedprice) AS m2, stddev_samp(l_extendedprice) AS s2 FROM lineitem) SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem, b WHERE l_quantity BETWEEN m1 - 2*s1 AND m1 + 2*s1 AND l_extendedprice BETWEEN m2 - 2*s2 AND m2 + 2*s2", columns=["l_quantity", "l_extendedprice"], cutoff_coef=2)
_Q = "(SELECT l_extendedprice FROM lineitem ORDER BY 1 LIMIT 1 OFFSET (SELECT cast(floor({q} * (count(*) - 1) + 0.5) AS bigint) FROM lineitem))"
_stage("outliers_iqr", "RemoveOutliersIQR", _NUM, f"WITH b AS (SELECT {_Q.format(q=0.25)} AS a, {_Q.format(q=0.75)} AS c) SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem, b WHERE l_extendedprice BETWEEN a - 2*(c-a) AND c + 2*(c-a)", columns=["l_extendedprice"], cutoff_coef=2)
def _envelope() -> str:
    """Moments, then three times those of the nearer half, then the nearer nine tenths; the inverse of two columns written out."""
    parts, inner = ["p AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice AS y FROM lineitem)"], "p"
    for k in range(4):
        parts.append(f"m{k} AS (SELECT avg(x) AS mx, avg(y) AS my, covar_samp(x, x) AS a, covar_samp(x, y) AS b, covar_samp(y, y) AS c FROM {inner})")
        parts.append(f"d{k} AS (SELECT p.*, ((x - mx) * (x - mx) * c - 2 * (x - mx) * (y - my) * b + (y - my) * (y - my) * a) / (a * c - b * b) AS d FROM p, m{k})")
        parts.append(f"h{k} AS (SELECT * FROM d{k} WHERE d <= (SELECT quantile_cont(d, 0.5) FROM d{k}))")
        inner = f"h{k}"
    return f"WITH {', '.join(parts)} SELECT l_orderkey, l_linenumber, x AS l_quantity, y AS l_extendedprice FROM d3 WHERE d <= (SELECT quantile_cont(d, 0.9) FROM d3)"


_stage("outliers_elliptic", "RemoveOutliersEllipticEnvelope", _NUM, _envelope(), columns=["l_quantity", "l_extendedprice"])
# scaling
_round = lambda *cs: lambda df, s: df.withColumns({c: F.round(c, 6) for c in cs})
_stage("normalize", "Normalize", _NUM, "SELECT l_orderkey, l_linenumber, round((l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()), 6) AS l_quantity, round((l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()), 6) AS l_extendedprice FROM lineitem", columns=["l_quantity", "l_extendedprice"], finish=_round("l_quantity", "l_extendedprice"))
_stage("standardize", "Standardize", _NUM, "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 6) AS l_quantity, l_extendedprice FROM lineitem", columns=["l_quantity"], finish=_round("l_quantity"))
_stage("scale_robust", "ScaleRobust", _NUM, f"WITH b AS (SELECT {_Q.format(q=0.25)} AS a, {_Q.format(q=0.75)} AS c, (SELECT median(l_extendedprice) FROM lineitem) AS m) SELECT l_orderkey, l_linenumber, l_quantity, round((l_extendedprice - m) / (c - a), 6) AS l_extendedprice FROM lineitem, b", columns=["l_extendedprice"], finish=_round("l_extendedprice"))
for _n, _t in (("normalize_inverse", "Normalize"), ("standardize_inverse", "Standardize"), ("scale_robust_inverse", "ScaleRobust")):
    _stage(_n, _t, _NUM, "SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice, 4) AS l_extendedprice FROM lineitem", columns=["l_extendedprice"], inverse=True, finish=lambda df, s: df.withColumn("l_extendedprice", F.round("l_extendedprice", 4)))
_stage(
    "quantile_transform",
    "QuantileTransform",
    ("customer", "c_custkey, c_acctbal"),
    # between the last landmark at or below a value and the first above it, from below and from above
    "WITH q AS (SELECT list(c_acctbal ORDER BY c_acctbal) AS s, count(*) AS n, least(1000, count(*)) AS k FROM customer),"
    " p AS (SELECT s, n, k, i, i * (n - 1) / (k - 1.0)::double AS w FROM (SELECT s, n, k, unnest(range(k)) AS i FROM q)),"
    " m AS (SELECT i, k, s[cast(floor(w) AS bigint) + 1] + (s[least(n, cast(floor(w) AS bigint) + 2)] - s[cast(floor(w) AS bigint) + 1]) * (w - floor(w)) AS v FROM p), c AS (SELECT c_custkey, c_acctbal AS x FROM customer),"
    " b AS (SELECT c_custkey, x, max(i) FILTER (v <= x) AS lo, min(i) FILTER (v > x) AS up, min(i) FILTER (v >= x) AS lo2, max(i) FILTER (v < x) AS dn, any_value(k) AS k FROM c, m GROUP BY 1, 2),"
    " f AS (SELECT b.*, coalesce(lo + (x - a.v) / (u.v - a.v), lo) AS up_place, coalesce(lo2 - (z.v - x) / (z.v - w.v), lo2) AS down_place FROM b LEFT JOIN m a ON a.i = lo LEFT JOIN m u ON u.i = up LEFT JOIN m z ON z.i = lo2 LEFT JOIN m w ON w.i = dn)"
    " SELECT c_custkey, round((up_place + down_place) / 2 / (k - 1), 6) AS c_acctbal FROM f",
    columns=["c_acctbal"],
    finish=_round("c_acctbal"),
)
# generated features
_stage("temporal_expand", "TemporalExpand", ("orders", "o_orderkey, o_orderdate"), "SELECT o_orderkey, o_orderdate, year(o_orderdate)::int AS o_orderdate_year, month(o_orderdate)::int AS o_orderdate_month, day(o_orderdate)::int AS o_orderdate_day, isodow(o_orderdate)::int AS o_orderdate_weekday, dayofyear(o_orderdate)::int AS o_orderdate_ordinal_day, hour(o_orderdate)::int AS o_orderdate_hour, minute(o_orderdate)::int AS o_orderdate_minute, second(o_orderdate)::int AS o_orderdate_second, (millisecond(o_orderdate) % 1000)::int AS o_orderdate_millisecond FROM orders")
_stage("discretize_uniform", "DiscretizeUniform", ("lineitem", "l_orderkey, l_quantity"), "WITH b AS (SELECT min(l_quantity) AS a, max(l_quantity) AS z FROM lineitem) SELECT l_orderkey, l_quantity, round(CASE WHEN l_quantity <= a THEN a WHEN l_quantity <= a + (z-a)/4 THEN a + (z-a)/4 WHEN l_quantity <= a + (z-a)*2/4 THEN a + (z-a)*2/4 WHEN l_quantity <= a + (z-a)*3/4 THEN a + (z-a)*3/4 WHEN l_quantity <= a + (z-a)*4/4 THEN a + (z-a)*4/4 ELSE 'inf'::double END, 6) AS l_quantity_discrete FROM lineitem, b", columns=["l_quantity"], bin_count=5, finish=_round("l_quantity_discrete"))
_stage("discretize_quantile", "DiscretizeQuantile", ("lineitem", "l_orderkey, l_quantity"), "WITH b AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [0.25, 0.5, 0.75]))) AS q FROM lineitem) SELECT l_orderkey, l_quantity, round(coalesce(list_min(list_filter(q, lambda x: l_quantity <= x)), 'inf'::double), 6) AS l_quantity_quantile FROM lineitem, b", columns=["l_quantity"], bin_count=4, finish=_round("l_quantity_quantile"))
_stage(
    "discretize_kmeans",
    "DiscretizeKMeans",
    ("lineitem", "l_orderkey, l_quantity"),
    # a hundred steps from the middles of ten equal bins; a value goes to the centre whose middles to the next ones enclose it
    "WITH RECURSIVE v AS (SELECT l_quantity AS x, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT min(x) AS a, max(x) AS z FROM v),"
    " s AS (SELECT 0 AS t, list_transform(range(10), lambda j: a + (z - a) * (2 * j + 1) / 20) AS c FROM e UNION ALL"
    " SELECT t + 1, list(m ORDER BY j) FROM (SELECT t, j, coalesce(sum(x * n) FILTER (own = j) / sum(n) FILTER (own = j), any_value(c[j + 1])) AS m"
    " FROM (SELECT t, c, x, n, len(list_filter(range(1, 10), lambda i: (c[i] + c[i + 1]) / 2 < x)) AS own FROM s, v WHERE t < 100), (SELECT unnest(range(10)) AS j) GROUP BY t, j) GROUP BY t),"
    " b AS (SELECT list_concat([a], list_concat(list_transform(range(1, 10), lambda i: (c[i] + c[i + 1]) / 2), [z])) AS b FROM s, e WHERE t = 100)"
    " SELECT l_orderkey, l_quantity, round(coalesce(list_min(list_filter(b, lambda m: l_quantity <= m)), 'inf'::double), 6) AS l_quantity_kmeans FROM lineitem, b",
    columns=["l_quantity"],
    finish=_round("l_quantity_kmeans"),
)
for _n, _t, _e in (("square", "TransformSquare", "x*x"), ("root", "TransformRoot", "CASE WHEN x < 0 THEN 'nan'::double ELSE sqrt(abs(x)) END"), ("log", "TransformLog", "CASE WHEN x = -1 THEN '-inf'::double WHEN x < -1 THEN 'nan'::double ELSE ln(1 + greatest(x, -0.5)) END"), ("exp", "TransformExp", "exp(x)")):
    _stage(f"transform_{_n}", _t, ("lineitem", "l_orderkey, l_linenumber, l_discount - 0.03 AS x"), f"SELECT l_orderkey, l_linenumber, x, round({_e}, 9) AS x_{_n} FROM (SELECT *, l_discount - 0.03 AS x FROM lineitem)", columns=["x"], finish=(lambda c: lambda df, s: df.withColumn(c, F.round(c, 9)))(f"x_{_n}"))
# selection: one row per feature with its score and whether it stays
_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _scores(df, stage):
    rows = [(c, round(stage.found[c], 6), c in stage.kept) for c in stage.columns]
    return df.sparkSession.createDataFrame(rows, "feature string, score double, kept boolean")


def _ranked(inner: str) -> str:
    return f"SELECT feature, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC) <= 2 AS kept FROM ({inner})"


def _each(expr: str, tail: str = "FROM lineitem") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {expr.format(c=c)} AS score {tail.format(c=c)}" for c in _FEATURES)


_SEL = ("lineitem", "l_quantity, l_discount, l_tax, l_linenumber, l_extendedprice")
_stage("select_pearson", "SelectUnivariatePearson", _SEL, _ranked(_each("corr({c}, l_extendedprice)")), target="l_extendedprice", finish=_scores)
_AVG = "(SELECT rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)"
_stage("select_spearman", "SelectUnivariateSpearman", _SEL, _ranked(_each("corr(a, b)", "FROM " + _AVG)), target="l_extendedprice", finish=_scores)
_CLS = ("lineitem", "l_quantity, l_discount, l_tax, l_linenumber, l_returnflag")
_stage("select_anova", "SelectUnivariateANOVA", _CLS, _ranked(_each("(sum(n * (m - t)^2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*)))", "FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM lineitem) AS t FROM lineitem GROUP BY l_returnflag)")), target="l_returnflag", finish=_scores)
_stage("select_chi2", "SelectUnivariateChi2", _CLS, _ranked(_each("sum((o - e)^2 / e)", "FROM (SELECT sum({c}) AS o, count(*)::double / (SELECT count(*) FROM lineitem) * (SELECT sum({c}) FROM lineitem) AS e FROM lineitem GROUP BY l_returnflag)")), target="l_returnflag", finish=_scores)


def _tau(c: str) -> str:
    """Rows of a lesser x and a lesser (at most equal) y than each row, by running sums over y and then over x."""
    return (
        f"(WITH w AS (SELECT {c} AS x, l_extendedprice AS y, count(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT y, x, coalesce(n, 0) AS n FROM (SELECT DISTINCT y FROM w) CROSS JOIN (SELECT DISTINCT x FROM w) LEFT JOIN w USING (x, y)),"
        " f AS (SELECT *, sum(n) OVER (PARTITION BY x ORDER BY y) AS upto, sum(n) OVER (PARTITION BY x) AS every FROM g),"
        " h AS (SELECT n, sum(upto) OVER o AS low, sum(n) OVER o AS same, sum(every) OVER o AS lesser FROM f WINDOW o AS (PARTITION BY y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),"
        " t AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM w GROUP BY x)) AS tx, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM w GROUP BY y)) AS ty, (SELECT sum(n) * (sum(n) - 1) / 2.0 FROM w) AS p)"
        " SELECT (sum(n * (low - same)) - sum(n * (lesser - low))) / (any_value(sqrt(p - tx)) * any_value(sqrt(p - ty))) FROM h, t WHERE n > 0)"
    )


_stage("select_kendall", "SelectUnivariateKendall", _SEL, _ranked(" UNION ALL ".join(f"SELECT '{c}' AS feature, {_tau(c)} AS score" for c in _FEATURES)), target="l_extendedprice", finish=_scores)
_QS = "list_distinct(quantile_cont({0}, list_transform(range(1, 32), lambda i: i / 32.0)))"


def _shared(c: str, y: str, other: str) -> str:
    """Mutual information of a grid of equal counts: 32 classes each way, or the classes of y as they are."""
    return (
        f"(WITH q AS (SELECT {_QS.format(c)} AS a, {_QS.format(y) if other else '[0.0]'} AS b FROM lineitem), g AS (SELECT len(list_filter(a, lambda m: m < {c})) AS x, {other or y} AS y FROM lineitem, q),"
        " j AS (SELECT x, y, count(*) AS n FROM g GROUP BY 1, 2), s AS (SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM j) SELECT sum(n / t * ln(n * t / (nx * ny)::double)) FROM s)"
    )


for _n, _t, _s, _y, _o in (("mutual_info_reg", "MutualInformationReg", _SEL, "l_extendedprice", "len(list_filter(b, lambda m: m < l_extendedprice))"), ("mutual_info_cls", "MutualInformationCls", _CLS, "l_returnflag", "")):
    _stage(f"select_{_n}", f"SelectUnivariate{_t}", _s, _ranked(" UNION ALL ".join(f"SELECT '{c}' AS feature, {_shared(c, _y, _o)} AS score" for c in _FEATURES)), target=_y, finish=_scores)
_stage("select_rfe_reg", "SelectRFEDecisionTreeReg", _SEL, target="l_extendedprice")
_stage("select_rfe_cls", "SelectRFEDecisionTreeCls", _CLS, target="l_returnflag")
_stage("drop_invariant_columns", "DropInvariantColumns", ("lineitem", "l_orderkey, l_linenumber, 1 AS one"), "SELECT l_orderkey, l_linenumber FROM lineitem")
_stage("select_variation_threshold", "SelectVariationThreshold", ("lineitem", "l_orderkey, l_quantity, 1000 + l_tax AS flat"), "SELECT l_orderkey, l_quantity FROM lineitem")
# reduction and neighbours
_DIMS = ", ".join(f"cast(embedding[{i}] as double) AS e{i}" for i in range(64))
_EMB = ("embeddings", f"vec_id, {_DIMS}, cast(label as string) AS label")
_E = [f"e{i}" for i in range(64)]
for _n, _t in (("pca", "DimReducePCA"), ("svd", "DimReduceTruncatedSVD"), ("lda", "DimReduceLDA")):
    _stage(f"dim_{_n}", _t, _EMB, target="label", columns=_E)
_GAP = ("embeddings", f"vec_id, CASE WHEN vec_id % 10 = 0 THEN NULL ELSE cast(embedding[0] as double) END AS e0, {_DIMS.split(', ', 1)[1]}")
_OWN = "e AS (SELECT vec_id AS r, embedding::double[] AS v, cast(label AS varchar) AS l FROM embeddings)"
_OUT = ", ".join(f"v[{i + 1}] AS e{i}" for i in range(64))
_DONORS = f"WITH {_OWN}, d AS (SELECT a.r, b.v[1] AS e0, row_number() OVER (PARTITION BY a.r ORDER BY list_distance(a.v[2:], b.v[2:])) AS k FROM e a JOIN e b ON a.r % 10 = 0 AND b.r % 10 <> 0), f AS (SELECT r, avg(e0) AS e0 FROM d WHERE k <= 5 GROUP BY r) SELECT e.r AS vec_id, round(coalesce(f.e0, v[1]), 6) AS e0, {_OUT.split(', ', 1)[1]} FROM e LEFT JOIN f USING (r)"
for _n, _t in (("knn", "KNN"), ("knn_or_mean", "KNNOrMean")):
    _stage(f"fill_none_{_n}", f"FillNone{_t}", _GAP, _DONORS, columns=_E, finish=_round("e0"))


def _balance(name: str, stage: str, projection: str, sql: str | None = None, **params) -> None:
    def make(spark, sf_dir):
        df = _table(spark, sf_dir, "embeddings").selectExpr(*_split(projection))
        return operator(stage)(**params).fit_transform(Dataset(df, target="label")).df

    _add(name, make, sql)


_PLAIN = f"{_DIMS}, cast(label as string) AS label"
_SMALL = "s AS (SELECT l FROM e GROUP BY l ORDER BY count(*), l LIMIT 1), z AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM e GROUP BY l))"
_NEAR = "n AS (SELECT a.r, a.l, b.r AS o, b.l AS ol, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.r ORDER BY list_distance(a.v, b.v), b.r) AS k FROM e a JOIN e b ON a.r <> b.r)"
_BALANCED = {
    "undersample_enn": f"WITH {_OWN}, {_SMALL}, {_NEAR} SELECT {_OUT}, l AS label FROM e WHERE l = (SELECT l FROM s) OR r NOT IN (SELECT r FROM n WHERE k <= 4 AND l <> ol)",
    "undersample_tomek": f"WITH {_OWN}, {_SMALL}, {_NEAR}, f AS (SELECT * FROM n WHERE k = 1) SELECT {_OUT}, l AS label FROM e WHERE l = (SELECT l FROM s) OR r NOT IN (SELECT a.r FROM f a JOIN f b ON a.o = b.r AND b.o = a.r WHERE a.l <> b.l)",
    "undersample_nearmiss": f"WITH {_OWN}, {_SMALL}, d AS (SELECT a.r, a.l, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.r ORDER BY list_distance(a.v, b.v)) AS k FROM e a JOIN e b ON a.l <> (SELECT l FROM s) AND b.l = (SELECT l FROM s)),"
    f" m AS (SELECT r, row_number() OVER (PARTITION BY l ORDER BY avg(d)) AS p FROM d WHERE k <= 5 GROUP BY r, l) SELECT {_OUT}, l AS label FROM e WHERE l = (SELECT l FROM s) OR r IN (SELECT r FROM m, z WHERE p <= n)",
}
for _n, _t in (("oversample_smote", "OversampleSMOTE"), ("oversample_adasyn", "OversampleADASYN"), ("oversample_smote_or_random", "OversampleSMOTEOrRandom"), ("undersample_enn", "UndersampleENN"), ("undersample_tomek", "UndersampleTomekLinks"), ("undersample_nearmiss", "UndersampleNearMiss"), ("undersample_cluster_centroids", "UndersampleClusterCentroids"), ("undersample_oss", "UndersampleOSS"), ("undersample_iht", "UndersampleIHT")):
    _balance(_n, _t, _PLAIN, _BALANCED.get(_n))
_balance("oversample_smotenc", "OversampleSMOTENC", f"{_DIMS}, concat('k', cast(vec_id % 7 as string)) AS kind, cast(label as string) AS label")
_balance("oversample_smoten", "OversampleSMOTEN", "concat('k', cast(vec_id % 7 as string)) AS kind, concat('p', cast(embedding[0] > 0 as string)) AS side, cast(label as string) AS label")
# outliers and reductions by neighbours
_VALUES = ("embeddings", f"vec_id, {_DIMS}")
_stage("outliers_isolation_forest", "RemoveOutliersIsolationForest", _VALUES, columns=_E)
_stage("outliers_one_class_svm", "RemoveOutliersOneClassSVM", _VALUES, columns=_E)
_stage("outliers_local_factor", "RemoveOutliersLocalOutlierFactor", _VALUES, f"WITH {_OWN}, {_NEAR}, t AS (SELECT r, o, d FROM n WHERE k <= 2), kd AS (SELECT r, max(d) AS kd FROM t GROUP BY r), lrd AS (SELECT t.r, 1 / (avg(greatest(kd.kd, d)) + 1e-10) AS lrd FROM t JOIN kd ON kd.r = t.o GROUP BY t.r), lof AS (SELECT t.r, avg(a.lrd) / any_value(b.lrd) AS lof FROM t JOIN lrd a ON a.r = t.o JOIN lrd b ON b.r = t.r GROUP BY t.r) SELECT r AS vec_id, {_OUT} FROM e JOIN lof USING (r) WHERE lof <= 1.5", columns=_E)
for _n, _t in (("kernel_pca", "DimReduceKernelPCA"), ("isomap", "DimReduceIsomap"), ("lle", "DimReduceLLE"), ("tsne", "DimReduceTSNE"), ("umap", "DimReduceUMAP")):
    _stage(f"dim_{_n}", _t, _EMB, target="label", columns=_E)
_H = "('0x' || substr(md5('42:' || doc_id || ':' || quality), 1, 15))::bigint"
_L = f"(SELECT doc_id, cast(quality AS varchar) AS quality, row_number() OVER (PARTITION BY quality ORDER BY {_H}) AS place, count(*) OVER (PARTITION BY quality) AS n FROM labels)"
_LAB = ("labels", "doc_id, cast(quality as string) AS quality")
_stage("undersample_random", "UndersampleRandom", _LAB, f"SELECT doc_id, quality FROM {_L} WHERE place <= 2 * (SELECT min(n) FROM {_L})", target="quality")
_stage("oversample_random", "OversampleRandom", _LAB, f"WITH l AS {_L}, w AS (SELECT cast(ceil(max(n) * 0.5) AS bigint) AS want FROM l) SELECT doc_id, quality FROM (SELECT doc_id, quality, unnest(range(cast(1 + CASE WHEN n < want THEN (want - n) // n + CASE WHEN place <= (want - n) % n THEN 1 ELSE 0 END ELSE 0 END AS bigint))) FROM l, w)", target="quality")
for _n, _part in (("train", "NOT"), ("test", "")):
    _add(f"stratified_split_{_n}", lambda spark, d, k=_n: sampling.split(_table(spark, d, "labels").selectExpr("doc_id", "cast(quality as string) AS quality"), 0.2, ["quality"], ["doc_id", "quality"])[k == "test"], f"SELECT doc_id, quality FROM {_L} WHERE {_part} place <= floor(n * 0.2 + 0.5)")
_M = "('0x' || substr(md5('{0}:' || doc_id || ':' || quality), 1, 15))::bigint"
_add("stratified_sample", lambda spark, d: sampling.stratified_sample(_table(spark, d, "labels").selectExpr("doc_id", "cast(quality as string) AS quality"), 50, 2, "quality", ["doc_id", "quality"]), f"WITH l AS {_L}, h AS (SELECT doc_id, quality FROM l WHERE place <= 2), o AS (SELECT doc_id, quality, row_number() OVER (ORDER BY {_M.format(43)}) AS p FROM l WHERE place > 2) SELECT * FROM h UNION ALL SELECT doc_id, quality FROM o WHERE p <= 50 - (SELECT count(*) FROM h)")
_add("subsample", lambda spark, d: sampling.subsample(_table(spark, d, "labels").selectExpr("doc_id", "cast(quality as string) AS quality"), 60, "quality", ["doc_id", "quality"]), f"SELECT doc_id, quality FROM {_L} WHERE place <= floor(n * (60 / (SELECT count(*) FROM labels)::double) + 0.5)")
_add("random_split_test", lambda spark, d: sampling.split(_table(spark, d, "orders").select("o_orderkey"), 0.2, [], ["o_orderkey"])[1], "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || o_orderkey), 1, 15))::bigint, o_orderkey) AS place, count(*) OVER () AS n FROM orders) WHERE place <= floor(n * 0.2 + 0.5)")
# plumbing
_add("union_diagonal", lambda spark, d: union_all([_table(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_name AS name", "s_acctbal"), _table(spark, d, "nation").selectExpr("n_nationkey AS k", "n_name AS name")]), "SELECT s_suppkey AS k, s_name AS name, s_acctbal FROM supplier UNION ALL SELECT n_nationkey, n_name, NULL FROM nation")
_add("beside", lambda spark, d: beside(_table(spark, d, "nation").select("n_nationkey", "n_name"), _table(spark, d, "region").select("r_regionkey", "r_name"), ["n_name"], ["r_name"]), "SELECT n_nationkey, n_name, r_regionkey, r_name FROM (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_name) AS p FROM nation) FULL JOIN (SELECT r_regionkey, r_name, row_number() OVER (ORDER BY r_name) AS p FROM region) USING (p)")
_add("feature_target_split", lambda spark, d: Dataset(_table(spark, d, "labels"), target="toxic").features(), "SELECT doc_id, quality FROM labels")
# profile
_add("profile_numeric", lambda spark, d: Profile(Dataset(_table(spark, d, "customer"))).numeric_frame().withColumns({c: F.round(c, 6) for c in ("mean", "std")}), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::double AS min, median({c})::double AS median, max({c})::double AS max FROM customer" for c in ("c_custkey", "c_nationkey", "c_acctbal")))
_add("profile_numeric_quarters", lambda spark, d: Profile(Dataset(_table(spark, d, "customer"))).numeric_stats().select("column", "q25", "q75"), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", " + ", ".join(f"(SELECT {c}::double FROM customer ORDER BY 1 LIMIT 1 OFFSET (SELECT cast(floor({q} * (count(*) - 1) + 0.5) AS bigint) FROM customer)) AS {n}" for q, n in ((0.25, "q25"), (0.75, "q75"))) for c in ("c_custkey", "c_nationkey", "c_acctbal")))
_add("profile_categorical", lambda spark, d: Profile(Dataset(_table(spark, d, "customer").select("c_mktsegment"))).categorical_frame().drop("mode").withColumns({c: F.round(c, 6) for c in ("mean", "std")}), "SELECT 'c_mktsegment' AS \"column\", count(*) AS unique_count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min, median(n)::double AS median, max(n) AS max FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)")
_add("profile_summary", lambda spark, d: Profile(Dataset(_table(spark, d, "labels").withColumn("toxic", F.col("toxic").cast("string")), target="toxic")).summary(), """WITH b AS (SELECT quantile_disc(doc_id, 0) AS lo, (SELECT doc_id FROM labels ORDER BY 1 LIMIT 1 OFFSET (SELECT cast(floor(0.25 * (count(*) - 1) + 0.5) AS bigint) FROM labels)) AS a, (SELECT doc_id FROM labels ORDER BY 1 LIMIT 1 OFFSET (SELECT cast(floor(0.75 * (count(*) - 1) + 0.5) AS bigint) FROM labels)) AS c, max(doc_id) AS hi,
 min(quality) AS qlo, (SELECT quality FROM labels ORDER BY 1 LIMIT 1 OFFSET (SELECT cast(floor(0.25 * (count(*) - 1) + 0.5) AS bigint) FROM labels)) AS qa, (SELECT quality FROM labels ORDER BY 1 LIMIT 1 OFFSET (SELECT cast(floor(0.75 * (count(*) - 1) + 0.5) AS bigint) FROM labels)) AS qc, max(quality) AS qhi FROM labels)
 SELECT unnest(['shape_n_rows', 'shape_n_columns', 'data_types_count', 'str_subtypes_count', 'feature_types_count', 'missing_values_count', 'duplicates_count', 'cols_w_outliers', 'imbalanced_target']) AS summary,
 unnest([(SELECT count(*) FROM labels), 3, 3, 1, 2, 0, (SELECT count(*) FROM labels) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labels)), cast(a - 1.5 * (c - a) > lo OR c + 1.5 * (c - a) < hi AS int) + cast(qa - 1.5 * (qc - qa) > qlo OR qc + 1.5 * (qc - qa) < qhi AS int), (SELECT cast(max(n) > 1.5 * min(n) AS int) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic))])::double AS ds FROM b""")
# presets
_ONE = ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())::double, 6) AS {c}" for c in ("o_orderkey", "o_custkey", "o_totalprice"))
_DAYS = {"o_orderdate": "epoch_us(o_orderdate)", "o_orderdate_year": "year(o_orderdate)", "o_orderdate_month": "month(o_orderdate)", "o_orderdate_day": "day(o_orderdate)", "o_orderdate_weekday": "isodow(o_orderdate)", "o_orderdate_ordinal_day": "dayofyear(o_orderdate)"}
_NUMBERS = {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_totalprice": "o_totalprice", **_DAYS}
_STATUS = "cast(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS bigint) AS o_orderstatus"
_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_PRESET_SQL = {
    "no_prep": "SELECT * FROM orders",
    "basic": f"SELECT * REPLACE (min(o_orderkey) OVER (PARTITION BY o_orderpriority) AS o_orderpriority) FROM (SELECT {_ONE}, o_orderdate, {_STATUS}, o_orderpriority FROM orders)",
    "tree": "SELECT " + ", ".join(f"{x}::double AS {c}" for c, x in _NUMBERS.items()) + f", {_STATUS}, cast(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS bigint) AS o_orderpriority FROM orders",
    "nn": "SELECT " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}" for c in _NUMBERS) + f", o_orderstatus, " + ", ".join(f'"o_orderpriority_{v}"' for v in _LEVELS) + " FROM (SELECT " + ", ".join(f"{x}::double AS {c}" for c, x in _NUMBERS.items()) + f", {_STATUS}, " + ", ".join(f"cast(o_orderpriority = '{v}' AS int) AS \"o_orderpriority_{v}\"" for v in _LEVELS) + " FROM orders)",
}
_PRESET_ENDS = {"basic": lambda df: _alike("o_orderkey", "o_orderpriority")(_round("o_orderkey", "o_custkey", "o_totalprice")(df, None)), "nn": lambda df: _round(*_NUMBERS)(df, None)}
for _k, _p in (("no_prep", "1_No_prep"), ("basic", "2_Basic"), ("tree", "3_Tree"), ("tree_imb", "4_Tree_imb"), ("nn", "5_NN"), ("nn_imb", "6_NN_imb")):
    _add(f"preset_{_k}", lambda spark, d, p=_p, end=_PRESET_ENDS.get(_k, lambda df: df): end(pipelines.adapt(Dataset(_table(spark, d, "orders"), target="o_orderstatus"), p)[1].df), _PRESET_SQL.get(_k))
#: What suits a table of two keys, a class target, a price, a date and a priority, none of them null or repeated.
_SUITS = {
    "o_orderpriority": {"encoding": "EncodeHash EncodeOneHot EncodeOneHotOrHash", "missing": "FillNoneCategoricalValue"},
    "o_orderstatus,o_orderpriority": {"encoding": "EncodeInt", "types": "CastStr"},
    "o_orderstatus": {"encoding": "EncodeIntTarget"},
    "o_orderkey,o_custkey,o_totalprice": {
        "generation": "DiscretizeKMeans DiscretizeQuantile DiscretizeUniform TransformExp TransformLog TransformRoot TransformSquare",
        "missing": "FillNoneInterpolation FillNoneKNN FillNoneKNNOrMean FillNoneMean FillNoneNumericValue",
        "reduction": "DimReduceIsomap DimReduceKernelPCA DimReduceLDA DimReduceLLE DimReducePCA DimReduceTSNE DimReduceTruncatedSVD DimReduceUMAP",
        "scaling": "Normalize QuantileTransform ScaleRobust Standardize",
        "selection": "SelectRFEDecisionTreeCls SelectUnivariateANOVA SelectUnivariateChi2 SelectUnivariateMutualInformationCls SelectVariationThreshold",
    },
    "o_orderdate": {"generation": "TemporalExpand", "types": "TemporalToInt"},
    "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority": {"missing": "DropNone DropNoneColumns DropNoneRows DropUnnamedColumns", "selection": "DropInvariantColumns", "types": "DropUnsupportedTypes"},
    "o_orderkey,o_custkey,o_totalprice,o_orderdate,o_orderpriority": {"missing": "EncodeNone FillNoneBackward FillNoneForward FillNoneMode"},
    "o_totalprice": {"missing": "FillNaNWithNone"},
}
_SUIT_ROWS = ", ".join(f"('{g}', '{n}', '{c}')" for c, groups in _SUITS.items() for g, names in groups.items() for n in names.split())
_add("pool_applicable", lambda spark, d: spark.createDataFrame([(g, n, ",".join(c)) for g, v in pipelines.Pool(Dataset(_table(spark, d, "orders"), target="o_orderstatus")).all().items() for n, c in v.items()], "category string, operator string, columns string"))
SQL["pool_applicable"] = f"SELECT * FROM (VALUES {_SUIT_ROWS}) AS t (category, operator, columns)"
# results analytics, over a leaderboard made from lineitem
_BOARD = "i_dataset, n_rows, n_cols, task, metric, pipeline, model, extra_metric, repeat, fold, score, extra_score, accuracy_score, balanced_accuracy_score"
_MAKE = """SELECT cast(l_suppkey % 20 AS int) AS i_dataset, cast(1000 AS bigint) AS n_rows, 10 AS n_cols, 'binary' AS task, 'roc_auc' AS metric,
 CASE l_returnflag WHEN 'A' THEN '1_No_prep' WHEN 'N' THEN '2_Basic' ELSE '3_Tree' END AS pipeline, concat(l_linestatus, cast(l_linenumber % 3 AS string)) AS model, 'accuracy' AS extra_metric,
 cast(l_partkey % 2 AS int) AS repeat, cast(l_partkey % 3 AS int) AS fold, avg(l_discount) * 10 AS score, avg(l_tax) * 10 AS extra_score, avg(l_discount) * 9 AS accuracy_score, avg(l_tax) * 9 AS balanced_accuracy_score FROM lineitem GROUP BY 1,2,3,4,5,6,7,8,9,10"""


def _board(spark, sf_dir):
    _table(spark, sf_dir, "lineitem").createOrReplaceTempView("tabloom_lineitem")
    made = spark.sql(_MAKE.replace("FROM lineitem", "FROM tabloom_lineitem"))
    times = {c: F.lit(1.0) for c in ("train_prep_time", "fit_models_time", "test_prep_time", "eval_models_time", "pred_time", "fit_time")}
    scores = {c: F.round(c, 6) for c in ("score", "extra_score", "accuracy_score", "balanced_accuracy_score")}
    return results.aggregate(results.normalise(made.withColumns(times))).withColumns(scores)


_FLOOR = "CASE WHEN {0} < 0 THEN 0 ELSE {0} END"
_AGG = f"""WITH b AS ({_MAKE}), z AS (SELECT * REPLACE ({_FLOOR.format('(2*score-1)')} AS score, {_FLOOR.format('extra_score')} AS extra_score) FROM b),
 f AS (SELECT i_dataset, n_rows, pipeline, model, repeat, avg(score) AS score, avg(extra_score) AS extra_score, avg(accuracy_score) AS accuracy_score, avg(balanced_accuracy_score) AS balanced_accuracy_score FROM z GROUP BY 1,2,3,4,5),
 a AS (SELECT i_dataset, n_rows, pipeline, model, round(avg(score), 6) AS score, round(stddev_samp(score), 6) AS score_std, round(avg(extra_score), 6) AS extra_score, round(avg(accuracy_score), 6) AS accuracy_score, round(avg(balanced_accuracy_score), 6) AS balanced_accuracy_score FROM f GROUP BY 1,2,3,4)""".replace("AS string", "AS varchar")
_add("leaderboard_aggregate", lambda s, d: _board(s, d).select("i_dataset", "pipeline", "model", "score", F.round("score_std", 6).alias("score_std"), "accuracy_score"), f"{_AGG} SELECT i_dataset, pipeline, model, score, score_std, accuracy_score FROM a")


def _wins(by: str, score: str = "score") -> str:
    return f"(WITH w AS (SELECT model, pipeline FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC, model, pipeline) AS r FROM a WHERE {score} > 0) WHERE r = 1), g AS (SELECT * FROM (SELECT DISTINCT model FROM w), (SELECT DISTINCT pipeline FROM w)) SELECT g.model, g.pipeline, count(w.model) AS win_count FROM g LEFT JOIN w USING (model, pipeline) GROUP BY 1, 2)"


_add("leaderboard_wins_by_pipeline", lambda s, d: results.wins_by_pipeline(_board(s, d)), f"{_AGG} SELECT * FROM {_wins('i_dataset, pipeline')}")
_add("leaderboard_wins_overall", lambda s, d: results.wins_overall(_board(s, d)), f"{_AGG} SELECT * FROM {_wins('i_dataset')}")
_add("leaderboard_metric_diff", lambda s, d: results.metric_win_diff(_board(s, d)), f"{_AGG} SELECT model, pipeline, coalesce(y.win_count, 0) - coalesce(x.win_count, 0) AS win_diff FROM {_wins('i_dataset', 'accuracy_score')} x FULL JOIN {_wins('i_dataset', 'balanced_accuracy_score')} y USING (model, pipeline)")
_LV = "lv AS (SELECT i_dataset, model, max(CASE WHEN pipeline = '1_No_prep' THEN score END) AS no_prep, coalesce(max(CASE WHEN pipeline = '1_No_prep' THEN score END), max(CASE WHEN pipeline = '2_Basic' THEN score END)) AS minimal, coalesce(max(score), 0) AS best FROM a GROUP BY 1, 2)"
_add("leaderboard_levels", lambda s, d: results.levels(_board(s, d)), f"{_AGG}, {_LV} SELECT * FROM lv")
_DIFF = "round(CASE WHEN {0} < 0 THEN 0 ELSE {0} END, 6)"
_add("leaderboard_level_diffs", lambda s, d: results.level_diffs(_board(s, d)).withColumns({c: F.round(c, 6) for c in ("diff_minimal_no_prep", "diff_best_minimal")}), f"{_AGG}, {_LV} SELECT i_dataset, model, {_DIFF.format('(minimal - no_prep)')} AS diff_minimal_no_prep, {_DIFF.format('(best - minimal)')} AS diff_best_minimal FROM lv")
_add("leaderboard_percentages", lambda s, d: results.percentages(_board(s, d)), f"{_AGG}, {_LV} SELECT round(avg(CASE WHEN no_prep IS NULL OR no_prep <= 0 THEN 100.0 ELSE 0 END), 2) AS no_prep_failed, round(avg(CASE WHEN best > coalesce(no_prep, 0) THEN 100.0 ELSE 0 END), 2) AS gained, round(avg(CASE WHEN best = no_prep THEN 100.0 ELSE 0 END), 2) AS best_without_prep FROM lv")
_NAMED = {"F0": "CatBoost", "F1": "TabDPT", "F2": "RandomForest", "O0": "TabM", "O1": "LinearModel", "O2": "RealTabPFN-v2.5"}


def _listed(spark, sf_dir):
    """The leaderboard with models of known names, a fifth of the results without preparation failed."""
    names = F.create_map(*[F.lit(x) for p in _NAMED.items() for x in p])
    failed = (F.col("pipeline") == "1_No_prep") & (F.col("i_dataset") % 5 == 0)
    df = _board(spark, sf_dir).withColumn("model", names[F.col("model")])
    return results.listed(df.withColumn("extra_score", F.when(failed, F.lit(float("nan"))).otherwise(F.col("extra_score"))))


_LIST = {k: results.MODEL_NAMES[v] for k, v in _NAMED.items()}
_CASE = "CASE model " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LIST.items()) + " END"
_KNOWN = f"k AS (SELECT i_dataset, pipeline, {_CASE} AS model, CASE WHEN pipeline = '1_No_prep' AND i_dataset % 5 = 0 THEN NULL ELSE extra_score END AS x, accuracy_score, balanced_accuracy_score FROM a)"
_PAIRS = "p AS (SELECT i_dataset, model, count(*) FILTER (pipeline = '1_No_prep') AS tried, count(*) FILTER (pipeline = '1_No_prep' AND x IS NULL) AS failed, max(x) FILTER (pipeline = '1_No_prep') AS plain, coalesce(max(x) FILTER (pipeline = '1_No_prep'), max(x) FILTER (pipeline = '2_Basic')) AS minimal, coalesce(max(x), 0) AS best FROM k GROUP BY 1, 2)"
_TOPS = "t AS (SELECT i_dataset, arg_min(model, [-plain, ascii(model)]) FILTER (plain > 0) AS plain, arg_min(model, [-best, ascii(model)]) FILTER (best > 0) AS top FROM p GROUP BY 1)"
_PCT = "cast(round(100.0 * count(*) FILTER ({0}) / count(*)) AS int) AS {1}"
_add("leaderboard_ratios", lambda s, d: results.ratios(_listed(s, d)), f"{_AGG}, {_KNOWN}, {_PAIRS}, {_TOPS} SELECT (SELECT cast(round(100.0 * sum(failed) / sum(tried)) AS int) FROM p) AS no_prep_failed, (SELECT cast(round(100.0 * count(*) FILTER (best > minimal) / count(*)) AS int) FROM p) AS best_gains, " + ", ".join(_PCT.format(f"{c} IN ({', '.join(repr(m) for m in ms)})", n) for c, ms, n in (("plain", results.TREES, "no_prep_tree_wins"), ("plain", ["g_CatBoost"], "no_prep_catboost_wins"), ("top", results.FOUNDATION, "best_foundation_wins"), ("top", ["k_RealTabPFN-v2.5"], "best_tabpfn_wins"), ("top", results.NETWORKS, "best_network_wins"))) + " FROM t")
_add("leaderboard_models", lambda s, d: results.listed(_listed(s, d)).select("i_dataset", "pipeline", "model"), f"{_AGG}, {_KNOWN} SELECT i_dataset, pipeline, model FROM k")
_add("leaderboard_performance", lambda s, d: results.performance(_board(s, d)).select("i_dataset", "task", "metric", "extra_metric", "pipeline", "model", "score", "extra_score"), f"{_AGG} SELECT i_dataset, 'binary' AS task, 'roc_auc' AS metric, 'accuracy' AS extra_metric, pipeline, model, score, extra_score FROM a")
_add("leaderboard_by_metric", lambda s, d: results.by_metric(_board(s, d)), f"{_AGG} UNPIVOT (SELECT i_dataset, model, pipeline, accuracy_score AS accuracy, balanced_accuracy_score AS balanced_accuracy FROM a) ON accuracy, balanced_accuracy INTO NAME acc_metric VALUE acc_score")
_MODELS = ["F0", "F1", "F2", "O0", "O1", "O2"]
_add("leaderboard_pivot", lambda s, d: (lambda p: p.withColumns({c: F.round(c, 6) for c in _MODELS}))(results.pivot(_board(s, d), _MODELS)), f"{_AGG}, {_LV} SELECT i_dataset, " + ", ".join(f"max(CASE WHEN model = '{m}' THEN {_DIFF.format('(best - minimal)')} END) AS {m}" for m in _MODELS) + " FROM lv GROUP BY 1")
_add("leaderboard_sankey", lambda s, d: results.sankey(_board(s, d)), f"{_AGG} SELECT model, pipeline, cast(sum(win_count) AS bigint) AS win_count FROM {_wins('i_dataset')} GROUP BY GROUPING SETS ((model), (pipeline), (model, pipeline))")
