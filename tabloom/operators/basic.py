"""Types, missing values, duplicates and encodings."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom import errors
from tabloom.core import FLOATS, INTEGERS, SUPPORTED, TEMPORALS, Domain, Feature, Role, Stage
from tabloom.functions import clean, stats
from tabloom.functions.storage import numbered, shared_dir


def q(c: str) -> Column:
    return F.col(f"`{c}`")


class _Each(Stage):
    """A column expression for each selected column."""

    with_target = True

    def expr(self, c: str, kind: T.DataType) -> Column:
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.expr(c, df.schema[c].dataType) for c in self.columns if c in df.columns})


class CastFloat(_Each):
    category, kinds = "types", (T.DecimalType, T.FloatType)

    def expr(self, c, kind):
        return q(c).cast("double")


class CastInt(_Each):
    category, kinds = "types", INTEGERS[:3]

    def expr(self, c, kind):
        return q(c).cast("bigint")


class CastUInt(_Each):
    """Unsigned numbers: Spark has none, so they are whole numbers of the next wider kind already; made bigint."""

    category, kinds = "types", INTEGERS[:3]

    def expr(self, c, kind):
        return q(c).cast("bigint")


class CastStr(_Each):
    category, kinds = "types", (T.StringType,)

    def expr(self, c, kind):
        return q(c).cast("string")


class BooleanToCategorical(_Each):
    category, kinds = "types", (T.BooleanType,)

    def expr(self, c, kind):
        return q(c).cast("string")


class BooleanToStr(BooleanToCategorical):
    category = "types"


class BooleanToInt(_Each):
    category, kinds = "types", (T.BooleanType,)

    def expr(self, c, kind):
        return q(c).cast("int").cast("bigint")


class TemporalToInt(_Each):
    """Dates to days, instants and durations to microseconds, times of day to nanoseconds."""

    category, kinds = "types", TEMPORALS

    def expr(self, c, kind):
        if isinstance(kind, T.DateType):
            return F.unix_date(q(c)).cast("bigint")
        if isinstance(kind, T.DayTimeIntervalType):
            return (F.extract(F.lit("DAY"), q(c)) * 86_400_000_000 + F.extract(F.lit("HOUR"), q(c)) * 3_600_000_000 + F.extract(F.lit("MINUTE"), q(c)) * 60_000_000 + F.extract(F.lit("SECOND"), q(c)) * 1_000_000).cast("bigint")
        if type(kind).__name__ == "TimeType":
            return (F.hour(q(c)) * 3600 + F.minute(q(c)) * 60 + F.second(q(c))).cast("bigint") * 1_000_000_000
        return F.unix_micros(q(c).cast("timestamp"))


_TIME = r"^\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?$"


class StrToTemporal(_Each):
    """Strings all of whose values parse as times, else dates, else instants."""

    category, kinds = "types", (T.StringType,)

    @staticmethod
    def parsed(c: str) -> dict[str, Column]:
        time = q(c).rlike(_TIME)
        return {"time": F.when(time, q(c)), "date": F.when(q(c).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(q(c))), "timestamp": F.when(~time, F.try_to_timestamp(q(c)))}

    @classmethod
    def detect(cls, df: DataFrame, columns: list[str], share: float = 1.0) -> dict[str, str]:
        ask = {f"{i}_{k}": F.count(e) for i, c in enumerate(columns) for k, e in cls.parsed(c).items()}
        got = stats(df, **ask, **{f"{i}_n": F.count(q(c)) for i, c in enumerate(columns)})
        out = {}
        for i, c in enumerate(columns):
            n = got[f"{i}_n"]
            fits = [k for k in ("time", "date", "timestamp") if n and got[f"{i}_{k}"] >= share * n]
            if fits:
                out[c] = fits[0]
        return out

    domains = {"share": Domain(1.0, 0.0, 1.0, whole=False)}

    def _fit(self, df, columns):
        self.formats = self.detect(df, columns, self.params["share"])

    def expr(self, c, kind):
        return self.parsed(c)[self.formats[c]] if c in self.formats else q(c)


class StrDecode(_Each):
    """Numeric strings to double; nan and infinity tokens are null. Strings that no value of decodes stay."""

    category, kinds = "types", (T.StringType,)

    @staticmethod
    def number(c: str) -> Column:
        return F.when(~F.lower(F.trim(q(c))).rlike(r"^[+-]?(nan|inf|infinity)$"), q(c).try_cast("double"))

    @classmethod
    def detect(cls, df: DataFrame, columns: list[str]) -> list[str]:
        odd = lambda c: F.lower(F.trim(q(c))).rlike(r"^[+-]?(nan|inf|infinity)$")
        got = stats(df, **{f"{i}_{k}": e for i, c in enumerate(columns) for k, e in (("ok", F.count(cls.number(c))), ("n", F.count(F.when(~odd(c), q(c)))))})
        return [c for i, c in enumerate(columns) if got[f"{i}_n"] and got[f"{i}_ok"] == got[f"{i}_n"]]

    def _fit(self, df, columns):
        self.decodable = self.detect(df, columns) if self.given is None else list(columns)

    def expr(self, c, kind):
        return self.number(c) if c in self.decodable else q(c)


class ListExplode(Stage):
    """One row per element, column after column; an empty or null list gives one row with null."""

    category, kinds, changes_rows = "types", (T.ArrayType,), True

    def _transform(self, df):
        for c in self.columns:
            df = df.withColumn(c, F.explode_outer(q(c)))
        return df


class DictUnnest(Stage):
    """Struct fields as columns; a name that is taken gets the struct's name before it."""

    category, kinds = "types", (T.StructType,)

    def _transform(self, df):
        taken, out = {c for c in df.columns if c not in self.columns}, []
        for c in df.columns:
            if c not in self.columns:
                out.append(q(c))
                continue
            for f in df.schema[c].dataType.names:
                name = f if f not in taken else f"{c}_{f}"
                taken.add(name)
                out.append(F.col(f"`{c}`.`{f}`").alias(name))
        return df.select(*out)


class _KeepColumns(Stage):
    whole_frame = True

    def _transform(self, df):
        return df.select(*[q(c) for c in df.columns if c in self.kept])


class DropUnsupportedTypes(_KeepColumns):
    category = "types"

    def _fit(self, df, columns):
        self.kept = [f.name for f in df.schema if isinstance(f.dataType, SUPPORTED)]


class DropUnnamedColumns(_KeepColumns):
    category = "missing"

    def _fit(self, df, columns):
        self.kept = [c for c in columns if not re.fullmatch(r"|_duplicated_\d+|_c\d+", c)]


class DropNoneColumns(_KeepColumns):
    category = "missing"

    def _fit(self, df, columns):
        got = stats(df, **{str(i): F.count(q(c)) for i, c in enumerate(columns)})
        self.kept = [c for i, c in enumerate(columns) if got[str(i)]]


class DropNoneRows(Stage):
    category, whole_frame, changes_rows = "missing", True, True

    def _transform(self, df):
        return df.where(reduce(lambda a, b: a | b, [q(c).isNotNull() for c in df.columns]))


class FillNaNWithNone(_Each):
    category, kinds, with_target = "missing", FLOATS[:2], False

    def expr(self, c, kind):
        return F.when(~F.isnan(q(c)), q(c))


class EncodeNone(Stage):
    """A column {c}_missing of true and false for each column that has nulls when fitted."""

    category = "missing"

    def _fit(self, df, columns):
        got = stats(df, **{str(i): F.count_if(q(c).isNull()) for i, c in enumerate(columns)})
        self.with_nulls = [c for i, c in enumerate(columns) if got[str(i)]]

    def _transform(self, df):
        return df.withColumns({f"{c}_missing": q(c).isNull().cast("string") for c in self.with_nulls})


class DropNone(Stage):
    category, role, changes_rows = "missing", Role.TRAIN, True

    def _transform(self, df):
        return df.where(reduce(lambda a, b: a & b, [q(c).isNotNull() for c in self.columns]))


class FillNoneNumericValue(_Each):
    category, feature, with_target = "missing", Feature.NUMERIC, False
    domains = {"value": Domain(-1, -1e18, 1e18, whole=False)}

    def expr(self, c, kind):
        return F.coalesce(q(c), F.lit(self.params["value"]).cast(kind))


class FillNoneCategoricalValue(_Each):
    category, feature, with_target = "missing", Feature.CATEGORICAL, False

    def __init__(self, columns=None, value: str = "_missing_"):
        super().__init__(columns)
        self.value_ = value

    def expr(self, c, kind):
        return F.coalesce(q(c), F.lit(self.value_))


class _Ordered(Stage):
    """Stages that read rows in order, which order_by gives, within each value of partition_by.

    Without partition_by rows are numbered by ranges of the order and filled within each; what the ranges before and
    behind it end with is filled in from the driver, which sees a row for each range.
    """

    def __init__(self, columns=None, order_by: list[str] | None = None, partition_by: list[str] | None = None):
        super().__init__(columns)
        self.order_by, self.partition_by = order_by, partition_by or []

    def select(self, ds):
        return [c for c in super().select(ds) if self.given is not None or c not in {*(self.order_by or ()), *self.partition_by}]

    def _fit(self, df, columns):
        if not self.order_by:
            raise errors.FitError(f"{type(self).__name__} needs order_by: rows of a frame have no order of their own")

    def around(self, df: DataFrame) -> tuple[DataFrame, dict[str, tuple[Column, ...]]]:
        """df with place_, and of each column the value and place last seen up to a row, and first seen from it on."""
        if self.partition_by:
            df = df.withColumn("place_", F.row_number().over(Window.partitionBy(*self.partition_by).orderBy(*self.order_by)).cast("bigint"))
            parts = Window.partitionBy(*self.partition_by)
        else:
            df = numbered(df, [q(c) for c in self.order_by])
            parts = Window.partitionBy("part_")
        # both run from an end to the row: for a frame from the row to the end, Spark reads all rows behind it again for each row
        back, ahead = (parts.orderBy(x).rowsBetween(Window.unboundedPreceding, 0) for x in (F.asc("place_"), F.desc("place_")))
        seen = {c: F.when(q(c).isNotNull(), F.struct(q(c).alias("v"), F.col("place_").alias("at"))) for c in self.columns}
        out = {c: [F.last(x, ignorenulls=True).over(w) for w in (back, ahead)] for c, x in seen.items()}
        if not self.partition_by:
            ends = df.groupBy("part_").agg(*[f(x).alias(f"{k}{i}") for i, x in enumerate(seen.values()) for k, f in (("a", lambda x: F.min_by(x, x["at"])), ("b", lambda x: F.max_by(x, x["at"])))]).collect()
            ends = sorted(ends, key=lambda r: r["part_"])
            for i, c in enumerate(self.columns):
                kind = f"struct<v:{df.schema[c].dataType.simpleString()},at:bigint>"
                for k, rows, side in (("b", ends, 0), ("a", ends[::-1], 1)):
                    carried, held = [], None
                    for r in rows:
                        if held is not None:
                            carried.append((r["part_"], held))
                        held = r[f"{k}{i}"] if r[f"{k}{i}"] is not None else held
                    given = F.lit(None).cast(kind)
                    if carried:
                        pairs = F.create_map(*[x for p, v in carried for x in (F.lit(p), F.struct(F.lit(v["v"]).cast(df.schema[c].dataType).alias("v"), F.lit(v["at"]).cast("bigint").alias("at")))])
                        given = F.try_element_at(pairs, F.col("part_"))
                    out[c][side] = F.coalesce(out[c][side], given)
        return df, out

    def value(self, c: str, before: Column, after: Column) -> Column:
        raise NotImplementedError

    def _transform(self, df):
        named = [q(c) for c in df.columns]
        placed, seen = self.around(df)
        placed = placed.withColumns({f"{k}{i}_": x for i, own in enumerate(seen.values()) for k, x in zip(("before", "after"), own)})
        return placed.withColumns({c: self.value(c, F.col(f"before{i}_"), F.col(f"after{i}_")) for i, c in enumerate(seen)}).select(*named)


class FillNoneForward(_Ordered):
    category = "missing"

    def value(self, c, before, after):
        return before["v"]


class FillNoneBackward(_Ordered):
    category = "missing"

    def value(self, c, before, after):
        return after["v"]


class FillNoneInterpolation(_Ordered):
    """Linear by row position; nulls before the first and after the last value stay."""

    category, feature = "missing", Feature.NUMERIC

    def value(self, c, before, after):
        a, b, i, j = before["v"].cast("double"), after["v"].cast("double"), before["at"], after["at"]
        return F.when(q(c).isNotNull(), q(c).cast("double")).otherwise(a + (b - a) * (F.col("place_") - i) / F.nullif(j - i, F.lit(0)))


class FillNoneMode(_Each):
    """The most frequent value, of several the least."""

    category, with_target = "missing", False

    def _fit(self, df, columns):
        got = stats(df, **{str(i): F.mode(q(c), True) for i, c in enumerate(columns)})
        self.values = {c: got[str(i)] for i, c in enumerate(columns)}

    def expr(self, c, kind):
        return F.coalesce(q(c), F.lit(self.values[c]).cast(kind)) if self.values[c] is not None else q(c)


class FillNoneMean(_Each):
    category, feature, with_target = "missing", Feature.NUMERIC, False

    def _fit(self, df, columns):
        got = stats(df, **{str(i): F.avg(q(c).cast("double")) for i, c in enumerate(columns)})
        self.values = {c: got[str(i)] for i, c in enumerate(columns)}

    def expr(self, c, kind):
        return F.coalesce(q(c).cast("double"), F.lit(self.values[c]).cast("double"))


class DropDuplicates(Stage):
    category, role, whole_frame, changes_rows = "duplicates", Role.TEST, True, True

    def _transform(self, df):
        return df.distinct()


class AggregateDuplicates(Stage):
    category, whole_frame, changes_rows = "duplicates", True, True

    def _transform(self, df):
        return df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("duplicate_count"))


#: Distinct values of a column that the driver holds, and that become columns.
MOST_VALUES = 10_000
#: Distinct values that an expression looks a value up in; beyond them it is joined.
FEW_VALUES = 256


class _Distinct(Stage):
    feature = Feature.CATEGORICAL

    def _number(self, df, columns):
        """Distinct values by column, null included."""
        got = stats(df, **{f"{i}{k}": f for i, c in enumerate(columns) for k, f in (("n", F.count_distinct(q(c))), ("z", F.max(q(c).isNull().cast("int"))))})
        return {c: got[f"{i}n"] + (got[f"{i}z"] or 0) for i, c in enumerate(columns)}

    def _values(self, df, columns):
        """Distinct values by column (null included), in order; for columns of few values."""
        if large := [c for c, n in self._number(df, columns).items() if n > MOST_VALUES]:
            raise errors.FitError(f"{large} have more than {MOST_VALUES} values; a hash or codes suit them")
        rows = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), q(c).alias("v")) for i, c in enumerate(columns)])).alias("x")).select("x.*").distinct().collect()
        out = {c: [] for c in columns}
        for i, v in rows:
            out[columns[i]].append(v)
        return {c: sorted(v, key=lambda x: (x is None, x)) for c, v in out.items()}


def _one_hot(df: DataFrame, values: dict[str, list]) -> DataFrame:
    """0/1 columns {c}_{value}; null is a value of its own."""
    new = [q(c).eqNullSafe(F.lit(v)).cast("int").alias(f"{c}_{v}") for c, own in values.items() for v in own]
    return df.select(*[q(c) for c in df.columns if c not in values], *new)


class EncodeOneHot(_Distinct):
    category = "encoding"

    def _fit(self, df, columns):
        self.values = self._values(df, columns)

    def _transform(self, df):
        return _one_hot(df, self.values)


class EncodeHash(_Each):
    category, feature, with_target = "encoding", Feature.CATEGORICAL, False

    def expr(self, c, kind):
        return F.xxhash64(q(c))


class EncodeOneHotOrHash(_Distinct):
    category = "encoding"
    domains = {"max_values_1hot": Domain(20, 1, 1_000_000)}

    def _fit(self, df, columns):
        number = self._number(df, columns)
        few = [c for c in columns if number[c] <= self.params["max_values_1hot"]]
        self.values = self._values(df, few) if few else {}
        self.hashed = [c for c in columns if c not in few]

    def _transform(self, df):
        return _one_hot(df.withColumns({c: F.xxhash64(q(c)) for c in self.hashed}), self.values)


class EncodeInt(_Distinct):
    """Values to their place in order; null stays, unseen values are -1. The inverse names unknown codes.

    Few values are looked up in an expression, more are joined from a broadcast table, and codes of a column of more
    than MOST_VALUES values stay in the shared folder.
    """

    category, with_target = "encoding", True

    def _fit(self, df, columns):
        number = self._number(df, columns)
        small = [c for c in columns if number[c] <= MOST_VALUES]
        self.values = {c: [v for v in own if v is not None] for c, own in self._values(df, small).items()} if small else {}
        self.tables = {}
        for c in columns:
            if c not in self.values:
                values = numbered(df.select(q(c).alias("value_")).where("value_ IS NOT NULL").distinct(), [F.col("value_")])
                self.tables[c] = f"{shared_dir(df.sparkSession)}/codes-{uuid.uuid4().hex}"  # stays as long as the stage is used
                values.select("value_", F.col("place_").alias("code_")).write.parquet(self.tables[c])

    def _codes(self, df, c):
        if c in self.tables:
            return df.sparkSession.read.schema("value_ string, code_ bigint").parquet(self.tables[c])
        return F.broadcast(df.sparkSession.createDataFrame(list(zip(self.values[c], range(len(self.values[c])))), "value_ string, code_ bigint"))

    def _joined(self, df, here: str, there: str, found):
        """df with the columns of many values replaced by what their codes give."""
        for c in self.columns:
            if c in df.columns and len(self.values.get(c, range(FEW_VALUES + 1))) > FEW_VALUES:
                names = df.columns
                both = df.join(self._codes(df, c), q(c).cast(here) == F.col(there), "left")
                df = both.select(*[found(c).alias(c) if a == c else q(a) for a in names])
        return df

    def _few(self, df):
        return {c: own for c, own in self.values.items() if c in df.columns and len(own) <= FEW_VALUES}

    def _transform(self, df):
        new = {}
        for c, own in self._few(df).items():
            place = F.array_position(F.array(*map(F.lit, own)), q(c)).cast("bigint") - 1 if own else F.lit(-1).cast("bigint")
            new[c] = F.when(q(c).isNotNull(), place)
        return self._joined(df.withColumns(new), "string", "value_", lambda c: F.when(q(c).isNotNull(), F.coalesce("code_", F.lit(-1)).cast("bigint")))

    def _inverse(self, df):
        new = {}
        for c, own in self._few(df).items():
            new[c] = F.when(q(c).isNotNull(), F.coalesce(F.when(q(c) >= 0, F.get(F.array(*map(F.lit, own)), q(c).cast("int"))), F.lit("unknown_label"))) if own else F.lit("unknown_label")
        return self._joined(df.withColumns(new), "bigint", "code_", lambda c: F.when(q(c).isNotNull(), F.coalesce("value_", F.lit("unknown_label"))))


class EncodeIntTarget(EncodeInt):
    category, target_only, needs_target = "encoding", True, Feature.CATEGORICAL
