"""Datasets, feature types, hyperparameter domains, fit/transform stages and pipelines."""

from __future__ import annotations

import copy
import enum
import pickle
import random
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabloom import errors


class Role(enum.IntEnum):
    """What a dataset is for; a stage runs on datasets up to its own role."""

    TRAIN = 0
    TEST = 1
    INFERENCE = 2

    @classmethod
    def of(cls, value: Role | str) -> Role:
        try:
            return value if isinstance(value, cls) else cls[value.upper()]
        except (KeyError, AttributeError):
            raise errors.DatasetTypeError(f"not a dataset role: {value!r}") from None


INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)
TEMPORALS = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType) + ((T.TimeType,) if hasattr(T, "TimeType") else ())
STRINGS = (T.StringType,)
SUPPORTED = INTEGERS + FLOATS + TEMPORALS + STRINGS


class Feature(enum.Enum):
    ANY = "any"
    NUMERIC = "numeric"
    DISCRETE = "numeric_discrete"
    CONTINUOUS = "numeric_continuous"
    CATEGORICAL = "categorical"
    OTHER = "other"

    @classmethod
    def of(cls, kind: T.DataType) -> Feature:
        for kinds, feature in ((INTEGERS, cls.DISCRETE), (FLOATS, cls.CONTINUOUS), (STRINGS, cls.CATEGORICAL)):
            if isinstance(kind, kinds):
                return feature
        return cls.OTHER

    def covers(self, other: Feature) -> bool:
        return self in (Feature.ANY, other) or (self is Feature.NUMERIC and other in (Feature.DISCRETE, Feature.CONTINUOUS))


def feature_columns(df: DataFrame, feature: Feature) -> list[str]:
    return [f.name for f in df.schema if feature.covers(Feature.of(f.dataType))]


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; missing columns are null and types widen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


class Dataset:
    """A frame with its role and an optional target column; other attributes are the frame's."""

    def __init__(self, *sources, role: Role | str = Role.TRAIN, target: str | None = None, spark=None, categorical_target: bool | None = None):
        from tabloom.sources import parse

        if not sources:
            raise errors.DatasetEmptyError("a dataset needs a source")
        self._df = union_all([parse(s, spark) for s in sources])
        self.role, self.target = Role.of(role), target
        self._check(self._df)
        # an encoder may make a class target numeric; oversamplers still treat it as classes
        self.categorical_target = categorical_target if categorical_target is not None else bool(target) and Feature.of(self._df.schema[target].dataType) is Feature.CATEGORICAL

    def _check(self, df: DataFrame) -> None:
        if self.target is not None and self.target not in df.columns:
            raise errors.TargetColumnError(f"no column {self.target!r}")

    @property
    def df(self) -> DataFrame:
        return self._df

    @df.setter
    def df(self, value: DataFrame) -> None:
        self._check(value)
        self._df = value

    def with_df(self, df: DataFrame) -> Dataset:
        return Dataset(df, role=self.role, target=self.target, categorical_target=self.categorical_target or None)

    def copy(self) -> Dataset:
        return self.with_df(self._df)

    def features(self) -> DataFrame:
        return self._df.drop(self.target) if self.target else self._df

    def target_frame(self) -> DataFrame:
        if not self.target:
            raise errors.NoTargetError("the dataset has no target")
        return self._df.select(self.target)

    def split(self, test_fraction: float = 0.2, order_by: list[str] | None = None, seed: int = 42) -> tuple[Dataset, Dataset]:
        """Train and test parts, stratified by a class target."""
        from tabloom.functions.sampling import split

        by = [self.target] if self.target and self.categorical_target else []
        train, test = split(self._df, test_fraction, by, order_by or self._df.columns, seed)
        return self.with_df(train), Dataset(test, role=Role.TEST, target=self.target)

    def save(self, path: str, format: str = "parquet") -> None:
        from tabloom.sources import save

        save(self._df, path, format)

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self._df, name)


@dataclass(frozen=True)
class Domain:
    """Values that a hyperparameter may take."""

    default: object
    low: float | None = None
    high: float | None = None
    choices: tuple = ()
    whole: bool = True

    def __post_init__(self):
        if not self.choices and not (self.low is not None and self.high is not None and self.low <= self.high):
            raise errors.HyperparameterRangeError(f"bad range {self.low} .. {self.high}")

    def check(self, name: str, value):
        ok = value in self.choices if self.choices else isinstance(value, (int, float)) and self.low <= value <= self.high and (not self.whole or value == int(value))
        if not ok:
            raise errors.HyperparameterValueError(f"{name}={value!r} is outside its domain")
        return value

    def draw(self, rng: random.Random):
        if self.choices:
            return rng.choice(self.choices)
        return rng.randint(int(self.low), int(self.high)) if self.whole else rng.uniform(self.low, self.high)

    def values(self, step: float = 1) -> list:
        if self.choices:
            return list(self.choices)
        if step <= 0:
            raise errors.HyperparameterStepError("a step must be positive")
        return [self.low + i * step for i in range(int((self.high - self.low) / step + 1e-9) + 1)]


REGISTRY: dict[str, dict[str, type]] = {}


class Stage:
    """Base of all operators.

    fit() checks the dataset, freezes the columns the stage works on and calls _fit; transform() is lazy and calls
    _transform. Subclasses say which columns they take (kinds, feature), whether they change the number of rows, up to
    which role they run, and what they ask of the target.
    """

    category = ""
    role = Role.INFERENCE
    kinds: tuple = ()
    feature = Feature.ANY
    changes_rows = False
    whole_frame = False
    with_target: bool | None = None  # whether the target may be among the columns; None: only if rows change
    target_only = False
    needs_target: Feature | None = None
    min_features = 0
    domains: dict[str, Domain] = {}

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        if cls.category and not cls.__name__.startswith("_"):
            REGISTRY.setdefault(cls.category, {})[cls.__name__] = cls

    def __init__(self, columns: list[str] | None = None, **params):
        for name in params:
            if name not in self.domains:
                raise errors.HyperparameterNameError(f"{type(self).__name__} has no {name}")
        self.given, self.columns, self.fitted = columns, None, False
        self.params = {k: d.check(k, params.get(k, d.default)) for k, d in self.domains.items()}

    def __getattr__(self, name):
        if name.startswith("_") or "params" not in self.__dict__ or name not in self.__dict__["params"]:
            raise AttributeError(name)
        return self.params[name]

    def select(self, ds: Dataset) -> list[str]:
        if self.target_only:
            return [ds.target] if ds.target else []
        if self.whole_frame:
            return list(ds.df.columns)
        if self.given is not None:
            return list(self.given)
        keep_target = self.changes_rows if self.with_target is None else self.with_target
        return [f.name for f in ds.df.schema if (not self.kinds or isinstance(f.dataType, self.kinds)) and self.feature.covers(Feature.of(f.dataType)) and (keep_target or f.name != ds.target) and self.takes(f)]

    def takes(self, field: T.StructField) -> bool:
        return True

    def check_target(self, ds: Dataset) -> None:
        if self.needs_target is not None:
            if not ds.target:
                raise errors.NoTargetError(f"{type(self).__name__} needs a target")
            kind = Feature.of(ds.df.schema[ds.target].dataType)
            if not (self.needs_target.covers(kind) or (self.needs_target is Feature.CATEGORICAL and ds.categorical_target)):
                raise errors.FeatureTypeError(f"the target of {type(self).__name__} must be {self.needs_target.value}")

    def fit(self, ds: Dataset) -> Stage:
        if self.fitted:
            raise errors.AlreadyFittedError(type(self).__name__)
        self.check_target(ds)
        columns = self.select(ds)
        if not columns:
            raise errors.FitError(f"{type(self).__name__} finds no column to work on")
        if missing := [c for c in columns if c not in ds.df.columns]:
            raise errors.FitError(f"no columns {missing}")
        if len([c for c in columns if c != ds.target]) < self.min_features:
            raise errors.InsufficientFeaturesError(f"{type(self).__name__} needs {self.min_features} features")
        for c in columns if not self.whole_frame else ():
            kind = ds.df.schema[c].dataType
            if self.kinds and not isinstance(kind, self.kinds):
                raise errors.DataTypeError(f"{c} is {kind.simpleString()}")
            if not self.feature.covers(Feature.of(kind)):
                raise errors.FeatureTypeError(f"{c} is not {self.feature.value}")
        self.columns, self.target = columns, ds.target
        try:
            self._fit(ds.df, columns)
        except errors.TabloomError:
            raise
        except Exception as e:
            raise errors.FitError(f"{type(self).__name__}: {e}") from e
        self.fitted = True
        return self

    def transform(self, ds: Dataset) -> Dataset:
        if not self.fitted:
            raise errors.NotFittedError(type(self).__name__)
        try:
            return ds.with_df(self._transform(ds.df))
        except errors.TabloomError:
            raise
        except Exception as e:
            raise errors.TransformError(f"{type(self).__name__}: {e}") from e

    def fit_transform(self, ds: Dataset) -> Dataset:
        return self.fit(ds).transform(ds)

    def inverse_transform(self, ds: Dataset) -> Dataset:
        if not self.fitted:
            raise errors.NotFittedError(type(self).__name__)
        return ds.with_df(self._inverse(ds.df))

    def _fit(self, df: DataFrame, columns: list[str]) -> None:
        pass

    def _transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _inverse(self, df: DataFrame) -> DataFrame:
        raise errors.NotInversibleError(type(self).__name__)

    @classmethod
    def inversible(cls) -> bool:
        return cls._inverse is not Stage._inverse


class Pipeline:
    """Stages in order; each is fitted on what the ones before it made."""

    def __init__(self, *stages: Stage):
        self.stages, self.fitted = [copy.deepcopy(s) for s in stages], False

    def add(self, stage: Stage) -> Pipeline:
        self.stages.append(copy.deepcopy(stage))
        return self

    def add_as_is(self, stage: Stage) -> Pipeline:
        self.stages.append(stage)
        return self

    def extend(self, other: Pipeline) -> Pipeline:
        for s in other.stages:
            self.add(s)
        return self

    def copy(self) -> Pipeline:
        return copy.deepcopy(self)

    def fit_transform(self, ds: Dataset) -> Dataset:
        if ds.role is not Role.TRAIN:
            raise errors.DatasetTypeError("a pipeline is fitted on training data")
        for s in self.stages:
            s.fit(ds)
            if ds.role <= s.role:
                ds = s.transform(ds)
        self.fitted = True
        return ds

    def transform(self, ds: Dataset) -> Dataset:
        for s in self.stages:
            if ds.role <= s.role:
                ds = s.transform(ds)
        return ds

    def inverse_transform(self, ds: Dataset) -> Dataset:
        """Undo, last first, what was done to the target."""
        for s in reversed(self.stages):
            if s.target and s.target in (s.columns or ()) and not s.changes_rows and s.inversible():
                ds = s.inverse_transform(ds)
        return ds

    def report(self) -> list[dict]:
        return [{type(s).__name__: dict(s.params)} for s in self.stages]

    def save(self, path: str) -> None:
        """Fitted parameters are plain values, never frames, so a pickle holds all there is."""
        with open(path, "wb") as f:
            pickle.dump(self, f)

    @staticmethod
    def load(path: str) -> Pipeline:
        with open(path, "rb") as f:
            return pickle.load(f)
