"""Which operators suit a dataset, preset pipelines, and searches for one."""

from __future__ import annotations

import random
from collections.abc import Callable

from tabloom import errors
from tabloom.core import REGISTRY, Dataset, Feature, Pipeline, Role, Stage
from tabloom.functions.profile import Profile
from tabloom.operators import operator


class Pool:
    """Operators that apply to a dataset. What the schema decides comes first; statistics are computed when a
    remaining operator depends on them."""

    def __init__(self, ds: Dataset, profile: Profile | None = None):
        self.ds, self.profile = ds, profile or Profile(ds)

    def columns(self, kind: type[Stage]) -> list[str] | None:
        """Columns the operator would take; None if it does not apply."""
        ds, probe = self.ds, kind()
        try:
            probe.check_target(ds)
            columns = probe.select(ds)
        except errors.TabloomError:
            return None
        if not columns or len([c for c in columns if c != ds.target]) < max(probe.min_features, int(not (probe.target_only or probe.with_target))):
            return None
        name, category = kind.__name__, kind.category
        if name == "StrToTemporal":
            columns = [c for c in columns if self.profile.str_subtypes.get(c) == "temporal"]
        elif name == "StrDecode":
            columns = [c for c in columns if self.profile.str_subtypes.get(c) == "decodable"]
        elif category == "duplicates" and not self.profile.duplicates:
            return None
        elif category == "outliers" and not self.profile.outlier_columns:
            return None
        elif category in ("oversampling", "undersampling") and not self.profile.imbalanced:
            return None
        return columns or None

    def all(self) -> dict[str, dict[str, list[str]]]:
        found = {g: {n: c for n, k in kinds.items() if (c := self.columns(k))} for g, kinds in REGISTRY.items()}
        return {g: v for g, v in found.items() if v}


_STRUCTURE = ["StrDecode", "ListExplode", "DictUnnest", "StrToTemporal", "TemporalExpand", "TemporalToInt"]
_CLEAN = ["DropUnsupportedTypes", "FillNaNWithNone", "DropNoneColumns", "DropNoneRows", "DropInvariantColumns"]
_TREE = ["BooleanToCategorical", *_STRUCTURE, *_CLEAN, "FillNoneMean", "FillNoneMode", "DropDuplicates"]
_NN = ["BooleanToCategorical", *_STRUCTURE, *_CLEAN, ("FillNoneKNNOrMean", {"n_neighbors": 2}), "FillNoneMode", "DropDuplicates"]
_HOT = ["EncodeIntTarget", ("EncodeOneHotOrHash", {"max_values_1hot": 20}), ("DimReduceTruncatedSVD", {"n_components": 2000})]
PRESETS = {
    "1_No_prep": [],
    "2_Basic": ["BooleanToCategorical", *_CLEAN, "FillNoneMean", "FillNoneMode", "Normalize", "EncodeIntTarget", "EncodeHash"],
    "3_Tree": [*_TREE, "EncodeIntTarget", "EncodeInt"],
    "4_Tree_imb": [*_TREE, ("QuantileTransform", {"n_quantiles": 1000}), "EncodeIntTarget", "EncodeInt", "OversampleRandom"],
    "5_NN": [*_NN, "Standardize", *_HOT],
    "6_NN_imb": [*_NN, ("QuantileTransform", {"n_quantiles": 1000}), *_HOT, ("OversampleSMOTEOrRandom", {"n_neighbors": 2})],
}


def adapt(ds: Dataset, preset: str) -> tuple[Pipeline, Dataset]:
    """The preset's stages that apply, each judged on what the ones before it made; fitted, with its result."""
    if ds.role is not Role.TRAIN:
        raise errors.DatasetTypeError("a preset is adapted to training data")
    out = Pipeline()
    for step in PRESETS[preset]:
        name, params = step if isinstance(step, tuple) else (step, {})
        kind = operator(name)
        columns = Pool(ds).columns(kind)
        if columns is None or ("n_components" in params and params["n_components"] >= len(ds.df.columns) - 1):
            continue
        stage = kind(**params) if name not in ("StrToTemporal", "StrDecode", "ListExplode", "DictUnnest") else kind(columns, **params)
        ds = stage.fit_transform(ds)
        out.add_as_is(stage)
    out.fitted = True
    return out, ds


def random_search(ds: Dataset, evaluate: Callable[[Dataset], float] | None = None, lengths: tuple[int, int] = (1, 10), iterations: int = 10, default_params: bool = True, seed: int = 42) -> tuple[Pipeline | None, float]:
    """The best of random pipelines of applicable operators; without a score the first that runs."""
    rng, pool = random.Random(seed), Pool(ds).all()
    best, top = None, float("-inf")
    for _ in range(iterations):
        pipeline = Pipeline()
        for _ in range(rng.randint(*lengths)):
            group = pool[rng.choice(sorted(pool))]
            kind = operator(rng.choice(sorted(group)))
            pipeline.add(kind(**({} if default_params else {k: d.draw(rng) for k, d in kind.domains.items()})))
        try:
            made = pipeline.fit_transform(ds)
            score = evaluate(made) if evaluate else 0.0
        except Exception:  # a pipeline that does not run scores lowest
            continue
        if score > top:
            best, top = pipeline, score
            if evaluate is None:
                break
    return best, top
