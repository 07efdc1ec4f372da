"""Errors of the library."""


class TabloomError(Exception):
    """Base of all errors raised on purpose."""


def _kinds(*names: str) -> dict[str, type]:
    return {n: type(n, (TabloomError,), {"__module__": __name__}) for n in names}


globals().update(
    _kinds(
        "NotFittedError", "AlreadyFittedError", "FitError", "TransformError", "InverseTransformError", "NotInversibleError", "DatasetTypeError",
        "TargetColumnError", "TransformTargetError", "FeatureTypeError", "DataTypeError", "NoTargetError", "DatasetEmptyError", "InsufficientFeaturesError",
        "UnsupportedFormatError", "OptimizerEvalError", "HyperparameterValueError", "HyperparameterNameError", "HyperparameterRangeError", "HyperparameterStepError",
    )
)
