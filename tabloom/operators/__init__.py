"""All operators; importing this registers them."""

from tabloom.operators import basic, detection, features, manifold, numeric, resampling  # noqa: F401
from tabloom.core import REGISTRY


def operator(name: str) -> type:
    return next(group[name] for group in REGISTRY.values() if name in group)
