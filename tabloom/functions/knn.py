"""Exact nearest neighbours of rows against all reference rows, which reach the tasks in blocks of bounded size.

A task holds one block of references at a time and keeps each row's best over the blocks; the driver holds all
references once. A row that is itself among the references is left out by its key, a draw over its values: rows with
equal values are interchangeable, and just one of them is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.sampling import draw

#: Default row bound of the operators that switch to a mean or random draw beyond it, as the reference does.
LIMIT = 50_000
#: Numbers in a block of references.
SPAN = 1 << 18


def vector(columns: list[str]) -> Column:
    """The columns as one array of doubles; missing values are null or NaN, which readers treat alike."""
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).cast("array<double>")


def matrix(rows, columns: int) -> np.ndarray:
    """A pandas series of such arrays as a matrix, null as NaN."""
    return np.array([[np.nan if v is None else v for v in r] for r in rows], float).reshape(-1, columns)


def references(df: DataFrame, columns: list[str], carry: list[str] = (), seed: int = 42) -> tuple[np.ndarray, list[list], np.ndarray]:
    """All rows as a matrix (null as NaN), with the carried columns and the rows' keys, in the order of the keys."""
    kept = [F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(carry)]
    rows = df.select(draw([*columns, *carry], seed).alias("draw_"), vector(columns).alias("x_"), *kept).orderBy("draw_").toArrow()
    x = np.concatenate([np.empty(0), *[part.flatten().to_numpy(zero_copy_only=False) for part in rows.column("x_").chunks]]).reshape(rows.num_rows, len(columns))
    carried = [rows.column(f"o{i}").to_pylist() for i in range(len(carry))]
    return x, [list(r) for r in zip(*carried)] if carry else [[]] * len(x), rows.column("draw_").to_numpy()


class Blocks:
    """Reference rows as broadcasts of bounded size; iteration gives the place of a block's first row and its rows."""

    def __init__(self, sc, x: np.ndarray, span: int = SPAN):
        step = max(1, span // max(1, x.shape[1]))
        self.rows, self.parts = len(x), [(at, sc.broadcast(x[at : at + step])) for at in range(0, len(x), step)]

    def __len__(self) -> int:
        return self.rows

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for at, part in self.parts:
            yield at, part.value
            if getattr(part, "_path", None):  # the next use reads the file again
                part.__dict__.pop("_value", None)

    def take(self, index: np.ndarray) -> np.ndarray:
        """The rows at the given places, whatever the shape of index."""
        out = None
        for at, rows in self:
            out = np.empty((*index.shape, rows.shape[1])) if out is None else out
            here = (index >= at) & (index < at + len(rows))
            out[here] = rows[index[here] - at]
        return out


def _squares(p: np.ndarray, refs: np.ndarray, present: np.ndarray | None) -> np.ndarray:
    """Squared distances; missing values are left out of a distance, which is scaled up for them."""
    here = ~np.isnan(p)
    if present is None and here.all():
        return np.maximum((p**2).sum(1)[:, None] + (refs**2).sum(1) - 2 * p @ refs.T, 0)
    z, present = np.where(here, p, 0), np.ones(refs.shape) if present is None else present
    d = (z**2) @ present.T + here @ (refs**2).T - 2 * z @ refs.T
    both = here.astype(float) @ present.T
    return np.where(both > 0, np.maximum(d, 0) * p.shape[1] / np.maximum(both, 1), np.inf)


def _least(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least of each row; of equal values those of lower columns."""
    if k >= d.shape[1]:
        return np.broadcast_to(np.arange(d.shape[1]), d.shape)
    out = np.argpartition(d, k - 1, axis=1)[:, :k]
    tied = (d <= np.take_along_axis(d, out[:, -1:], 1)).sum(1) > k
    out[tied] = np.argsort(d[tied], axis=1, kind="stable")[:, :k]
    return out


def nearest(points: np.ndarray, refs: np.ndarray | Blocks, k: int, own: np.ndarray | None = None, keys: np.ndarray | None = None, having: int | None = None, block: int = 512, measure=None) -> tuple[np.ndarray, np.ndarray]:
    """Distances and indices of the k nearest reference rows; ties by index.

    own, keys: keys of the points and the references; one reference row with a point's key is the point itself and is
    left out. having: reference rows without this column are infinitely far. measure: gives the squared distances of
    some points and some references in place of the Euclidean ones.
    """
    take = min(k + (own is not None), len(refs))
    distance, index = np.empty((len(points), 0)), np.empty((len(points), 0), np.int64)
    for start, rows in refs if isinstance(refs, Blocks) else [(0, refs)]:
        present = ~np.isnan(rows)
        filled = np.where(present, rows, 0)
        whole = None if present.all() else present.astype(float)
        best_d, best_i = [], []
        for at in range(0, len(points), block):
            d = measure(points[at : at + block], rows) if measure else _squares(points[at : at + block], filled, whole)
            if having is not None:
                d[:, ~present[:, having]] = np.inf
            places = _least(d, take)
            d = np.concatenate([distance[at : at + block], np.take_along_axis(d, places, 1)], 1)
            places = np.concatenate([index[at : at + block], places + start], 1)
            order = np.lexsort((places, d), axis=1)[:, :take]
            best_d.append(np.take_along_axis(d, order, 1))
            best_i.append(np.take_along_axis(places, order, 1))
        if best_d:
            distance, index = np.concatenate(best_d), np.concatenate(best_i)
    if own is not None and take:
        mine = keys[index] == own[:, None]
        mine[~mine.any(1), -1] = True
        keep = np.arange(take) != mine.argmax(1)[:, None]
        distance, index = distance[keep].reshape(len(points), take - 1), index[keep].reshape(len(points), take - 1)
    return np.sqrt(distance), index


def nearest_everywhere(sc, points: np.ndarray, own: np.ndarray, refs: np.ndarray, keys: np.ndarray, k: int, block: int = 512, with_distance: bool = False, measure=None):
    """Indices (and distances before them) of the k nearest reference rows of points that the driver holds, found by
    the executors."""
    blocks, all_keys = Blocks(sc, refs), sc.broadcast(keys)
    pieces = [(points[at : at + block], own[at : at + block]) for at in range(0, len(points), block)]
    found = sc.parallelize(pieces, max(1, len(pieces))).map(lambda piece: nearest(piece[0], blocks, k, piece[1], all_keys.value, measure=measure)).collect()
    distance, index = (np.concatenate([f[i] for f in found]) if found else np.empty((0, k), (float, np.int64)[i]) for i in (0, 1))
    return (distance, index) if with_distance else index
