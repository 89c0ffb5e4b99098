"""Douglas-Peucker simplification, feature by feature.

A recursive vertex selection has no column-expression form, so this runs in
``mapInArrow``, with an iterative stack per path over flat coordinate arrays.
Rings stay closed and keep at least four vertices; lines keep their end points.
Neighbouring features are not kept in step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import geom as G

# Fixed value: tolerance in degrees.
SIMPLIFY_TOLERANCE = 0.00004


def dp_keep(xs: np.ndarray, ys: np.ndarray, tol: float) -> np.ndarray:
    """Boolean mask of the vertices Douglas-Peucker keeps."""
    n = len(xs)
    keep = np.zeros(n, dtype=bool)
    if n <= 2:
        keep[:] = True
        return keep
    keep[0] = keep[-1] = True
    stack = [(0, n - 1)]
    while stack:
        a, b = stack.pop()
        if b <= a + 1:
            continue
        ax, ay, bx, by = xs[a], ys[a], xs[b], ys[b]
        px, py = xs[a + 1:b], ys[a + 1:b]
        dx, dy = bx - ax, by - ay
        l2 = dx * dx + dy * dy
        if l2 == 0:
            d = np.hypot(px - ax, py - ay)
        else:
            t = np.clip(((px - ax) * dx + (py - ay) * dy) / l2, 0.0, 1.0)
            d = np.hypot(px - (ax + t * dx), py - (ay + t * dy))
        i = int(np.argmax(d))
        if d[i] > tol:
            m = a + 1 + i
            keep[m] = True
            stack.append((a, m))
            stack.append((m, b))
    return keep


def _keep_path(xs: np.ndarray, ys: np.ndarray, tol: float, closed: bool) -> np.ndarray:
    keep = dp_keep(xs, ys, tol)
    if closed and keep.sum() < 4 and len(xs) >= 4:
        # a ring needs four vertices: add back those farthest from its start
        order = np.argsort(-np.hypot(xs - xs[0], ys - ys[0]))
        keep[order[~keep[order]][:4 - int(keep.sum())]] = True
    return keep


def _simplified(geoms: pa.StructArray, tol: float) -> pa.StructArray:
    """The geometries with fewer vertices: Arrow offsets and flat coordinate
    arrays throughout, no Python object per vertex."""
    names = [f.name for f in geoms.type]
    fields = dict(zip(names, geoms.flatten()))
    parts = fields["parts"].combine_chunks() if isinstance(fields["parts"], pa.ChunkedArray) else fields["parts"]
    rings, paths = parts.flatten(), parts.flatten().flatten()
    verts = paths.flatten()
    xs, ys = (np.asarray(v, dtype=float) for v in verts.flatten())
    ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(paths), 0).to_numpy(zero_copy_only=False))))
    rings_of = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
    paths_of = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.repeat(np.arange(len(parts)), rings_of), paths_of)
    kinds = np.array(fields["kind"].to_pylist(), dtype=object)[row]
    keep = np.ones(len(xs), dtype=bool)
    for i, kind in enumerate(kinds):
        if kind != "point":
            lo, hi = ends[i], ends[i + 1]
            keep[lo:hi] = _keep_path(xs[lo:hi], ys[lo:hi], tol, kind == "poly")
    sums = np.concatenate(([0], np.cumsum(keep)))
    new_paths = _relisted(paths, sums[ends], verts.filter(pa.array(keep)))
    new_rings = _relisted(rings, np.concatenate(([0], np.cumsum(paths_of))), new_paths)
    fields["parts"] = _relisted(parts, np.concatenate(([0], np.cumsum(rings_of))), new_rings)
    return pa.StructArray.from_arrays([fields[n] for n in names], names=names, mask=geoms.is_null())


def _relisted(old: pa.ListArray, offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=old.is_null())


def _simplify_batches(tol: float, geom: str):
    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(geom)
            new = _simplified(b.column(at), tol) if len(b) else b.column(at)
            yield pa.RecordBatch.from_arrays(
                [new if i == at else c for i, c in enumerate(b.columns)], b.schema.names)
    return run


def simplify(df: DataFrame, tol: float = SIMPLIFY_TOLERANCE, geom: str = "geom") -> DataFrame:
    """Simplify every line and polygon of ``df``, whatever the layer's size;
    points pass unchanged, other columns pass as Arrow columns, and the
    envelope is recomputed."""
    out = df.mapInArrow(_simplify_batches(tol, geom), df.schema)
    return out.withColumn(geom, G.refresh_envelope(F.col(geom)))


def vertex_count(geom: str = "geom"):
    return F.size(F.flatten(F.flatten(F.col(f"{geom}.parts"))))
