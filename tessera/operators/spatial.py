"""Orientation, resampling, tile layouts, placement and stitching."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.operators.graph import Graph, greedy_coloring
from tessera.plans.runs import whole_groups
from tessera.plans.scratch import Scratch

AXES = ("x", "y", "z")
Orientation = tuple[int, int, int]


def format_orientation(orientation, default=None) -> Orientation | None:
    """None -> default, 'left' -> None (identity), 'right' -> (-1, 2, 3), else three signed axes."""
    if orientation is None:
        return default
    if orientation == "left":
        return None
    if orientation == "right":
        return (-1, 2, 3)
    o = tuple(int(a) for a in orientation)
    if sorted(abs(a) for a in o) != [1, 2, 3]:
        raise ValueError(f"no signed permutation: {orientation}")
    return o  # type: ignore[return-value]


def inverse_orientation(o: Orientation | None) -> Orientation | None:
    if o is None:
        return None
    out = [0, 0, 0]
    for i, a in enumerate(o):
        out[abs(a) - 1] = (i + 1) * (1 if a > 0 else -1)
    return tuple(out)  # type: ignore[return-value]


def permutation(o: Orientation | None) -> tuple[int, int, int]:
    return (0, 1, 2) if o is None else tuple(abs(a) - 1 for a in o)  # type: ignore[return-value]


def orient(values, o: Orientation | None):
    """A shape or resolution with its axes permuted."""
    return tuple(values[i] for i in permutation(o))


def resample_shape(source_shape, sink_shape=None, source_resolution=None, sink_resolution=None, o: Orientation | None = None):
    """(source shape, sink shape) from each other and the resolutions; sizes are rounded up."""
    if sink_shape is not None:
        return tuple(source_shape), tuple(sink_shape)
    if source_resolution is None or sink_resolution is None:
        raise ValueError("needs a sink shape or both resolutions")
    shape, resolution = orient(source_shape, o), orient(source_resolution, o)
    return tuple(source_shape), tuple(int(ceil(n * r / s)) for n, r, s in zip(shape, resolution, sink_resolution))


def resample_factor(source_shape, sink_shape, o: Orientation | None = None) -> tuple[float, float, float]:
    """sink / source size of each source axis."""
    back = orient(sink_shape, inverse_orientation(o))
    return tuple(b / a for a, b in zip(source_shape, back))  # type: ignore[return-value]


def _turn(columns: list[Column], shape, o: Orientation | None) -> list[Column]:
    """Permuted coordinates; a negative axis is mirrored as n - 1 - x."""
    if o is None:
        return columns
    return [columns[abs(a) - 1] if a > 0 else F.lit(shape[abs(a) - 1] - 1) - columns[abs(a) - 1] for a in o]


def resample_points(points: DataFrame, source_shape, sink_shape, o: Orientation | None = None) -> DataFrame:
    f = resample_factor(source_shape, sink_shape, o)
    scaled = [F.col(a) * k for a, k in zip(AXES, f)]
    turned = _turn(scaled, orient(sink_shape, inverse_orientation(o)), o)
    return points.select([c for c in points.columns if c not in AXES] + [c.alias(a) for c, a in zip(turned, AXES)])


def resample_points_inverse(points: DataFrame, source_shape, sink_shape, o: Orientation | None = None) -> DataFrame:
    inv = inverse_orientation(o)
    back = _turn([F.col(a) for a in AXES], sink_shape, inv)
    f = resample_factor(source_shape, sink_shape, o)
    return points.select([c for c in points.columns if c not in AXES] + [(c / k).alias(a) for c, k, a in zip(back, f, AXES)])


def resample_nearest(vox: DataFrame, source_shape, sink_shape) -> DataFrame:
    """Each sink voxel takes the source voxel under its centre; the source voxel is sent to all sink voxels it covers."""
    out = vox
    for a, n, m in zip(AXES, source_shape, sink_shape):
        # source index of sink voxel i: floor((i + 1/2) n / m); its inverse image is a run of sink voxels
        lo = F.ceil((2 * F.col(a) * m - n) / (2.0 * n)).cast("int")
        hi = (F.ceil((2 * (F.col(a) + 1) * m - n) / (2.0 * n)) - 1).cast("int")
        out = out.withColumn("_a", F.greatest(lo, F.lit(0))).withColumn("_b", F.least(hi, F.lit(m - 1))).filter("_a <= _b").withColumn(a, F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")
    return out


def resample_area(vox: DataFrame, factor: tuple[int, int, int]) -> DataFrame:
    """Means over whole blocks of voxels: one partial aggregation."""
    return vox.groupBy("vol_id", *[F.floor(F.col(a) / k).cast("int").alias(a) for a, k in zip(AXES, factor)]).agg(F.avg("v").alias("v"))


def _linear_axis(vox: DataFrame, axis: str, n: int, m: int) -> DataFrame:
    """One axis at a time: sink voxel i samples at (i + 1/2) n / m - 1/2 (border repeated); both neighbours send their weighted share."""
    rest = [c for c in ("vol_id", *AXES) if c != axis]
    pos = [(i + 0.5) * n / m - 0.5 for i in range(m)]
    shares: dict[int, list[tuple[int, float]]] = {}
    for i, p in enumerate(pos):
        lo = int(np.floor(p))
        w = p - lo
        for j, k in ((lo, 1 - w), (lo + 1, w)):
            if k:
                shares.setdefault(min(max(j, 0), n - 1), []).append((i, k))
    table = vox.sparkSession.createDataFrame([(j, i, k) for j, pairs in shares.items() for i, k in pairs], f"{axis} int, _to int, _k double")
    return vox.join(F.broadcast(table), axis).groupBy(*rest, F.col("_to").alias(axis)).agg(F.sum(F.col("v") * F.col("_k")).alias("v"))  # table rows: at most twice the axis


def resample_linear(vox: DataFrame, source_shape, sink_shape) -> DataFrame:
    for a, n, m in zip(AXES, source_shape, sink_shape):
        if n != m:
            vox = _linear_axis(vox, a, n, m)
    return vox.select("vol_id", *AXES, F.col("v").cast("double").alias("v"))


def affine_points(points: DataFrame, matrix, offset) -> DataFrame:
    c = [F.col(a) for a in AXES]
    new = [sum((float(matrix[i][j]) * c[j] for j in range(3)), F.lit(float(offset[i]))) for i in range(3)]
    return points.select([x for x in points.columns if x not in AXES] + [n.alias(a) for n, a in zip(new, AXES)])


def deformation_distance(field: DataFrame, scale=(1.0, 1.0, 1.0)) -> DataFrame:
    """Norm of the displacement columns dx, dy, dz."""
    return field.withColumn("distance", F.sqrt(sum((F.col(f"d{a}") * F.col(f"d{a}") * (s * s) for a, s in zip(AXES, scale)), F.lit(0.0))))


# layouts: tiles(tile, lox, loy, loz, hix, hiy, hiz), alignments(pre, post, dx, dy, dz, quality)
def overlaps(tiles: DataFrame, cell: int) -> DataFrame:
    """pre, post and the overlap box of tiles that share at least one voxel on every axis.

    Tiles are registered in the grid cells they touch, so pairs are made inside cells only.
    """
    t = tiles
    for a in AXES:
        t = t.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(f"lo{a}") / cell), F.floor((F.col(f"hi{a}") - 1) / cell))))
    left, right = t.alias("p"), t.hint("merge").alias("q")  # many cells for a tile, so the size on disk of the tiles says little
    on = [F.col(f"p.c{a}") == F.col(f"q.c{a}") for a in AXES] + [F.col("p.tile") < F.col("q.tile")]
    box = [F.greatest(F.col(f"p.lo{a}"), F.col(f"q.lo{a}")).alias(f"lo{a}") for a in AXES] + [F.least(F.col(f"p.hi{a}"), F.col(f"q.hi{a}")).alias(f"hi{a}") for a in AXES]
    pairs = left.join(right, on).select(F.col("p.tile").alias("pre"), F.col("q.tile").alias("post"), *box, *[F.col(f"p.c{a}").alias(f"_c{a}") for a in AXES])
    met = [f"lo{a} < hi{a} and _c{a} = floor(lo{a} / {cell})" for a in AXES]  # of the cells of a pair, that of its box's low corner
    return pairs.filter(" and ".join(met)).drop(*[f"_c{a}" for a in AXES]).distinct()


def filter_alignments(alignments: DataFrame, min_quality: float = float("-inf"), max_quality: float | None = None) -> DataFrame:
    out = alignments.filter(F.col("quality") > min_quality)
    return out if max_quality is None else out.filter(F.col("quality") < max_quality)


def layout_components(tiles: DataFrame, alignments: DataFrame, min_quality: float = float("-inf")) -> DataFrame:
    """tile, component."""
    scratch = Scratch(tiles.sparkSession, "layout")
    found = connected_components(filter_alignments(alignments, min_quality).select(F.col("pre").alias("a"), F.col("post").alias("b")), scratch)
    return tiles.select("tile").join(found.withColumnRenamed("node", "tile"), "tile", "left").withColumn("component", F.coalesce("component", "tile"))


def is_connected(tiles: DataFrame, alignments: DataFrame) -> bool:
    return layout_components(tiles, alignments).select("component").distinct().limit(2).count() <= 1


def positions_from_tree(alignments: DataFrame, source: int) -> DataFrame:
    """tile, x, y, z, steps: shifts added along a shortest path from the source (ties: the smallest predecessor)."""
    both = alignments.select(F.col("pre").alias("a"), F.col("post").alias("b"), "dx", "dy", "dz").unionByName(alignments.select(F.col("post").alias("a"), F.col("pre").alias("b"), (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"), (-F.col("dz")).alias("dz")))
    s = alignments.sparkSession
    scratch = Scratch(s, "tree")
    both = scratch.save(both, "both")
    front = done = scratch.save(s.createDataFrame([(source, 0.0, 0.0, 0.0, 0)], "tile bigint, x double, y double, z double, steps int"), "start")
    i = 0
    while True:
        i += 1
        new = both.join(front, both.a == front.tile).groupBy("b").agg(F.min_by(F.struct(*[(F.col(a) + F.col(f"d{a}")).alias(a) for a in AXES]), F.col("a")).alias("p"))
        new = new.select(F.col("b").alias("tile"), "p.*", F.lit(i).alias("steps")).join(done, "tile", "left_anti")
        front = scratch.save(new, f"front-{i}")
        if not front.take(1):
            return done
        done = scratch.save(done.unionByName(front), f"done-{i}")


def _tree_start(p: np.ndarray, q: np.ndarray, d: np.ndarray, n: int, roots: np.ndarray) -> np.ndarray:
    """Positions along spanning trees from the roots, level by level: exact if the alignments agree."""
    order = np.argsort(np.concatenate([p, q]), kind="stable")
    other, step = np.concatenate([q, p])[order], np.concatenate([d, -d])[order]
    begin = np.searchsorted(np.concatenate([p, q])[order], np.arange(n + 1))
    x, seen, front = np.zeros((n, d.shape[1])), np.zeros(n, bool), roots
    seen[roots] = True
    while len(front):
        size = begin[front + 1] - begin[front]
        e = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[front], size)
        come = np.repeat(front, size)
        new, first = np.unique(other[e], return_index=True)
        first = first[~seen[new]]
        front = other[e][first]
        x[front] = x[come[first]] + step[e][first]
        seen[front] = True
    return x


def solve_layouts(p: np.ndarray, q: np.ndarray, d: np.ndarray, part: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """Least-squares positions from x[q] - x[p] = d of nodes in components (``part``: ascending numbers from 0, one for each node), each component's first node at 0: conjugate
    gradients on the normal equations, whose matrix is only ever applied edge by edge. Components have steps of their own and share the passes. Memory: a few numbers for each node and edge."""
    n, roots = len(part), np.flatnonzero(np.diff(part, prepend=-1))
    total = lambda x: np.stack([np.bincount(part, x[:, c], len(roots)) for c in range(x.shape[1])], axis=1)

    def apply(x: np.ndarray) -> np.ndarray:
        e = x[q] - x[p]
        return np.stack([np.bincount(q, e[:, c], n) - np.bincount(p, e[:, c], n) for c in range(x.shape[1])], axis=1)

    b = np.stack([np.bincount(q, d[:, c], n) - np.bincount(p, d[:, c], n) for c in range(d.shape[1])], axis=1)
    degree = np.maximum(np.bincount(p, minlength=n) + np.bincount(q, minlength=n), 1)[:, None]
    x = _tree_start(p, q, d, n, roots)
    r = b - apply(x)
    z = r / degree
    way, rz = z.copy(), total(r * z)
    least = tolerance**2 * np.maximum(1.0, total(b * b / degree).sum(axis=1))
    most = 10 * np.bincount(part, minlength=len(roots)) + 100
    for i in range(int(most.max(initial=0))):
        open_ = (rz.sum(axis=1) > least) & (i < most)
        if not open_.any():
            break
        aw = apply(way)
        step = np.where(open_[:, None], rz / np.maximum(total(way * aw), 1e-300), 0.0)[part]
        x, r = x + step * way, r - step * aw
        z = r / degree
        new = total(r * z)
        turn = np.where(open_[:, None], new / np.maximum(rz, 1e-300), 0.0)  # a component that is done stays where it is
        way, rz = z + turn[part] * way, np.where(open_[:, None], new, 0.0)
    return x - x[roots[part]]


def solve_layout(p: np.ndarray, q: np.ndarray, d: np.ndarray, n: int, tolerance: float = 1e-10) -> np.ndarray:
    """``solve_layouts`` of n connected nodes."""
    return solve_layouts(p, q, d, np.zeros(n, np.int64), tolerance)


#: Alignments of one component that one task solves; beyond that the matrix-vector product is a distributed aggregation.
TASK_ALIGNMENTS = 1_000_000


def _solve_distributed(edges: DataFrame, scratch: Scratch, tolerance: float = 1e-8, rounds: int = 100_000) -> DataFrame:
    """component, tile, x, y, z of components that are too large for a task. ``edges``: component, pre, post, dx, dy, dz. Components share the rounds; a round is one
    join and one aggregation over the edges, and a written table of the nodes."""
    names = list(AXES)
    both = edges.select("component", F.col("post").alias("tile"), *[F.col(f"d{a}").cast("double").alias(f"d{a}") for a in names]).unionByName(edges.select("component", F.col("pre").alias("tile"), *[(-F.col(f"d{a}").cast("double")).alias(f"d{a}") for a in names]))
    near = scratch.save(edges.select(F.col("pre").alias("tile"), F.col("post").alias("other")).unionByName(edges.select(F.col("post").alias("tile"), F.col("pre").alias("other"))), "near")
    nodes = both.groupBy("component", "tile").agg(F.count("*").cast("double").alias("k"), *[F.sum(f"d{a}").alias(f"r{a}") for a in names])
    nodes = scratch.save(nodes.select("component", "tile", "k", *[F.lit(0.0).alias(f"x{a}") for a in names], *[f"r{a}" for a in names], *[(F.col(f"r{a}") / F.col("k")).alias(f"w{a}") for a in names]), "cg-0")
    sums = lambda expr: [F.sum(expr(a)).alias(a) for a in names]
    rz = {r["component"]: r for r in nodes.groupBy("component").agg(*sums(lambda a: F.col(f"r{a}") * F.col(f"r{a}") / F.col("k"))).collect()}  # a row for each large component
    start = sum(r[a] for r in rz.values() for a in names)
    spark = edges.sparkSession
    numbers = ", ".join(["component bigint", *[f"s{a} double" for a in names]])
    for i in range(1, rounds + 1):
        if sum(r[a] for r in rz.values() for a in names) <= tolerance**2 * max(1.0, start):
            break
        spread = near.join(nodes.select(F.col("tile").alias("other"), *[F.col(f"w{a}").alias(f"o{a}") for a in names]), "other").groupBy("tile").agg(*[F.sum(f"o{a}").alias(f"o{a}") for a in names])
        applied = scratch.save(nodes.join(spread, "tile").select(*nodes.columns, *[(F.col("k") * F.col(f"w{a}") - F.col(f"o{a}")).alias(f"a{a}") for a in names]), f"applied-{i}")
        waw = {r["component"]: r for r in applied.groupBy("component").agg(*sums(lambda a: F.col(f"w{a}") * F.col(f"a{a}"))).collect()}
        step = spark.createDataFrame([(c, *[rz[c][a] / waw[c][a] if waw[c][a] > 0 else 0.0 for a in names]) for c in rz], numbers)
        moved = applied.join(F.broadcast(step), "component").select("component", "tile", "k", *[(F.col(f"x{a}") + F.col(f"s{a}") * F.col(f"w{a}")).alias(f"x{a}") for a in names], *[(F.col(f"r{a}") - F.col(f"s{a}") * F.col(f"a{a}")).alias(f"r{a}") for a in names], *[f"w{a}" for a in names])
        moved = scratch.save(moved, f"moved-{i}")
        new = {r["component"]: r for r in moved.groupBy("component").agg(*sums(lambda a: F.col(f"r{a}") * F.col(f"r{a}") / F.col("k"))).collect()}
        turn = spark.createDataFrame([(c, *[new[c][a] / rz[c][a] if rz[c][a] > 0 else 0.0 for a in names]) for c in rz], numbers)
        nodes = scratch.save(moved.join(F.broadcast(turn), "component").select("component", "tile", "k", *[f"x{a}" for a in names], *[f"r{a}" for a in names], *[(F.col(f"r{a}") / F.col("k") + F.col(f"s{a}") * F.col(f"w{a}")).alias(f"w{a}") for a in names]), f"cg-{i}")
        scratch.drop(f"cg-{i - 1}", f"applied-{i}", f"moved-{i}")
        rz = new
    first = nodes.groupBy("component").agg(F.min_by(F.struct(*[f"x{a}" for a in names]), "tile").alias("o"))
    return nodes.join(F.broadcast(first), "component").select("component", "tile", *[(F.col(f"x{a}") - F.col(f"o.x{a}")).alias(a) for a in names])


def positions_from_optimization(tiles: DataFrame, alignments: DataFrame, min_quality: float = float("-inf"), task_alignments: int = TASK_ALIGNMENTS) -> DataFrame:
    """tile, component, x, y, z: least squares of sum (p_pre + d - p_post)^2 within each component, its first tile at 0.

    Conjugate gradients over the alignments: components of at most ``task_alignments`` in one task each, larger ones as distributed rounds.
    """
    scratch = Scratch(tiles.sparkSession, "positions")
    parts = layout_components(tiles, alignments, min_quality)
    good = filter_alignments(alignments, min_quality).filter("pre <> post")
    edges = good.join(parts.select(F.col("tile").alias("pre"), "component"), "pre").select("component", "pre", "post", "dx", "dy", "dz")
    large = scratch.save(edges.groupBy("component").count().filter(F.col("count") > task_alignments).select("component"), "large")
    alone = parts.select("component", F.col("tile").alias("pre"), F.col("tile").alias("post"), *[F.lit(0.0).alias(f"d{a}") for a in AXES])

    def solve(batches):
        """Whole components; small ones share an array."""
        for rows, cuts in whole_groups(batches, ["component"]):
            pre, post = rows["pre"], rows["post"]
            component = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            order = np.lexsort((np.concatenate([pre, post]), np.concatenate([component, component])))
            ids, part = np.concatenate([pre, post])[order], np.concatenate([component, component])[order]
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (part[1:] != part[:-1])
            number = np.empty(len(ids), np.int64)
            number[order] = np.cumsum(new) - 1
            ids, part, e = ids[new], part[new], pre != post
            d = np.stack([rows[f"d{a}"][e] for a in AXES], axis=1).astype(float)
            x = solve_layouts(number[: len(pre)][e], number[len(pre) :][e], d, part)
            yield pa.RecordBatch.from_arrays([pa.array(rows["component"][cuts[:-1]][part]), pa.array(ids), *[pa.array(x[:, i].copy()) for i in range(3)]], ["component", "tile", *AXES])

    some = bool(large.take(1))
    small = edges.unionByName(alone)
    small = small.join(F.broadcast(large), "component", "left_anti") if some else small
    small = small.select(*[F.col(c).cast("bigint") for c in ("component", "pre", "post")], *[F.col(f"d{a}").cast("double").alias(f"d{a}") for a in AXES])
    out = small.repartition("component").sortWithinPartitions("component").mapInArrow(solve, "component bigint, tile bigint, x double, y double, z double")
    if not some:
        return out
    big = _solve_distributed(scratch.save(edges.join(F.broadcast(large), "component", "left_semi"), "big"), scratch)
    return out.unionByName(big)


def stitch_weights(shape) -> Column:
    """1 + distance to the tile's border."""
    return F.least(*[F.least(F.col(a), F.lit(n - 1) - F.col(a)) for a, n in zip(AXES, shape) if n > 1] or [F.lit(0), F.lit(0)]) + 1


def stitch(tiles_vox: DataFrame, positions: DataFrame, method: str = "interpolation", shape=None) -> DataFrame:
    """x, y, z, v of the mosaic. tiles_vox: tile, x, y, z, v; positions: tile, x, y, z. max, min, mean or interpolation (weights grow from the tile's border)."""
    if method not in ("max", "min", "mean", "interpolation"):
        raise ValueError(f"unknown method {method}")
    w = stitch_weights(shape).alias("w") if method == "interpolation" else F.lit(1).alias("w")
    v = tiles_vox.withColumn("w", w)
    p = positions.select("tile", *[F.round(a).cast("int").alias(f"p{a}") for a in AXES])
    at = v.join(p, "tile").select(*[(F.col(a) + F.col(f"p{a}")).alias(a) for a in AXES], "v", "w")
    value = {"max": F.max("v"), "min": F.min("v"), "mean": F.avg("v"), "interpolation": F.sum(F.col("v") * F.col("w")) / F.sum("w")}[method]
    return at.groupBy(*AXES).agg(value.alias("v"))


def stitch_adjusted(tiles_vox: DataFrame, positions: DataFrame, shape) -> DataFrame:
    """x, y, z, v of the mosaic by interpolation, and in each overlap (the voxels that the same tiles cover) scaled so that its largest value is that of the tiles there."""
    p = positions.select("tile", *[F.round(a).cast("int").alias(f"p{a}") for a in AXES])
    at = tiles_vox.withColumn("w", stitch_weights(shape)).join(p, "tile").select("tile", *[(F.col(a) + F.col(f"p{a}")).alias(a) for a in AXES], "v", "w")
    mixed = at.groupBy(*AXES).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"), F.max("v").alias("_most"), F.array_sort(F.collect_set("tile")).alias("_by"))  # a place has few tiles
    mixed = Scratch(tiles_vox.sparkSession, "mosaic").save(mixed, "mixed")
    several = mixed.filter(F.size("_by") > 1)  # a single tile needs no factor
    factors = several.groupBy("_by").agg(F.max("_most").alias("_m"), F.max("v").alias("_s")).select("_by", F.when(F.col("_s") != 0, F.col("_m") / F.col("_s")).otherwise(1.0).alias("_f"))
    scaled = several.join(factors, "_by").select(*AXES, (F.col("v") * F.col("_f")).alias("v"))
    return mixed.filter(F.size("_by") == 1).select(*AXES, F.col("v").cast("double").alias("v")).unionByName(scaled)


#: Colors of overlays (red, green, blue) for up to two, up to four, and more colors.
OVERLAY_COLORS = {
    2: [(1, 0, 1), (0, 1, 0)],
    4: [(0.5, 0.5, 0), (0, 0.5, 0.5), (0.5, 0, 0), (0, 0, 0.5)],
    8: [(0.25, 0, 0), (0, 0.25, 0), (0, 0, 0.25), (0.25, 0.25, 0), (0, 0.25, 0.25), (0.25, 0, 0.25), (0.125, 0.25, 0), (0.125, 0, 0.25)],
}


def layout_coloring(tiles: DataFrame, cell: int, colors: list[tuple[float, float, float]] | None = None) -> DataFrame:
    """tile, color, red, green, blue: overlapping tiles have different colors, each the first free one in the order of tiles. More colors than the list has repeat it."""
    pairs = overlaps(tiles, cell).select(F.col("pre").alias("src"), F.col("post").alias("dst")).distinct()
    numbers = greedy_coloring(Graph(tiles.select(F.col("tile").alias("vid")), pairs)).withColumnRenamed("vid", "tile")
    n = (numbers.agg(F.max("color")).first()[0] or 0) + 1
    chosen = colors or next((c for k, c in OVERLAY_COLORS.items() if n <= k), OVERLAY_COLORS[8])
    table = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in chosen])
    rgb = F.element_at(table, F.col("color") % len(chosen) + 1)
    return numbers.select("tile", "color", *[rgb[i].alias(name) for i, name in enumerate(("red", "green", "blue"))])


def best_shift(pre: np.ndarray, post: np.ndarray, max_shift: int) -> tuple[tuple[int, ...], float]:
    """(shift, quality) of two arrays: the shift with the least mean squared difference of their overlap, by FFT correlations; quality is minus that."""
    a, b = pre.astype(float), post.astype(float)
    size = [m + n for m, n in zip(a.shape, b.shape)]
    axes = tuple(range(a.ndim))
    to = lambda x: np.fft.rfftn(x, size, axes)
    fa, fb = to(a), to(b)
    one_a, one_b = to(np.ones(a.shape)), to(np.ones(b.shape))
    back = lambda f: np.fft.irfftn(f, size, axes)
    n = np.rint(back(one_a * one_b.conj()))
    ssd = back(to(a**2) * one_b.conj()) + back(one_a * to(b**2).conj()) - 2 * back(fa * fb.conj())
    best: tuple[tuple[int, ...], float] | None = None
    for s in np.ndindex(*[2 * max_shift + 1] * a.ndim):
        d = tuple(i - max_shift for i in s)
        count = n[d]
        if count >= 1:
            e = max(float(ssd[d]) / count, 0.0)
            if best is None or e < -best[1] - 1e-9:
                best = (d, -e)
    return best if best is not None else ((0,) * a.ndim, float("-inf"))


def align_pairs(pairs: DataFrame, max_shift: int = 10) -> DataFrame:
    """pre, post, dx, dy, dz, quality. pairs: pre, post, and both tiles' overlap bands as arrays with their shape (a, b, shape_a, shape_b)."""

    def run(batches):
        for df in batches:
            rows = []
            for r in df.itertuples():
                (s, q) = best_shift(np.array(r.a, float).reshape(r.shape_a), np.array(r.b, float).reshape(r.shape_b), max_shift)
                rows.append((r.pre, r.post, *s, q))
            yield pd.DataFrame(rows, columns=["pre", "post", "dx", "dy", "dz", "quality"])

    return pairs.mapInPandas(run, "pre bigint, post bigint, dx int, dy int, dz int, quality double")
