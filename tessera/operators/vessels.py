"""Steps of a vessel graph's post-processing, on ``Graph`` tables: measures from volumes, arteries and veins, small parts.

Every step is a fixed number of equi-joins, or a traversal that writes each round. Edges are judged row by row, so parallel edges
stay apart. Where voxels and vertices both have a vol_id, a vertex looks into its own volume only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import morphology as M
from tessera.operators.graph import Graph

AXES = ("x", "y", "z")


def _at(vox: DataFrame, value: Column) -> DataFrame:
    """Voxels by place, with vol_id where there is one."""
    return vox.select(*[c for c in ("vol_id", *AXES) if c in vox.columns], value.alias("v"))


def measure_radii(g: Graph, binary: DataFrame, name: str = "radius") -> Graph:
    """Vertices with the distance of their voxel to the nearest background voxel; edges with the larger of their ends' radii."""
    radii = _at(M.distance_transform(binary), F.col("v"))
    out = g.sample_vertices(radii, name, 0.0)
    at = lambda end: out.vertices.select(F.col("vid").alias(end), F.col(name).alias(f"_{end}"))
    return Graph(out.vertices, out.edges.drop(name).join(at("src"), "src").join(at("dst"), "dst").withColumn(name, F.greatest("_src", "_dst")).drop("_src", "_dst"))


def set_artery_binary(g: Graph, mask: DataFrame, name: str = "artery_binary") -> Graph:
    """Vertices and edges marked where the mask (x, y, z, v) is positive: an edge needs both ends."""
    out = g.sample_vertices(_at(mask, F.col("v") > 0), name, False)
    at = lambda end: out.vertices.select(F.col("vid").alias(end), F.col(name).alias(f"_{end}"))
    return Graph(out.vertices, out.edges.drop(name).join(at("src"), "src").join(at("dst"), "dst").withColumn(name, F.col("_src") & F.col("_dst")).drop("_src", "_dst"))


def set_arteriness(g: Graph, vox: DataFrame, name: str = "artery_raw") -> Graph:
    """Vertices with the channel's value at their voxel; edges with the mean of their ends."""
    return g.sample_vertices(_at(vox, F.col("v").cast("double")), name, 0.0).edge_mean_of_vertices(name, name)


def distance_to_surface(g: Graph, distances: DataFrame, name: str = "distance_to_surface") -> Graph:
    """Vertices with the distance volume's value at their voxel; edges with the mean."""
    return set_arteriness(g, distances, name)


def annotate(g: Graph, atlas: DataFrame, name: str = "annotation") -> Graph:
    """Vertices with the atlas label (x, y, z, id) of their voxel; 0 outside."""
    return g.sample_vertices(_at(atlas, F.col("id")), name, 0)


def pre_filter_veins(g: Graph, min_radius: float, max_arteriness: float, radius: str = "radius", arteriness: str = "artery_raw") -> DataFrame:
    """src, dst, vein: large edges that the artery channel does not show."""
    return g.edges.select("src", "dst", ((F.col(radius) >= min_radius) & (F.col(arteriness) <= max_arteriness)).alias("vein"))


def _without(g: Graph, label: str, on: Column, small: DataFrame) -> Graph:
    """Edges with ``label``: those that are ``on``, but for parts of the small components (vid)."""
    gone = small.select(F.col("vid").alias("src"), F.lit(True).alias("_small"))
    return Graph(g.vertices, g.edges.join(gone, "src", "left").withColumn(label, F.coalesce(on & F.col("_small").isNull(), F.lit(False))).drop("_small"))


def pre_filter_arteries(g: Graph, huge_vein: str = "vein", artery: str = "artery_binary", least_edges: int = 4) -> Graph:
    """Edges with ``artery``: marked ones that are no vein, in connected groups of at least ``least_edges`` of them."""
    on = Graph(g.vertices, g.edges.filter(F.col(artery) & ~F.col(huge_vein)))
    small = on.small_components(least_edges)
    return _without(g, artery, F.col(artery) & ~F.col(huge_vein), small)


def post_filter_veins(g: Graph, min_radius: float, radius: str = "radius", artery: str = "artery") -> Graph:
    """Edges with ``vein``: at least ``min_radius`` wide and no artery."""
    return g.define_edge_property("vein", (F.col(radius) >= min_radius) & ~F.col(artery))


def trace_arteries(g: Graph, min_arteriness: float, max_iterations: int | None = 5, artery: str = "artery", arteriness: str = "artery_raw") -> DataFrame:
    """src, dst, artery: grown from marked edges over neighbours whose channel value reaches ``min_arteriness``."""
    return g.trace_edges(artery, F.col(arteriness) >= min_arteriness, max_iterations)


def trace_veins(g: Graph, min_distance_to_artery: int, min_radius: float, max_iterations: int | None = 5, vein: str = "vein", artery: str = "artery", radius: str = "radius") -> DataFrame:
    """src, dst, vein: grown from marked edges over edges of at least ``min_radius`` that are more than ``min_distance_to_artery`` steps from an artery."""
    near = g.define_edge_property("_near", F.col(artery)).edge_propagate("_near", True, min_distance_to_artery, keep=(vein, radius))
    return Graph(g.vertices, near).trace_edges(vein, (F.col(radius) >= min_radius) & ~F.col("_near"), max_iterations)


def remove_small_components(g: Graph, label: str, least_edges: int) -> Graph:
    """Edges of a label in connected groups of fewer than ``least_edges`` lose it."""
    on = Graph(g.vertices, g.edges.filter(F.col(label)))
    return _without(g, label, F.col(label), on.small_components(least_edges))


def clean_open_branches(skeleton: DataFrame, length: int) -> DataFrame:
    """vol_id, x, y, z: the skeleton without branches of at most ``length`` voxels that end openly. A branch is what is left of a tip when voxels with three or more
    26-neighbours are taken away; it goes only if it touches such a voxel (free strands stay)."""
    at = ["vol_id", *AXES]
    s = skeleton.select(*at).distinct()
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)])
    near = lambda df: df.withColumn("_o", F.explode(steps)).select("vol_id", *[(F.col(a) + F.col(f"_o.d{a}")).alias(a) for a in AXES])
    degree = s.join(near(s).groupBy(*at).agg(F.count("*").alias("degree")).hint("merge"), at, "left").fillna(0, ["degree"])
    branch = degree.filter("degree >= 3").select(*at)
    rest = M.label_voxels(s.join(branch.hint("merge"), at, "left_anti"), faces_only=False)
    facts = rest.join(degree.hint("merge"), at).join(near(branch).distinct().withColumn("_touch", F.lit(True)).hint("merge"), at, "left")
    gone = facts.groupBy("vol_id", "label").agg(F.count("*").alias("n"), F.min("degree").alias("least"), F.max(F.coalesce("_touch", F.lit(False))).alias("touch")).filter((F.col("n") <= length) & (F.col("least") <= 1) & F.col("touch"))
    return s.join(rest.join(gone.select("vol_id", "label").hint("merge"), ["vol_id", "label"], "left_semi").select(*at).hint("merge"), at, "left_anti")


#: Names of the bits of a binarisation's status, smallest bit first.
STATUS = ("High", "Equalized", "Deconvolved", "Adaptive", "Tube", "Fill", "Tracing")


def status_to_description(status: int, names: tuple[str, ...] = STATUS) -> str:
    """Names of a status' bits, joined by commas; Background for 0."""
    return ",".join(n for i, n in enumerate(names) if status >> i & 1) or "Background"


def binary_statistics(status: DataFrame, names: tuple[str, ...] = STATUS) -> DataFrame:
    """status, description, n of every status value (column v) that occurs."""
    on = F.concat_ws(",", *[F.when(F.col("status").bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(names)])
    counts = status.groupBy(F.col("v").cast("long").alias("status")).agg(F.count("*").alias("n"))
    return counts.select("status", F.when(on == "", F.lit("Background")).otherwise(on).alias("description"), "n")
