"""Source queries: tags, patterns and round trips of volume files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.graph import Graph
from tessera.plans import fixtures as fx
from tessera.plans.scratch import Scratch
from tessera.registry import register
from tessera.sources import graph_files, sliced, slicing, tags, volumes


@register("tag_expression", "SELECT printf('tile_%02d_%02d.npy', CAST(n_nationkey AS INTEGER), CAST(n_regionkey AS INTEGER)) AS name, CAST(n_nationkey AS INTEGER) AS X, CAST(n_regionkey AS INTEGER) AS Y FROM nation")
def _tags(spark, sf_dir):
    e = tags.Expression("tile_<X,2>_<Y,2>.npy")
    n = fx.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("X"), F.col("n_regionkey").alias("Y")).select(e.format().alias("name"))
    return n.select("name", *e.columns(F.col("name")))


@register("volume_slice", f"WITH {fx.VOX_SQL} SELECT vol_id, x, y, z, v FROM vox WHERE x BETWEEN 1 AND 2 AND y IN (0, 2) AND z = 3")
def _slice(spark, sf_dir):
    return slicing.apply(fx.vox(spark, sf_dir), (slice(1, 3), slice(None, None, 2), -1), (4, 4, 4))


def _round_trip(fmt: str):
    def run(spark, sf_dir):
        scratch = Scratch(spark, f"volumes-{fmt}")
        written = volumes.write(fx.vox(spark, sf_dir), f"{scratch.path}/files", fmt, F.format_string(f"volume_%d.{fmt}", "vol_id"))
        back = volumes.read_listed(written, fmt)
        return back.select(F.regexp_extract("path", r"volume_(\d+)\.", 1).cast("long").alias("vol_id"), "x", "y", "z", F.col("v").cast("long").alias("v"))

    return run


for _fmt in ("npy", "tif", "nrrd"):
    register(f"volume_round_trip_{_fmt}", f"WITH {fx.VOX_SQL} SELECT vol_id, x, y, z, v FROM vox")(_round_trip(_fmt))


_BOUNDS = {"x": (20, 90), "y": (2, 7), "z": (3, 4)}


def _sliced(fmt: str):
    def run(spark, sf_dir):
        """All embeddings as one file; a box of it is read by byte ranges."""
        scratch = Scratch(spark, f"sliced-{fmt}")
        written = volumes.write(fx.slab(spark, sf_dir), f"{scratch.path}/files", fmt, F.lit(f"slab.{fmt}"))
        first = sliced.read_slices(spark, written.first()["path"], _BOUNDS, task_bytes=4096)
        return first.select("x", "y", "z", F.col("v").cast("long").alias("v"))

    return run


for _fmt in ("npy", "tif"):
    register(f"volume_sliced_read_{_fmt}", f"WITH {fx.SLAB_SQL} SELECT x, y, z, v FROM slab WHERE x >= 20 AND x < 90 AND y >= 2 AND y < 7 AND z = 3")(_sliced(_fmt))


@register("volume_headers", "SELECT vec_id AS vol_id, [4, 4, 4]::INTEGER[] AS shape, 'float32' AS dtype FROM embeddings")
def _headers(spark, sf_dir):
    scratch = Scratch(spark, "headers")
    written = volumes.write(fx.vox(spark, sf_dir), f"{scratch.path}/files", "npy", F.format_string("volume_%d.npy", "vol_id"))
    return sliced.headers_of(written, "npy").select(F.regexp_extract("path", r"volume_(\d+)\.", 1).cast("long").alias("vol_id"), "shape", "dtype")


@register("tile_columns", "SELECT CAST(p_partkey % 10 AS INTEGER) AS x, CAST(p_partkey // 10 % 10 AS INTEGER) AS y, array_to_string(list(p_name ORDER BY p_partkey // 100), ',') AS paths FROM part GROUP BY ALL")
def _columns(spark, sf_dir):
    p = fx.read(spark, sf_dir, "part").select((F.col("p_partkey") % 10).cast("int").alias("x"), F.expr("cast(p_partkey div 10 % 10 as int)").alias("y"), F.expr("p_partkey div 100").alias("z"), F.col("p_name").alias("path"))
    return tags.columns_of_tiles(p, ["x", "y"], "z").select("x", "y", F.array_join("paths", ",").alias("paths"))


def _graph_file(spark, sf_dir):
    """The graph of customers, suppliers, nations and regions, written to a file and read again; ``was`` are its own ids."""
    path = f"{Scratch(spark, 'graph-file').path}/files/graph.gt"
    graph_files.write_graph(Graph(*fx.graph(spark, sf_dir)), path, ids="was")
    return graph_files.read_graph(spark, path, 4096).graph


@register("graph_file_vertices", f"WITH {fx.GRAPH_SQL} SELECT row_number() OVER (ORDER BY vid) - 1 AS vid, vid AS was, x, y, z, radius, label FROM vertices")
def _file_vertices(spark, sf_dir):
    return _graph_file(spark, sf_dir).vertices


@register("graph_file_edges", f"WITH {fx.GRAPH_SQL}, n AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS new FROM vertices) SELECT row_number() OVER (ORDER BY a.new, b.new) - 1 AS eid, a.new AS src, b.new AS dst, e.length, e.radius FROM edges e JOIN n a ON e.src = a.vid JOIN n b ON e.dst = b.vid")
def _file_edges(spark, sf_dir):
    return _graph_file(spark, sf_dir).edges
