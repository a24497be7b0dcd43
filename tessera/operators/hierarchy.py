"""Label hierarchies: a tree of labels as a table with paths, and lookups through it.

The tree (id, parent_id, ...) is built level by level: each step joins the
last level's rows with their children, so the number of joins is the depth, and
nothing is collected. Hierarchies are small against the data that refers to them;
lookups are equi-joins that Spark broadcasts while the tree is small.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_paths(tree: DataFrame) -> DataFrame:
    """tree with level (root 0), path (ids from the root to the label) and preorder (0 for the root; siblings by id).

    Labels whose ancestors do not lead to a root are left out.
    """
    level = tree.filter("parent_id is null").withColumn("level", F.lit(0)).withColumn("path", F.array("id"))
    out = level
    for i in count(1):  # ends at the deepest level: a cycle can't be reached from a root
        above = level.select(F.col("id").alias("_p"), F.col("path").alias("_path"))
        level = tree.join(above, tree.parent_id == above["_p"]).withColumn("level", F.lit(i)).withColumn("path", F.concat("_path", F.array("id"))).drop("_p", "_path")
        if not level.take(1):
            break
        out = out.unionByName(level)
    # paths in array order are in preorder
    return out.withColumn("preorder", F.row_number().over(Window.orderBy("path")).cast("long") - 1)


def label_points(points: DataFrame, atlas: DataFrame, invalid: int = 0) -> DataFrame:
    """points with id: the atlas label of the voxel they fall in (coordinates truncated), ``invalid`` outside."""
    a = atlas.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"), F.col("id").alias("_id"))
    at = [F.col(c).cast("int") for c in "xyz"]
    joined = points.join(a, (at[0] == F.col("_x")) & (at[1] == F.col("_y")) & (at[2] == F.col("_z")), "left")
    return joined.withColumn("id", F.coalesce("_id", F.lit(invalid))).drop("_x", "_y", "_z", "_id")


def at_level(path: Column, level: int | None) -> Column:
    """The ancestor at a level (the label itself if it is above that level)."""
    return F.element_at(path, -1) if level is None else F.coalesce(F.get(path, F.lit(level)), F.element_at(path, -1))


def convert_label(df: DataFrame, paths: DataFrame, key: str = "id", value: str = "name", level: int | None = None, strict: bool = True, missing=0) -> DataFrame:
    """df with the column ``value`` of the label (or of its ancestor at ``level``). ``strict``: a label that is not in the tree is an error, else ``missing``."""
    to = paths.select(F.col(key).alias("_k"), at_level(F.col("path"), level).alias("_a"))
    values = paths.select(F.col("id").alias("_a"), F.col(value).alias("_v"))
    out = df.join(to, df[key] == F.col("_k"), "left").join(values, "_a", "left")
    lost = F.raise_error(F.concat(F.lit("no label "), F.col(key).cast("string"))).cast(paths.schema[value].dataType) if strict else F.lit(missing).cast(paths.schema[value].dataType)
    return out.withColumn(value, F.when(F.col("_k").isNull(), lost).otherwise(F.col("_v"))).drop("_k", "_a", "_v")


def parents(paths: DataFrame) -> DataFrame:
    """id, ancestors: the chain from the label to the root, itself first."""
    return paths.select("id", F.reverse("path").alias("ancestors"))


def common_parent(paths: DataFrame, groups: DataFrame) -> DataFrame:
    """key, parent: the deepest ancestor that all labels of a group share. ``groups``: key, id."""
    known = groups.join(paths.select("id", "path"), "id")
    steps = known.select("key", F.col("id").alias("label"), F.posexplode("path").alias("depth", "node"))
    sizes = known.groupBy("key").agg(F.countDistinct("id").alias("n"))
    shared = steps.groupBy("key", "depth", "node").agg(F.countDistinct("label").alias("m")).join(sizes, "key").filter("m = n")
    return shared.groupBy("key").agg(F.max_by("node", "depth").alias("parent"))


def descendants(paths: DataFrame, including_self: bool = False) -> DataFrame:
    """parent, child for every label and each of its descendants."""
    out = paths.select(F.explode("path").alias("parent"), F.col("id").alias("child"))
    return out if including_self else out.filter("parent <> child")


def child_to_parent(paths: DataFrame, chosen: list[int]) -> DataFrame:
    """child, parent (of the chosen labels the last listed one that is the child's ancestor or itself)."""
    rank = F.array_position(F.array(*[F.lit(c).cast("long") for c in chosen]), F.col("parent"))
    return descendants(paths, True).filter(F.col("parent").isin(chosen)).groupBy("child").agg(F.max_by("parent", rank).alias("parent"))


def enrich(df: DataFrame, paths: DataFrame, columns: tuple[str, ...] = ("name",)) -> DataFrame:
    """df with the named columns of its id; null where the id is unknown."""
    return df.join(paths.select("id", *columns), "id", "left")


def volume_map(atlas: DataFrame, scale: tuple[float, float, float] = (1.0, 1.0, 1.0), by: tuple[str, ...] = ("id",)) -> DataFrame:
    """Voxels per label (and hemisphere, if named in ``by``) times the voxel volume."""
    return atlas.groupBy(*by).agg((F.count("*") * (scale[0] * scale[1] * scale[2])).alias("volume"))


def all_structures(frames: list[DataFrame]) -> DataFrame:
    """Sorted distinct ids over frames."""
    out = frames[0].select("id")
    for f in frames[1:]:
        out = out.unionByName(f.select("id"))
    return out.distinct().orderBy("id")
