"""Elementwise, scatter, measure and cell-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cells as C
from tessera.operators import elementwise as E
from tessera.operators import hierarchy as H
from tessera.operators import scatter as S
from tessera.plans import fixtures as fx
from tessera.registry import register

_V = f"WITH {fx.VOX_SQL}"


@register("cells_region_statistics", f"""WITH {fx.CELLS_SQL} SELECT CASE hemisphere WHEN 0 THEN 'LH' WHEN 255 THEN 'RH' END AS hemisphere, id, count(name) AS counts, round(avg(size), 6) AS mean_size
FROM cells WHERE hemisphere IS NOT NULL GROUP BY ALL""")
def _statistics(spark, sf_dir):
    c = fx.cells(spark, sf_dir).withColumn("hemisphere", C.side(F.col("hemisphere"))).filter("hemisphere is not null")
    return C.region_statistics(c).withColumn("mean_size", F.round("mean_size", 6))


@register("clip", f"{_V} SELECT vol_id, x, y, z, round(255.0::DOUBLE * (least(greatest(v, 90), 120) - 90) / 30, 6) AS v FROM vox")
def _clip(spark, sf_dir):
    return fx.vox(spark, sf_dir).select("vol_id", "x", "y", "z", F.round(E.clip(F.col("v"), 90, 120, 255.0), 6).alias("v"))


@register("clip_with_flags", f"{_V} SELECT vol_id, x, y, z, CAST(floor((least(greatest(v, 90), 120) - 90) * 4095 / 30) AS INTEGER) AS clipped, v >= 90 AND v < 120 AS mask, v >= 120 AS high, v < 90 AS low FROM vox")
def _flags(spark, sf_dir):
    return E.clip_with_flags(fx.vox(spark, sf_dir), 90, 120)


@register("apply_lut", f"{_V} SELECT vol_id, x, y, z, CAST((v * 7) % 256 AS INTEGER) AS v FROM vox")
def _lut(spark, sf_dir):
    return E.apply_lut(fx.vox(spark, sf_dir), [(i * 7) % 256 for i in range(256)])


@register("where_positive", f"{_V} SELECT vol_id, x, y, z FROM vox WHERE v > 110")
def _where(spark, sf_dir):
    return E.where_positive(fx.vox(spark, sf_dir), 110)


@register("filter_cells", f"WITH {fx.CELLS_SQL} SELECT id, size, source FROM cells WHERE size >= 10 AND source >= 1000 AND source < 50000")
def _filter(spark, sf_dir):
    return E.filter_cells(fx.cells(spark, sf_dir), {"size": 10, "source": (1000, 50000), "sample": 0}).select("id", "size", "source")


@register("filter_structures", f"WITH {fx.CELLS_SQL} SELECT id, hemisphere, size FROM cells WHERE id NOT IN (1, 2, 3) AND hemisphere IN (0)")
def _structures(spark, sf_dir):
    return E.filter_structures(fx.cells(spark, sf_dir), [1, 2, 3], [0], exclude=True).select("id", "hemisphere", "size")


@register("sanitize_ids", f"WITH {fx.CELLS_SQL} SELECT id, size FROM cells WHERE id > 0 AND id < 65536 AND id <> 997")
def _sanitize(spark, sf_dir):
    return E.sanitize_ids(fx.cells(spark, sf_dir)).select("id", "size")


@register("in_range", f"{_V} SELECT vol_id, x, y, z, v FROM vox WHERE v BETWEEN 95 AND 105")
def _range(spark, sf_dir):
    return fx.vox(spark, sf_dir).filter(E.in_range(F.col("v"), 95, 105))


@register("rename_columns", f"WITH {fx.CELLS_SQL} SELECT id AS structure_id, size AS cell_size FROM cells")
def _rename(spark, sf_dir):
    return E.rename_columns(fx.cells(spark, sf_dir).select("id", "size"), {"id": "structure_id", "size": "cell_size", "absent": "x"})


@register("delete_border", f"{_V} SELECT vol_id, x, y, z, CASE WHEN x IN (0, 3) OR y IN (0, 3) OR z IN (0, 3) THEN 0 ELSE v END AS v FROM vox")
def _delete_border(spark, sf_dir):
    return E.delete_border(fx.vox(spark, sf_dir))


@register("check_border", f"{_V} SELECT vol_id, bool_and(v = 0) AS clean FROM vox WHERE x IN (0, 3) OR y IN (0, 3) OR z IN (0, 3) GROUP BY vol_id")
def _check_border(spark, sf_dir):
    return E.check_border(fx.vox(spark, sf_dir))


@register("correct_illumination", f"{_V} SELECT vol_id, x, y, z, round(v / (1.0::DOUBLE + x) * 2.5::DOUBLE, 6) AS v FROM vox")
def _illumination(spark, sf_dir):
    line = spark.range(4).select(F.col("id").cast("int").alias("x"), (F.col("id") + 1.0).alias("f"))
    return E.correct_illumination(fx.vox(spark, sf_dir), E.flatfield_from_line(line, 4), scaling="mean").withColumn("v", F.round("v", 6))


@register("combine_binary", f"{_V} SELECT DISTINCT vol_id, x, y, z FROM vox WHERE v > 115 OR v < 85")
def _combine(spark, sf_dir):
    v = fx.vox(spark, sf_dir)
    return E.combine_binary(v.filter("v > 115"), v.filter("v < 85"))


@register("count_cells", f"""WITH {fx.CELLS_SQL} SELECT id, CASE hemisphere WHEN 0 THEN 'LH' ELSE 'RH' END AS hemisphere, count(name) AS counts FROM cells WHERE hemisphere IS NOT NULL GROUP BY ALL""")
def _count(spark, sf_dir):
    return C.count_cells(fx.cells(spark, sf_dir))


_SAMPLES = f"""WITH {fx.CELLS_SQL}, k AS (SELECT sample, id, CASE hemisphere WHEN 0 THEN 'LH' ELSE 'RH' END AS hemisphere, count(name) AS counts FROM cells WHERE hemisphere IS NOT NULL GROUP BY ALL),
g AS (SELECT id, hemisphere, {', '.join(f"CAST(coalesce(sum(counts) FILTER (sample = {s}), 0) AS BIGINT) AS counts_{s}" for s in range(1, 8))} FROM k GROUP BY ALL)"""


def _samples(spark, sf_dir):
    c = fx.cells(spark, sf_dir).withColumn("hemisphere", C.side(F.col("hemisphere"))).filter("hemisphere is not null")
    counts = c.groupBy("sample", "id", "hemisphere").agg(F.count("name").alias("counts"))
    return C.group_counts(counts.withColumn("sample", F.col("sample").cast("string")), [str(s) for s in range(1, 8)])


@register("group_counts", f"{_SAMPLES} SELECT * FROM g")
def _group(spark, sf_dir):
    return _samples(spark, sf_dir)


@register("collapse_structures", f"{_SAMPLES} SELECT CASE WHEN id <= 40 THEN id % 4 ELSE id END AS id, hemisphere, {', '.join(f'CAST(sum(counts_{s}) AS BIGINT) AS counts_{s}' for s in range(1, 8))} FROM g GROUP BY 1, 2")
def _collapse(spark, sf_dir):
    mapping = spark.range(1, 41).select(F.col("id").alias("child"), (F.col("id") % 4).alias("parent"))
    return C.collapse_structures(_samples(spark, sf_dir), mapping)


@register("normalize_counts", f"{_SAMPLES} SELECT id, hemisphere, round(counts_1 * 100.0::DOUBLE / (SELECT sum(counts_1) FROM g), 6) AS counts_1 FROM g")
def _normalize(spark, sf_dir):
    g = _samples(spark, sf_dir)
    return C.normalize(g, g, ["counts_1"]).select("id", "hemisphere", F.round("counts_1", 6).alias("counts_1"))


@register("group_scaffold", f"{_SAMPLES} SELECT i.id, s.hemisphere, CAST(coalesce(counts_1, 0) AS BIGINT) AS counts_1, CAST(i.id * 2.5::DOUBLE AS DOUBLE) AS volume FROM (SELECT DISTINCT id FROM g) i CROSS JOIN (VALUES ('LH'), ('RH')) s(hemisphere) LEFT JOIN g ON g.id = i.id AND g.hemisphere = s.hemisphere")
def _scaffold(spark, sf_dir):
    g = _samples(spark, sf_dir)
    ids, sides = g.select("id").distinct(), spark.createDataFrame([("LH",), ("RH",)], "hemisphere string")
    volumes = ids.crossJoin(F.broadcast(sides)).withColumn("volume", F.col("id") * 2.5)
    return C.group_scaffold(ids, sides, g.select("id", "hemisphere", "counts_1"), volumes)


_SHAPE = (60, 12, 8)


@register("devolve_counts", f"WITH {fx.POINTS_SQL} SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, count(*) AS v FROM points GROUP BY ALL")
def _devolve(spark, sf_dir):
    return S.devolve(fx.points(spark, sf_dir), _SHAPE)


@register("devolve_weights", f"WITH {fx.POINTS_SQL} SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, round(sum(w), 2) AS v FROM points GROUP BY ALL")
def _devolve_w(spark, sf_dir):
    return S.devolve(fx.points(spark, sf_dir), _SHAPE, weights="w").withColumn("v", F.round("v", 2))


@register("average_weights", f"WITH {fx.POINTS_SQL} SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, round(avg(w), 6) AS v, count(*) AS n FROM points GROUP BY ALL")
def _average(spark, sf_dir):
    return S.average(fx.points(spark, sf_dir), _SHAPE, "w").withColumn("v", F.round("v", 6))


_OFF = "(SELECT a.i AS dx, b.i AS dy, c.i AS dz FROM range(-2, 3) a(i), range(-2, 3) b(i), range(-2, 3) c(i))"
_IN = "x + dx BETWEEN 0 AND 59 AND y + dy BETWEEN 0 AND 11 AND z + dz BETWEEN 0 AND 7"


@register("voxelize_sphere", f"WITH {fx.POINTS_SQL} SELECT CAST(x + dx AS INTEGER) AS x, CAST(y + dy AS INTEGER) AS y, CAST(z + dz AS INTEGER) AS z, count(*) AS v FROM points, {_OFF} o WHERE dx*dx + dy*dy + dz*dz <= 4 AND {_IN} GROUP BY ALL")
def _sphere(spark, sf_dir):
    return S.voxelize(fx.points(spark, sf_dir), _SHAPE, "sphere", (2, 2, 2))


@register("voxelize_rectangle", f"WITH {fx.POINTS_SQL} SELECT CAST(x + dx AS INTEGER) AS x, CAST(y + dy AS INTEGER) AS y, CAST(z + dz AS INTEGER) AS z, count(*) AS v FROM points, {_OFF} o WHERE abs(dx) <= 1 AND abs(dy) <= 1 AND abs(dz) <= 1 AND {_IN} GROUP BY ALL")
def _rectangle(spark, sf_dir):
    return S.voxelize(fx.points(spark, sf_dir), _SHAPE, "rectangle", (1, 1, 1))


@register("voxelize_pixel", f"WITH {fx.POINTS_SQL} SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, count(*) AS v FROM points GROUP BY ALL")
def _pixel(spark, sf_dir):
    return S.voxelize(fx.points(spark, sf_dir), _SHAPE, "pixel")


def _centres(spark, sf_dir):
    v = fx.vox(spark, sf_dir).filter("v > 115")
    return v.select((F.col("vol_id") * 64 + F.col("x") * 16 + F.col("y") * 4 + F.col("z")).alias("point_id"), "vol_id", "x", "y", "z", F.pmod("v", F.lit(3)).cast("double").alias("radius"), (F.col("v") - 40).alias("bar"))


_CENTRES = f"{_V}, p AS (SELECT vol_id * 64 + x * 16 + y * 4 + z AS point_id, vol_id, x, y, z, v % 3 AS radius, v, v - 40 AS bar FROM vox WHERE v > 115)"
for _name, _sql in (("max", "max(n.v)"), ("min", "min(n.v)"), ("sum", "CAST(sum(n.v) AS BIGINT)"), ("mean", "round(avg(n.v), 6)")):

    def _measure(spark, sf_dir, name=_name):
        out = S.measure_expression(_centres(spark, sf_dir), fx.vox(spark, sf_dir), name)
        return out.withColumn("v", F.round("v", 6)) if name == "mean" else out

    register(f"measure_{_name}", f"{_CENTRES} SELECT p.point_id, {_sql} AS v FROM p JOIN vox n ON n.vol_id = p.vol_id AND (n.x-p.x)*(n.x-p.x)+(n.y-p.y)*(n.y-p.y)+(n.z-p.z)*(n.z-p.z) <= p.radius * p.radius GROUP BY p.point_id")(_measure)


@register("measure_radius", f"""{_CENTRES}, n AS (SELECT p.point_id, min(sqrt((n.x-p.x)*(n.x-p.x)+(n.y-p.y)*(n.y-p.y)+(n.z-p.z)*(n.z-p.z))) AS r FROM p JOIN vox n ON n.vol_id = p.vol_id AND n.v <= p.bar
WHERE (n.x-p.x)*(n.x-p.x)+(n.y-p.y)*(n.y-p.y)+(n.z-p.z)*(n.z-p.z) <= 4 GROUP BY p.point_id) SELECT p.point_id, round(coalesce(r, -1), 6) AS radius FROM p LEFT JOIN n ON p.point_id = n.point_id""")
def _radius(spark, sf_dir):
    offsets = S.sphere_offsets(spark, (2, 2, 2)).withColumn("dist", F.col("dist") * 2)
    return S.measure_radius(_centres(spark, sf_dir), fx.vox(spark, sf_dir), offsets, F.col("bar"), default=-1.0).withColumn("radius", F.round("radius", 6))


@register("block_sums", f"{_V} SELECT vol_id, CAST(z // 2 AS INTEGER) AS block, count(*) FILTER (v > 100) AS n FROM (SELECT vol_id, z, v FROM vox) GROUP BY ALL")
def _blocks(spark, sf_dir):
    return S.block_sums(fx.vox(spark, sf_dir).withColumn("v", F.col("v") - 100), 2)


@register("max_projection", f"{_V} SELECT vol_id, x, y, max(v) AS v FROM vox GROUP BY ALL")
def _projection(spark, sf_dir):
    return S.projection(fx.vox(spark, sf_dir))


@register("find_size_and_intensity", f"{_V} SELECT vol_id, CAST(x AS BIGINT) AS label, count(*) AS size, CAST(sum(v) AS BIGINT) AS v FROM vox GROUP BY ALL")
def _labels(spark, sf_dir):
    v = fx.vox(spark, sf_dir)
    return S.measure_labels(v, v.withColumn("label", F.col("x").cast("long")))


_TREE = f"""WITH RECURSIVE {fx.HIERARCHY_SQL}, paths(id, parent_id, name, level, path) AS (
  SELECT id, parent_id, name, 0, [id] FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.id, t.parent_id, t.name, p.level + 1, list_append(p.path, t.id) FROM tree t JOIN paths p ON t.parent_id = p.id)"""


def _paths(spark, sf_dir):
    return H.with_paths(fx.hierarchy(spark, sf_dir))


@register("hierarchy_paths", f"{_TREE} SELECT id, CAST(level AS INTEGER) AS level, array_to_string(path, '/') AS path, CAST(row_number() OVER (ORDER BY path) - 1 AS BIGINT) AS preorder FROM paths")
def _hierarchy(spark, sf_dir):
    return _paths(spark, sf_dir).select("id", "level", F.array_join(F.transform("path", lambda i: i.cast("string")), "/").alias("path"), "preorder")


@register("hierarchy_convert_label", f"{_TREE} SELECT c.c_custkey + 1000 AS id, n.name FROM customer c JOIN paths p ON p.id = c.c_custkey + 1000 JOIN paths n ON n.id = p.path[2]")
def _convert(spark, sf_dir):
    ids = fx.read(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).cast("long").alias("id"))
    return H.convert_label(ids, _paths(spark, sf_dir), level=1)


@register("hierarchy_descendants", f"{_TREE} SELECT unnest(path) AS parent, id AS child FROM paths")
def _descendants(spark, sf_dir):
    return H.descendants(_paths(spark, sf_dir), True)


@register("hierarchy_parents", f"{_TREE} SELECT id, array_to_string(list_reverse(path), '/') AS ancestors FROM paths")
def _parents(spark, sf_dir):
    return H.parents(_paths(spark, sf_dir)).select("id", F.array_join(F.transform("ancestors", lambda i: i.cast("string")), "/").alias("ancestors"))


@register("hierarchy_common_parent", f"""{_TREE}, g AS (SELECT id % 50 AS key, id, path FROM paths WHERE level = 3), s AS (SELECT key, id, unnest(path) AS node, unnest(range(len(path))) AS depth FROM g),
m AS (SELECT key, depth, node, count(DISTINCT id) AS m FROM s GROUP BY ALL), n AS (SELECT key, count(DISTINCT id) AS n FROM g GROUP BY key)
SELECT m.key, arg_max(node, depth) AS parent FROM m JOIN n ON m.key = n.key AND m = n GROUP BY m.key""")
def _common(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return H.common_parent(p, p.filter("level = 3").select(F.pmod("id", F.lit(50)).alias("key"), "id"))


@register("hierarchy_child_to_parent", f"{_TREE} SELECT id AS child, CASE WHEN list_contains(path, 105) THEN 105 WHEN list_contains(path, 2) THEN 2 ELSE 0 END::BIGINT AS parent FROM paths")
def _child(spark, sf_dir):
    return H.child_to_parent(_paths(spark, sf_dir), [0, 2, 105])


@register("label_points", f"{_V}, a AS (SELECT x, y, z, max(v) AS id FROM vox GROUP BY ALL), {fx.POINTS_SQL} SELECT p.x, p.y, p.z, CAST(coalesce(a.id, 0) AS BIGINT) AS id FROM points p LEFT JOIN a ON CAST(p.x AS INTEGER) = a.x AND CAST(p.y AS INTEGER) = a.y AND CAST(p.z AS INTEGER) = a.z")
def _label_points(spark, sf_dir):
    atlas = fx.vox(spark, sf_dir).groupBy("x", "y", "z").agg(F.max("v").alias("id"))
    return H.label_points(fx.points(spark, sf_dir).select("x", "y", "z"), atlas)


@register("volume_map", f"{_V} SELECT v AS id, CAST(x % 2 * 255 AS INTEGER) AS hemisphere, round(count(*) * 0.03125::DOUBLE, 6) AS volume FROM vox GROUP BY ALL")
def _volume(spark, sf_dir):
    atlas = fx.vox(spark, sf_dir).select("x", "y", "z", F.col("v").alias("id"), (F.col("x") % 2 * 255).cast("int").alias("hemisphere"))
    return H.volume_map(atlas, (0.25, 0.25, 0.5), ("id", "hemisphere")).withColumn("volume", F.round("volume", 6))


@register("all_structures", "SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS id FROM lineitem UNION SELECT CAST(s_suppkey AS BIGINT) FROM supplier")
def _all(spark, sf_dir):
    return H.all_structures([fx.cells(spark, sf_dir), fx.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"))])


@register("enrich_names", f"{_TREE}, {fx.CELLS_SQL} SELECT c.id, c.size, t.name FROM cells c LEFT JOIN tree t ON c.id = t.id")
def _enrich(spark, sf_dir):
    return H.enrich(fx.cells(spark, sf_dir).select("id", "size"), fx.hierarchy(spark, sf_dir))
