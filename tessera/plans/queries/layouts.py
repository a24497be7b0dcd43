"""Layout queries: embeddings as tiles in a row, each over half of the next one; group reports over cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import alignment as A
from tessera.operators import spatial as P
from tessera.plans import fixtures as fx
from tessera.plans import group_reports as R
from tessera.registry import register

_TILES = f"{fx.VOX_SQL}, tiles AS (SELECT DISTINCT vol_id AS tile, vol_id * 2 AS lox, 0 AS loy, 0 AS loz, vol_id * 2 + 4 AS hix, 4 AS hiy, 4 AS hiz FROM vox)"
_ERRORS = f"""WITH {_TILES}, a AS (SELECT vol_id AS pre, vol_id + 1 AS post, x - 2 AS p, y AS q, z AS s, v FROM vox WHERE x >= 2), b AS (SELECT vol_id - 1 AS pre, vol_id AS post, x AS p, y AS q, z AS s, v FROM vox WHERE x < 2),
errors AS (SELECT a.pre, a.post, a.s, i AS dx, j AS dy, 0 AS dz, avg(CAST((a.v - b.v) * (a.v - b.v) AS DOUBLE)) AS error, count(*) AS n
  FROM a JOIN b ON a.pre = b.pre AND a.post = b.post AND a.s = b.s, (VALUES (-1), (0), (1)) t(i), (VALUES (-1), (0), (1)) u(j) WHERE a.p = b.p + i AND a.q = b.q + j GROUP BY ALL)"""


def _tiles(spark, sf_dir):
    t = fx.vox(spark, sf_dir).select(F.col("vol_id").alias("tile")).distinct()
    return t.select("tile", (F.col("tile") * 2).alias("lox"), F.lit(0).alias("loy"), F.lit(0).alias("loz"), (F.col("tile") * 2 + 4).alias("hix"), F.lit(4).alias("hiy"), F.lit(4).alias("hiz"))


def _voxels(spark, sf_dir):
    return fx.vox(spark, sf_dir).withColumnRenamed("vol_id", "tile")


def _errors(spark, sf_dir):
    t = _tiles(spark, sf_dir)
    return A.slice_errors(t, _voxels(spark, sf_dir), P.overlaps(t, 8), "z", 1)


@register("layout_slice_errors", f"{_ERRORS} SELECT pre, post, s, dx, dy, dz, round(error, 6) AS error, n FROM errors")
def _slice_errors(spark, sf_dir):
    return _errors(spark, sf_dir).withColumn("error", F.round("error", 6))


@register("layout_align_slices", f"""{_ERRORS}, r AS (SELECT *, row_number() OVER (PARTITION BY pre, post, s ORDER BY error, dx * dx + dy * dy, dx, dy) AS k FROM errors WHERE n >= 4)
SELECT pre, post, s, dx, dy, dz, round(-error, 6) AS quality FROM r WHERE k = 1""")
def _align_slices(spark, sf_dir):
    return A.align_slices(_errors(spark, sf_dir), 4).withColumn("quality", F.round("quality", 6))


@register("layout_sort_by_position", f"WITH {_TILES} SELECT tile, CAST(row_number() OVER (ORDER BY lox, loy, loz, tile) AS INTEGER) AS rank FROM tiles")
def _sort(spark, sf_dir):
    return A.sort_by_position(_tiles(spark, sf_dir)).select("tile", "rank")


@register("layout_center_tile", f"WITH {_TILES}, m AS (SELECT (min(lox) + max(hix)) / 2.0 AS mx FROM tiles) SELECT tile FROM tiles, m ORDER BY abs((lox + hix) / 2.0 - mx), tile LIMIT 1")
def _center(spark, sf_dir):
    return A.center_tile(_tiles(spark, sf_dir))


@register("layout_slices", f"WITH {_TILES} SELECT tile, CAST(k AS BIGINT) AS slab, greatest(lox, k * 3) AS lox, least(hix, k * 3 + 3) AS hix FROM (SELECT *, unnest(range(lox // 3, (hix - 1) // 3 + 1)) AS k FROM tiles)")
def _slices(spark, sf_dir):
    return A.slice_layout(_tiles(spark, sf_dir), "x", 3).select("tile", "slab", "lox", "hix")


@register("layout_alignments_from_positions", f"WITH {_TILES} SELECT a.tile AS pre, b.tile AS post, CAST(b.tile % 5 - a.tile % 5 AS DOUBLE) AS dx, CAST(0 AS DOUBLE) AS dy, CAST(b.tile % 2 - a.tile % 2 AS DOUBLE) AS dz FROM tiles a JOIN tiles b ON b.tile = a.tile + 1")
def _from_positions(spark, sf_dir):
    t = _tiles(spark, sf_dir)
    at = t.select("tile", (F.col("lox") + F.col("tile") % 5).cast("double").alias("x"), F.lit(0.0).alias("y"), (F.col("tile") % 2).cast("double").alias("z"))
    return A.alignments_from_positions(t, at, P.overlaps(t, 8))


@register("layout_align_mip")
def _mip(spark, sf_dir):
    t = _tiles(spark, sf_dir)
    return A.align_layout(t, _voxels(spark, sf_dir), 8, 1)


@register("layout_place", f"WITH {_TILES} SELECT tile, round(CAST(lox + tile % 3 - (SELECT min(lox + tile % 3) FROM tiles) AS DOUBLE), 3) AS x FROM tiles")
def _place(spark, sf_dir):
    t = _tiles(spark, sf_dir)
    p = P.overlaps(t, 8).select("pre", "post", ((F.col("post") % 3) - (F.col("pre") % 3)).cast("double").alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"), F.lit(1.0).alias("quality"))
    return A.place_layout(t, p).select("tile", F.round("x", 3).alias("x"))


_SUMMARY = f"""WITH {fx.CELLS_SQL}, k AS (SELECT id, hemisphere, sample, count(*) AS n FROM cells WHERE hemisphere IN (0, 255) GROUP BY ALL),
ids AS (SELECT DISTINCT id, h.hemisphere FROM cells, (VALUES (0), (255)) h(hemisphere) WHERE sample <= 6),
w AS (SELECT ids.id, ids.hemisphere, {", ".join(f"CAST(coalesce(sum(n) FILTER (sample = {i}), 0) AS DOUBLE) AS c{i}" for i in range(1, 7))} FROM ids LEFT JOIN k ON ids.id = k.id AND ids.hemisphere = k.hemisphere GROUP BY ALL),
m AS (SELECT *, (c1 + c2 + c3) / 3 AS mean_a, (c4 + c5 + c6) / 3 AS mean_b FROM w)
SELECT id, hemisphere, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(sqrt(((c1 - mean_a) ** 2 + (c2 - mean_a) ** 2 + (c3 - mean_a) ** 2) / 2), 6) AS sd_a, CASE WHEN mean_a < mean_b AND (c1 <> c2 OR c2 <> c3 OR c4 <> c5 OR c5 <> c6) THEN -1 ELSE 1 END AS p_sign
FROM m WHERE mean_a <> 0 AND mean_b <> 0"""


@register("group_summary", _SUMMARY)
def _summary(spark, sf_dir):
    cells = fx.cells(spark, sf_dir)
    volumes = cells.select("id").distinct().select("id", F.explode(F.array(F.lit(0), F.lit(255))).alias("hemisphere"), F.lit(1.0).alias("volume"))
    s = R.summary(cells.filter("sample <= 3"), cells.filter("sample between 4 and 6"), ("a", "b"), volumes)
    return s.select("id", "hemisphere", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "sd_a")], "p_sign")
