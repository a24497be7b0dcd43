"""Property graphs as two tables: vertices (vid, ...) and edges (src, dst, ...), undirected, parallel edges allowed.

Iterative operators (components, chains, tracing) move narrow key rows and write each round to
the shared folder; everything else is a fixed number of equi-joins with partial aggregation, so hubs are
pre-aggregated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.plans.scratch import Scratch

COORDINATES = ("x", "y", "z")


@dataclass
class Graph:
    """A lazy graph; every method gives a new one or a table."""

    vertices: DataFrame
    edges: DataFrame

    # construction and storage
    def save(self, path: str) -> None:
        self.vertices.write.parquet(f"{path}/vertices")
        self.edges.write.parquet(f"{path}/edges")

    @staticmethod
    def load(spark, path: str) -> Graph:
        return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))

    def copy(self) -> Graph:
        return Graph(self.vertices, self.edges)

    def info(self) -> DataFrame:
        return self.vertices.agg(F.count("*").alias("vertices")).crossJoin(self.edges.agg(F.count("*").alias("edges")))  # two one-row tables

    def add_vertices(self, vertices: DataFrame) -> Graph:
        return Graph(self.vertices.unionByName(vertices, allowMissingColumns=True), self.edges)

    def remove_vertices(self, ids: DataFrame) -> Graph:
        gone = ids.select("vid")
        e = self.edges
        for end in ("src", "dst"):
            e = e.join(gone.withColumnRenamed("vid", end), end, "left_anti")
        return Graph(self.vertices.join(gone, "vid", "left_anti"), e)

    def add_edges(self, edges: DataFrame) -> Graph:
        return Graph(self.vertices, self.edges.unionByName(edges, allowMissingColumns=True))

    def remove_edges(self, pairs: DataFrame) -> Graph:
        return Graph(self.vertices, self.edges.join(pairs.select("src", "dst"), ["src", "dst"], "left_anti"))

    def define_vertex_property(self, name: str, value: Column) -> Graph:
        return Graph(self.vertices.withColumn(name, value), self.edges)

    def define_edge_property(self, name: str, value: Column) -> Graph:
        return Graph(self.vertices, self.edges.withColumn(name, value))

    def remove_property(self, vertex: str | None = None, edge: str | None = None) -> Graph:
        return Graph(self.vertices.drop(vertex) if vertex else self.vertices, self.edges.drop(edge) if edge else self.edges)

    # adjacency
    def ends(self) -> DataFrame:
        """One row per edge end: vid and the edge's columns."""
        return self.edges.select(F.col("src").alias("vid"), "*").unionByName(self.edges.select(F.col("dst").alias("vid"), "*"))

    def neighbours(self) -> DataFrame:
        """vid, other: both directions of every edge."""
        e = self.edges
        return e.select(F.col("src").alias("vid"), F.col("dst").alias("other")).unionByName(e.select(F.col("dst").alias("vid"), F.col("src").alias("other")))

    def vertex_neighbours(self, vid: int) -> DataFrame:
        return self.neighbours().filter(F.col("vid") == vid).select("other").distinct()

    def vertex_degrees(self) -> DataFrame:
        """vid, degree; a loop counts twice, isolated vertices have 0."""
        d = self.ends().groupBy("vid").agg(F.count("*").alias("degree"))
        return self.vertices.select("vid").join(d, "vid", "left").fillna(0, ["degree"])

    def edge_connectivity(self) -> DataFrame:
        return self.edges.select("src", "dst")

    # sub-graphs
    def sub_graph(self, vertex_filter: Column | None = None, edge_filter: Column | None = None) -> Graph:
        """Vertices and edges that pass; an edge needs both its vertices."""
        v = self.vertices if vertex_filter is None else self.vertices.filter(vertex_filter)
        e = self.edges if edge_filter is None else self.edges.filter(edge_filter)
        if vertex_filter is not None:
            for end in ("src", "dst"):
                e = e.join(v.select(F.col("vid").alias(end)), end, "left_semi")
        return Graph(v, e)

    def sub_slice(self, bounds: dict[str, tuple[float, float] | float]) -> Graph:
        """Vertices in a half-open box; a number means equality."""
        return self.sub_graph(self.box_filter(bounds))

    @staticmethod
    def box_filter(bounds: dict[str, tuple[float, float] | float]) -> Column:
        keep = F.lit(True)
        for a, b in bounds.items():
            keep = keep & ((F.col(a) >= b[0]) & (F.col(a) < b[1]) if isinstance(b, tuple) else F.col(a) == b)
        return keep

    def renumbered(self) -> Graph:
        """Vertex ids 0..n-1 in the order of the old ids, with an equi-join for each end. Numbers come from a range sort: one count per partition, no single task."""
        new = _numbered(self.vertices.select("vid"), Scratch(self.vertices.sparkSession, "renumbered"), "new")
        e = self.edges
        for end in ("src", "dst"):
            e = e.join(new.select(F.col("vid").alias(end), F.col("new").alias(f"_{end}")), end).drop(end).withColumnRenamed(f"_{end}", end)
        return Graph(self.vertices.join(new, "vid").drop("vid").withColumnRenamed("new", "vid"), e)

    def remove_self_loops(self) -> Graph:
        return Graph(self.vertices, self.edges.filter("src <> dst"))

    def remove_isolated_vertices(self) -> Graph:
        used = self.ends().select("vid").distinct()
        return Graph(self.vertices.join(used, "vid", "left_semi"), self.edges)

    def remove_isolated_edges(self) -> Graph:
        """Edges whose both ends have degree 1 go, then vertices without edges."""
        one = self.vertex_degrees().filter("degree = 1").select("vid")
        e = self.edges
        for end in ("src", "dst"):
            e = e.join(one.select(F.col("vid").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
        e = e.filter("_src is null or _dst is null").drop("_src", "_dst")
        return Graph(self.vertices, e).remove_isolated_vertices()

    # components
    def label_components(self) -> DataFrame:
        """vid, component (the smallest vid in it)."""
        scratch = Scratch(self.edges.sparkSession, "graph")
        found = connected_components(self.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), scratch)
        return self.vertices.select("vid").join(found.withColumnRenamed("node", "vid"), "vid", "left").withColumn("component", F.coalesce("component", "vid"))

    def component_sizes(self) -> DataFrame:
        return self.label_components().groupBy("component").agg(F.count("*").alias("size"))

    def largest_component(self) -> Graph:
        """The component with most vertices; on ties the one with the smallest vid."""
        labels = self.label_components()
        top = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
        inside = labels.join(F.broadcast(top), "component", "left_semi").select("vid")
        return Graph(self.vertices.join(inside, "vid", "left_semi"), self.edges.join(inside.withColumnRenamed("vid", "src"), "src", "left_semi"))

    # labels
    def edge_label(self, label: str, end: str = "src") -> DataFrame:
        """src, dst and the vertex label at one end."""
        return self.edges.select("src", "dst").join(self.vertices.select(F.col("vid").alias(end), label), end)

    def edge_to_vertex(self, label: str, function: Callable = F.max) -> DataFrame:
        """vid and an aggregate of its edges' labels; null for isolated vertices."""
        return self.vertices.select("vid").join(self.ends().groupBy("vid").agg(function(label).alias(label)), "vid", "left")

    def vertex_to_edge(self, label: str, combine: Callable[[Column, Column], Column] | None = None) -> DataFrame:
        """src, dst and the mean of the ends' labels (booleans: both)."""
        kind = self.vertices.schema[label].dataType.simpleString()
        f = combine or ((lambda a, b: a & b) if kind == "boolean" else (lambda a, b: (a + b) / 2))
        at = lambda end: self.vertices.select(F.col("vid").alias(end), F.col(label).alias(f"_{end}"))
        return self.edges.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", f(F.col("_src"), F.col("_dst")).alias(label))

    def vertex_propagate(self, label: str, value, steps: int = 1) -> DataFrame:
        """vid, label: neighbours of vertices with the value take it, ``steps`` times."""
        at = self.vertices.select("vid", label)
        pairs = self.neighbours()
        for _ in range(steps):
            hit = pairs.join(at.filter(F.col(label) == value).select(F.col("vid").alias("other")), "other", "left_semi").select("vid").distinct().withColumn("_hit", F.lit(True))
            at = at.join(hit, "vid", "left").withColumn(label, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(label))).drop("_hit")
        return at

    def vertex_dilate(self, label: str, steps: int = 1) -> DataFrame:
        return self.vertex_propagate(label, True, steps)

    def vertex_erode(self, label: str, steps: int = 1) -> DataFrame:
        return self.vertex_propagate(label, False, steps)

    def _with(self, at: DataFrame, label: str) -> Graph:
        return Graph(self.vertices.drop(label).join(at, "vid"), self.edges)

    def vertex_open(self, label: str, steps: int = 1) -> DataFrame:
        return self._with(self.vertex_erode(label, steps), label).vertex_dilate(label, steps)

    def vertex_close(self, label: str, steps: int = 1) -> DataFrame:
        return self._with(self.vertex_dilate(label, steps), label).vertex_erode(label, steps)

    def _numbered_edges(self, scratch: Scratch) -> DataFrame:
        """Edges with a number ``eid``; written, so that the numbers stay."""
        return scratch.save(self.edges.drop("eid").withColumn("eid", F.monotonically_increasing_id()), "edges")

    def edge_graph(self) -> Graph:
        """The line graph: a vertex per edge (vid: a number of its own, so parallel edges stay apart), joined where edges share a vertex.

        A hub of degree d would give d^2 / 2 pairs; each vertex's edges are joined to the first of them only (a
        star), which has the same components and the same reach through the vertex in two steps.
        """
        e = self._numbered_edges(Scratch(self.edges.sparkSession, "edge-graph"))
        ends = e.select(F.col("src").alias("vid"), "eid").unionByName(e.select(F.col("dst").alias("vid"), "eid")).distinct()
        first = ends.groupBy("vid").agg(F.min("eid").alias("hub"))
        links = ends.join(first, "vid").filter("eid <> hub").select(F.col("hub").alias("src"), F.col("eid").alias("dst")).distinct()
        return Graph(e.withColumnRenamed("eid", "vid"), links)

    def edge_propagate(self, label: str, value, steps: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
        """src, dst, the columns in ``keep``, label, a row for each edge: edges that share a vertex with an edge of the value take it, ``steps`` times; through vertices, so hubs don't square."""
        at = self.edges.select("src", "dst", *keep, label)
        for _ in range(steps):
            on = at.filter(F.col(label) == value)
            hit = on.select(F.col("src").alias("vid")).union(on.select("dst")).distinct()
            for end in ("src", "dst"):
                at = at.join(hit.select(F.col("vid").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
            at = at.select("src", "dst", *keep, F.when(F.col("_src") | F.col("_dst"), F.lit(value)).otherwise(F.col(label)).alias(label))
        return at

    def edge_dilate(self, label: str, steps: int = 1) -> DataFrame:
        return self.edge_propagate(label, True, steps)

    def edge_erode(self, label: str, steps: int = 1) -> DataFrame:
        return self.edge_propagate(label, False, steps)

    def edge_open(self, label: str, steps: int = 1) -> DataFrame:
        return Graph(self.vertices, self.edge_erode(label, steps)).edge_dilate(label, steps)

    def edge_close(self, label: str, steps: int = 1) -> DataFrame:
        return Graph(self.vertices, self.edge_dilate(label, steps)).edge_erode(label, steps)

    def trace_vertices(self, label: str, condition: Column, max_iterations: int | None = None) -> DataFrame:
        """vid, label: grows from labelled vertices over neighbours that meet the condition; each vertex is tested once."""
        scratch = Scratch(self.edges.sparkSession, "trace")
        good = scratch.save(self.vertices.filter(condition).select("vid"), "good")
        pairs = scratch.save(self.neighbours().join(good, "vid", "left_semi").distinct(), "pairs")
        reached = scratch.save(self.vertices.filter(F.col(label)).select("vid"), "start")
        front, i = reached, 0
        while max_iterations is None or i < max_iterations:
            new = pairs.join(front.select(F.col("vid").alias("other")), "other", "left_semi").select("vid").distinct().join(reached, "vid", "left_anti")
            front = scratch.save(new, f"front-{i}")
            if not front.take(1):
                break
            reached = scratch.save(reached.unionByName(front), f"reached-{i}")
            i += 1
        return self.vertices.select("vid").join(reached.withColumn(label, F.lit(True)), "vid", "left").fillna(False, [label])

    def trace_edges(self, label: str, condition: Column, max_iterations: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """src, dst, the columns in ``keep``, label, a row for each edge: the same over edges that share a vertex. Edges are known by a number of their own, so parallel ones are
        tested apart. A round writes the edges that it reaches and nothing else."""
        scratch = Scratch(self.edges.sparkSession, "trace")
        e = self._numbered_edges(scratch).withColumn("_on", F.coalesce(F.col(label), F.lit(False)))
        ends = lambda df: df.select(F.col("src").alias("vid")).union(df.select("dst")).distinct()
        pool = e.filter(condition & ~F.col("_on")).select("eid", "src", "dst")
        front, i = scratch.save(ends(e.filter("_on")), "front"), 0
        while (max_iterations is None or i < max_iterations) and front.take(1):
            # an edge of the pool is reached once, since the pool shrinks
            at = lambda end: front.select(F.col("vid").alias(end), F.lit(True).alias(f"_{end}"))  # noqa: E731, B023
            met = scratch.save(pool.join(at("src"), "src", "left").join(at("dst"), "dst", "left").select("eid", "src", "dst", (F.coalesce("_src", F.lit(False)) | F.coalesce("_dst", F.lit(False))).alias("hit")), f"met-{i}", by="hit")
            pool = met.filter("not hit").select("eid", "src", "dst")
            new = met.filter("hit").select("eid", "src", "dst")
            front = scratch.save(ends(new), f"front-{i}")
            hits = new.select("eid") if i == 0 else hits.unionByName(new.select("eid"))
            i += 1
        if not i:
            return e.select("src", "dst", *keep, F.col("_on").alias(label))
        return e.join(hits.withColumn("_hit", F.lit(True)), "eid", "left").select("src", "dst", *keep, (F.col("_on") | F.coalesce("_hit", F.lit(False))).alias(label))

    # geometry
    def edge_vectors(self, normalize: bool = False) -> DataFrame:
        """src, dst, vx, vy, vz: source minus target coordinates; unit length if asked (0 stays 0)."""
        at = lambda end, p: self.vertices.select(F.col("vid").alias(end), *[F.col(c).alias(f"{p}{c}") for c in COORDINATES])
        v = self.edges.select("src", "dst").join(at("src", "a"), "src").join(at("dst", "b"), "dst")
        d = [F.col(f"a{c}") - F.col(f"b{c}") for c in COORDINATES]
        if normalize:
            n = F.sqrt(sum((x * x for x in d), F.lit(0.0)))
            d = [F.when(n > 0, x / n).otherwise(x) for x in d]
        return v.select("src", "dst", *[x.alias(f"v{c}") for x, c in zip(d, COORDINATES)])

    def geometry_lengths(self) -> DataFrame:
        return self.edges.select("src", "dst", F.size("geometry").alias("n"))

    def flat_geometry(self) -> DataFrame:
        """src, dst, pos and one row per polyline point."""
        return self.edges.select("src", "dst", F.posexplode("geometry").alias("pos", "point")).select("src", "dst", "pos", "point.*")

    def geometry_consistent(self) -> DataFrame:
        """Edges whose polyline does not run from the source's to the target's coordinates."""
        at = lambda end: self.vertices.select(F.col("vid").alias(end), F.struct(*COORDINATES).alias(f"_{end}"))
        e = self.edges.join(at("src"), "src").join(at("dst"), "dst")
        same = lambda p, q: sum((F.abs(p[c] - q[c]) for c in COORDINATES), F.lit(0.0)) == 0
        return e.filter(~(same(F.element_at("geometry", 1), F.col("_src")) & same(F.element_at("geometry", -1), F.col("_dst")))).select("src", "dst")

    def expand_length(self, length: str = "length", step: float = 1.0) -> DataFrame:
        """src, dst, part, length: each edge cut into ceil(length / step) equal parts."""
        n = F.greatest(F.ceil(F.col(length) / step), F.lit(1)).cast("int")
        return self.edges.select("src", "dst", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"), (F.col(length) / n).alias("length"))

    def expand_vertex_filter(self, label: str, steps: int = 1) -> DataFrame:
        """vid of vertices with a true label, and of those within ``steps`` edges of one."""
        return self.vertex_dilate(label, steps).filter(F.col(label)).select("vid")

    def transform_properties(self, matrix, offset) -> Graph:
        """Coordinates of vertices, and of edge polylines, moved by an affine map."""
        move = lambda get: [sum((float(matrix[i][j]) * get(c) for j, c in enumerate(COORDINATES)), F.lit(float(offset[i]))) for i in range(3)]
        v = self.vertices.withColumns(dict(zip(COORDINATES, move(F.col))))
        e = self.edges
        if "geometry" in e.columns:
            e = e.withColumn("geometry", F.transform("geometry", lambda p: p.withField("x", move(lambda c: p[c])[0]).withField("y", move(lambda c: p[c])[1]).withField("z", move(lambda c: p[c])[2])))
        return Graph(v, e)

    def scale(self, factors) -> Graph:
        return self.transform_properties([[factors[i] if i == j else 0.0 for j in range(3)] for i in range(3)], (0.0, 0.0, 0.0))

    def sample_vertices(self, vox: DataFrame, name: str, default=None) -> Graph:
        """Vertices with ``name``: the value of the voxel (x, y, z, v) they lie in; ``default`` outside.

        If both have a vol_id, a vertex looks into its own volume. Vertices without one belong to the only volume: a place that several volumes
        hold is an error then.
        """
        at = vox.withColumnsRenamed({c: f"_{c}" for c in COORDINATES}).withColumns({f"_{c}": F.col(f"_{c}").cast("int") for c in COORDINATES})
        places = [f"_{c}" for c in COORDINATES]
        if "vol_id" in vox.columns and "vol_id" in self.vertices.columns:
            places.append("vol_id")
        elif "vol_id" in vox.columns:
            one = F.when(F.min("vol_id") == F.max("vol_id"), F.first("v")).otherwise(F.raise_error(F.lit("voxels of several volumes, and vertices without vol_id")))
            at = at.groupBy(*places).agg(one.alias("v"))
        v = self.vertices.drop(name).withColumns({f"_{c}": F.round(c).cast("int") for c in COORDINATES}).join(at.select(*places, F.col("v").alias(name)), places, "left").drop(*[f"_{c}" for c in COORDINATES])
        return Graph(v if default is None else v.fillna({name: default}), self.edges)

    def edge_mean_of_vertices(self, name: str, to: str) -> Graph:
        """Edges with ``to``: the mean of their ends' values."""
        at = lambda end: self.vertices.select(F.col("vid").alias(end), F.col(name).cast("double").alias(f"_{end}"))
        e = self.edges.drop(to).join(at("src"), "src").join(at("dst"), "dst").withColumn(to, (F.col("_src") + F.col("_dst")) / 2).drop("_src", "_dst")
        return Graph(self.vertices, e)

    def small_components(self, least_edges: int) -> DataFrame:
        """vid of vertices whose component has fewer than ``least_edges`` edges."""
        labels = self.label_components()
        sizes = self.edges.join(labels.select(F.col("vid").alias("src"), "component"), "src").groupBy("component").agg(F.count("*").alias("n"))
        big = sizes.filter(F.col("n") >= least_edges).select("component")
        return labels.join(big, "component", "left_anti").select("vid")

    def structure_sub_graph(self, structures: DataFrame, annotation: str = "annotation") -> Graph:
        """The part of the graph whose vertices are annotated with one of the structures (id), for example all descendants of one."""
        inside = self.vertices.join(structures.select(F.col("id").alias(annotation)).distinct(), annotation, "left_semi")
        e = self.edges
        for end in ("src", "dst"):
            e = e.join(inside.select(F.col("vid").alias(end)), end, "left_semi")
        return Graph(inside, e)

    def expand(self, length: str = "length", step: float = 1.0) -> Graph:
        """Every edge as a chain of ceil(length / step) equal edges over new vertices (negative vids), on the straight line between its ends."""
        scratch = Scratch(self.edges.sparkSession, "expand")
        e = self._numbered_edges(scratch).withColumn("_n", F.greatest(F.ceil(F.col(length) / step), F.lit(1)).cast("int"))
        most = F.lit(int(e.agg(F.max("_n")).first()[0] or 1))
        vid = lambda i: -(F.col("eid") * most + i) - 1
        at = lambda end: self.vertices.select(F.col("vid").alias(end), *[F.col(c).alias(f"_{end}_{c}") for c in COORDINATES])
        inner = e.filter("_n > 1").join(at("src"), "src").join(at("dst"), "dst").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n") - 1)))
        new = inner.select(vid(F.col("_i")).alias("vid"), *[(F.col(f"_src_{c}") + (F.col(f"_dst_{c}") - F.col(f"_src_{c}")) * F.col("_i") / F.col("_n")).alias(c) for c in COORDINATES])
        parts = e.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
        a, b = F.when(F.col("_i") == 1, F.col("src")).otherwise(vid(F.col("_i") - 1)), F.when(F.col("_i") == F.col("_n"), F.col("dst")).otherwise(vid(F.col("_i")))
        rest = [c for c in self.edges.columns if c not in ("src", "dst", "eid", length)]
        return Graph(self.vertices.unionByName(new, allowMissingColumns=True), parts.select(a.alias("src"), b.alias("dst"), (F.col(length) / F.col("_n")).alias(length), *rest))

    # cleaning and reduction
    def clean(self, coordinates: tuple[str, ...] = COORDINATES, radius: str = "radius") -> Graph:
        """Connected groups of vertices of degree >= 3 become one vertex (mean coordinates, largest radius, smallest vid);
        then loops, parallel edges and isolated vertices go."""
        branch = self.vertex_degrees().filter("degree >= 3").select("vid")
        inner = self.edges
        for end in ("src", "dst"):
            inner = inner.join(branch.withColumnRenamed("vid", end), end, "left_semi")
        scratch = Scratch(self.edges.sparkSession, "clean")
        groups = connected_components(inner.select(F.col("src").alias("a"), F.col("dst").alias("b")), scratch)
        groups = scratch.save(groups.select(F.col("node").alias("vid"), F.col("component").alias("to")), "groups")
        v = self.vertices.join(groups, "vid", "left").withColumn("vid", F.coalesce("to", "vid"))
        rest = [c for c in self.vertices.columns if c not in ("vid", radius, *coordinates)]
        v = v.groupBy("vid").agg(*[F.avg(c).alias(c) for c in coordinates], F.max(radius).alias(radius), *[F.first(c).alias(c) for c in rest])
        e = self.edges
        for end in ("src", "dst"):
            e = e.join(groups.select(F.col("vid").alias(end), F.col("to").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        e = e.filter("src <> dst").withColumn("_a", F.least("src", "dst")).withColumn("_b", F.greatest("src", "dst")).drop("src", "dst").withColumnsRenamed({"_a": "src", "_b": "dst"})
        props = [c for c in e.columns if c not in ("src", "dst")]
        return Graph(v, e.groupBy("src", "dst").agg(*[F.max(c).alias(c) for c in props])).remove_isolated_vertices()

    def reduce(self, length: str = "length", radius: str = "radius") -> Graph:
        """Chains of degree-2 vertices between other vertices become one edge: summed length, largest radius, and the number of edges.

        Edges of one chain are the components of "share a degree-2 vertex". A ring of
        degree-2 vertices is kept as one loop at its smallest vertex.
        """
        scratch = Scratch(self.edges.sparkSession, "reduce")
        degree = scratch.save(self.vertex_degrees(), "degree")
        e = self._numbered_edges(scratch)
        ends = e.select(F.col("src").alias("vid"), "eid").unionByName(e.select(F.col("dst").alias("vid"), "eid"))
        pass_through = ends.join(degree.filter("degree = 2").select("vid"), "vid", "left_semi")
        links = pass_through.groupBy("vid").agg(F.min("eid").alias("a"), F.max("eid").alias("b"))
        chains = connected_components(links.select("a", "b"), scratch).select(F.col("node").alias("eid"), F.col("component").alias("chain"))
        chained = e.join(chains, "eid", "left").withColumn("chain", F.coalesce("chain", "eid"))
        sums = chained.groupBy("chain").agg(F.sum(length).alias(length), F.max(radius).alias(radius), F.count("*").alias("n_edges"), F.least(F.min("src"), F.min("dst")).alias("_ring"))
        tips = chained.select("chain", F.col("src").alias("vid")).unionByName(chained.select("chain", F.col("dst").alias("vid"))).join(degree.filter("degree <> 2").select("vid"), "vid", "left_semi")
        tips = tips.groupBy("chain").agg(F.min("vid").alias("src"), F.max("vid").alias("dst"))
        edges = sums.join(tips, "chain", "left").select(F.coalesce("src", "_ring").alias("src"), F.coalesce("dst", "_ring").alias("dst"), length, radius, "n_edges")
        used = edges.select(F.col("src").alias("vid")).union(edges.select("dst")).distinct()
        return Graph(self.vertices.join(used, "vid", "left_semi"), edges)


def _numbered(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows with ``name``: 0..n-1 in their order. One range sort, written, so that the numbers stay."""
    at = rows.repartitionByRange(*rows.columns).sortWithinPartitions(*rows.columns).withColumn("_id", F.monotonically_increasing_id())
    ids = scratch.save(at.select(*rows.columns, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_row")), "ids")
    counts = ids.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each partition
    begin = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_begin"))
    return ids.join(F.broadcast(begin), "_part").select(*rows.columns, (F.col("_begin") + F.col("_row")).alias(name))


#: Largest coordinate, and largest extent along y and z, of which a place and its neighbours are packed in 21 bits an axis.
PACKED = (1 << 21) - 3


def _packs(voxels: DataFrame) -> bool:
    """Whether packed places can neither overflow nor be equal."""
    bounds = voxels.agg(*[f(F.col(c).cast("long")) for c in COORDINATES for f in (F.min, F.max)]).first()
    ends = [(bounds[i], bounds[i + 1]) for i in (0, 2, 4) if bounds[i] is not None]
    return all(max(abs(lo), abs(hi)) <= PACKED for lo, hi in ends) and all(hi - lo <= PACKED for lo, hi in ends[1:])


def graph_from_skeleton(vox: DataFrame) -> Graph:
    """Vertices: foreground voxels. Edges: the 13 orientations of the 26-neighbourhood, each an equi-join on exact
    positions, as one exploded join. Without a column vol_id there is one volume, and vid is the position packed in 21 bits an axis, or where a position does not
    fit in them (bounds are looked up first) the number of the voxel in the order of positions; with it volumes stay apart, vertices carry vol_id, and vid is a number."""
    half = [(dx, dy, dz) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) if (dx, dy, dz) > (0, 0, 0)]
    offsets = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz")) for a, b, c in half])
    if "vol_id" in vox.columns:
        at = ["vol_id", *COORDINATES]
        v = vox.filter("v > 0").select("vol_id", *[F.col(c).cast("int").alias(c) for c in COORDINATES]).distinct().withColumn("vid", F.monotonically_increasing_id())
        v = Scratch(vox.sparkSession, "skeleton").save(v, "voxels")
        near = v.select(F.col("vid").alias("src"), *at, F.explode(offsets).alias("o")).select("src", "vol_id", *[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in COORDINATES])
        return Graph(v.select("vid", *at), near.join(v.withColumnRenamed("vid", "dst"), at).select("src", "dst"))
    if not _packs(vox.filter("v > 0")):
        v = vox.filter("v > 0").select(*[F.col(c).cast("int").alias(c) for c in COORDINATES]).distinct()
        scratch = Scratch(vox.sparkSession, "skeleton")
        v = scratch.save(_numbered(v, scratch, "vid"), "voxels")
        near = v.select(F.col("vid").alias("src"), *COORDINATES, F.explode(offsets).alias("o")).select("src", *[(F.col(c).cast("long") + F.col(f"o.d{c}")).alias(c) for c in COORDINATES])
        return Graph(v.select("vid", *COORDINATES), near.join(v.withColumnRenamed("vid", "dst").hint("merge"), list(COORDINATES)).select("src", "dst"))
    pack = lambda x, y, z: (x.cast("long") * (1 << 42)) + (y.cast("long") * (1 << 21)) + z.cast("long")
    v = vox.filter("v > 0").select(pack(F.col("x"), F.col("y"), F.col("z")).alias("vid"), "x", "y", "z")
    near = v.select(F.col("vid").alias("src"), "x", "y", "z", F.explode(offsets).alias("o")).select("src", pack(F.col("x") + F.col("o.dx"), F.col("y") + F.col("o.dy"), F.col("z") + F.col("o.dz")).alias("dst"))
    return Graph(v, near.join(v.select(F.col("vid").alias("dst")).hint("merge"), "dst", "left_semi").select("src", "dst"))


def graph_to_skeleton(graph: Graph) -> DataFrame:
    """x, y, z, v of the vertices, and of the polyline points where edges have a geometry."""
    out = graph.vertices.select(*[F.col(c).cast("int").alias(c) for c in COORDINATES])
    if "geometry" in graph.edges.columns:
        out = out.unionByName(graph.flat_geometry().select(*[F.col(c).cast("int").alias(c) for c in COORDINATES]))
    return out.distinct().withColumn("v", F.lit(1))


def group_labels(df: DataFrame, label: str, row: str) -> DataFrame:
    """label, rows in order."""
    return df.groupBy(label).agg(F.array_sort(F.collect_list(row)).alias("rows"))


def index_neighbours(rows: DataFrame, offset: int) -> DataFrame:
    """i, j of all pairs with idx[j] = idx[i] + offset."""
    return rows.select((F.col("idx") + offset).alias("_k"), F.col("idx").alias("i")).join(rows.select(F.col("idx").alias("_k"), F.col("idx").alias("j")), "_k").select("i", "j")


def greedy_coloring(graph: Graph) -> DataFrame:
    """vid, color: the first free color in the order of vertex ids. Order-dependent, so it runs by rounds: in each round the vertices
    that are smaller than all their uncolored neighbours take a color."""
    scratch = Scratch(graph.edges.sparkSession, "coloring")
    pairs = scratch.save(graph.neighbours().filter("vid <> other").distinct(), "pairs")
    done = scratch.save(graph.vertices.select("vid", F.lit(None).cast("int").alias("color")).limit(0), "done-0")
    left = scratch.save(graph.vertices.select("vid"), "left-0")
    i = 0
    while left.take(1):
        i += 1
        open_pairs = pairs.join(left, "vid", "left_semi").join(left.withColumnRenamed("vid", "other"), "other", "left_semi")
        blocked = open_pairs.filter("other < vid").select("vid").distinct()
        now = left.join(blocked, "vid", "left_anti")
        used = pairs.join(now, "vid", "left_semi").join(done.withColumnRenamed("vid", "other"), "other").groupBy("vid").agg(F.collect_set("color").alias("used"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), "used"))
        new = now.join(used, "vid", "left").select("vid", F.when(F.col("used").isNull(), 0).otherwise(free).cast("int").alias("color"))
        done = scratch.save(done.unionByName(new), f"done-{i}")
        left = scratch.save(left.join(done, "vid", "left_anti"), f"left-{i}")
    return done
