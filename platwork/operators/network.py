"""Road network work: shortest paths, nearest nodes, origin-destination totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platwork.session import cut_lineage


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Least total weight from any source to every reachable node of a directed graph.

    edges: src, dst, weight; a negative or missing weight is refused before the first round,
    so the rounds always end. sources: node. Each round relaxes only the
    edges of nodes that improved in the round before, and one aggregate per round folds
    offers into the table of best distances. Rounds are checkpointed, so a lost executor
    costs at most one round. Returns node, distance and predecessor (the smallest id
    among equals).
    """
    if not edges.filter("weight IS NULL OR isnan(weight) OR weight < 0").isEmpty():
        raise ValueError("INVALID_EDGE_WEIGHT: shortest paths need weights of zero or more")
    best = cut_lineage(
        sources.select("node")
        .distinct()
        .selectExpr("node", "0D AS distance", "CAST(NULL AS bigint) AS predecessor", "true AS moved")
    )
    # The edges are dealt out by their start once and stay there for all rounds.
    outgoing = edges.withColumnRenamed("src", "node").repartition("node").persist()
    while True:
        offers = (
            best.filter("moved")
            .join(outgoing, "node")
            .selectExpr("dst AS node", "distance + weight AS distance", "node AS predecessor")
        )
        known = best.selectExpr("node", "distance", "predecessor", "distance AS old")
        best = cut_lineage(
            known.unionByName(offers.withColumn("old", F.lit(None).cast("double")))
            .groupBy("node")
            .agg(F.min(F.struct("distance", "predecessor")).alias("b"), F.min("old").alias("old"))
            .selectExpr(
                "node",
                "b.distance AS distance",
                "b.predecessor AS predecessor",
                "old IS NULL OR b.distance < old AS moved",
            )
        )
        if best.filter("moved").isEmpty():
            outgoing.unpersist()
            return best.drop("moved")


def _box_distances() -> tuple[str, str]:
    """Squared least distance to a bin's occupied box, and the farthest a node can be."""
    gap = {a: f"greatest(lo_{a} - {a}, {a} - hi_{a}, 0D)" for a in "xy"}
    far = {a: f"greatest(abs({a} - lo_{a}), abs({a} - hi_{a}))" for a in "xy"}
    return (
        f"{gap['x']} * {gap['x']} + {gap['y']} * {gap['y']}",
        f"{far['x']} * {far['x']} + {far['y']} * {far['y']}",
    )


def snap_nearest(
    points: DataFrame, nodes: DataFrame, base: float = 4.0, ratio: int = 16
) -> DataFrame:
    """Nearest node of each point (ties: smallest id), exact at any distance.

    Occupied bins of a few nested sizes are summarised by the box of their nodes. Each
    point walks down the sizes and keeps only the bins that can still hold its nearest
    node: those no farther than the least "surely within" distance seen. Only nodes of
    the last bins are compared one by one. points: package_id, point_id, x, y; nodes:
    package_id, node_id, x, y. Sizes are added until the nodes fill a few bins only, so no
    point ever meets more than a handful of the coarsest ones. Points in one place are looked up
    once.
    """
    key = ["package_id", "x", "y"]
    sites = nodes.groupBy("package_id", "x", "y").agg(F.min("node_id").alias("node_id"))
    near, far = _box_distances()
    extent = sites.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 0.0
    sizes = [base]
    while sizes[-1] < extent:
        sizes.append(sizes[-1] * ratio)
    levels = len(sizes)

    def bins(level: int) -> DataFrame:
        size = sizes[level]
        up = sizes[level + 1] if level + 1 < levels else None
        parent = (
            [f"floor(x / {up}D) AS px", f"floor(y / {up}D) AS py"] if up else ["0L AS px", "0L AS py"]
        )
        return (
            sites.selectExpr(
                "package_id", *parent, f"floor(x / {size}D) AS bx", f"floor(y / {size}D) AS by", "x", "y"
            )
            .groupBy("package_id", "px", "py", "bx", "by")
            .agg(
                F.min("x").alias("lo_x"),
                F.max("x").alias("hi_x"),
                F.min("y").alias("lo_y"),
                F.max("y").alias("hi_y"),
            )
        )

    walk = points.select(*key).distinct().selectExpr(*key, "0L AS px", "0L AS py")
    for level in range(levels - 1, -1, -1):
        bound = F.min(F.expr(far)).over(Window.partitionBy(*key))
        walk = (
            walk.join(bins(level), ["package_id", "px", "py"])
            .withColumn("_bound", bound)
            .filter(f"{near} <= _bound")
            .selectExpr(*key, "bx AS px", "by AS py")
        )
    last = sites.selectExpr(
        "package_id",
        f"floor(x / {base}D) AS px",
        f"floor(y / {base}D) AS py",
        "x AS nx",
        "y AS ny",
        "node_id",
    )
    snapped = (
        walk.join(last, ["package_id", "px", "py"])
        .selectExpr(*key, "(x - nx) * (x - nx) + (y - ny) * (y - ny) AS d2", "node_id")
        .groupBy(*key)
        .agg(F.min(F.struct("d2", "node_id")).alias("m"))
    )
    # A point id given at several places gets the nearest node of all of them.
    return (
        points.join(snapped, key)
        .groupBy("package_id", "point_id")
        .agg(F.min("m").alias("m"))
        .selectExpr("package_id", "point_id", "m.node_id AS node_id", "m.d2 AS distance_sq")
    )


def od_totals(trips: DataFrame) -> DataFrame:
    """Trips per pair, origin, destination, and in total (a NULL stands for all).

    level tells which: 0 a pair, 1 an origin, 2 a destination, 3 everything.
    """
    return trips.cube("origin", "destination").agg(
        F.sum("trips").alias("trips"), F.count("*").alias("records"), F.grouping_id().alias("level")
    )
