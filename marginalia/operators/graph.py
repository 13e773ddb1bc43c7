"""The link graph: vertices (id, ...) and edges (src, dst, type), unique by src and dst.

Traversals are rounds of joins over a frontier, for many seeds at once; each round is written to the shared folder, so plans stay flat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.scratch import discard, saved


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, other) of every edge seen from both ends, distinct."""
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"))).distinct()


def neighbors(edges: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """(id, other): successors ("out"), predecessors ("in") or both, distinct."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"))
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("other"))
    found = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return found.join(ids.select("id").distinct(), "id", "left_semi").distinct()


def related(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, depth, id): breadth first without direction, each note at its smallest depth, the seed left out."""
    return _related(saved(both_ways(edges)), seeds, depth)


def _related(step: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    front = saved(seeds.select(F.col("id").alias("seed"), "id").distinct())
    seen = front.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        reached = front.join(step, "id").select("seed", F.col("other").alias("id")).distinct()
        front = saved(reached.join(seen, ["seed", "id"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
    return seen.filter("depth > 0").select("seed", "depth", "id")


def shortest_path(edges: DataFrame, pairs: DataFrame, max_length: int = 5) -> DataFrame:
    """(src, dst, path, length) of the directed shortest path of each (src, dst), if it has ``max_length`` edges at most; of several, the first in
    the order of ids. A note's path to itself is the note.

    Walks belong to sources, not to pairs: a note that a source has reached serves all its targets, and a source goes on while a pair is open.
    """
    left = [saved(pairs.select("src", F.col("dst").alias("at")).distinct())]

    def hit(front: DataFrame) -> DataFrame:
        found = saved(front.join(left[-1], ["src", "at"], "left_semi"))
        left.append(saved(left[-1].join(found.select("src", "at"), ["src", "at"], "left_anti")))
        discard(left.pop(0))
        return found

    return _walks(edges, left[0].select("src").distinct(), max_length, hit, lambda front: front.join(left[-1].select("src").distinct(), "src", "left_semi"))


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_length: int = 5) -> DataFrame:
    """As ``shortest_path``, from each of the sources (id) to each of the targets (id) that it reaches; the pairs are never made."""
    ends = saved(targets.select(F.col("id").alias("at")).distinct())
    return _walks(edges, sources.select(F.col("id").alias("src")).distinct(), max_length, lambda front: front.join(ends, "at", "left_semi"), lambda front: front)


def _walks(edges: DataFrame, sources: DataFrame, max_length: int, hit: Callable[[DataFrame], DataFrame], go_on: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``hit`` takes the wanted rows of a frontier (src, at, path), ``go_on`` those whose source is not done."""
    step = saved(edges.filter("src <> dst").select(F.col("src").alias("at"), F.col("dst").alias("next")))
    front = sources.select("src", F.col("src").alias("at"), F.array("src").alias("path"))
    done = visited = None
    for length in range(max_length + 1):
        front = saved(front)
        found = hit(front).select("src", F.col("at").alias("dst"), "path", F.lit(length).alias("length"))
        done = found if done is None else done.unionByName(found)
        own = front.select("src", "at")
        visited = own if visited is None else visited.unionByName(own)
        front = go_on(front)
        if length == max_length or front.isEmpty():
            break
        # One path, the smallest, is enough for each note that is reached at this length.
        reached = front.join(step, "at").groupBy("src", F.col("next").alias("at")).agg(F.min(F.concat("path", F.array("next"))).alias("path"))
        front = reached.join(visited, ["src", "at"], "left_anti")
    return done


def clusters(edges: DataFrame) -> DataFrame:
    """(cluster, id) of weakly connected components of at least two notes; the cluster's name is its smallest id.

    Labels move along edges and then jump to the label of their label, so long chains take few rounds.
    """
    step = saved(both_ways(edges).filter("id <> other"))
    labels = saved(step.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("cluster")))
    while True:
        seen = step.join(labels.select(F.col("id").alias("other"), "cluster"), "other").groupBy("id").agg(F.min("cluster").alias("near"))
        moved = labels.join(seen, "id").select("id", F.col("cluster").alias("old"), F.least("cluster", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("cluster").alias("above"))
        new = saved(moved.join(jump, "to", "left").select("id", "old", F.least("to", F.coalesce("above", "to")).alias("cluster")))
        discard(labels)
        labels = new.select("id", "cluster")
        labels._scratch = new._scratch
        if new.filter("old <> cluster").isEmpty():
            return labels.select("cluster", "id")


def cluster_sizes(edges: DataFrame) -> DataFrame:
    return clusters(edges).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree); a link of a note to itself counts in both."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    back = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return vertices.select("id").join(out, "id", "left").join(back, "id", "left").select("id", zero("in_degree").alias("in_degree"), zero("out_degree").alias("out_degree"), (zero("in_degree") + zero("out_degree")).alias("degree"))


def hubs(vertices: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    return degrees(vertices, edges).orderBy(F.desc("degree"), "id").limit(top)


def stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, avg_degree, isolated, clusters; zeros for an empty graph."""
    each = degrees(vertices, edges).agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.avg("degree"), F.lit(0.0)).alias("avg_degree"), F.count_if(F.col("degree") == 0).alias("isolated"))
    many = edges.agg(F.count(F.lit(1)).alias("edges"))
    groups = cluster_sizes(edges).agg(F.count(F.lit(1)).alias("clusters"))
    return each.crossJoin(many).crossJoin(groups).select("nodes", "edges", "avg_degree", "isolated", "clusters")  # one row each


def orphans(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Notes without any link."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return vertices.join(ends, "id", "left_anti")


def subgraph(edges: DataFrame, seed: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, depth) around a seed and the edges among them."""
    near = related(edges, seed, depth).select("id", "depth").unionByName(seed.select("id").withColumn("depth", F.lit(0))).groupBy("id").agg(F.min("depth").alias("depth"))
    near = saved(near)
    inside = edges.join(near.select(F.col("id").alias("src")), "src", "left_semi").join(near.select(F.col("id").alias("dst")), "dst", "left_semi")
    return near, inside


def draw(notes: DataFrame, edges: DataFrame, seed: DataFrame, depth: int = 2, links: int = 5) -> str:
    """The surroundings of a note as text: levels, titles and up to ``links`` outgoing links each. For a report of one note on the driver."""
    near, inside = subgraph(edges, seed, depth)
    per = Window.partitionBy("src").orderBy("dst")
    few = inside.withColumn("n", F.row_number().over(per)).filter(F.col("n") <= links).groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("to"))
    rows = near.join(notes.select("id", "title"), "id", "left").join(few, "id", "left").orderBy("depth", "id")
    out = []
    for r in rows.toLocalIterator():
        out.append(f"{'  ' * r['depth']}{r['title'] or r['id']} ({r['id']})" + (f" -> {', '.join(r['to'])}" if r["to"] else ""))
    return "\n".join(out)


def enrich(hits: DataFrame, notes: DataFrame, edges: DataFrame, depth: int = 2, per_depth: int = 3) -> DataFrame:
    """Hits (query_id, id, rank) with neighbors (number of different ones) and related: up to ``per_depth`` notes of each depth, by id."""
    hits = saved(hits)
    seeds = hits.select("id").distinct()
    step = saved(both_ways(edges))  # edges are resolved once, for both
    near = _related(step, seeds, depth)
    order = Window.partitionBy("seed", "depth").orderBy("id")
    few = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_depth).join(notes.select("id", "title"), "id")
    lists = few.groupBy(F.col("seed").alias("id")).agg(F.sort_array(F.collect_list(F.struct("depth", F.col("id").alias("other"), "title"))).alias("related"))
    many = step.join(seeds, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("neighbors"))
    return hits.join(many, "id", "left").join(lists, "id", "left").withColumn("neighbors", F.coalesce("neighbors", F.lit(0).cast("long")))
