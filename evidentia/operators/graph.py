"""Edge tables, breadth-first shortest paths, and rendering of paths with relation names.

Edges are (x_index, x_name, relation, y_index, y_name, ord), with ``ord`` the order in
which a first row wins. Of several shortest paths the lexicographically least is taken.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import bucketed, pieces, saved, small, spread
from .worklist import numbered

#: More rows than this of one key are not sent to one task to meet what they ask for.
CROWD = 100_000


def directed(edges: DataFrame) -> DataFrame:
    """Each pair once, one way."""
    return edges.select(F.col("x_index").alias("src"), F.col("y_index").alias("dst")).distinct()


def both_ways(edges: DataFrame, src: str = "x_name", dst: str = "y_name") -> DataFrame:
    """Both directions of each row; rows with a missing end out."""
    pairs = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def undirected(edges: DataFrame, src: str = "x_name", dst: str = "y_name", parts: int | None = None) -> DataFrame:
    """Both directions of each pair, once; rows with a missing end out. With ``parts`` spread by ``src`` over so many partitions."""
    pairs = both_ways(edges, src, dst)
    return (pairs if parts is None else pairs.repartition(parts, "src")).distinct()


def _union(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


def _numbers(nodes: DataFrame, salt: int = 0) -> tuple[Callable[[Column], Column], DataFrame]:
    """A long for each node, and (id, name): hashes, drawn again with another salt if two nodes share one."""
    number = lambda c: F.when(c.isNotNull(), F.xxhash64(c, F.lit(salt)))
    names = saved(nodes.where("name IS NOT NULL").groupBy(number(F.col("name")).alias("id")).agg(F.min("name").alias("name"), F.max("name").alias("other")), "names")
    return _numbers(nodes, salt + 1) if names.where("name <> other").limit(1).count() else (number, names.select("id", "name"))


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None, max_depth: int | None = None, back: int | None = None, parts: int | None = None) -> DataFrame:
    """(source, node, path, depth) of all nodes reached from ``sources`` (source), or of ``targets`` (node) only.

    Level by level: the frontier meets the edges, visited (source, node) pairs fall away,
    and each new pair keeps its least path. A source reaches itself with a path of one.
    Levels end at ``max_depth`` edges, when nothing is new, or when every target is reached.
    ``back`` is how many of the last levels an edge can lead back to: 2 in an undirected
    graph, where only these are looked at for visited pairs; all levels if not given.

    No path goes along: paths of a level have places in their order, and the least path to a
    node continues the one with the least place. Paths are put together at the end, for the
    nodes asked for. Edges lie in ``parts`` buckets by ``src``, as numbers, and are shuffled once.
    """
    spark = edges.sparkSession
    parts = parts or pieces(spark, 0)
    ends = edges.select(F.col("src").alias("name"))
    nodes = _union([ends, sources.select(F.col("source").alias("name"))] + ([edges.select(F.col("dst").alias("name"))] if back is None else []))
    number, names = _numbers(nodes)
    pairs = bucketed(edges.select(number(F.col("src")).alias("src"), number(F.col("dst")).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").repartition(parts, "src").distinct(), "src", parts, "edges")
    first = sources.select(F.col("source").alias("name")).where("name IS NOT NULL").distinct()
    front = saved(first.select(number(F.col("name")).alias("source"), number(F.col("name")).alias("node"), F.lit(None).cast("long").alias("before"), "name", F.monotonically_increasing_id().alias("at")), "bfs")
    asked = None if targets is None else saved(targets.select(number(F.col("node")).alias("node")).where("node IS NOT NULL").distinct(), "asked")
    wanted = None if asked is None else front.count() * asked.count()
    hits = lambda rows: rows if asked is None else rows.join(asked, "node", "left_semi")
    levels, depth, reached = [front], 0, 0 if asked is None else hits(front).count()
    while (max_depth is None or depth < max_depth) and (wanted is None or reached < wanted):
        depth += 1
        step = front.join(pairs, front["node"] == pairs["src"]).groupBy("source", F.col("dst").alias("node")).agg(F.min("at").alias("before"))
        seen = _union([x.select("source", "node") for x in (levels if back is None else levels[-back:])])
        fresh = saved(step.join(seen, ["source", "node"], "left_anti"), "bfs").join(names.withColumnRenamed("id", "node"), "node").select("source", "node", "before", "name")
        rows = fresh.count()
        if rows == 0:
            break
        reached += 0 if asked is None else hits(fresh).count()
        last = depth == max_depth or (wanted is not None and reached >= wanted)
        front = fresh if last else saved(_placed(fresh, rows), "bfs")
        levels.append(front)
    return _put_together(levels, hits)


def _placed(fresh: DataFrame, rows: int) -> DataFrame:
    """Adds each path's place (at) among its level's; up to 100,000 rows by one window, more in ranges."""
    if rows > 100_000:
        return numbered(fresh, [F.col("before")], [F.col("name")], "at")
    return fresh.withColumn("at", F.row_number().over(Window.orderBy("before", "name")).cast("long"))


def _put_together(levels: list[DataFrame], hits: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Paths of the nodes asked for, from the last level to the first, along the places of the paths before."""
    rows = None
    for depth in range(len(levels) - 1, -1, -1):
        own = hits(levels[depth]).select("before", F.array("name").alias("path"), F.lit(depth).alias("depth"))
        if rows is not None:
            level = levels[depth].select("at", "name", F.col("before").alias("__before"))
            rows = rows.join(level, rows["before"] == level["at"]).select(F.col("__before").alias("before"), F.concat(F.array("name"), "path").alias("path"), "depth")
            if depth % 4 == 0 and depth > 0:
                rows = saved(rows, "paths")
        rows = own if rows is None else rows.unionByName(own)
    return rows.select(F.get("path", F.lit(0)).alias("source"), F.get("path", F.size("path") - 1).alias("node"), "path", "depth")


def paths_to_targets(edges: DataFrame, starts: DataFrame, targets: DataFrame, max_depth: int | None = None, parts: int | None = None) -> DataFrame:
    """(source, node, path, depth) from each start to each of few targets, searched once backward from the targets.

    The path of a node to a target is itself and the least path of its best neighbour, so the
    least forward path results; its cost follows targets times nodes, not starts times nodes.
    Edges are made once, in ``parts`` buckets by ``dst``; each step is spread over so many partitions.
    Semi and anti joins would be pushed below the spreading, so plain ones with distinct rows stand here.
    """
    parts = parts or pieces(edges.sparkSession, 0)
    edges = bucketed(spread(edges, parts, "dst"), "dst", parts, "edges")
    starts = saved(spread(starts.select(F.col("source").alias("node")), parts, "node").distinct(), "starts")
    front = saved(targets.select(F.col("node").alias("target"), "node", F.array("node").alias("path"), F.lit(0).alias("depth")).distinct(), "bfs")
    levels, seen, depth = [front], front.select("target", "node"), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(edges, front["node"] == edges["dst"]).select("target", F.col("src").alias("node"), F.concat(F.array("src"), "path").alias("path"))
        best = spread(step, parts, "target", "node").groupBy("target", "node").agg(F.min("path").alias("path"))
        fresh = best.join(spread(seen, parts, "target", "node").withColumn("old", F.lit(True)), ["target", "node"], "left").where("old IS NULL")
        front = saved(fresh.select("target", "node", "path", F.lit(depth).alias("depth")), "bfs")
        if front.limit(1).count() == 0:
            break
        levels.append(front)
        seen = seen.unionByName(front.select("target", "node"))
    found = spread(_union(levels), parts, "node").join(spread(starts, parts, "node"), "node")
    return found.select(F.col("node").alias("source"), F.col("target").alias("node"), "path", "depth")


def node_names(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, name): the name in the first edge that starts at the node."""
    return spread(edges.select(F.col("x_index").alias("node"), "x_name", "ord"), parts, "node").groupBy("node").agg(F.min_by("x_name", "ord").alias("name"))


def relation_directed(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(src, dst, relation) for both ways of each pair: the first row that way, else the first of the other way."""
    way = lambda a, b, prio: edges.select(F.col(a).alias("src"), F.col(b).alias("dst"), "relation", F.struct(F.lit(prio).alias("prio"), F.col("ord")).alias("at"))
    return spread(way("x_index", "y_index", 0).unionByName(way("y_index", "x_index", 1)), parts, "src", "dst").groupBy("src", "dst").agg(F.min_by("relation", "at").alias("relation"))


def relation_either(edges: DataFrame, among: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(src, dst, relation) by name for both ways of each pair: the first row of either way.

    Only of the pairs in ``among`` (src, dst), if given. Each pair goes one way until its relation is found.
    """
    pair = lambda df, a, b: df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"src": F.least(a, b), "dst": F.greatest(a, b)})
    rows = pair(edges, "x_name", "y_name").select("src", "dst", "relation", "ord")
    rows = rows if parts is None else rows.repartition(parts, "src", "dst")
    if among is not None:
        rows = rows.join(pair(among.select(F.col("src").alias("a"), F.col("dst").alias("b")), "a", "b").select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    found = rows.groupBy("src", "dst").agg(F.min_by("relation", "ord").alias("relation"))
    return found.unionByName(found.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation"))


def steps_of(paths: DataFrame) -> DataFrame:
    """(src, dst) of every edge of (path_id, path)."""
    return _steps(paths).where("step IS NOT NULL").select("src", "dst")


def _steps(paths: DataFrame) -> DataFrame:
    """A row per edge of each path: (path_id, step, src, dst, steps)."""
    rows = paths.select("path_id", "path", F.explode_outer(F.when(F.size("path") > 1, F.sequence(F.lit(1), F.size("path") - 1))).alias("step"))
    return rows.select("path_id", "step", F.get("path", F.col("step") - 1).alias("src"), F.get("path", F.col("step")).alias("dst"), (F.size("path") - 1).alias("steps"))


def _gather(parts: DataFrame, separator: str) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("step", "part")))
    return parts.groupBy("path_id").agg(F.array_join(F.transform(items, lambda x: x["part"]), separator).alias("rendered"))


def render_by_name(paths: DataFrame, relations: DataFrame, arrow: str = " -> ") -> DataFrame:
    """(path_id, rendered): ``A (node) -> relation (edge) -> B (node)``; a path of one node is its name.

    ``paths`` is (path_id, path of names), ``relations`` as :func:`relation_either`.
    """
    steps = _steps(paths).where("step IS NOT NULL").join(relations, ["src", "dst"], "left")
    head = F.when(F.col("step") == 1, F.concat("src", F.lit(" (node)" + arrow))).otherwise("")
    part = F.concat(head, F.coalesce("relation", F.lit("unknown_relation")), F.lit(" (edge)" + arrow), "dst", F.lit(" (node)"))
    single = paths.where(F.size("path") <= 1).select("path_id", F.coalesce(F.get("path", F.lit(0)), F.lit("")).alias("rendered"))
    return _gather(steps.select("path_id", "step", part.alias("part")), arrow).unionByName(single)


def render_by_index(paths: DataFrame, relations: DataFrame, names: DataFrame, queries: DataFrame, parts: int | None = None) -> DataFrame:
    """(path_id, rendered): ``q(node)->relation(edge)->B(node)``; ends have their query's name, others the graph's.

    A path of one node is an empty string. ``queries`` is (node, query), ``names`` as :func:`node_names`.
    Relation and names are looked up once for each distinct step. Both sides of each join are
    spread by its key over ``parts`` partitions; what over ``CROWD`` rows ask for is broadcast to them.
    """
    key = ["src", "dst", "first", "last"]
    steps = _steps(paths).where("step IS NOT NULL").select("path_id", "step", "src", "dst", (F.col("step") == 1).alias("first"), (F.col("step") == F.col("steps")).alias("last"))
    called = saved(spread(names, parts, "node").join(spread(queries, parts, "node"), "node", "full"), "called")
    texts = spread(_counts(steps, key, "path_id", parts, "src", "dst").join(spread(relations, parts, "src", "dst"), ["src", "dst"], "left"), parts, "src")
    texts = saved(texts.join(spread(called.select(F.col("node").alias("src"), F.col("query").alias("src_query")), parts, "src"), "src", "left"), "texts")
    say = called.select(F.col("node").alias("dst"), F.col("name").alias("dst_name"), F.col("query").alias("dst_query"))
    hubs = saved(_counts(texts, ["dst"], "src", parts, "dst").where(F.col("n") > CROWD).select("dst"), "hubs")
    texts = _looked_up(texts, say.join(small(hubs), "dst", "left_semi"), say, small(hubs), ["dst"], parts)
    head = F.when(F.col("first"), F.concat(F.coalesce("src_query", F.lit("")), F.lit("(node)"))).otherwise("")
    part = F.concat(head, F.lit("->"), F.coalesce("relation", F.lit("")), F.lit("(edge)->"), F.coalesce(F.when(F.col("last"), F.col("dst_query")).otherwise(F.col("dst_name")), F.lit("")), F.lit("(node)"))
    texts = saved(texts.select(*key, "n", part.alias("part")), "texts")
    common = texts.where(F.col("n") > CROWD).select(*key, "part")
    said = _looked_up(steps, common, texts.where(F.col("n") <= CROWD).select(*key, "part"), small(common.select(*key)), key, parts).select("path_id", "step", "part")
    single = paths.where(F.size("path") <= 1).select("path_id", F.lit("").alias("rendered"))
    return _gather(spread(said, parts, "path_id"), "").unionByName(single)


def _counts(rows: DataFrame, keys: list[str], by: str, parts: int | None, *on: str) -> DataFrame:
    """(keys, n), spread by ``on``: rows of each key, counted in 32 shares by hash of ``by`` first, as one key may have most rows."""
    shares = spread(rows.select(*keys, F.pmod(F.xxhash64(by), F.lit(32)).alias("share")), parts, *on, "share").groupBy(*keys, "share").agg(F.count(F.lit(1)).alias("n"))
    return spread(shares, parts, *on).groupBy(*keys).agg(F.sum("n").alias("n"))


def _looked_up(rows: DataFrame, common: DataFrame, table: DataFrame, crowded: DataFrame, keys: list[str], parts: int | None) -> DataFrame:
    """Left join with ``table``, but rows of the few keys in ``crowded`` stay where they are and meet ``common``, the table's rows of these."""
    there = rows.join(crowded, keys, "left_semi").join(small(common), keys, "left")
    rest = spread(rows.join(crowded, keys, "left_anti"), parts, *keys).join(spread(table, parts, *keys), keys, "left")
    return there.unionByName(rest)


def path_length(rendered: Column) -> Column:
    return (F.size(F.split(rendered, r"\(edge\)")) - 1).cast("long")


def path_statistics(paths: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Means over (patient, disease, rendered): paths a patient, edges a path, paths an endpoint.

    ``endpoints`` lists all (patient, disease), those without a path too.
    """
    per = paths.groupBy("patient", "disease").agg(F.count(F.lit(1)).alias("n"), F.sum(path_length(F.col("rendered"))).alias("len"))
    whole = endpoints.join(per, ["patient", "disease"], "left").agg(F.countDistinct("patient").alias("patients"), F.count(F.lit(1)).alias("ends"), F.coalesce(F.sum("n"), F.lit(0)).alias("paths"), F.coalesce(F.sum("len"), F.lit(0)).alias("len"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return whole.select(share("paths", "patients").alias("paths_per_patient"), share("len", "paths").alias("path_length"), share("paths", "ends").alias("paths_per_endpoint"))


def feature_statistics(paths: DataFrame, endpoints: DataFrame, positives: DataFrame) -> DataFrame:
    """(feature, paths_per_patient, path_length) of each positive label, counted once for every endpoint of its patient.

    That counting inflates: a patient's paths go to each of its positive labels.
    """
    per = paths.groupBy("patient").agg(F.count(F.lit(1)).alias("n"), F.sum(path_length(F.col("rendered"))).alias("len"))
    patients = endpoints.agg(F.countDistinct("patient").alias("patients"))
    rows = positives.select("patient", "feature").distinct().join(per, "patient").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("len").alias("len"))
    return rows.crossJoin(F.broadcast(patients)).select("feature", (F.col("n") / F.col("patients")).alias("paths_per_patient"), (F.col("len") / F.col("n")).alias("path_length"))


def distinct_in_order(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """(by, pos, value): distinct values in the order in which they first appear."""
    first = rows.groupBy(by, value).agg(F.min(order).alias("__at"))
    return first.select(by, F.row_number().over(Window.partitionBy(by).orderBy("__at", value)).alias("pos"), value)


def patient_paths(starts: DataFrame, ends: DataFrame, paths: DataFrame, parts: int | None = None) -> DataFrame:
    """(patient, disease, label, start_index, path): each patient's starts against its ends, with each pair's path.

    ``starts`` is (patient, start_index), ``ends`` (patient, disease, label, end_index);
    ``paths`` holds each distinct pair once, whatever the number of patients.
    """
    pairs = spread(starts.join(small(ends), "patient"), parts, "start_index")
    found = paths.select(F.col("source").alias("start_index"), F.col("node").alias("end_index"), "path")
    return pairs.join(found, ["start_index", "end_index"]).select("patient", "disease", "label", "start_index", "path")
