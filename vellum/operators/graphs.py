"""A property graph as two tables: integrity, degree and structure.  No pair of nodes is compared that no edge joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from .connected import connect
from .skew import HOT_ROWS, salted_lookup


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, degree)`` of every node, counting both directions; nodes without edges have 0."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def hubs(degrees: DataFrame, deviations: float = 1.5) -> DataFrame:
    """Nodes of a degree above the mean plus 1.5 (population) standard deviations."""
    bound = degrees.agg((F.avg("degree") + deviations * F.stddev_pop("degree")).alias("bound"))
    return degrees.crossJoin(F.broadcast(bound)).filter("round(degree - bound, 6) > 0").select("id", "degree")  # one row


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(source, target, side)`` of edges whose end is no node; counted by distinct edge and side."""
    ends = edges.select("source", "target", F.explode(F.map_from_arrays(F.array(F.lit("source"), F.lit("target")), F.array("source", "target"))).alias("side", "id"))
    return ends.join(nodes.select("id"), "id", "left_anti").select("source", "target", "side")


def dense_clusters(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(id, cluster)``: the basin of the locally best connected node to which a node climbs; ``cluster`` is its smallest member.

    Each node points at its neighbour of the highest degree (of equal ones the smallest id), if that is better connected than itself (of equal degree: has
    a smaller id).  Nodes that no neighbour surpasses are the peaks; the nodes that climb to one peak are a cluster, in which edges are denser than
    between clusters.  Pointers run uphill only, so they form trees.  Every node of an edge is in one cluster.
    """
    scratch = Scratch(edges.sparkSession, "clusters")
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).filter("a is not null and b is not null and a <> b")
    both = scratch.keep(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    size = scratch.keep(both.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    told = salted_lookup(both, size.select(F.col("a").alias("b"), "n"), ["b"], "a", "inner", hot_rows, counted="n")
    best = told.groupBy("a").agg(F.max("n").alias("best")).join(size, "a")
    # the smallest of the best: a second pass, so that only numbers and ids are aggregated, no structs
    up = salted_lookup(told, best.filter("best >= n").select("a", "best", F.col("n").alias("own")), ["a"], "b", "inner", hot_rows, counted="own")
    up = up.filter("n = best and (n > own or b < a)").groupBy("a").agg(F.min("b").alias("b"))
    labels = connect(up, hot_rows, scratch)
    return size.select(F.col("a").alias("id")).join(labels, "id", "left").select("id", F.coalesce("group_id", "id").alias("cluster"))


def bridges(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(id, clusters)``: nodes whose edges span two clusters or more (their own counts), and how many."""
    labels = Scratch(edges.sparkSession, "bridges").keep(dense_clusters(edges, hot_rows))
    ends = edges.select(F.col("source").alias("id"), F.col("target").alias("other")).filter("id is not null and other is not null and id <> other")
    ends = ends.unionByName(ends.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
    spans = salted_lookup(ends, labels.select(F.col("id").alias("other"), "cluster"), ["other"], "id", "inner", hot_rows).select("id", "cluster").unionByName(labels)
    return spans.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("clusters")).filter("clusters >= 2")


def component_labels(nodes: DataFrame, edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(id, label)``: the smallest node that a node is linked to directly or through other nodes, however far; its own id when alone.

    Edges with an end that is no node link nothing.
    """
    scratch = Scratch(nodes.sparkSession, "labels")
    ids = scratch.keep(nodes.select("id").filter("id is not null").distinct())
    inner = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    for end, other in (("a", "b"), ("b", "a")):
        inner = salted_lookup(inner, ids.withColumnRenamed("id", end), [end], other, "left_semi", hot_rows)
    labels = connect(inner, hot_rows, scratch)
    return ids.join(labels, "id", "left").select("id", F.coalesce("group_id", "id").alias("label"))


GRAPH_FILE = "nodes array<struct<id:string,ledger_ids:array<string>>>, edges array<struct<source:string,target:string,ledger_ids:array<string>>>, metadata struct<node_count:bigint,edge_count:bigint>"


def file_findings(files: DataFrame, known: DataFrame, sources: DataFrame) -> DataFrame:
    """``(severity, check, subject)`` about graph files ``(file, text)``, JSON objects of nodes, edges and metadata.

    Every node and edge names ledger ids; ``known (id)`` are those that exist, ``sources (id, included, was_read)`` says more of the sources.  Checked are: JSON that
    doesn't parse, no nodes, nodes without id, edges without an end or with one that is no node of the file, no ledger ids, ids in no ledger form, unknown ids, sources
    that are excluded or unread, and declared counts that differ.  Null and empty texts don't parse; absent lists are empty.
    """
    parsed = files.select("file", F.expr("try_parse_json(text)").isNotNull().alias("ok"), F.from_json("text", GRAPH_FILE).alias("g"))
    good = parsed.filter("ok").select("file", F.coalesce("g.nodes", F.expr("array()").cast("array<struct<id:string,ledger_ids:array<string>>>")).alias("nodes"), F.coalesce("g.edges", F.expr("array()").cast("array<struct<source:string,target:string,ledger_ids:array<string>>>")).alias("edges"), F.col("g.metadata").alias("m"))
    finding = lambda df, severity, check, *subject: df.select(F.lit(severity).alias("severity"), (F.lit(check) if isinstance(check, str) else check).alias("check"), F.concat_ws(">", F.col("file").cast("string"), *subject).alias("subject"))
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    nodes = good.select("file", F.posexplode("nodes").alias("at", "x")).select("file", "at", "x.id", "x.ledger_ids")
    edges = good.select("file", F.posexplode("edges").alias("at", "x")).select("file", "at", "x.source", "x.target", "x.ledger_ids")
    parts = [
        finding(parsed.filter(~F.col("ok")), "error", "graph-unparseable"),
        finding(good.filter(F.size("nodes") == 0), "error", "graph-empty"),
        finding(nodes.filter(missing("id")), "error", "graph-node-without-id", F.concat(F.lit("node "), "at")),
    ]
    for kind, declared in (("nodes", "m.node_count"), ("edges", "m.edge_count")):
        parts.append(finding(good.filter(F.col(declared).isNotNull() & (F.col(declared) != F.size(kind))), "warn", "graph-count-mismatch", F.lit(kind)))
    label = F.concat(F.lit("edge "), F.col("at"))
    ends = edges.select("file", "at", F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source").alias("id")), F.struct(F.lit("target").alias("side"), F.col("target").alias("id")))).alias("e")).select("file", "at", "e.*")
    parts.append(finding(ends.filter(missing("id")), "error", "graph-edge-endpoint-missing", label, F.col("side")))
    there = nodes.filter(~missing("id")).select("file", "id").distinct()
    parts.append(finding(ends.filter(~missing("id")).join(there, ["file", "id"], "left_anti"), "error", "graph-dangling-edge", label, F.col("id")))
    listed = nodes.select("file", F.concat(F.lit("node "), "at").alias("what"), "ledger_ids").unionByName(edges.select("file", label.alias("what"), "ledger_ids"))
    parts.append(finding(listed.filter(F.coalesce(F.size("ledger_ids"), F.lit(0)) <= 0), "warn", "graph-without-ledger-id", F.col("what")))
    ids = listed.select("file", "what", F.explode("ledger_ids").alias("id")).withColumn("id", F.regexp_replace(F.upper(F.coalesce("id", F.lit("NULL"))), r"[\[\]]", ""))
    formed = F.col("id").rlike(r"^(S|E|CL|V)\d+$")
    parts.append(finding(ids.filter(~formed), "error", "graph-bad-id", F.col("what"), F.col("id")))
    state = ids.filter(formed).join(known.select("id", F.lit(True).alias("known")), "id", "left").join(sources.select("id", "included", "was_read"), "id", "left")
    is_source = F.col("id").startswith("S")
    check = F.when(F.col("known").isNull(), "graph-unknown-id").when(is_source & ~F.coalesce("included", F.lit(False)), "graph-excluded-source").when(is_source & ~F.coalesce("was_read", F.lit(False)), "graph-unread-source")
    parts.append(finding(state.withColumn("check", check).filter("check is not null"), "error", F.col("check"), F.col("what"), F.col("id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
