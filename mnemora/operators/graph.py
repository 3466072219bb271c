"""Bounded traversal of typed relationships."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.functions.text import clamp
from mnemora.session import cut

EDGE = ("edge_id", "source", "target", "relation", "confidence", "tenant_id", "ord")


def edges(relationships: DataFrame, tenant: str | None = None, order: str = "row_seq") -> DataFrame:
    """(edge_id, source, target, relation, confidence, tenant_id, ord) of the active relationships, of one tenant if named.

    An id written several times is one edge: its last row's, at the place of the first. Rows without an end are none.
    """
    last = F.max(F.struct(order, "source_object", "target_object", "relation_type", "lifecycle_state", "confidence", "tenant_id")).alias("v")
    rows = relationships.where(F.col("id").isNotNull()).groupBy("id").agg(last, F.min(order).alias("ord"))
    kept = (F.col("v.lifecycle_state") == "active") & F.col("v.source_object").isNotNull() & F.col("v.target_object").isNotNull()
    if tenant is not None:
        kept = kept & (F.col("v.tenant_id") == tenant)
    return rows.where(kept).select(F.col("id").alias("edge_id"), F.col("v.source_object").alias("source"), F.col("v.target_object").alias("target"), F.col("v.relation_type").alias("relation"), F.col("v.confidence").alias("confidence"), F.col("v.tenant_id").alias("tenant_id"), "ord")


def resolved_edges(found: DataFrame, aliases: DataFrame) -> DataFrame:
    """``edges`` with both ends followed through redirects."""
    for end in ("source", "target"):
        found = found.join(aliases.select(F.col("alias").alias(end), "canonical"), end, "left").withColumn(end, F.coalesce("canonical", end)).drop("canonical")
    return found


def stepping(found: DataFrame, aliases: DataFrame) -> DataFrame:
    """``edges`` by the ids from which a walk takes them: ``source`` is any id that stands for the edge's own source.

    A walk stands at ids as they are recorded and looks for edges under what an id stands for; so an edge recorded
    under an id that was merged away is on no walk, and the targets stay as recorded.
    """
    merged = aliases.select(F.col("alias").alias("source"))
    own = found.join(merged, "source", "left_anti")
    by_alias = own.join(aliases.select(F.col("canonical").alias("source"), "alias"), "source").withColumn("source", F.col("alias")).drop("alias")
    return own.unionByName(by_alias)


def standing_for(found: DataFrame, aliases: DataFrame, end: str) -> DataFrame:
    """``found`` with ``arrives``: whether the edge's target stands for ``end``."""
    those = aliases.where(F.col("canonical") == end).select(F.col("alias").alias("target"), F.lit(True).alias("__a")).distinct()
    return found.join(those, "target", "left").withColumn("arrives", F.col("__a").isNotNull() | (F.col("target") == end)).drop("__a")


def incident(relationships: DataFrame, objects: DataFrame) -> DataFrame:
    """(id, direction, edge_id): out-edges and in-edges of each object, as a bag: a self-loop comes twice."""
    known = objects.select("id")
    out = relationships.select(F.col("source").alias("id"), F.lit("out").alias("direction"), "edge_id")
    into = relationships.select(F.col("target").alias("id"), F.lit("in").alias("direction"), "edge_id")
    return out.unionByName(into).join(known, "id", "left_semi")


def steps_to(found: DataFrame, end: str, depth: int) -> DataFrame:
    """(id, away): the fewest edges from each node to ``end``, of those at most ``depth`` away."""
    reached = found.sparkSession.createDataFrame([(end, 0)], "id string, away int")
    frontier, seen = reached, reached
    for n in range(1, depth + 1):
        before = found.join(frontier.select(F.col("id").alias("target")), "target").select(F.col("source").alias("id")).distinct()
        frontier = cut(before.join(seen, "id", "left_anti").withColumn("away", F.lit(n)))
        seen = seen.unionByName(frontier)
    return seen


def simple_paths(found: DataFrame, starts: DataFrame, depth: int, end: str | None = None) -> DataFrame:
    """(start, nodes, edge_ids, hops, score) of every path without a repeated node, up to ``depth`` edges.

    One equi-join a step from the frontier of paths, so only what is reached is read from the edges; a frontier is
    materialised before the next step. The score is the product of the edges' confidences, each between 0 and 1.
    With ``end``, paths that can't arrive there in the steps left are dropped.
    """
    frontier = starts.select(F.col("id").alias("start"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("edge_ids"), F.lit(1.0).alias("score"), F.col("id").alias("at"))
    out = None
    step = found.select(F.col("source").alias("at"), "target", "edge_id", clamp(F.col("confidence")).alias("p"))
    if end is not None:
        step = cut(step.join(steps_to(found, end, depth - 1).withColumnRenamed("id", "target"), "target"))
    for hop in range(1, depth + 1):
        grown = frontier.join(step, "at").where(~F.array_contains("nodes", F.col("target")))
        if end is not None:
            grown = grown.where(F.col("away") <= depth - hop)
        frontier = cut(grown.select("start", F.array_append("nodes", F.col("target")).alias("nodes"), F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids"), (F.col("score") * F.col("p")).alias("score"), F.col("target").alias("at")))
        paths = frontier.select("start", "nodes", "edge_ids", F.lit(hop).alias("hops"), "score")
        out = paths if out is None else out.unionByName(paths)
    return out


def paths_between(found: DataFrame, start: str, end: str, depth: int = 4) -> DataFrame:
    """(nodes, edge_ids, hops, score) from ``start`` to ``end``; paths stop where they arrive. One empty path of score
    1 if the two are one."""
    spark = found.sparkSession
    if start == end:
        return spark.createDataFrame([([start], [], 0, 1.0)], "nodes array<string>, edge_ids array<string>, hops int, score double")
    starts = spark.createDataFrame([(start,)], "id string")
    ahead = cut(found.where(F.col("source") != end))
    return simple_paths(ahead, starts, depth, end).where(F.element_at("nodes", -1) == end).drop("start")


def neighbourhood(found: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, …edge) of the edges that leave nodes less than ``depth`` steps from a start."""
    reached = starts.select(F.col("id").alias("start"), F.col("id").alias("at"))
    frontier, seen = reached, reached
    for _ in range(depth - 1):
        nxt = frontier.join(found.select(F.col("source").alias("at"), F.col("target")), "at").select("start", F.col("target").alias("at")).distinct()
        frontier = cut(nxt.join(seen, ["start", "at"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen.join(found, seen["at"] == found["source"]).select("start", *[c for c in found.columns])


def ordered_walk(found: DataFrame, starts: DataFrame, depth: int, end: str | None = None) -> DataFrame:
    """(start, rank, nodes, edge_ids, tenants, score) of a depth-first walk that expands each node once, out-edges in
    order.

    Unlike ``simple_paths`` the result depends on the edges' order: a node met again is not expanded again, nor one
    first met at the last depth. With ``end`` the paths that arrive there are given, and not followed further; a column
    ``arrives`` of ``found`` says which edges do, if there is one. ``tenants`` are those of the path's edges. The walk
    itself is sequential, so each start's neighbourhood of ``depth`` steps, cut out by joins first, is one group.
    """
    goal = F.col("arrives") if "arrives" in found.columns else F.lit(False) if end is None else F.col("target") == end
    flagged = found.select(*EDGE, goal.alias("arrives"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(["ord", "edge_id"])
        by_source: dict[str, list[tuple]] = {}
        for at, edge, target, p, tenant, arrives in zip(*[ordered[c] for c in ("source", "edge_id", "target", "confidence", "tenant_id", "arrives")], strict=True):
            by_source.setdefault(at, []).append((edge, target, min(1.0, max(0.0, p if p == p else 0.0)), tenant, arrives))
        start, visited, out = rows["start"].iloc[0], set(), []

        def children(node: str, nodes: list, path: list, tenants: list, score: float, at: int) -> Iterator[tuple]:
            if at >= depth or node in visited:
                return
            visited.add(node)
            for edge, target, p, tenant, arrives in by_source.get(node, ()):
                yield arrives, (target, [*nodes, target], [*path, edge], [*tenants, tenant], score * p, at + 1)

        stack = [children(start, [start], [], [], 1.0, 0)]
        while stack:
            nxt = next(stack[-1], None)
            if nxt is None:
                stack.pop()
                continue
            arrives, step = nxt
            if end is None or arrives:
                out.append((start, len(out), *step[1:5]))
            if end is None or not arrives:
                stack.append(children(*step))
        return pd.DataFrame(out, columns=["start", "rank", "nodes", "edge_ids", "tenants", "score"])

    schema = "start string, rank int, nodes array<string>, edge_ids array<string>, tenants array<string>, score double"
    return neighbourhood(flagged, starts, depth).groupBy("start").applyInPandas(walk, schema)


def within_tenant(walked: DataFrame, tenant: str) -> DataFrame:
    """The walked paths all of whose edges are ``tenant``'s: a foreign edge still visits what it leads to."""
    return walked.where(F.forall("tenants", lambda t: F.coalesce(t == tenant, F.lit(False))))
