"""Parent–child links to full hierarchies by pointer doubling (problem 3).

Each round joins every open pointer with the pointer of the node it points at, so jumps double: chains of length L
need log2(L) rounds. A round that closes no pointer proves that only cycles, and chains into them, are left. What a
round closes is written once; of it only the nodes that open pointers still ask for are read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.session import cut
from mnemora.sources.tables import current_objects

#: A target is hot from so many rows pointing at it, and from one thousandth of all rows: so a thousand are, at most.
HOT = 10_000
SALTS = 64


def _look_up(rows: DataFrame, key: str, table: DataFrame, hot: int = HOT, salts: int = SALTS) -> DataFrame:
    """``rows`` left-joined with ``table`` on ``key``; rows of hot keys, as counted, are spread over ``salts``."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    # two numbers and a thousand keys come to the driver, at most
    found = [r[0] for r in counts.where(F.col("n") >= hot).orderBy(F.col("n").desc()).limit(1_000).select(key).collect()]
    if not found:
        return rows.join(table, key, "left")
    is_hot = F.col(key).isin(found)
    salted = rows.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    spread = table.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(spread, [key, "__salt"], "left").drop("__salt")


def links(objects: DataFrame) -> DataFrame:
    """(id, next, broken) of each object that leads on; broken says whether ``next`` is no object."""
    now = cut(current_objects(objects, "redirect_to"))
    sources = now.where(F.col("redirect_to") != "").select("id", F.col("redirect_to").alias("next"))
    known = now.select(F.col("id").alias("next"), F.lit(True).alias("known"))
    return _look_up(sources, "next", known).select("id", "next", F.col("known").isNull().alias("broken"))


def _resolve(start: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Doubles (id, at, depth, path) until a round closes nothing: (closed, open) rows, None where there are none.

    ``path`` holds the ids after ``at`` down to ``id``. A pointer is closed when ``at`` has no pointer itself.
    """
    closed: list[DataFrame] = []
    live = start
    while True:
        asked = live.select(F.col("at").alias("id")).distinct()
        pointers = [live.select("id", "at", "depth", "path", F.lit(False).alias("ends"))]
        pointers += [c.select("id", "at", "depth", "path", F.lit(True).alias("ends")) for c in closed]
        wanted = reduce(DataFrame.unionByName, pointers).join(asked, "id", "left_semi")
        onward = wanted.select(F.col("id").alias("at"), F.col("at").alias("to"), F.col("depth").alias("more"), F.col("path").alias("upper"), "ends")
        moved = _look_up(live, "at", onward).select(
            "id", F.coalesce("to", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.when(F.col("to").isNull(), F.col("path")).otherwise(F.concat("upper", F.lit(">"), "path")).alias("path"),
            F.coalesce("ends", F.lit(True)).alias("done"),
        )
        moved = cut(moved)
        n = moved.agg(F.count_if("done").alias("closed"), F.count_if(~F.col("done")).alias("open")).first()
        if n["closed"]:
            closed.append(moved.where("done").drop("done"))
        live = moved.where("NOT done").drop("done")
        if not n["open"] or not n["closed"]:
            return (reduce(DataFrame.unionByName, closed) if closed else None), (live if n["open"] else None)


def _cycles(rest: DataFrame) -> DataFrame:
    """(at, root_id) of the nodes on cycles among (id, next) rows that never end, each with its cycle's smallest id.

    Jumps double until a round changes neither the number of nodes jumped to nor any smallest id passed: nodes whose
    number a jump leaves as it is are permuted by it, so they lie on cycles, and the jumps from one of them have then
    passed its whole cycle.
    """
    ring = rest.select("id", F.col("next").alias("at"), F.col("id").alias("least"))
    before = None
    while True:
        pointers = ring.select(F.col("id").alias("at"), F.col("at").alias("to"), F.col("least").alias("other"))
        moved = _look_up(ring, "at", pointers).select("id", F.col("to").alias("at"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("changed"))
        moved = cut(moved)
        n = moved.agg(F.countDistinct("at").alias("met"), F.count_if("changed").alias("changed")).first()
        ring = moved.drop("changed")
        if n["met"] == before and not n["changed"]:
            break
        before = n["met"]
    on = ring.select("at").distinct()
    return on.join(ring.select(F.col("id").alias("at"), F.col("least").alias("root_id")), "at")


def hierarchy(edges: DataFrame) -> DataFrame:
    """(id, root_id, depth, path, status) of each node of ``edges`` (id, next, broken): one row a node, next not null.

    ``tree``: the chain ends at a node without link; ``broken``: at one whose link leads to no node (that node itself
    too, at depth 0); ``cycle`` and ``into_cycle`` never end: root_id is the smallest id on the cycle, depth the links
    to the cycle and path empty. Empty input gives an empty result; a link to itself is a cycle of one.
    """
    edges = cut(edges)
    ends = edges.where("broken").select("id", F.col("id").alias("root_id"), F.lit(0).alias("depth"), F.col("id").alias("path"), F.lit("broken").alias("status"))
    live = edges.where("NOT broken").select("id", F.col("next").alias("at"), F.lit(1).alias("depth"), F.col("id").alias("path"))
    out = ends
    closed, rest = _resolve(live)
    if closed is not None:
        tops = ends.select(F.col("id").alias("at"), "status")
        named = _look_up(closed, "at", tops)
        trees = named.select("id", F.col("at").alias("root_id"), "depth", F.concat("at", F.lit(">"), "path").alias("path"), F.coalesce("status", F.lit("tree")).alias("status"))
        out = out.unionByName(trees)
    if rest is None:
        return out
    loose = cut(edges.select("id", "next").join(rest.select("id"), "id", "left_semi"))
    on = cut(_cycles(loose))
    rings = on.select(F.col("at").alias("id"), "root_id", F.lit(0).alias("depth"), F.lit("").alias("path"), F.lit("cycle").alias("status"))
    inward = loose.join(on.select(F.col("at").alias("id")), "id", "left_anti").select("id", F.col("next").alias("at"), F.lit(1).alias("depth"), F.lit("").alias("path"))
    arrived, _ = _resolve(cut(inward))
    if arrived is None:
        return out.unionByName(rings)
    into = _look_up(arrived, "at", on).select("id", "root_id", "depth", F.lit("").alias("path"), F.lit("into_cycle").alias("status"))
    return out.unionByName(rings).unionByName(into)


def object_hierarchy(objects: DataFrame) -> DataFrame:
    """``hierarchy`` of the objects' current redirects; a redirect of blanks is one, and broken."""
    return hierarchy(links(objects))


def descendants(found: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of every pair on a path that ends (``tree`` and ``broken`` rows)."""
    ids = F.split("path", ">")
    each = found.where(F.col("path") != "").select(F.col("id").alias("descendant"), F.posexplode(ids).alias("level", "ancestor"), F.size(ids).alias("n"))
    return each.where(F.col("level") < F.col("n") - 1).select("ancestor", "descendant", (F.col("n") - 1 - F.col("level")).alias("distance"))
