"""Queries by words, by vectors and by context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.text import bucket, embedding_tokens, first_quarter, first_words, overlap, query_tokens, tokens, words
from mnemora.session import cut

#: Query vectors multiplied with the stored ones at a time.
BLOCK = 2_048


def represent(texts: DataFrame, key: str, text: str, kind: str = "essence_nl") -> DataFrame:
    """(key, type, content, token_count, semantic_classes): the simple representation of a text.

    ``essence_structured``: its first five words as a JSON topic; any other kind: its first quarter. Null texts have none.
    """
    rows = texts.where(F.col(text).isNotNull())
    if kind == "essence_structured":
        topic = first_words(F.col(text), 5)
        return rows.select(key, F.lit(kind).alias("type"), F.to_json(F.struct(topic.alias("topic"))).alias("content"), F.size(words(topic)).alias("token_count"), F.array(F.lit("topic")).alias("semantic_classes"))
    essence = first_quarter(F.col(text))
    return rows.select(key, F.lit(kind).alias("type"), essence.alias("content"), F.size(words(essence)).alias("token_count"), F.array(F.lit("topic"), F.lit("decision")).alias("semantic_classes"))


def entry_points(representations: DataFrame, key: str, query: str, order: str | None = None) -> DataFrame:
    """(key, score, matched, explanation) of the representations sharing tokens with ``query``, best first, equal ones
    in ``order``, a column, or by key.

    The score is the share of the query's tokens, repeats counting, found in the content.
    """
    asked = query_tokens(query)
    # bound inside a transform, so that a content is split once and not once a token of the query
    bound = F.transform(F.array(tokens(F.coalesce("content", F.lit("")))), lambda t: F.struct(*[c.alias(n) for c, n in zip(overlap(asked, t), ("score", "hits"), strict=True)]))
    rows = representations.select(key, F.col(order or key).alias("__order"), F.inline(bound))
    text = F.format_string("%s (score=%.2f): matched: %s", F.col(key).cast("string"), "score", F.array_join("hits", ", "))
    return rows.where(F.col("score") > 0).select(key, "score", F.array_join("hits", ", ").alias("matched"), text.alias("explanation"), "__order").orderBy(F.col("score").desc(), "__order").drop("__order")


def inverted_index(representations: DataFrame, key: str) -> DataFrame:
    """(token, key): each token of a content once; write it partitioned or bucketed by token to be asked again."""
    return representations.select(key, F.explode(F.array_distinct(tokens(F.coalesce("content", F.lit(""))))).alias("token"))


def entry_points_indexed(index: DataFrame, key: str, query: str) -> DataFrame:
    """(key, score) as ``entry_points``, from an inverted index: only the query's tokens are read."""
    asked = query_tokens(query)
    times = {t: asked.count(t) for t in asked}
    if not times:
        return index.where(F.lit(False)).select(key, F.lit(0.0).alias("score"))
    worth = F.create_map(*[F.lit(x) for pair in times.items() for x in pair])
    return index.where(F.col("token").isin(list(times))).groupBy(key).agg((F.sum(worth[F.col("token")]) / F.lit(float(len(asked)))).alias("score"))


def matching_claims(claims: DataFrame, query: str) -> DataFrame:
    """Claims any of whose tokens, of predicate and value, the query has."""
    asked = query_tokens(query)
    said = tokens(F.concat_ws(" ", "predicate", "object_or_value"))
    return claims.where(F.arrays_overlap(said, F.array(*map(F.lit, asked)))) if asked else claims.where(F.lit(False))


def matching_relationships(relationships: DataFrame, query: str) -> DataFrame:
    """Relationships whose type, in small letters, is a token of the query; so a type with ``_`` never matches."""
    return relationships.where(F.lower("relation_type").isin(query_tokens(query)))


def mentioned_objects(claims: DataFrame, relationships: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects that are subject or end of the facts given, once each."""
    ids = claims.select(F.col("subject_id").alias("id")).union(relationships.select("source_object")).union(relationships.select("target_object"))
    return objects.join(ids.where(F.col("id").isNotNull()).distinct(), "id", "left_semi")


def agent_members(memberships: DataFrame, tables: dict[str, DataFrame], aliases: DataFrame, tenant: str, visible: Column) -> DataFrame:
    """(context_id, member_type, member_id) of what an agent may see: members of its tenant, sensitive enough at most.

    ``tables``: by member type, each with id, tenant_id and sensitivity (evidence has none and only needs the tenant).
    Objects are followed through redirects, so two members may come out as one, twice. One join a type of member.
    """
    ours = memberships.where(F.col("tenant_id") == tenant).drop("tenant_id")
    parts = []
    for kind, rows in tables.items():
        of_kind = ours.where(F.col("member_type") == kind)
        if kind == "object":
            of_kind = of_kind.join(aliases.select(F.col("alias").alias("member_id"), "canonical"), "member_id", "left").withColumn("member_id", F.coalesce("canonical", "member_id")).drop("canonical")
        seen = rows.where(F.col("tenant_id") == tenant)
        seen = (seen if kind == "evidence" else seen.where(visible)).select(F.col("id").alias("member_id")).distinct()
        parts.append(of_kind.join(seen, "member_id").select("context_id", "member_type", "member_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, key, similarity): the ``k`` stored vectors most like each query, itself left out; exact cosine.

    Queries are taken in blocks of bounded size; each block is multiplied with every stored batch where it lies, and
    only ``k`` candidates per query and batch go on to be ranked. Null and all-zero vectors are like nothing (0). Ties
    go to the smaller key.
    """
    spark = vectors.sparkSession
    numbered = cut(queries.select(F.col(key).alias("q"), F.col(vector).alias("v")).where(F.col(vector).isNotNull()))
    blocks = max(1, -(-numbered.count() // block))
    placed = cut(numbered.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(blocks))))
    out = None
    for b in range(blocks):
        part = placed.where(F.col("b") == b).select("q", "v").toPandas()
        if not len(part):
            continue
        ids, mat = part["q"].to_numpy(), _unit(part["v"])
        shared = spark.sparkContext.broadcast((ids, mat))  # one block: at most about ``block`` vectors

        def score(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, mat = shared.value
            for rows in batches:
                rows = rows[rows[vector].notna()]
                if not len(rows):
                    continue
                keys = rows[key].to_numpy()
                sims = mat @ _unit(rows[vector]).T
                sims[ids[:, None] == keys[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(keys, sims.shape), -sims), axis=1)[:, : min(k, sims.shape[1])]
                got = np.take_along_axis(sims, order, 1).ravel()
                found = pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), key: keys[order].ravel(), "similarity": got})
                yield found[np.isfinite(got)]

        schema = f"query_id long, {key} long, similarity double"
        near = vectors.select(key, vector).mapInPandas(score, schema)
        out = near if out is None else out.unionByName(near)
    if out is None:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, similarity double")
    # a rank up to k is limited in each task before the exchange
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "similarity")


def hash_embeddings(texts: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """(key, bucket, weight): term counts by hashed bucket, scaled to length one; only buckets that aren't zero.

    Each distinct token is hashed once and joined back; a text without tokens has no row.
    """
    said = texts.select(key, F.explode(embedding_tokens(F.coalesce(text, F.lit("")))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    placed = said.select("token").distinct().select("token", bucket(F.col("token"), dims).alias("bucket"))
    counts = said.join(placed, "token").groupBy(key, "bucket").agg(F.sum("n").cast("double").alias("n"))
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, key).select(key, "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def dense(sparse: DataFrame, key: str, dims: int = 64) -> DataFrame:
    """(key, embedding) of sparse (key, bucket, weight) rows."""
    held = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    return held.select(key, F.array(*[F.coalesce(F.try_element_at("m", F.lit(i)), F.lit(0.0)) for i in range(dims)]).alias("embedding"))


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)
