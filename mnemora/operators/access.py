"""Who may see what: tenants, sensitivity levels, purposes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions.text import sensitivity_rank


def in_tenant(tenant: str) -> Column:
    return F.col("tenant_id") == tenant


def within(level: Column, most: str | None, default: str = "restricted") -> Column:
    """Whether a row's sensitivity is at most ``most``; unknown levels are internal."""
    return sensitivity_rank(level) <= sensitivity_rank(F.lit(most or default))


def context_gate(contexts: DataFrame, most: str | None) -> DataFrame:
    """``contexts`` with ``allowed``: at most ``most``, which is internal if not given."""
    return contexts.withColumn("allowed", within(F.col("sensitivity"), most, "internal"))


def agent_gate(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """(…request, allowed, reason) of requests (agent_id, tenant_id, sensitivity, purpose).

    The first policy (by ``ord``) of agent and tenant decides: none denies, a level above its limit denies, and a
    purpose that isn't listed denies where the policy lists purposes and the request names one.
    """
    first = policies.groupBy("agent_id", "tenant_id").agg(F.min(F.struct("ord", "max_sensitivity", "allowed_purposes")).alias("p"))
    joined = requests.join(first, ["agent_id", "tenant_id"], "left")
    purposed = F.col("p.allowed_purposes").isNotNull() & (F.coalesce("purpose", F.lit("")) != "")
    reason = (
        F.when(F.col("p").isNull(), F.lit("no policy for agent and tenant"))
        .when(~(sensitivity_rank(F.col("sensitivity")) <= sensitivity_rank(F.col("p.max_sensitivity"))), F.lit("sensitivity above policy limit"))
        .when(purposed & ~F.array_contains("p.allowed_purposes", F.col("purpose")), F.lit("purpose not allowed"))
        .otherwise(F.lit("allowed"))
    )
    return joined.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "allowed").drop("p")
