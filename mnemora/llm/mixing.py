"""Mixing sources to target shares of all tokens (problem 7).

Every document has a fixed hash; a source's budget becomes a threshold on it, found from histograms of tokens by source
and hash bucket: the bucket in which the budget runs out is refined, and only that one. No document is sorted, and a
larger budget's threshold is never smaller, so mixes are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.llm.tokens import TOKENIZER, token_counts
from mnemora.session import cut

#: Bits of the hash that one histogram tells apart, and the histograms taken: 4 x 10 of the 60 bits used.
BITS, LEVELS = 10, 4
SALTS = 8
#: Sources in the targets that are broadcast at most.
BROADCAST = 100_000


def source_name(text: Column) -> Column:
    """A source as the targets write it: small letters, no outer blanks, ``-`` for ``_``."""
    return F.replace(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), F.lit("_"), F.lit("-"))


def _draw() -> Column:
    return F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("mix")), 4)


def _beside(rows: DataFrame, sources: DataFrame, salts: int) -> DataFrame:
    """``rows`` beside the row of their source; a source that holds a third of all rows is spread over ``salts``."""
    salted = rows.withColumn("salt", F.pmod("draw", F.lit(salts)).cast("int"))
    return salted.join(sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["source_name", "salt"]).drop("salt")


def plan_mix(rows: DataFrame, targets: DataFrame, total: float | None = None, salts: int = SALTS) -> DataFrame:
    """(source_name, copies, threshold) of each source of ``targets`` (source_name, target_share, max_repeats) that gives
    anything: all its (source_name, draw, n_tokens) rows ``copies`` times, those drawn under ``threshold`` once more.

    ``total`` tokens, or the most at which no source falls short. A source with fewer tokens than its budget asks for,
    all repeats used, gives what it has. A source without any token gives nothing, and the others' targets are scaled
    up to one. Thresholds are found bucket by bucket: at most 1,024 sums a source and level, of the rows in its
    boundary bucket of the level before.
    """
    sums = rows.groupBy("source_name").agg(F.sum("n_tokens").alias("tokens"))
    there = cut(targets.where("target_share > 0 AND max_repeats > 0").join(sums, "source_name"))
    scale = there.agg(F.sum("target_share")).first()[0] or 1.0
    room = F.col("tokens") * F.col("max_repeats")
    if total is None:
        total = there.agg(F.min(room * F.lit(scale) / F.col("target_share"))).first()[0] or 0.0
    budget = F.least(F.lit(float(total)) * F.col("target_share") / F.lit(scale), room.cast("double"))
    planned = there.select("source_name", "tokens", budget.alias("budget")).withColumn("copies", F.floor(F.col("budget") / F.col("tokens")))
    planned = planned.select("source_name", "copies", (F.col("budget") - F.col("copies") * F.col("tokens")).alias("rest"))
    state = cut(planned.select("*", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("threshold"), (F.col("rest") > 0).alias("open")))
    for level in range(LEVELS):
        low = 60 - BITS * (level + 1)
        at_work = state.where("open").select("source_name", "prefix", F.col("rest").alias("wanted"))
        here = _beside(rows, at_work, salts)
        if level:
            here = here.where(F.shiftrightunsigned("draw", low + BITS) == F.col("prefix"))
        bucket = F.shiftrightunsigned("draw", low).bitwiseAND(F.lit((1 << BITS) - 1))
        counted = here.groupBy("source_name", "wanted", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("n"))
        # at most 1,024 rows a source
        upto = F.sum("n").over(Window.partitionBy("source_name").orderBy("bucket"))
        run = counted.withColumn("upto", upto)
        over = F.col("upto") > F.col("wanted")
        first = run.groupBy("source_name").agg(
            F.min(F.when(over, F.struct("bucket", "n"))).alias("first"), F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0)).alias("taken")
        )
        joined = state.join(first, "source_name", "left").withColumn("at", F.coalesce("first.bucket", F.lit((1 << BITS) - 1)))
        prefix = F.shiftleft("prefix", BITS).bitwiseOR(F.col("at"))
        left = F.col("rest") - F.col("taken")
        end = F.shiftleft(prefix + F.when(F.col("first").isNull(), F.lit(1)).otherwise(F.lit(0)), low)
        if level == LEVELS - 1:
            # the last bucket, a document as a rule, when it misses less than its absence
            end = end + F.when(F.col("first").isNotNull() & (left > 0) & (F.col("first.n") - left < left), F.lit(1 << low)).otherwise(F.lit(0))
        state = cut(
            joined.select(
                "source_name", "copies", F.when(F.col("open"), left).otherwise(F.col("rest")).alias("rest"), F.when(F.col("open"), prefix).otherwise(F.col("prefix")).alias("prefix"),
                F.when(F.col("open"), end).otherwise(F.col("threshold")).alias("threshold"), (F.col("open") & F.col("first").isNotNull() & (left > 0)).alias("open"),
            )
        )
    return state.select("source_name", "copies", "threshold")


def mix(documents: DataFrame, mix_targets: DataFrame, total: float | None = None, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(mix, shares). Mix: (doc_id, source_name, n_tokens, copies) of each document taken, copies at most max_repeats.

    Shares, a row a source of the targets: target_share, tokens, actual_share of all tokens in the mix, documents and
    the most copies of one. Documents of other sources or none, and those without tokens, are not taken. Target rows
    of one name are added up, with the greatest max_repeats; a null or negative share or cap counts as 0.
    """
    named = mix_targets.where(F.col("source_name").isNotNull()).groupBy(source_name(F.col("source_name")).alias("source_name"))
    share, most = F.coalesce(F.sum(F.greatest(F.col("target_share"), F.lit(0.0))), F.lit(0.0)), F.greatest(F.max("max_repeats"), F.lit(0))
    targets = cut(named.agg(share.alias("target_share"), F.coalesce(most, F.lit(0)).cast("int").alias("max_repeats")))
    named_so, names = documents.withColumn("source_name", source_name(F.col("source"))), targets.select("source_name")
    if targets.count() <= BROADCAST:
        sized = token_counts(named_so.join(F.broadcast(names), "source_name", "left_semi"), path, "source_name")
    else:  # no text is shuffled: those of other sources are measured too, and left out then
        sized = token_counts(named_so, path, "source_name").join(names, "source_name", "left_semi")
    rows = cut(sized.where(F.col("n_tokens") > 0).withColumn("draw", _draw()))
    copies = F.col("copies") + (F.col("draw") < F.col("threshold")).cast("int")
    taken = _beside(rows, plan_mix(rows, targets, total), SALTS).select("doc_id", "source_name", "n_tokens", copies.cast("int").alias("copies")).where(F.col("copies") > 0)
    given = taken.groupBy("source_name").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    beside = targets.join(given, "source_name", "left").fillna(0, ["documents", "tokens", "most_copies"])
    # one row a source of the targets, so the window over all of them is small
    whole = F.sum("tokens").over(Window.partitionBy())
    actual = F.when(whole > 0, F.col("tokens") / whole).otherwise(F.lit(0.0))
    shares = beside.select("source_name", "target_share", "max_repeats", "documents", "tokens", "most_copies", actual.alias("actual_share"))
    return taken, shares
