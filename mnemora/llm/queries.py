"""Queries of the text problems, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F

from mnemora.llm import langid, linking, mixing, packing
from mnemora.llm.shortforms import ANYONE
from mnemora.llm.tokens import TOKENIZER, token_counts
from mnemora.session import cut
from mnemora.sources.tables import current_objects, table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return linking.linked_names(table(spark, d, "objects"), table(spark, d, "extracted_claims"))


def p6_windows(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))[0]


def p6_unused(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))[1]


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def _languages(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    model = langid.fit(langid.training_sample(documents, table(spark, d, "languages")))
    return langid.document_languages(documents, model)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.wrong_or_mixed(_languages(spark, d))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d)


def _reduced(name: str) -> Column:
    """A name's ASCII letters and digits in small letters."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def _named(spark: SparkSession, d: str) -> DataFrame:
    """(key, name, mention) of objects and mentions."""
    objects = current_objects(table(spark, d, "objects"), "name").select(F.col("id").alias("key"), "name", F.lit(False).alias("mention"))
    mentions = table(spark, d, "extracted_claims").select(F.col("mention_id").alias("key"), F.col("subject_name").alias("name"), F.lit(True).alias("mention"))
    return objects.unionByName(mentions).where(F.col("key").isNotNull() & F.col("name").isNotNull()).distinct()


def p4_account(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the pairs found, counted: nothing."""
    found = p4_found(spark, d)
    a, b = (_named(spark, d).select(F.col("key").alias(f"key_{x}"), F.col("name").alias(f"name_{x}"), F.col("mention").alias(f"mention_{x}")) for x in "ab")
    rows = found.join(a, "key_a", "left").join(b, "key_b", "left")
    wrong = {
        "out_of_order": F.col("key_a") >= F.col("key_b"), "of_same_name": F.col("name_a") == F.col("name_b"), "of_two_mentions": F.col("mention_a") & F.col("mention_b"), "of_unknown": F.col("name_a").isNull() | F.col("name_b").isNull()
    }
    return rows.agg(*[F.count_if(F.coalesce(w, F.lit(False))).alias(n) for n, w in wrong.items()], (F.count("*") - F.countDistinct("key_a", "key_b")).alias("repeated"))


def p4_same_letters(spark: SparkSession, d: str) -> DataFrame:
    """Of the pairs found those whose names differ in case, blanks and marks only."""
    found = p4_found(spark, d)
    a, b = (_named(spark, d).select(F.col("key").alias(f"key_{x}"), _reduced("name").alias(f"n_{x}")) for x in "ab")
    return found.join(a, "key_a").join(b, "key_b").where(F.col("n_a") == F.col("n_b")).select("key_a", "key_b")


def p6_account(spark: SparkSession, d: str) -> DataFrame:
    """How many texts have a place, and what is wrong with the windows, counted: nothing."""
    placed, report = packing.pack_documents(table(spark, d, "documents"))
    windows = placed.groupBy("window_no").agg(
        F.sum("n_tokens").alias("tokens"), F.max("window_tokens").alias("said"), F.count("*").alias("n"), F.max("position").alias("last"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"),
    )
    bad = windows.agg(
        F.count_if(F.col("tokens") > packing.CAPACITY).alias("overfull"), F.count_if((F.col("tokens") != F.col("said")) | (F.col("n") != F.col("last") + 1) | (F.col("end") != F.col("tokens"))).alias("miscounted"),
        F.count("*").alias("windows"),
    )
    texts = placed.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.countDistinct("piece_no").alias("pieces"))
    split = texts.agg(F.count("*").alias("texts"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= packing.CAPACITY)).alias("split_needlessly"), F.count_if(F.col("n") != F.col("pieces")).alias("placed_twice"))
    one = F.lit(1).alias("k")
    said = report.select(one, F.col("windows").alias("reported"), "windows_needed")
    joined = bad.withColumn("k", one).join(split.withColumn("k", one), "k").join(said, "k")
    return joined.select("texts", "overfull", "miscounted", "split_needlessly", "placed_twice", (F.col("reported") - F.col("windows")).alias("unreported"), (F.col("windows") > 1.1 * F.col("windows_needed") + 1).alias("wasteful"))


def p7_account(spark: SparkSession, d: str) -> DataFrame:
    """Per source of the targets whether it has texts, whether a text is used too often, and whether its tokens miss
    its budget by more than one text."""
    docs = table(spark, d, "documents")
    _, shares = mixing.mix(docs, table(spark, d, "mix_targets"))
    sized = token_counts(docs.withColumn("source_name", mixing.source_name(F.col("source"))), TOKENIZER, "source_name")
    held = sized.where("n_tokens > 0").groupBy("source_name").agg(F.sum("n_tokens").alias("all"), F.max("n_tokens").alias("largest"))
    rows = cut(shares.join(held, "source_name", "left"))
    gives = F.col("all").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    scale = rows.where(gives).agg(F.sum("target_share")).first()[0] or 1.0
    total = rows.where(gives).agg(F.min(F.col("all") * F.col("max_repeats") * F.lit(scale) / F.col("target_share"))).first()[0] or 0.0
    off = F.coalesce(gives & (F.abs(F.col("tokens") - F.lit(total) * F.col("target_share") / F.lit(scale)) > F.col("largest")), F.lit(False))
    return rows.select("source_name", "target_share", gives.alias("gives"), (F.col("most_copies") > F.col("max_repeats")).alias("over_cap"), off.alias("off_target"))


def p8_account(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the languages found, counted: nothing."""
    found = _languages(spark, d)
    codes = table(spark, d, "languages").select(F.lower("lang_code").alias("lang"), F.lit(True).alias("known")).distinct()
    after = found.where("seg_no > 0").select("doc_id", (F.col("seg_no") - 1).alias("seg_no"), F.col("lang").alias("after"))
    rows = found.join(codes, "lang", "left").join(after, ["doc_id", "seg_no"], "left")
    docs = found.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max("n_segments").alias("segments"), F.count_if(F.col("seg_no") == 0).alias("mains"), F.sum(F.when(F.col("seg_no") == 0, F.col("letters"))).alias("main"), F.max(F.when(F.col("seg_no") > 0, F.col("letters"))).alias("longest"),
    )
    one = F.lit(1).alias("k")
    a = rows.agg(F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if((F.col("seg_no") > 0) & (F.col("after") == F.col("lang"))).alias("not_merged"), F.count_if(~F.col("confidence").between(0, 1.0000001)).alias("unsure"))
    b = docs.agg(F.count_if((F.col("n") != F.col("segments") + 1) | (F.col("mains") != 1)).alias("incomplete"), F.count_if(F.col("main") < F.col("longest")).alias("not_main"))
    right = langid.wrong_or_mixed(found).where("seg_no = 0").join(table(spark, d, "documents").select("doc_id", langid.code_of(F.col("lang")).alias("label")), "doc_id").agg(F.count_if(F.col("label") == F.col("lang")).alias("right_but_listed"))
    return a.withColumn("k", one).join(b.withColumn("k", one), "k").join(right.withColumn("k", one), "k").drop("k")


QUERIES = {f.__name__: f for f in (p4_found, p4_account, p4_same_letters, p6_windows, p6_unused, p6_account, p7_mix, p7_shares, p7_account, p8_found, p8_languages, p8_account)}

_VAGUE = "(" + ", ".join(f"'{w}'" for w in sorted(ANYONE)) + ")"
SQL: dict[str, str] = {
    "p4_account": "SELECT 0 AS out_of_order, 0 AS of_same_name, 0 AS of_two_mentions, 0 AS of_unknown, 0 AS repeated",
    "p4_same_letters": rf"""WITH o AS (SELECT id AS key, arg_max(name, updated_at) AS name, arg_max(lower(trim(type)), updated_at) AS type FROM objects WHERE id IS NOT NULL GROUP BY id),
shut AS (SELECT DISTINCT name FROM o WHERE type IN ('decision', 'incident')),
n AS (SELECT key, name, false AS mention FROM o UNION SELECT DISTINCT mention_id, subject_name, true FROM extracted_claims WHERE mention_id IS NOT NULL),
r AS (SELECT key, name, mention, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS letters FROM n
  WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM shut WHERE name IS NOT NULL)
    AND len(list_filter(regexp_split_to_array(trim(lower(name)), '\s+'), lambda w: w NOT IN {_VAGUE})) > 0)
SELECT a.key AS key_a, b.key AS key_b FROM r a JOIN r b ON a.letters = b.letters AND a.key < b.key AND a.name <> b.name WHERE a.letters <> '' AND NOT (a.mention AND b.mention)""",
    "p6_account": "SELECT count(DISTINCT doc_id) AS texts, 0 AS overfull, 0 AS miscounted, 0 AS split_needlessly, 0 AS placed_twice, 0 AS unreported, false AS wasteful FROM documents WHERE text <> ''",
    "p7_account": r"""WITH t AS (SELECT replace(lower(regexp_replace(source_name, '^\s+|\s+$', '', 'g')), '_', '-') AS source_name, sum(greatest(target_share, 0)) AS target_share, max(max_repeats) AS r FROM mix_targets WHERE source_name IS NOT NULL GROUP BY 1),
s AS (SELECT DISTINCT replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '_', '-') AS source_name FROM documents WHERE text <> '')
SELECT t.source_name, target_share, s.source_name IS NOT NULL AND target_share > 0 AND r > 0 AS gives, false AS over_cap, false AS off_target FROM t LEFT JOIN s USING (source_name)""",
    "p8_account": "SELECT 0 AS unknown, 0 AS not_merged, 0 AS unsure, 0 AS incomplete, 0 AS not_main, 0 AS right_but_listed",
}
