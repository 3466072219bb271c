"""Facts proposed from texts: patterns, model answers, and what is decided about each proposal."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions.text import clamp, make_id, slug
from mnemora.operators.identity import resolve
from mnemora.operators.mutations import provenance
from mnemora.operators.sequence import numbered
from mnemora.schema import PREDICATES, RELATIONS
from mnemora.session import cut

# The patterns of claims (subject, value) and of relationships (source, target).
CLAIM_PATTERNS = (
    r"(?im)(?:we chose|we selected|decision:)\s*([A-Za-z][\w\s-]+?)(?:\s+as\s+(.+?))?(?:\.|$)",
    r"(?im)([A-Za-z][\w\s-]+?)\s+(?:is|are)\s+([A-Za-z][\w\s-]+?)(?:\.|$)",
    r"(?im)([A-Za-z][\w\s-]+?)\s+has\s+role\s+([A-Za-z][\w\s-]+?)(?:\.|$)",
)
RELATION_PATTERNS = {
    "supersedes": r"(?im)(.+?)\s+supersedes\s+(.+?)(?:\.|$)",
    "caused_by": r"(?im)(.+?)\s+caused\s+by\s+(.+?)(?:\.|$)",
    "depends_on": r"(?im)(.+?)\s+depends\s+on\s+(.+?)(?:\.|$)",
    "contradicts": r"(?im)(.+?)\s+contradicts\s+(.+?)(?:\.|$)",
}
# Texts without these hold no match, and need no search.
_NEEDS = (r"(?i)we chose|we selected|decision:", r"(?i)\s(is|are)\s", r"(?i)has\s+role")
# The only places where a pattern can begin, so that each run of characters is gone through once and not
# once from each of its letters. What begins with a line's ``.+?`` begins where the line does or the match before ended;
# what begins with a letter and ``[\w\s-]+?``, at the first letter of such a run or after the match before.
_RUN = r"(?:(?<![\w\s-])|\G)[\d_\s-]*+"
_AT = ("", _RUN, _RUN)
_LINE = r"(?:^|\G)"
#: Matches after which a pattern stops; each pattern still gives its first.
CAP = 10


def _matches(text: Column, pattern: str, needs: str, at: str = "") -> Column:
    # the whole match once; its parts are read from it, not from the text again
    whole = F.regexp_extract_all(text, F.lit(f"(?m){at}({pattern})"), F.lit(1))

    def part(m: Column, group: int) -> Column:
        return F.regexp_replace(F.regexp_extract(m, pattern, group), r"^\s+|\s+$", "")

    found = F.transform(whole, lambda m: F.struct(part(m, 1).alias("a"), part(m, 2).alias("b"), F.concat(F.lit("Pattern match: "), F.substring(m, 1, 50)).alias("basis")))
    return F.when(text.rlike(needs), found).otherwise(F.array().cast("array<struct<a:string,b:string,basis:string>>"))


def _capped(lists: list[Column], cap: int = CAP) -> list[Column]:
    """Each list cut where the matches so far reach ``cap``; a list begun at the cap keeps one."""
    out, so_far = [], F.lit(0)
    for x in lists:
        taken = F.slice(x, F.lit(1), F.greatest(F.lit(1), F.lit(cap) - so_far))
        so_far = so_far + F.size(taken)
        out.append(taken)
    return out


def _labelled(matches: Column, name: str, value: int | str) -> Column:
    return F.transform(matches, lambda v, i: F.struct(F.lit(value).alias(name), i.alias("position"), v["a"].alias("a"), v["b"].alias("b"), v["basis"].alias("basis")))


def lines(text: Column) -> Column:
    """Any line end as a line feed, so that a pattern's end of line means one thing."""
    return F.regexp_replace(text, "\r\n?", "\n")


def extract_claims(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pattern_no, position, subject_name, predicate, object_or_value, confidence, basis) of each claim in a text.

    Null and matchless texts give no rows; a value left out is ``true``. Patterns stop per text at ten claims in all,
    each giving one at least if it has one.
    """
    rows = texts.select(key, lines(F.col(text)).alias("t"))
    staged = rows.select(key, *[_matches(F.col("t"), p, n, at).alias(f"m{i}") for i, (p, n, at) in enumerate(zip(CLAIM_PATTERNS, _NEEDS, _AT, strict=True))])
    parts = _capped([F.col(f"m{i}") for i in range(len(CLAIM_PATTERNS))])
    flat = F.flatten(F.array(*[_labelled(x, "pattern_no", n) for n, x in enumerate(parts)]))
    found = staged.select(key, F.explode(flat).alias("v"))
    value = F.when(F.col("v.b") == "", F.lit("true")).otherwise(F.col("v.b"))
    return found.select(key, "v.pattern_no", "v.position", F.col("v.a").alias("subject_name"), F.lit("has_role").alias("predicate"), value.alias("object_or_value"), F.lit(0.5).alias("confidence"), "v.basis")


def extract_relationships(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, source_name, relation_type, target_name, confidence, basis), as ``extract_claims``."""
    rows = texts.select(key, lines(F.col(text)).alias("t"))
    needs = {k: "(?i)" + k.replace("_", r"\s+") for k in RELATION_PATTERNS}
    staged = rows.select(key, *[F.filter(_matches(F.col("t"), p, needs[k], _LINE), lambda v: (v["a"] != "") & (v["b"] != "")).alias(k) for k, p in RELATION_PATTERNS.items()])
    parts = _capped([F.col(k) for k in RELATION_PATTERNS])
    flat = F.flatten(F.array(*[_labelled(x, "relation_type", k) for k, x in zip(RELATION_PATTERNS, parts, strict=True)]))
    found = staged.select(key, F.explode(flat).alias("v"))
    return found.select(key, "v.relation_type", "v.position", F.col("v.a").alias("source_name"), F.col("v.b").alias("target_name"), F.lit(0.5).alias("confidence"), "v.basis")


# Model answers -----------------------------------------------------------------------------------------------------

_ANSWER = (
    "claims array<struct<subjectName:string,predicate:string,objectOrValue:string,confidence:double,basis:string>>,"
    "relationships array<struct<sourceName:string,relationType:string,targetName:string,confidence:double,basis:string>>"
)


def usable_claims(claims: DataFrame) -> DataFrame:
    """Claims of a model that can be used: a subject's name that isn't blank, a known predicate; confidence in 0..1.

    Takes and gives subject_name, predicate, object_or_value, confidence, basis beside any other columns.
    """
    name = F.regexp_replace("subject_name", r"^\s+|\s+$", "")
    kept = claims.withColumn("subject_name", name).where((F.col("subject_name") != "") & F.col("predicate").isin(*PREDICATES))
    return kept.withColumn("confidence", clamp(F.col("confidence").cast("double")))


def parse_answers(answers: DataFrame, key: str, body: str, style: str = "response") -> DataFrame:
    """(key, kind, a, relation, b, confidence, basis, error) of model answers in JSON: usable facts, or what is wrong.

    ``style``: ``response`` for an envelope whose ``response`` is the inner JSON text, ``choices`` for one whose
    ``choices[0].message.content`` is. Facts lose what can't be used; a broken envelope or inner text gives one row
    whose error says so.
    """
    envelope = "struct<response:string,error:string,choices:array<struct<message:struct<content:string>>>>"
    outer = answers.select(key, F.col(body).alias("raw"), F.from_json(body, envelope[7:-1].replace("response:", "response ").replace("error:", "error ").replace("choices:", "choices ")).alias("o"))
    inner = F.col("o.response") if style == "response" else F.get("o.choices", F.lit(0))["message"]["content"]
    broken = F.col("raw").isNull() | ~F.coalesce(F.col("raw").rlike(r"^\s*\{"), F.lit(False)) | F.expr("try_parse_json(raw) IS NULL")
    read = outer.select(key, "raw", broken.alias("broken"), F.col("o.error").alias("said"), inner.alias("inner"))
    read = read.withColumn("bad", F.col("inner").isNotNull() & F.expr("try_parse_json(inner) IS NULL"))
    error = (
        F.when(F.col("broken"), F.lit("invalid JSON response")).when(F.coalesce(F.col("said"), F.lit("")) != "", F.col("said"))
        .when(F.col("inner").isNull(), F.lit("response has no generated text")).when(F.col("bad"), F.lit("model returned invalid JSON"))
    )
    staged = read.select(key, error.alias("error"), F.from_json("inner", _ANSWER).alias("x"))

    def side(rows: str, kind: str, a: str, rel: str, b: str, known: tuple[str, ...]) -> DataFrame:
        one = staged.where(F.col("error").isNull()).select(key, F.explode(f"x.{rows}").alias("v"))
        trimmed = one.select(key, F.lit(kind).alias("kind"), F.trim(f"v.{a}").alias("a"), F.col(f"v.{rel}").alias("relation"), F.trim(f"v.{b}").alias("b"), clamp(F.col("v.confidence")).alias("confidence"), "v.basis", F.lit(None).cast("string").alias("error"))
        usable = (F.col("a") != "") & F.col("relation").isin(*known)
        return trimmed.where(usable if kind == "claim" else usable & (F.col("b") != ""))

    wrong = staged.where(F.col("error").isNotNull()).select(key, F.lit("error").alias("kind"), *[F.lit(None).cast("string").alias(c) for c in ("a", "relation", "b")], F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("basis"), "error")
    claims = side("claims", "claim", "subjectName", "predicate", "objectOrValue", PREDICATES)
    return claims.unionByName(side("relationships", "relationship", "sourceName", "relationType", "targetName", RELATIONS)).unionByName(wrong)


def ask_model(texts: DataFrame, key: str, text: str, client: Callable[[str], str]) -> DataFrame:
    """(key, body): what ``client`` answers to each text, one call a row where the row lies; a failed call gives the
    error as an envelope, so that one text's failure is one row of ``parse_answers``. Null texts are not asked."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bodies = []
            for t in b[text]:
                try:
                    bodies.append(client(t))
                except Exception as x:  # noqa: BLE001
                    bodies.append(json.dumps({"error": f"request failed: {x}"}))
            yield pd.DataFrame({key: b[key], "body": bodies})

    return texts.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"`{key}` {kind}, body string")


def parse_embeddings(answers: DataFrame, key: str, body: str) -> DataFrame:
    """(key, embedding, dimensions, error) of model answers holding ``embedding`` or ``embeddings[0]``."""
    read = answers.select(key, F.from_json(body, "embedding array<double>, embeddings array<array<double>>").alias("x"))
    vector = F.coalesce("x.embedding", F.get("x.embeddings", F.lit(0)))
    staged = read.select(key, vector.alias("embedding"))
    bad = F.col("embedding").isNull() | (F.size("embedding") == 0) | F.exists("embedding", lambda v: v.isNull())
    return staged.select(key, F.when(~bad, F.col("embedding")).alias("embedding"), F.when(~bad, F.size("embedding")).alias("dimensions"), F.when(bad, F.lit("response has no embedding")).alias("error"))


# Proposals, decisions, policies ------------------------------------------------------------------------------------


def verdicts(candidates: DataFrame, claims_before: int = 0) -> DataFrame:
    """``candidates`` with verdict and reasoning.

    Takes ``type``, ``evidence_refs`` and ``ord``, the order in which proposals are handled. Without evidence a
    proposal is rejected, with two pieces or more accepted; with one, a claim is escalated once any claim is held:
    the claims held at the start, or an earlier accepted one. As an accepted claim makes every later single-evidence
    claim escalate, only the first accepted one matters: one aggregate, no ordered pass over all rows.
    """
    refs = F.coalesce(F.size(F.filter("evidence_refs", lambda r: r.isNotNull())), F.lit(0))
    staged = candidates.withColumn("refs", refs)
    claim = F.col("type") == "ClaimCandidate"
    first = staged.where(claim & (F.col("refs") > 0)).agg(F.min("ord")).first()[0]
    taken = F.lit(claims_before > 0) | F.coalesce(F.col("ord") > F.lit(first), F.lit(False))
    verdict = F.when(F.col("refs") == 0, F.lit("Reject")).when(F.col("refs") >= 2, F.lit("Accept")).when(claim & taken, F.lit("Escalate")).otherwise(F.lit("Accept"))
    reasons = (
        F.when(F.col("refs") == 0, F.lit("No evidence attached")).when(F.col("refs") >= 2, F.format_string("%d evidence refs", "refs"))
        .when(F.col("verdict") == "Escalate", F.lit("Single evidence with existing claims — needs review")).otherwise(F.lit("Single evidence, no conflicts"))
    )
    return staged.withColumn("verdict", verdict).withColumn("reasoning", reasons).drop("refs")


def actions(decisions: DataFrame) -> DataFrame:
    """``decisions`` with what follows from their verdict."""
    action = F.when(F.col("verdict") == "Accept", F.lit("Allow")).when(F.col("verdict") == "Escalate", F.lit("Quarantine")).otherwise(F.lit("Deny"))
    return decisions.withColumn("action", action)


def decide(candidates: DataFrame, claims_before: int = 0) -> DataFrame:
    """``candidates`` with verdict, reasoning and action."""
    return actions(verdicts(candidates, claims_before))


def undecided(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """``candidates`` without a decision yet: a verdict is given once."""
    given = decisions.select(F.col("candidate_ref").alias("id")).where(F.col("id").isNotNull()).distinct()
    return candidates.join(given, "id", "left_anti")


def by_patterns(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and relationships of (evidence_id, content), by the fixed patterns."""
    return extract_claims(texts, "evidence_id", "content"), extract_relationships(texts, "evidence_id", "content")


def extracted(texts: DataFrame, claims: DataFrame, relationships: DataFrame, objects: DataFrame, aliases: DataFrame, claims_before: int, verdict: Callable = verdicts, action: Callable = actions, tag: int = 0) -> dict[str, DataFrame]:
    """What a batch of extracted facts changes: rows of candidates, decisions, policies, objects, claims, relationships,
    provenance, ``events`` for the journal (ord, step) and ``counts`` per evidence.

    ``texts``: (ord, evidence_id, content, tenant_id), handled by ``ord`` (then evidence), each text's claims before
    its relationships, in order of pattern and position. Allowed facts are about the objects of those very names, of
    several the one recorded first; names without one become new objects, once each, where they come first. Names that
    make the same id as an object held or an earlier name's are that object. One pass of joins; facts of one text or
    of all, no row comes to the driver but one aggregate of the verdicts.
    """
    each = texts.select(F.col("ord").alias("text_ord"), "evidence_id", "tenant_id").distinct()
    basis = F.col("basis") if "basis" in claims.columns else F.lit(None).cast("string")
    c = claims.select(
        "evidence_id", F.lit("ClaimCandidate").alias("type"), F.col("pattern_no").cast("string").alias("part"), "position", F.col("subject_name").alias("a"),
        F.col("predicate").alias("how"), F.col("object_or_value").alias("b"), "confidence", basis.alias("basis"),
    )
    basis = F.col("basis") if "basis" in relationships.columns else F.lit(None).cast("string")
    order = F.create_map(*[F.lit(x) for i, k in enumerate(RELATION_PATTERNS) for x in (k, str(i))])
    r = relationships.select(
        "evidence_id", F.lit("RelationshipCandidate").alias("type"), F.coalesce(F.try_element_at(order, F.col("relation_type")), F.lit("9")).alias("part"), "position",
        F.col("source_name").alias("a"), F.col("relation_type").alias("how"), F.col("target_name").alias("b"), "confidence", basis.alias("basis"),
    )
    facts = c.unionByName(r).join(each, "evidence_id")
    ranged = numbered(facts, ["text_ord", "evidence_id", "type", "part", "position", "a", "how", "b"], "ord")
    payload = F.to_json(F.struct("type", "a", "how", "b", "confidence", "basis"))
    staged = ranged.withColumn("evidence_refs", F.array("evidence_id")).withColumn("payload", payload)
    staged = staged.withColumn("candidate_id", F.concat_ws(":", F.lit("cand"), "type", F.lit(str(tag)), F.col("ord").cast("string")))
    decided = cut(action(verdict(staged.withColumnRenamed("candidate_id", "id"), claims_before)))
    allowed = decided.where(F.col("action") == "Allow")

    # names: held objects of that very name, else the object whose id the name makes
    sides = F.array(F.struct(F.lit(1).alias("side"), F.col("a").alias("name")), F.struct(F.lit(2).alias("side"), F.when(F.col("type") == "RelationshipCandidate", F.col("b")).alias("name")))
    named = allowed.select("ord", "tenant_id", F.inline(sides)).where(F.col("name").isNotNull())
    first = named.groupBy("name").agg(F.min(F.struct("ord", "side", "tenant_id")).alias("f"))
    held = objects.where(F.col("name").isNotNull()).groupBy("name").agg(F.min(F.struct("_first_seq", "id")).alias("o")).select("name", F.col("o.id").alias("held"))
    keyed = first.join(held, "name", "left").withColumn("made", make_id("obj", slug(F.col("name"))))
    live = objects.where(F.coalesce(F.col("lifecycle_state") != "merged", F.lit(True))).select(F.col("id").alias("made"), F.lit(True).alias("there")).distinct()
    keyed = cut(keyed.join(live, "made", "left"))
    fresh = keyed.where(F.col("held").isNull() & F.col("there").isNull()).groupBy("made").agg(F.min(F.struct("f", "name")).alias("v"))
    new = fresh.select(
        F.col("made").alias("id"), F.lit("entity").alias("type"), "v.name", F.array().cast("array<string>").alias("aliases"), F.lit("active").alias("lifecycle_state"),
        F.lit("internal").alias("sensitivity"), F.col("v.f.tenant_id").alias("tenant_id"), F.col("v.f.ord").alias("ord"), F.col("v.f.side").alias("side"),
    )
    stands = resolve(keyed.select("name", F.coalesce("held", "made").alias("object_id")), "object_id", aliases)

    level = F.struct(F.lit("weak").alias("level"), F.lit(1).alias("evidence_count"), F.lit(0).alias("disagreeing_count"))
    common = ("ord", "evidence_refs", F.lit("active").alias("lifecycle_state"), level.alias("support_state"), "confidence", F.lit("internal").alias("sensitivity"), "tenant_id")
    a = allowed.join(stands.select(F.col("name").alias("a"), F.col("object_id").alias("a_id")), "a")
    made = a.where(F.col("type") == "ClaimCandidate").select(
        make_id("claim", F.col("a_id"), F.col("how")).alias("id"), F.col("a_id").alias("subject_id"), F.col("how").alias("predicate"), F.col("b").alias("object_or_value"), *common
    )
    linked = a.where(F.col("type") == "RelationshipCandidate").join(stands.select(F.col("name").alias("b"), F.col("object_id").alias("b_id")), "b").select(
        make_id("rel", F.col("a_id"), F.col("how"), F.col("b_id")).alias("id"), F.col("a_id").alias("source_object"), F.col("how").alias("relation_type"), F.col("b_id").alias("target_object"), *common
    )
    proof = provenance(made, "claim").unionByName(provenance(linked, "relationship"))

    def event(rows: DataFrame, step: int | Column, kind: str, operation: str, key: str | Column = "id") -> DataFrame:
        return rows.select("ord", (step if isinstance(step, Column) else F.lit(step)).alias("step"), F.lit(kind).alias("entity_type"), (F.col(key) if isinstance(key, str) else key).alias("entity_id"), F.lit(operation).alias("operation"))

    decision, policy = F.concat(F.lit("dec:"), "id"), F.concat(F.lit("pol:dec:"), "id")
    events = event(decided, 0, "candidate", "propose").unionByName(event(decided, 1, "decision", "decide", decision)).unionByName(event(decided, 2, "policy", "apply_policy", policy))
    events = events.unionByName(event(new, F.col("side") + 2, "object", "create")).unionByName(event(made, 5, "claim", "create")).unionByName(event(linked, 5, "relationship", "create"))
    return {
        "candidates": decided.select("ord", "id", "type", "payload", "evidence_refs"),
        "decisions": decided.select("ord", decision.alias("id"), F.col("id").alias("candidate_ref"), "verdict", "reasoning", F.lit("deterministic").alias("decision_model")),
        "policies": decided.select("ord", policy.alias("id"), decision.alias("decision_ref"), "action"),
        "objects": new, "claims": made, "relationships": linked, "provenance": proof, "events": events, "counts": outcome_counts(decided, "evidence_id"),
    }


def outcome_counts(decided: DataFrame, key: str) -> DataFrame:
    """Proposals made, accepted, quarantined and rejected per ``key``."""
    return decided.groupBy(key).agg(F.count("*").alias("candidates"), *[F.count_if(F.col("action") == a).alias(n) for a, n in (("Allow", "accepted"), ("Quarantine", "quarantined"), ("Deny", "rejected"))])
