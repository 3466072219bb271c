"""Pigeonhole segment join of strings, and the linking of name spellings built on it (problem 4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.llm.names import SegmentIndex, Words, looks_short, read, taught, words
from mnemora.llm.shortforms import ORNAMENTS, SHORT
from mnemora.session import cut
from mnemora.sources.tables import current_objects

SALTS = 8
#: Edits allowed from so many letters on.
EDITS = ((5, 1), (32, 2))
#: A word is common from so many distinctive words beside it; what is taught, from so many objects. Each is also at
#: least one 50,000th of all such pairs, so no more than 50,000 words can be either, however many names there are.
SPREAD, TAUGHT, SHARE = 5, 3, 50_000
#: A short form stands beside this share, at least, of its distinctive words in full too; a meaning is no slip of the
#: pen from this share of all that its short form is taught to mean.
ALIKE, RARELY = 0.4, 0.05


def _swapped(a: Column, b: Column) -> Column:
    """Whether equally long strings differ in two neighbouring letters changing places only."""
    d = F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: a.substr(i, F.lit(1)) != b.substr(i, F.lit(1)))

    def letter(s: Column, i: int) -> Column:
        return s.substr(F.get(d, F.lit(i)), F.lit(1))

    return (F.size(d) == 2) & (F.get(d, F.lit(1)) == F.get(d, F.lit(0)) + 1) & (letter(a, 0) == letter(b, 1)) & (letter(a, 1) == letter(b, 0))


def similar_strings(strings: DataFrame, column: str, k: int = 1, within: tuple[str, ...] = ()) -> DataFrame:
    """``similar_by_length`` with ``k`` edits at any length; strings of k letters or fewer have no partners but themselves."""
    return similar_by_length(strings, column, within, ((k + 1, k),))


def similar_by_length(strings: DataFrame, column: str, within: tuple[str, ...] = (), edits: tuple[tuple[int, int], ...] = EDITS) -> DataFrame:
    """(*within, a, b, edits): every pair of strings of ``column``, equal in ``within``, as few edits apart as the
    shorter one's length allows, in both orders; each string beside itself too, at 0 edits.

    ``edits``: (from so many letters on, k), growing; shorter strings have no partners but themselves. A string is cut
    into k + 1 segments, of which k edits leave one as it is. Segments go into an inverted index by (``within``, length,
    number, text); each string looks up, for each length up to k shorter, its substrings at the few positions to which
    a segment can have moved (multi-match-aware selection). What is found together is verified by edit distance within
    a band of k. For k = 1 a swap of neighbouring letters counts as one edit too: the swap that straddles the cut is
    looked up as a swapped copy. Nulls have no row, repeated strings count once. One join: the exchange carries
    segments, not pairs; pairs arise only under one segment.
    """
    s = strings.select(*within, F.col(column).alias("a")).where(F.col(column).isNotNull()).distinct()
    n = F.length("a")

    def start(length: Column, i: int, k: int) -> Column:
        return F.floor(length * i / (k + 1)).cast("int")

    def cut_out(length: Column, i: int, k: int, shift: int = 0) -> Column:
        piece = F.col("a").substr(start(length, i, k) + 1 + shift, start(length, i + 1, k) - start(length, i, k))
        return F.struct(length.alias("n"), F.lit(i).alias("no"), piece.alias("piece"))

    def only(when: Column, pieces: list[Column]) -> Column:
        return F.when(when, F.array(*pieces)).otherwise(F.array().cast("array<struct<n:int,no:int,piece:string>>"))

    held, asked, allowed = [], [], F.lit(0)
    ends = [*(at for at, _ in edits[1:]), None]
    for (at, k), end in zip(edits, ends, strict=True):
        short = n >= at if end is None else n.between(at, end - 1)
        held.append(only(short, [cut_out(n, i, k) for i in range(k + 1)]))
        looked = [
            cut_out(n - less, i, k, shift)
            for less in range(k + 1)
            for i in range(k + 1)
            for shift in range(max(-i, less - (k - i)), min(i, less + (k - i)) + 1)
        ]
        if k == 1:
            middle = start(n, 1, k)
            turned = F.concat(F.col("a").substr(F.lit(1), middle - 1), F.col("a").substr(middle + 1, F.lit(1)))
            looked.append(F.struct(n.alias("n"), F.lit(0).alias("no"), turned.alias("piece")))
        asked.append(only(n >= at if end is None else n.between(at, end - 1 + k), looked))
        allowed = F.when(F.length("b") >= at, F.lit(k)).otherwise(allowed)
    index = s.select(*within, F.col("a").alias("b"), F.inline(F.concat(*held)))
    met = s.select(*within, "a", F.inline(F.concat(*asked))).join(index, [*within, "n", "no", "piece"])
    a, b = F.col("a"), F.col("b")
    far = F.levenshtein(a, b, max(k for _, k in edits))
    swap = (allowed == 1) & (F.length(a) == F.length(b)) & _swapped(a, b)
    judged = met.withColumn("edits", F.when((far >= 0) & (far <= allowed), far).when(swap, F.lit(1))).where(F.col("edits").isNotNull())
    # equally long strings meet from both sides, others from the longer one only
    both = F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(b.alias("a"), a.alias("b")))
    found = judged.select(*within, F.inline(both), "edits").distinct()
    tiny = s.where(n < edits[0][0]).select(*within, "a", F.col("a").alias("b"), F.lit(0).alias("edits"))
    return found.unionByName(tiny)


# Words -------------------------------------------------------------------------------------------------------------


def _spelled(names: DataFrame) -> DataFrame:
    """(name, word, nth) of the words of distinct ``name``s, repeats once."""
    known = Words(short={})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, w, i) for n in b["name"] for i, w in enumerate(dict.fromkeys(words(n, known)[0]))]
            yield pd.DataFrame(rows, columns=["name", "word", "nth"])

    return names.mapInPandas(run, "name string, word string, nth int")


def distinctive(said: DataFrame) -> DataFrame:
    """(word, head): the distinctive words beside which each other word stands, once each.

    A name's distinctive word is its rarest, if it stands in two names at least.
    """
    # a word that a third of all names hold is spread over salts
    times = said.groupBy("word").agg(F.count("*").alias("n")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = said.where(F.length("word") > 1).withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int"))
    counted = cut(salted.join(times, ["word", "salt"]).drop("salt"))
    rarest = counted.groupBy("name").agg(F.min(F.struct("n", -F.length("word"), "word")).alias("v")).where(F.col("v.n") > 1).select("name", F.col("v.word").alias("head"))
    return cut(counted.join(rarest, "name").where(F.col("word") != F.col("head")).select("word", "head").distinct())


def common_words(pairs: DataFrame) -> set[str]:
    """Those of ``distinctive`` that stand beside SPREAD words or more: a given name beside many surnames, a kind of
    system beside many systems, but not a surname beside many spellings of one given name."""
    least = max(SPREAD, pairs.count() / SHARE)
    return {r["word"] for r in pairs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()}


def _may_stand(found: set[str]) -> list[tuple[str, str]]:
    """(short, full) of common words by their looks: shortened, or one edit apart."""
    at: dict[str, list[str]] = {}
    for w in sorted(found):
        at.setdefault(w[0], []).append(w)
        at.setdefault(w[:2], []).append(w)
    index = SegmentIndex(w for w in found if len(w) > 2)
    shorter = [(s, f) for s in sorted(found) for f in at[s[:2] if len(s) > 4 else s[0]] if looks_short(s, f)]
    return sorted({*shorter, *((s, f) for s in found if len(s) > 2 for f in index.near(s))})


def learn_words(objects: DataFrame, names: DataFrame, short: dict[str, str] | None = None) -> Words:
    """What the tables tell of words; ``names``: distinct ``name``s, ``objects``: (name, aliases, kind).

    Short forms are learnt from objects whose name and alias differ in them alone, and from common words that look
    like a shortening of another and stand beside the same distinctive words; ornaments (titles and the like) from
    aliases that add nothing else; words of decisions and incidents from the objects of that kind that they stand in.
    The table ``short``, if given, adds to them. What comes to the driver is bounded by SHARE, whatever the number of
    names.
    """
    spark = names.sparkSession
    said = cut(_spelled(names))
    pairs = distinctive(said)
    found = common_words(pairs)
    listed = F.broadcast(spark.createDataFrame([(w,) for w in sorted(found)], "word string"))  # at most SHARE words

    def teach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, *p) for n, a in zip(b["name"], b["alias"], strict=True) for p in taught(n, a)]
            yield pd.DataFrame(rows, columns=["name", "said", "meant"])

    beside_aliases = objects.select("name", F.explode("aliases").alias("alias")).where(F.col("name").isNotNull() & F.col("alias").isNotNull()).distinct()
    lessons = cut(beside_aliases.mapInPandas(teach, "name string, said string, meant string").groupBy("said", "meant").agg(F.countDistinct("name").alias("n")))
    least = max(TAUGHT, (lessons.agg(F.sum("n")).first()[0] or 0) / SHARE)
    learnt = [(r["said"], r["meant"], r["n"]) for r in lessons.where((F.col("n") >= least) & ~F.contains("said", F.lit(" "))).collect()]
    gone = {m: n for s, m, n in learnt if not s}
    ornaments = {s for s, m, n in learnt if s and not m and n > gone.get(s, 0)}
    stands: dict[str, dict[str, int]] = {}
    for s, m, n in learnt:
        if s and m and len(s) < len(m):
            stands.setdefault(s, {})[m] = n
    forms = {k: set(v.split()) for k, v in (short or {}).items()}
    for s, of in stands.items():
        forms.setdefault(s, set()).update(m for m, n in of.items() if n >= RARELY * sum(of.values()))

    common = pairs.join(listed, "word")
    looks = spark.createDataFrame(_may_stand(found), "word string, meant string")
    beside_both = common.join(looks, "word").join(common.select(F.col("word").alias("meant"), "head"), ["meant", "head"]).groupBy("word", "meant").agg(F.count("*").alias("both"))
    spread = common.groupBy("word").agg(F.count("*").alias("n"))
    alike = beside_both.join(spread, "word").join(spread.select(F.col("word").alias("meant"), F.col("n").alias("more")), "meant")
    for r in alike.where((F.col("both") >= TAUGHT) & (F.col("both") >= ALIKE * F.col("n")) & (F.col("more") > F.col("n"))).select("word", "meant").collect():
        if r["word"] not in stands:
            forms.setdefault(r["word"], set()).add(r["meant"])
    # a meaning that itself is a slip or short for another one is that one
    forms = {s: {m if forms.get(m, ()) == () or len(forms[m]) > 1 else next(iter(forms[m])) for m in f} for s, f in forms.items()}

    kinds = objects.where(F.col("kind").isNotNull() & F.col("name").isNotNull()).select("name", "kind").distinct().join(said, "name").join(listed, "word")
    told = kinds.groupBy("word").agg(F.count("*").alias("n"), F.count_if(F.col("kind").isin("decision", "incident")).alias("of"))
    events = {r["word"] for r in told.where((F.col("of") >= TAUGHT) & (F.col("of") >= 0.8 * F.col("n"))).select("word").collect()}
    both = said.join(listed, "word")
    after = both.select("name", (F.col("nth") - 1).alias("nth"), F.col("word").alias("after"))
    beside = both.join(after, ["name", "nth"]).groupBy("word", "after").agg(F.count("*").alias("n"))
    total = max(TAUGHT, (beside.agg(F.sum("n")).first()[0] or 0) / SHARE)
    near = {(r["word"], r["after"]) for r in beside.where(F.col("n") >= total).select("word", "after").collect()}
    shorts = {s: tuple(sorted(f)) for s, f in forms.items()}
    return Words(frozenset(found) - frozenset(shorts), shorts, ORNAMENTS | ornaments, frozenset(events), frozenset(near))


def readings(names: DataFrame, known: Words) -> DataFrame:
    """(name, head, tail, whole, asks, answers) of distinct ``name``; names that denote nobody are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch["name"]:
                r = read(name, known)
                if r:
                    rows.append((name, r.head, r.tail, r.whole, [list(x) for x in r.asks], [list(x) for x in r.answers]))
            out = pd.DataFrame(rows, columns=["name", "head", "tail", "whole", "asks", "answers"])
            for c, keys in (("asks", ("head", "tail", "rank")), ("answers", ("head", "tail", "how"))):
                out[c] = [[dict(zip(keys, x, strict=True)) for x in xs] for xs in out[c]]
            yield out

    return names.mapInPandas(run, "name string, head string, tail string, whole boolean, asks array<struct<head:string,tail:string,rank:int>>, answers array<struct<head:string,tail:string,how:string>>")


# Entities ----------------------------------------------------------------------------------------------------------


def resolved_names(objects: DataFrame, mentions: DataFrame, short: dict[str, str] | None = SHORT, similar: Callable[..., DataFrame] = similar_by_length) -> DataFrame:
    """(name, entity) of the names of objects, their aliases and mentions; names that denote nobody have no row.

    ``objects``: (id, name, aliases, kind), one row an object; ``mentions``: (name). A name is its distinctive words
    (head) and its common ones (tail). Names with nothing shortened that meet in the segment join, tails equal, are
    one entity with the better attested of them. Shortened names meet what others may be shortened to; they go to the
    one entity that answers, of those that objects name first, and to none where several answer. An alias that reads
    like no object goes to the entity of the object bearing it.
    """
    named = objects.select("name", F.lit(True).alias("of_object"))
    aliases = cut(objects.select("name", F.explode("aliases").alias("alias")).where(F.col("alias").isNotNull()).distinct())
    seen = named.unionByName(mentions.select("name", F.lit(False).alias("of_object"))).unionByName(aliases.select(F.col("alias").alias("name"), F.lit(False).alias("of_object")))
    others = objects.where(F.col("kind").isin("decision", "incident")).select("name").distinct()
    distinct = cut(seen.where(F.col("name").isNotNull()).groupBy("name").agg(F.max("of_object").alias("of_object"), F.count("*").alias("times")))
    known = learn_words(objects, distinct.select("name"), short)
    said = cut(readings(distinct.join(others, "name", "left_anti").select("name"), known).join(distinct, "name"))

    group = ["head", "tail"]
    whole, part = said.where("whole"), said.where("NOT whole")
    used = said.groupBy("head").agg(F.count("*").alias("names"))
    counted = whole.groupBy(*group).agg(F.count("*").alias("spellings"), F.sum("times").alias("times"), F.max("of_object").alias("of_object"))
    full = cut(counted.join(used, "head").select(*group, "of_object", F.struct("names", "spellings", "times", "head").alias("own")))
    asks = part.select(*group, F.explode("asks").alias("v")).select(F.col("v.head").alias("a"), F.col("v.tail").alias("tail"), "v.rank", F.col("head").alias("of_head"), F.col("tail").alias("of_tail")).distinct()
    # of all that names may be shortened to only what some name asks, tail by tail
    asked = full.select("tail").unionByName(asks.select("tail")).distinct()
    answers = whole.select(*group, F.explode("answers").alias("v")).select(F.col("v.head").alias("b"), F.col("v.tail").alias("tail"), "v.how", F.col("head").alias("to_head"), F.col("tail").alias("to_tail"))
    answers = cut(answers.join(asked, "tail", "left_semi").distinct())
    strings = full.select("head", "tail").unionByName(answers.select(F.col("b").alias("head"), "tail")).unionByName(asks.select(F.col("a").alias("head"), "tail"))
    near = cut(similar(strings, "head", ("tail",)))

    # whole names that meet, each with itself too: a misspelling goes to the better attested
    mine = full.select("tail", F.col("head").alias("a"), "own")
    plain_ways = answers.where("how = 'plain'").select("b", "tail", "to_head")
    written = near.join(mine, ["tail", "a"]).join(plain_ways, ["tail", "b"]).where(F.col("a") != F.col("to_head")).select("tail", "a", F.col("to_head").alias("b"))
    meets = near.select("tail", "a", "b").unionByName(written).unionByName(written.select("tail", F.col("b").alias("a"), F.col("a").alias("b")))
    best = (
        meets.join(mine, ["tail", "a"]).join(mine.select("tail", F.col("a").alias("b"), F.col("own").alias("theirs")), ["tail", "b"])
        .groupBy("tail", F.col("a").alias("head")).agg(F.max("theirs").alias("top")).select("tail", "head", F.col("top.head").alias("to"))
    )
    best = cut(best)
    onward = best.select("tail", F.col("head").alias("to"), F.col("to").alias("next"))
    entities = full.join(best.join(onward, ["tail", "to"]), group).select("head", "tail", "of_object", F.concat_ws("|", "next", "tail").alias("entity"))
    entities = cut(entities)
    held = entities.groupBy("entity").agg(F.max("of_object").alias("held"))
    marked = cut(entities.drop("of_object").join(held, "entity"))

    # a whole name may still be what a longer one is shortened to
    ways = answers.where("how != 'plain'").withColumn("guess", F.col("how") == "guess")
    less = cut(near.join(full.select(F.col("head").alias("a"), "tail"), ["tail", "a"]).join(ways, ["tail", "b"]).where((F.col("a") != F.col("to_head")) | (F.col("tail") != F.col("to_tail"))).select("a", "tail").distinct())
    tops = marked.join(less.withColumnRenamed("a", "head"), group, "left_anti").select(F.col("head").alias("to_head"), F.col("tail").alias("to_tail"), "entity", "held")
    named_so = marked.select(F.col("head").alias("b"), "tail", "entity", "held").unionByName(plain_ways.join(marked.withColumnRenamed("head", "to_head"), ["to_head", "tail"]).select("b", "tail", "entity", "held"))
    shorter = ways.join(tops, ["to_head", "to_tail"]).select("b", "tail", "entity", "held", "guess", F.lit(True).alias("short"))
    lookup = shorter.unionByName(named_so.select("*", F.lit(False).alias("guess"), F.lit(False).alias("short")))
    lookup = lookup.groupBy("b", "tail", (~F.col("held")).alias("other"), "guess", "short").agg(F.min("entity").alias("least"), F.max("entity").alias("most"))

    # asked by shortened names, and by whole ones of what they may be short for: the entity that answers nearest, of
    # those that objects name first; null where several do
    asking = asks.withColumn("whole", F.lit(False)).unionByName(less.select("a", "tail", F.lit(0).alias("rank"), F.col("a").alias("of_head"), F.col("tail").alias("of_tail"), F.lit(True).alias("whole")))
    met = asking.join(near, ["tail", "a"]).join(lookup, ["tail", "b"]).where("short OR NOT whole")
    reached = met.groupBy("of_head", "of_tail", "other", "guess", "rank", "edits").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    nearest = reached.groupBy("of_head", "of_tail").agg(F.min(F.struct("other", "guess", "rank", "edits", "least", "most")).alias("v"))
    given = nearest.select(F.col("of_head").alias("head"), F.col("of_tail").alias("tail"), F.when(F.col("v.least") == F.col("v.most"), F.col("v.least")).alias("given"), F.lit(True).alias("met"))
    alone = F.when(~F.col("whole"), F.concat_ws("|", F.lit("?"), "head", "tail"))
    own = said.select("name", "whole", *group).join(marked.select(*group, "entity"), group, "left").join(given, group, "left")
    plain_names = cut(own.select("name", F.when(F.col("met"), F.col("given")).otherwise(F.coalesce("entity", alone)).alias("entity")).where(F.col("entity").isNotNull()))

    # aliases: what an alias reads as, unless that is an object's name already, is the entity of its bearer
    bearer = aliases.join(plain_names.select("name", F.col("entity").alias("bearer")), "name").groupBy(F.col("alias").alias("name")).agg(F.min("bearer").alias("bearer"), F.max("bearer").alias("last"))
    objects_of = cut(plain_names.join(named.select("name").distinct(), "name", "left_semi").select("entity").distinct())
    loose = bearer.join(plain_names, "name").join(objects_of, "entity", "left_anti")
    sole = loose.groupBy("entity").agg(F.min("bearer").alias("bearer"), F.max("last").alias("last")).where(F.col("bearer") == F.col("last")).drop("last")
    return plain_names.join(sole, "entity", "left").select("name", F.coalesce("bearer", "entity").alias("entity"))


def linked_names(objects: DataFrame, extracted: DataFrame, salts: int = SALTS, short: dict[str, str] | None = SHORT, similar: Callable[..., DataFrame] = similar_by_length) -> DataFrame:
    """(key_a, key_b): pairs of two object ids, or an object id and a mention id, whose differing names denote one
    person, team or system; the smaller key first.

    Takes each object's current name, aliases and, where the table has it, type. Names that are null, blank or vague,
    and those of decisions and incidents, link to nothing; identical names make no pair; repeated rows count once.
    Names are resolved once each, so a name that a tenth of the mentions bear is one row until the very last join,
    where mentions, and the objects of one entity, are spread over ``salts``.
    """
    kind = ("type",) if "type" in objects.columns else ()
    now = current_objects(objects, "name", "aliases", *kind)
    now = cut(now.select("id", "name", "aliases", F.lower(F.trim("type")).alias("kind") if kind else F.lit(None).cast("string").alias("kind")))
    mentions = extracted.where(F.col("mention_id").isNotNull() & F.col("subject_name").isNotNull()).select("mention_id", F.col("subject_name").alias("name"))
    names = cut(resolved_names(now, mentions.select("name"), short, similar))
    placed = cut(now.select("id", "name").join(names, "name"))
    each = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))

    def salt(key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")

    other = placed.select(F.col("id").alias("id2"), F.col("name").alias("name2"), "entity")
    pairs = placed.withColumn("salt", salt("id")).join(other.withColumn("salt", each), ["entity", "salt"])
    pairs = pairs.where((F.col("id") < F.col("id2")) & (F.col("name") != F.col("name2"))).select(F.col("id").alias("key_a"), F.col("id2").alias("key_b"))
    # a mentioned name's objects, found a name at a time; names all of whose objects bear the very same name end here
    links = names.join(other, "entity").where(F.col("name") != F.col("name2")).select("name", "id2")
    met = mentions.distinct().withColumn("salt", salt("mention_id")).join(links.withColumn("salt", each), ["name", "salt"])
    return pairs.unionByName(met.select(F.least("mention_id", "id2").alias("key_a"), F.greatest("mention_id", "id2").alias("key_b"))).distinct()
