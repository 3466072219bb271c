"""The text operators against brute force, exact accounts and held-out accuracy."""

import random
import string

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mnemora.llm import langid, linking, mixing, packing
from mnemora.llm.names import SegmentIndex, Words, one_edit, read, taught
from mnemora.llm.tokens import TOKENIZER, counter, token_counts

DOC = "doc_id LONG, text STRING, lang STRING, source STRING"


# Similar strings ---------------------------------------------------------------------------------------------------


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, before = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(before[j] + 1, d[-1] + 1, before[j - 1] + (x != y)))
    return d[-1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_segment_join_equals_brute_force(spark, k):
    r = random.Random(k)
    words = {"".join(r.choice("ab") for _ in range(r.randrange(1, 9))) for _ in range(120)} | {"x" * 40, "x" * 41, "äöü", "ÄÖ"}
    df = spark.createDataFrame([(w,) for w in words] * 2 + [(None,), ("",)], "w string")
    got = {(x["a"], x["b"]) for x in linking.similar_strings(df, "w", k).collect()}
    long = [w for w in words if len(w) > k]
    close = (lambda a, b: one_edit(a, b)) if k == 1 else (lambda a, b: edits(a, b) <= k)
    assert got == {(a, b) for a in long for b in long if close(a, b)} | {(w, w) for w in [*words, ""]}
    index = SegmentIndex(words)
    assert k > 1 or all(index.near(w) == {x for x in words if x != w and one_edit(x, w)} for w in words if len(w) > 2)


def test_segment_join_by_length_within_a_column(spark):
    r = random.Random(8)
    rows = [(t, "".join(r.choice("ab") for _ in range(n))) for t in "xy" for n in (2, 3, 4, 5, 6, 7, 8, 9) for _ in range(12)]
    df = spark.createDataFrame(rows, "t string, w string")
    got = {(x["t"], x["a"], x["b"], x["edits"]) for x in linking.similar_by_length(df, "w", ("t",), ((4, 1), (7, 2))).collect()}

    def allowed(a, b):
        n = min(len(a), len(b))
        e = 1 if 4 <= n < 7 and a != b and one_edit(a, b) else edits(a, b)
        return e if e <= (0 if n < 4 else 1 if n < 7 else 2) else None

    assert got == {(t, a, b, allowed(a, b)) for t, a in rows for u, b in rows if t == u and allowed(a, b) is not None}


def test_one_edit_is_edit_distance_with_swaps():
    r = random.Random(5)
    for _ in range(2000):
        a = "".join(r.choice("abc") for _ in range(r.randrange(0, 6)))
        b = "".join(r.choice("abc") for _ in range(r.randrange(0, 6)))
        swaps = {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        assert one_edit(a, b) == (edits(a, b) <= 1 or b in swaps)


# Names -------------------------------------------------------------------------------------------------------------

KNOWN = Words(common=frozenset("wilhelmina balancer load energy associates limited database service".split()), short={"mina": ("wilhelmina",), "lb": ("load balancer",), "assoc": ("associates",), "ltd": ("limited",), "chris": ("christina", "christopher")}, events=frozenset({"outage"}), beside=frozenset({("load", "balancer")}))
SAME = {
    ("fischer", "wilhelmina"): ["Wilhelmina Fischer", "FISCHER, Wilhelmina", "Mina Fischer", "Mr Wilhelmina Fischer", "@wilhelmina.fischer", " Wilhelmina  Fischer\t", "Wilhelmina Fis-cher", "Wilhelmina Fîscher", "wILHELMINA fISCHER, pHd", "Wilhelmina Fischer (on call)", "Wilhelmina Fischer - DBA", "Wilhlemina Fischer"],
    ("stekoklorin", "balancer load"): ["Stekoklorin Load Balancer", "Stekoklorin LB", "stekoklorin_lb", "stekoklorin-load-balancer", "StekoklorinLoadBalancer", "stekoklorinloadbalancer", "Load Balancer Stekoklorin", "Stekoklorin Lod Balancer."],
    ("acme", "associates energy limited"): ["Acme Energy Associates Limited", "The Acme Energy Assoc. Ltd", "Acme-Energy Associates Limited", "AcmeEnergy Associates Ltd", "Acme Enegry Associates Limited", "acmeenergy assoc ltd"],
}


def test_readings():
    for key, names in SAME.items():
        for n in names:
            r = read(n, KNOWN)
            assert (r.head, r.tail) == key and r.whole, n
    for n in (None, "", "  ", "the platform", "We", "n/a", "core team", "?", "...", "@", "-", ",", "Acme Outage", "Mr"):
        assert read(n, KNOWN) is None or n == "Mr", n
    r = read("Chris Fischer", KNOWN)
    assert not r.whole and r.asks[0] == ("fischer", "chris", 0) and ("fischer", "chris", "short") in read("Christina Fischer", Words(common=frozenset({"christina"}), short=KNOWN.short)).answers
    assert ("acme", "a e limited", "short") in read("Acme Energy Associates Limited", KNOWN).answers and read("x" * 20_000, KNOWN).whole
    assert len(read(" ".join(["energy", "associates", "limited", "service", "database", "load"] * 50) + " acme", KNOWN).answers) < 1000


def test_aliases_teach():
    assert taught("Acme Energy Associates", "Acme Energy Assoc.") == [("assoc", "associates")] and taught("Zug Load Balancer", "Zug LB") == []
    assert taught("Zugspitz Load Balancer", "zugspitz_lb") == [("lb", "load balancer")] and taught("Wilhelmina Fischer", "Mr Wilhelmina Fischer") == [("mr", "")]
    assert taught("Acme Energy Associates Limited", "Acme Energy Assoc.") == [("assoc", "associates")]
    assert taught(None, "a") == taught("a", None) == taught("", "") == taught("Ann Lee", "Bob Ray") == []


def link(spark, objects, mentions, **kw):
    o = spark.createDataFrame([(f"obj:{i}", n, a, i, "junk", "junk") for i, (n, a) in enumerate(objects)], "id STRING, name STRING, aliases ARRAY<STRING>, updated_at INT, entity STRING, core STRING")
    x = spark.createDataFrame([(f"xc:{i}", n, "junk") for i, n in enumerate(mentions)], "mention_id STRING, subject_name STRING, entity STRING")
    names = {f"obj:{i}": n for i, (n, _) in enumerate(objects)} | {f"xc:{i}": n for i, n in enumerate(mentions)}
    got = linking.linked_names(o, x, **kw).collect()
    assert all(r["key_a"] < r["key_b"] for r in got)
    return {(names[r["key_a"]], names[r["key_b"]]) for r in got}


def test_links_of_words_never_seen(spark):
    """Few names, none of whose words is common: whole names, in any order, and the table of short forms."""
    objects = [
        "Wilhelmina Fischer", "Ahmed Hassan", "Kafka Cluster", "Acme Billing Service", "PostgreSQL", "Grace Hopper", "Elizabeth Garcia Marquez", "Central Message Bus", "Zug Database", "Cobo",
        "Daniel Ruiz", "Daniel Brown", "Daniel Wolf", "Samuel Holm-Gard", "Samantha Holmgard", None, "", "the platform",
    ]
    same = {
        "Wilhelmina Fischer": ["Fischer, Wilhelmina", "Mina Fischer", "W. Fischer", "Wilhelmina Fisher"], "Ahmed Hassan": ["Hassan Ahmed"], "Kafka Cluster": ["kafka-cluster", "KafkaCluster", "kafka_cluster"],
        "Acme Billing Service": ["ACME Billing Svc", "Acme Biling Service"], "PostgreSQL": ["Postgres"], "Grace Hopper": ["Hopper, Grace", "Hopper Grace", "G. Hopper", "Grace B. Hopper", "Grace Hoper"],
        "Elizabeth Garcia Marquez": ["Garcia Marquez, Liz", "E. Garcia Marquez"], "Central Message Bus": ["centralmessagebus", "Bus, Central Message"], "Zug Database": ["Zgu DB"], "Daniel Ruiz": ["Daniel Riuz"],
        "Daniel Brown": ["Dan Brwn"], "Samantha Holmgard": [], "Samuel Holm-Gard": [],
    }
    others = ["Grace Lord", "A. Hopper", "Grace", "Hopper", "E. Garcia", "Central Bus", "D. Wlof", "Robert Riuz", "Zgu Gateway", "Cobb", None, "", "the platform", "Anna Fischer", "S. Holmgard", "Kafka"]
    assert link(spark, [(n, None) for n in objects], [m for x in same.values() for m in x] + others) == {(n, m) for n, x in same.items() for m in x}
    assert link(spark, [], []) == set() and link(spark, [("Grace Hopper", None)], []) == set() and link(spark, [], ["Grace Hopper"]) == set()


def test_links_learnt_from_the_tables(spark):
    """Enough names of an invented vocabulary: abbreviations, short names and titles are learnt, none is listed."""
    r = random.Random(3)

    def stem():
        return "".join(r.choice(a) for a in ("bdfgklmnpr", "aeiou", "bdfgklmnpr", "aeiou", "lmnrst", "aeiou", "kmnt")).capitalize()

    stems = [stem() for _ in range(160)]
    given, nick = ["Olufunmilayo", "Bartholomew", "Gwendolyn", "Ferdinand", "Thorvald"], {"Olufunmilayo": "Funmi", "Bartholomew": "Barty", "Gwendolyn": "Wendy", "Ferdinand": "Nando", "Thorvald": "Thor"}
    kinds = {"Turbine Controller": "TC", "Ledger Archive": "LA"}
    people = [(f"{r.choice(given)} {s}", s) for s in stems[:100]]
    objects, mentions, want = [], [], set()
    for i, (name, s) in enumerate(people):
        g = name.split()[0]
        objects.append((name, [f"{nick[g]} {s}"] if i % 2 else [f"Mx {name}"]))
        for m in (f"{s}, {g}", f"{g[0]}. {s}", f"{nick[g]} {s}", f"Mx {name}", name[:-2] + name[-1] + name[-2]):
            mentions.append(m)
            want.add((name, m))
    for i, s in enumerate(stems[100:]):
        k = list(kinds)[i % 2]
        objects.append((f"{s} {k}", [f"{s} {kinds[k]}"] if i < 30 else None))
        for m in (f"{s.lower()}_{kinds[k].lower()}", f"{s}{k.replace(' ', '')}", f"{k} {s}", f"{s} {k[: -2 - i % 6]}{k[-1 - i % 6 :]}"):
            mentions.append(m)
            want.add((f"{s} {k}", m))
    got = link(spark, objects, mentions, short=None)
    assert len(got & want) >= 0.95 * len(want), sorted(want - got)[::5]
    assert len(got & want) >= 0.99 * len(got)

    def none(strings, column, within):
        return strings.select(*within, F.col(column).alias("a"), F.col(column).alias("b"), F.lit(0).alias("edits")).limit(0)

    assert len(link(spark, objects, mentions, short=None, similar=none)) < 0.02 * len(want)  # the segment join makes the links


def test_aliases_lead_to_their_bearer(spark):
    objects = [("Stekoklorin Billing", ["Midronouford Payments", "core team"]), ("Gwendolyn Zapairowick", ["core team", None, ""]), ("Robert Zapairowick", [])]
    mentions = ["Midronouford Payments", "Midronouford Paymnets", "core team", "R. Zapairowick", "Zapairowick"]
    assert link(spark, objects, mentions) == {("Stekoklorin Billing", "Midronouford Payments"), ("Stekoklorin Billing", "Midronouford Paymnets"), ("Robert Zapairowick", "R. Zapairowick")}


def test_decisions_and_incidents_are_not_what_they_are_named_after(spark):
    o = spark.createDataFrame([("o1", "Stekoklorin Gateway", None, 1, "technology"), ("o2", "Stekoklorin Gateways", None, 1, " Decision"), ("o3", "stekoklorin gateway", None, 1, "SERVICE")], "id STRING, name STRING, aliases ARRAY<STRING>, updated_at INT, type STRING")
    x = spark.createDataFrame([], "mention_id STRING, subject_name STRING")
    assert [tuple(r) for r in linking.linked_names(o, x).collect()] == [("o1", "o3")]


# Packing -----------------------------------------------------------------------------------------------------------


def test_knapsack_equals_brute_force():
    r = random.Random(2)
    for _ in range(30):
        cap, worth = r.randrange(3, 15), np.full(16, -np.inf)
        for length in r.sample(range(1, 12), 4):
            worth[length] = r.random()
        worth = worth[: cap + 1]
        chosen, value = packing.best_filling(worth, cap)

        def best(c, worth=worth):
            return max([0.0, *(worth[n] + best(c - n, worth) for n in range(1, c + 1) if np.isfinite(worth[n]))])

        assert abs(value - best(cap)) < 1e-9 and chosen.sum() <= cap and abs(worth[chosen].sum() - value) < 1e-9


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plans_place_everything_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(129, np.int64)
    for x in rng.integers(1, [20, 60, 129][seed - 1], 4000):
        counts[x] += 1
    plan = packing.plan_windows(counts)
    placed = np.zeros(129, np.int64)
    for lengths, n in plan.fillings:
        assert sum(lengths) <= 128 and n > 0
        for length in lengths:
            placed[length] += n
    assert (placed == counts).all() and plan.windows <= plan.bound * 1.02 + 2
    assert packing.plan_windows(np.zeros(10, np.int64)).fillings == []


def histogram(capacity, **pieces):
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.items():
        counts[int(length[1:])] = n
    return counts


@pytest.mark.parametrize("seed", [1, 2])
def test_the_program_covers_every_length(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(rng.integers([90, 150][seed - 1], 400, 20_000), minlength=1001)
    fillings, times, bound = packing.fractional(counts)
    lengths = np.flatnonzero(counts)
    assert ((fillings * lengths).sum(1) <= 1000).all() and (fillings >= 0).all()
    assert ((fillings * times[:, None]).sum(0) >= counts[lengths] * (1 - 1e-9)).all()
    assert bound <= times.sum() <= (1 + packing.EPS) * bound + 1e-6


def test_the_program_beats_filling_longest_first():
    counts = histogram(2048, _1045=600, _553=600, _532=600, _471=1200)
    assert packing.plan_windows(counts).windows == 900 < sum(n for _, n in packing.longest_first(counts)) == 1100
    counts = np.bincount(np.random.default_rng(4).integers(300, 800, 50_000), minlength=2049)
    plan = packing.plan_windows(counts)
    assert plan.bound <= plan.windows < plan.bound * 1.005 and sum(n for _, n in packing.longest_first(counts)) > plan.bound * 1.02


def test_the_bound_sees_what_fits_together():
    counts = np.bincount(np.random.default_rng(5).integers(690, 1100, 20_000), minlength=2049)
    plan = packing.plan_windows(counts)
    assert np.ceil(plan.bound - 1e-6) == plan.windows == 10_000  # no three fit


def test_bounds_are_bounds():
    r = random.Random(6)
    for _ in range(40):
        pieces = [r.randrange(1, 11) for _ in range(r.randrange(1, 8))]

        def least(rest, rooms):
            if not rest:
                return len(rooms)
            return min([least(rest[1:], [*rooms, 10 - rest[0]]), *(least(rest[1:], [*rooms[:i], x - rest[0], *rooms[i + 1 :]]) for i, x in enumerate(rooms) if x >= rest[0])])

        plan = packing.plan_windows(np.bincount(pieces, minlength=11))
        best = least(sorted(pieces, reverse=True), [])
        assert plan.bound <= best + 1e-6 and plan.windows <= best + 1


def test_packing(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.choice([1, 5, 5, 40, 90]))) for _ in range(300)] + [None, "", "word " * 700, "x" * 3000]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOC).withColumn("size", F.lit(1)).withColumn("pid", F.lit("p")).withColumn("n_tokens", F.lit(9))
    placed, report = packing.pack_documents(docs, 100)
    got = placed.toPandas()
    size = counter(TOKENIZER)
    want = {i: size(t) for i, t in enumerate(texts) if t}
    assert got.groupby("doc_id")["n_tokens"].sum().to_dict() == want
    assert (got.groupby("window_no")["n_tokens"].sum() <= 100).all() and not got.duplicated(["doc_id", "piece_no"]).any()
    assert (got.groupby("doc_id").size()[[i for i, n in want.items() if n <= 100]] == 1).all()  # only what exceeds a window is split
    for _, w in got.sort_values("position").groupby("window_no"):
        assert (w["start_token"].to_numpy() == np.r_[0, w["n_tokens"].cumsum()[:-1]]).all() and (w["window_tokens"] == w["n_tokens"].sum()).all()
    r = report.first()
    assert (r["windows"], r["tokens"]) == (got["window_no"].nunique(), sum(want.values())) and abs(r["unused_share"] - (1 - r["tokens"] / r["windows"] / 100)) < 1e-9
    placed, report = packing.pack_documents(docs.where("false"), 100)
    assert placed.count() == 0 and report.first()["windows"] == 0


def test_tokens_round_trip(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    from mnemora.llm.tokens import PATTERN

    e = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in ("I'll be there", "Größe\r\n\tx  ", "<|endoftext|>", "日本語 текст"):
        assert e.decode(e.encode_ordinary(t)) == t and counter(TOKENIZER)(t) == len(e.encode_ordinary(t))
    df = spark.createDataFrame([(1, None, "a", None), (2, "", None, "s"), (None, "one two", None, None)], DOC)
    assert {(r["doc_id"], r["n_tokens"]) for r in token_counts(df, TOKENIZER, "source").collect()} == {(1, 0), (2, 0), (None, 2)}


# Mixing ------------------------------------------------------------------------------------------------------------


def mixed(spark, docs, targets, total=None):
    d = spark.createDataFrame([(i, t, "en", s) for i, (t, s) in enumerate(docs)], DOC).withColumn("draw", F.lit(1)).withColumn("source_name", F.lit("clash"))
    t = spark.createDataFrame(targets, "source_name STRING, target_share DOUBLE, max_repeats INT")
    taken, shares = mixing.mix(d, t, total)
    return taken.toPandas(), shares.toPandas().set_index("source_name")


def test_mix(spark):
    r = random.Random(4)
    docs = [(" ".join(["word"] * r.randrange(1, 30)), s) for s, n in (("big", 3000), ("Mid_Src ", 500), ("tiny", 60)) for _ in range(n)] + [(None, "big"), ("", "tiny"), ("w", None), ("w", "other")]
    targets = [("big", 0.4, 1), ("mid-src", 0.3, 2), ("tiny", 0.2, 8), ("absent", 0.1, 3)]
    taken, shares = mixed(spark, docs, targets)
    reach = {"big": 0.4 / 0.9, "mid-src": 0.3 / 0.9, "tiny": 0.2 / 0.9}
    for s, want in reach.items():
        assert abs(shares.loc[s, "actual_share"] - want) < 0.01
    assert shares.loc["absent", "tokens"] == 0 and (shares["most_copies"] <= shares["max_repeats"]).all()
    assert abs(shares["actual_share"].sum() - 1) < 1e-9 and (taken["copies"] > 0).all() and not taken["doc_id"].duplicated().any()
    assert (taken["n_tokens"] * taken["copies"]).sum() == shares["tokens"].sum()
    less, _ = mixed(spark, docs, targets, float(shares["tokens"].sum()) / 2)
    copies = taken.set_index("doc_id")["copies"]
    assert (less.set_index("doc_id")["copies"] <= copies.reindex(less["doc_id"]).fillna(0).to_numpy()).all()  # nested
    over, capped = mixed(spark, docs, targets, 1e9)
    assert (capped["most_copies"] == capped["max_repeats"].where(capped["tokens"] > 0, 0)).all()


def test_many_sources_and_no_broadcast(spark, monkeypatch):
    docs = [("w " * (1 + i % 7), f"s{i % 40}") for i in range(400)]
    targets = [(f"s{i}", 1 / 50, 2) for i in range(50)]
    whole = mixed(spark, docs, targets)
    monkeypatch.setattr(mixing, "BROADCAST", 5)
    taken, shares = mixed(spark, docs, targets)
    assert whole[0].sort_values("doc_id").reset_index(drop=True).equals(taken.sort_values("doc_id").reset_index(drop=True)[whole[0].columns])
    assert whole[1].sort_index().equals(shares.sort_index()[whole[1].columns])
    assert len(whole[1]) == 50 and (whole[1]["actual_share"] > 0).sum() == 40


def test_mix_edges(spark):
    assert len(mixed(spark, [], [("a", 1.0, 1)])[0]) == 0
    assert len(mixed(spark, [("w", "a")], [])[0]) == 0
    taken, shares = mixed(spark, [("w w", "a"), ("w", "b")], [("a", 0.5, 1), ("A", 0.25, 2), ("b", None, 1), (None, 1.0, 1), ("c", 0.1, None)])
    assert list(taken["source_name"].unique()) == ["a"] and shares.loc["a", "target_share"] == 0.75


# Languages ---------------------------------------------------------------------------------------------------------


def test_sentences():
    text = "# Title: One Two\r\n\r\nDate: 2024-01-02\rDatum : 2024-01-02\n**Impact\nImpact\n- First item is here.\n1. Second one follows! Third?\n`SELECT a FROM b`\ncfg.x=5\nERR_1 retry=3 state=q\n| 1 | 2 |\n--- a/5.cfg +++ b/5.cfg\n[882] 0x882e4 0x00 0xff\nDr. Smith met J. Doe at noon. End of it."
    assert langid.sentences(text) == ["First item is here.", "Second one follows!", "Third?", "Dr. Smith met J. Doe at noon.", "End of it."]
    for t in (None, "", "  \n\t", "#", "x", "12 34 56", "`a`"):
        assert langid.sentences(t) == []
    assert len(langid.sentences("Word and word again. " * 5000)) == 5000


WORDS = {"en": "the of and that was with they have from this", "de": "der die und dass nicht mit wir haben von diese", "fr": "le les des que pas avec nous avons dans cette"}


def corpus(n, seed, wrong=0.15):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        say = lambda c: " ".join([*r.choices(WORDS[c].split(), k=8), "".join(r.choices(string.ascii_lowercase, k=9))]).capitalize() + "."
        label = lang if r.random() > wrong else r.choice([None, "", "xx", *WORDS])
        second = r.choice(list(WORDS)) if r.random() < 0.2 else lang
        out.append((i, label, [(lang, say(lang)) for _ in range(4)] + [(second, say(second)) for _ in range(3)]))
    return out


def test_languages(spark):
    docs = corpus(500, 1)
    df = spark.createDataFrame([(i, " ".join(s for _, s in said), label, "s") for i, label, said in docs] + [(1000, None, "en", "s"), (1001, "", "en", None), (1002, "# only", None, None), (1003, "The of and was.", "EN_gb", None)], DOC)
    langs = spark.createDataFrame([(c, c) for c in [*WORDS, "sv"]], "lang_code STRING, lang_name STRING")
    model = langid.fit(langid.training_sample(df, langs))
    assert model.codes == ["de", "en", "fr"]
    found = langid.document_languages(df, model)
    got = {(r["doc_id"], r["seg_no"]): r for r in found.collect()}
    right = 0
    for i, _, said in docs:
        runs = [c for j, (c, _) in enumerate(said) if j == 0 or said[j - 1][0] != c]
        right += [got[i, k + 1]["lang"] for k in range(len(runs)) if (i, k + 1) in got] == runs and (i, len(runs) + 1) not in got
        assert 0 <= got[i, 0]["confidence"] <= 1
    assert right >= 490
    assert not {1000, 1001, 1002} & {k[0] for k in got}
    cases = {(r["doc_id"], r["seg_no"]) for r in langid.wrong_or_mixed(found).collect()}
    assert (1003, 0) not in cases
    for i, label, said in docs[:50]:
        assert ((i, 0) in cases) == (label != said[0][0]) and ((i, 1) in cases) == (got[i, 0]["n_segments"] > 1)


def test_held_out_accuracy():
    rows = [(c, s) for _, _, said in corpus(300, 2) for c, s in said]
    model = langid.fit(pd.DataFrame([(c, s) for c, s in rows[:1500]], columns=["label", "text"]))
    said = model.scores([langid.bare(s).lower() for _, s in rows[1500:]], {})[0].argmax(1)
    assert np.mean([model.codes[i] == c for i, (c, _) in zip(said, rows[1500:], strict=True)]) > 0.98


def test_languages_without_labels(spark):
    df = spark.createDataFrame([(1, "Some text is here.", None, None)], DOC)
    langs = spark.createDataFrame([("en", "English")], "lang_code STRING, lang_name STRING")
    model = langid.fit(langid.training_sample(df, langs))
    assert model is None and langid.document_languages(df, model).count() == 0 and langid.wrong_or_mixed(langid.document_languages(df, model)).count() == 0


def test_one_label_only(spark):
    model = langid.fit(pd.DataFrame({"label": ["en"] * 30, "text": ["The cat was here with them."] * 30}))
    assert model.codes == ["en"]


@pytest.mark.parametrize("name", ["p4_found", "p6_windows", "p7_mix", "p8_found"])
def test_registered(name):
    assert name in entry.queries()
