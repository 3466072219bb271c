"""Languages of documents and of the stretches of mixed ones (problem 8).

Averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy on a bounded
sample of labelled documents, then applied to every sentence of every document. The labels are partly wrong, so the
model is trained twice: the second time on the sentences whose label the first model confirms.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.session import cut

BUCKETS = 1 << 16
DIMENSIONS = 24
#: About so many labelled documents are read for training, of each label LEAST at least if it has them, and so many
#: sentences used. Labels keep their proportions: of a label drawn more densely, its mistakes would be too.
DOCUMENTS, LEAST, SENTENCES = 10_000, 300, 24_000
#: Share of wrong answers allowed among accepted held-out sentences; sets the rejection threshold.
ACCEPTED_ERROR = 0.002
#: Words in fewer training sentences than COMMON, names as a rule, weigh only RARE.
COMMON, RARE = 4, 0.1
#: Sentences alike but for names and numbers used in training, at most: room for the rare ones.
SAME = 60
#: Log-odds that a change of language between two neighbouring sentences must outweigh.
SWITCH = 2.5

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_LINE = re.compile(r"\r\n|\r|\n| | |\x85")
_CODE_SPAN = re.compile(r"`[^`]*`")
_BULLET = re.compile(r"^(?:[-*+•>]\s+|\d{1,3}[.)]\s+)+")
_DATED = re.compile(r"^\W*[^\W\d_]+\s*:\s*[\d\-/.: TZ+]+$")
_CODELIKE = re.compile(r"[\w.\-]*[=_\\{}<>|@#/][\w.\-]*|\b0x[0-9a-f]+\b|^\[[ x\d]*\]", re.I)
_END = re.compile(r"(?<=[.!?…])[\"»”’)]*\s+")
_ABBREVIATED = re.compile(r"(?:^|[\s(])(?:[^\W\d_]|dr|mr|mrs|ms|prof|inc|ltd|corp|co|no|st|vs|etc|z\.b|d\.h|bzw|e\.g|i\.e)\.$", re.I)


def sentences(text: str | None) -> list[str]:
    """The prose of a text in reading order, sentence by sentence.

    Left out: headings (marked, or short lines that end in no sentence mark), dates, tables, code and log lines.
    Line ends may be of any kind. Null, blank and prose-free texts give an empty list.
    """
    if not text:
        return []
    found = []
    for raw in _LINE.split(unicodedata.normalize("NFC", text)):
        line = raw.strip()
        if not line or line[0] in "#|" or line.startswith(("**", "---", "+++", "@@", "```")) or _DATED.match(line):
            continue
        line = _BULLET.sub("", _CODE_SPAN.sub(" ", line)).strip()
        words = line.split()
        if len(words) < 2:
            continue
        bare_words = [w.strip(".,;:!?…\"'()«»“”„¿¡") for w in words]
        plain = sum(1 for w in bare_words if w.isalpha() or _WORD.fullmatch(w))
        if plain * 2 <= len(words) or (plain < len(words) and not line[-1] in ".!?…" and _CODELIKE.search(line)):
            continue
        if line[-1] not in ".!?…\"»”)’;,:" and len(words) <= 6:
            continue
        held = ""
        for piece in _END.split(line):
            held = f"{held} {piece}" if held else piece
            if not _ABBREVIATED.search(held):
                found.append(held)
                held = ""
        if held:
            found.append(held)
    return found


def words(text: str) -> list[str]:
    """``spoken`` without the letters."""
    return spoken(text)[0]


def spoken(text: str) -> tuple[list[str], int]:
    """The words of a sentence in small letters, without names: runs of two or more capitalised words; and the letters
    of all its words.

    A sentence all in capitals, or without any, shows no names; there rare words count for little instead.
    """
    plain = _WORD.findall(text)
    letters = sum(map(len, plain))
    capital = [w[0].isupper() for w in plain]
    if sum(capital) == len(plain) or not any(a and b for a, b in pairwise(capital)):
        return [w.lower() for w in plain], letters
    found, kept = list(_WORD.finditer(text)), []
    for i, m in enumerate(found):
        beside = (i > 0 and capital[i - 1] and text[found[i - 1].end() : m.start()] == " ") or (i + 1 < len(found) and capital[i + 1] and text[m.end() : found[i + 1].start()] == " ")
        if not (capital[i] and beside):
            kept.append(m.group().lower())
    return kept, letters


def bare(text: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def variants(text: str) -> tuple[str, str, str]:
    """The forms in which one sentence may be met: as written, without accents, in small letters (names unmarked)."""
    return text, bare(text), text.lower()


def grams(word: str) -> list[int]:
    """Buckets of a word and of its pieces of three and four letters, ends marked."""
    w = f"<{word}>"
    return [zlib.crc32(g.encode()) % BUCKETS for g in {w, *(w[i : i + n] for n in (3, 4) for i in range(len(w) - n + 1))}]


@dataclass
class LanguageModel:
    """``table``: what each bucket adds to each language's score (its embedding times the softmax weights)."""

    codes: list[str]
    table: np.ndarray
    bias: np.ndarray
    common: frozenset[str]
    temperature: float = 1.0
    threshold: float = 0.5

    def word(self, w: str) -> np.ndarray:
        """Scores a word adds, the number of its buckets, both weighed, and whether the word is common."""
        b = grams(w)
        weight = 1.0 if w in self.common else RARE
        return np.concatenate([weight * self.table[b].sum(0), [weight * len(b), weight == 1.0]])

    def scores(self, texts: list[str], cache: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-probabilities by language, the share of each text's words that are common in training, and its letters."""
        flat, sizes, lengths = [], [], []
        for t in texts:
            ws, letters = spoken(t)
            lengths.append(letters)
            sizes.append(len(ws))
            for w in ws:
                v = cache.get(w)
                if v is None:
                    if len(cache) > 200_000:
                        cache.clear()
                    v = cache[w] = self.word(w)
                flat.append(v)
        k = len(self.codes)
        total = np.zeros((len(texts), k + 2))
        if flat:
            at = np.repeat(np.arange(len(texts)), sizes)
            rows = np.asarray(flat)
            for j in range(k + 2):
                total[:, j] = np.bincount(at, rows[:, j], len(texts))
        n = np.maximum(total[:, k : k + 1], 1e-9)
        z = (total[:, :k] / n + self.bias) / self.temperature
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True)), total[:, k + 1] / np.maximum(np.array(sizes, float), 1), np.array(lengths, np.int64)


def train(texts: list[tuple[list[str], ...]], y: np.ndarray, k: int, epochs: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, frozenset[str]]:
    """Stochastic gradient descent (AdaGrad steps, batches of 64) over mean bucket embeddings and a linear softmax.

    ``texts``: the words of each in its ``variants``, which are seen in turn. Gives (table, bias, common words).
    """
    rng = np.random.default_rng(seed)
    known: dict[str, list[int]] = {}

    def buckets(said: list[str]) -> np.ndarray:
        out: list[int] = []
        for w in said:
            out += known.get(w) or known.setdefault(w, grams(w))
        return np.asarray(out, np.int64)

    forms = [[buckets(said) for said in t] for t in texts]
    e = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w, b = np.zeros((DIMENSIONS, k), np.float32), np.zeros(k, np.float32)
    ge, gw, gb = np.full((BUCKETS, 1), 1e-4, np.float32), np.full_like(w, 1e-4), np.full_like(b, 1e-4)
    rate = 0.3
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), 64):
            batch = order[i : i + 64]
            ids = [forms[j][(epoch + j) % 3] for j in batch]
            n = np.array([len(x) for x in ids])
            keep = n > 0
            if not keep.any():
                continue
            flat, n, target = np.concatenate(ids), n[keep], y[batch][keep]
            row = np.repeat(np.arange(len(n)), n)
            start = np.r_[0, np.cumsum(n)[:-1]]
            h = np.add.reduceat(e[flat], start, axis=0) / n[:, None]
            z = h @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(n)), target] -= 1
            p /= len(n)
            dh = (p @ w.T) / n[:, None] * len(n)
            dw, db = h.T @ p, p.sum(0)
            gw += dw**2
            gb += db**2
            w -= rate * dw / np.sqrt(gw)
            b -= rate * db / np.sqrt(gb)
            once, inverse = np.unique(flat, return_inverse=True)
            sorted_rows = np.argsort(inverse, kind="stable")
            de = np.add.reduceat(dh[row[sorted_rows]].astype(np.float32), np.searchsorted(inverse[sorted_rows], np.arange(len(once))), axis=0)
            ge[once] += (de**2).mean(1, keepdims=True)
            e[once] -= 0.1 * de / np.sqrt(ge[once])
    often = Counter(v for t in texts for v in {x for form in t for x in form})
    return (e @ w).astype(np.float32), b, frozenset(v for v, n in often.items() if n >= COMMON)


def code_of(label: Column) -> Column:
    """A label's part before any ``-`` or ``_``, in small letters."""
    return F.lower(F.regexp_extract(label, r"^([^-_]*)", 1))


def training_sample(documents: DataFrame, languages: DataFrame, documents_used: int = DOCUMENTS, sentences_used: int = SENTENCES) -> pd.DataFrame:
    """(label, text) rows, a sentence each, of about ``documents_used`` labelled documents.

    Documents are chosen by a hash of ``doc_id``, and so are sentences, whole, where there are more than twice
    ``sentences_used``: that many, within chance, come to the driver, whatever the number and length of the texts.
    """
    codes = languages.where(F.col("lang_code").isNotNull()).select(F.lower("lang_code").alias("label")).distinct()
    # ids and labels only, until the few documents to be read are known
    labelled = documents.where(F.col("text").isNotNull()).select("doc_id", code_of(F.col("lang")).alias("label")).join(codes, "label", "left_semi")
    counts = cut(labelled.groupBy("label").agg(F.count("*").alias("n")))
    even = documents_used / max(1, counts.agg(F.sum("n")).first()[0] or 0)
    shares = counts.select("label", F.least(F.lit(1.0), F.greatest(F.lit(even), F.lit(LEAST) / F.col("n"))).alias("share"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    ids = cut(labelled.join(shares, "label").where(draw < F.col("share")).select("doc_id", "label"))
    drawn = documents.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= 1_000_000 else ids, "doc_id").where(F.col("text").isNotNull())

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, label, s) for d, label, t in zip(b["doc_id"], b["label"], b["text"], strict=True) for i, s in enumerate(sentences(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "nth", "label", "text"])

    said = cut(drawn.mapInPandas(split, "doc_id long, nth int, label string, text string"))
    part = min(1.0, 2 * sentences_used / max(1, said.count()))
    picked = said.where(F.pmod(F.xxhash64("doc_id", "nth"), F.lit(1_000_000)) / 1_000_000 < part).toPandas()
    return picked.sort_values(["doc_id", "nth", "label", "text"])[["label", "text"]].reset_index(drop=True)


def fit(sample: pd.DataFrame, sentences_used: int = SENTENCES, accepted_error: float = ACCEPTED_ERROR, seed: int = 7) -> LanguageModel | None:
    """A model from (label, text) rows; None where no labelled prose is given.

    Sentences that are the same but for names and numbers have the label that three quarters, and three at least, of
    them have. Others are left out where the first model says another.
    A label that the first model confirms for under a third of its sentences is no class of the second. One sentence in
    ten is held out: it sets the temperature, and the rejection threshold at the least confidence above which no more
    than ``accepted_error`` of the answers are wrong.
    """
    rows = [(label, s, tuple(words(s))) for label, t in zip(sample["label"], sample["text"], strict=True) for s in sentences(t)]
    if not rows:
        return None
    votes: dict[tuple, Counter] = {}
    for label, _, key in rows:
        votes.setdefault(key, Counter())[label] += 1
    settled = {k: v.most_common(1)[0][0] for k, v in votes.items() if v.most_common(1)[0][1] >= max(3, 0.75 * v.total())}
    rng, times = np.random.default_rng(seed), Counter()
    picked: list[tuple[str, str, bool]] = []
    for i in rng.permutation(len(rows)):
        label, text, key = rows[i]
        times[key] += 1
        if times[key] <= SAME and len(picked) < sentences_used:
            picked.append((settled.get(key, label), text, key in settled))
    texts = [p[1] for p in picked]
    said_of = [tuple(words(v) for v in variants(t)) for t in texts]
    codes = sorted({p[0] for p in picked})
    y = np.array([codes.index(p[0]) for p in picked])
    table, bias, common = train(said_of, y, len(codes), 6, seed)
    first = LanguageModel(codes, table, bias, common)
    said = first.scores(texts, {})[0].argmax(1)
    kept = [c for i, c in enumerate(codes) if (y == i).any() and (said[y == i] == i).mean() >= 1 / 3 and (said == i).sum() > 0]
    if not kept:
        return first
    right = np.array([(a == b or p[2]) and codes[b] in kept for a, b, p in zip(said, y, picked, strict=True)])
    good, good_said = [t for t, r in zip(texts, right, strict=True) if r], [t for t, r in zip(said_of, right, strict=True) if r]
    z = np.array([kept.index(codes[c]) for c in y[right]])
    held = np.arange(len(good)) % 10 == 9
    table, bias, common = train([t for t, h in zip(good_said, held, strict=True) if not h], z[~held], len(kept), 12, seed)
    model = LanguageModel(kept, table, bias, common)
    if held.sum() >= 20:
        tested = [t for t, h in zip(good, held, strict=True) if h]
        tested = [variants(t)[i % 3] for i, t in enumerate(tested)]
        raw = model.scores(tested, {})[0]

        def loss(t: float) -> float:
            s = raw / t
            s = s - np.log(np.exp(s).sum(1, keepdims=True))
            return -s[np.arange(len(s)), z[held]].mean()

        model.temperature = float(min(np.geomspace(0.3, 10, 60), key=loss))
        p = np.exp(model.scores(tested, {})[0])
        sure, wrong = p.max(1), p.argmax(1) != z[held]
        order = np.argsort(-sure)
        bad = np.cumsum(wrong[order]) / np.arange(1, len(order) + 1)
        within = np.flatnonzero(bad <= accepted_error)
        model.threshold = float(np.clip(sure[order][within[-1]] if len(within) else 0.99, 0.5, 0.99))
    return model


def _path(logp: np.ndarray, switch: float) -> np.ndarray:
    """The most likely languages of successive sentences when each change costs ``switch``."""
    n, k = logp.shape
    best, back = logp[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - switch
        back[i] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, best[top] - switch) + logp[i]
    out = np.zeros(n, np.int64)
    out[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def segments(model: LanguageModel, logp: np.ndarray, known: np.ndarray, letters: np.ndarray, switch: float = SWITCH) -> list[tuple[str, float, int]]:
    """(language, confidence, letters) of each longest run of sentences in one language.

    A sentence under the rejection threshold, or with hardly a word that is common in training, says nothing: it goes with
    its neighbours. Where every sentence is rejected their sum decides, and the confidence is low.
    """
    p = np.exp(logp)
    accepted = (p.max(1) >= model.threshold) & (known >= 0.2)
    if not accepted.any():
        total = logp.sum(0)
        path = np.full(len(logp), int(total.argmax()))
    else:
        path = _path(np.where(accepted[:, None], np.maximum(logp, -12.0), 0.0), switch)
    cuts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(path)], strict=True):
        lang = path[a]
        weight = letters[a:b]
        out.append((model.codes[lang], float((p[a:b, lang] * weight).sum() / max(1, weight.sum())), int(weight.sum())))
    return out


def document_languages(documents: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, label, seg_no, lang, confidence, letters, n_segments): seg_no 0 the main language, 1… the segments.

    The main language has the most letters of prose, the earlier one if two have as many. Documents without prose
    (null, blank, only code or headings) give no row. Every text is read whole. The model, some 2 MB whatever the
    number of documents, is sent with the function.
    """
    schema = "doc_id long, label string, seg_no int, lang string, confidence double, letters long, n_segments int"
    if model is None:
        return documents.select("doc_id", F.col("lang").alias("label")).where(F.lit(False)).mapInPandas(lambda it: it, "doc_id long, label string").selectExpr("doc_id", "label", "0 AS seg_no", "'' AS lang", "0D AS confidence", "0L AS letters", "0 AS n_segments")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, np.ndarray] = {}
        for batch in batches:
            # a batch may hold long texts: a few hundred at a time keep its sentences small in memory
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                each = [sentences(t) for t in part["text"]]
                logp, known, sizes = model.scores([s for x in each for s in x], cache)
                out, done = [], 0
                for doc, label, said in zip(part["doc_id"], part["label"], each, strict=True):
                    if not said:
                        continue
                    own = slice(done, done + len(said))
                    runs = segments(model, logp[own], known[own], sizes[own])
                    done += len(said)
                    sums: dict[str, list[float]] = {}
                    for lang, sure, letters in runs:
                        s = sums.setdefault(lang, [0, 0.0])
                        s[0] += letters
                        s[1] += sure * letters
                    main = max(sums, key=lambda c: sums[c][0])
                    out.append((doc, label, 0, main, sums[main][1] / max(1, sums[main][0]), int(sums[main][0]), len(runs)))
                    out += [(doc, label, i, *r, len(runs)) for i, r in enumerate(runs, 1)]
                yield pd.DataFrame(out, columns=["doc_id", "label", "seg_no", "lang", "confidence", "letters", "n_segments"])

    return documents.where(F.col("text").isNotNull()).select("doc_id", F.col("lang").alias("label"), "text").mapInPandas(run, schema)


def wrong_or_mixed(found: DataFrame) -> DataFrame:
    """(doc_id, seg_no, lang) of ``document_languages``: the main language where the label is missing or another, and
    the segments of documents that have several."""
    right = F.coalesce(code_of(F.col("label")) == F.col("lang"), F.lit(False))
    return found.where(((F.col("seg_no") == 0) & ~right) | ((F.col("seg_no") > 0) & (F.col("n_segments") > 1))).select("doc_id", "seg_no", "lang")
