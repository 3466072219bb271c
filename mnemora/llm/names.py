"""What a typed name says: its words in a common form, told by counts and by what recorded aliases teach (problem 4)."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations, product

from mnemora.llm.shortforms import ANYONE, ORNAMENTS, SHORT

#: Words of a name for which every way of shortening is foreseen; of longer names only initials for all, or all left out but one.
FORESEEN = 4


def one_edit(a: str, b: str) -> bool:
    """Whether a and b are equal or differ by one letter put in, left out, replaced, or two neighbours swapped."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def looks_short(s: str, full: str) -> bool:
    """Whether s may be a shortening of full by its looks: begun alike, or, of up to four letters, letters of it in order."""
    rest = iter(full)
    return len(s) < len(full) and s[:1] == full[:1] and (s[:2] == full[:2] or (len(s) <= 4 and all(c in rest for c in s)))


class SegmentIndex:
    """Words at most one edit away, by the two halves of each: one edit leaves a half as it is, moved by one at most."""

    def __init__(self, known: Iterable[str]) -> None:
        self.at: dict[tuple[int, int, str], list[str]] = {}
        for w in known:
            h = len(w) // 2
            self.at.setdefault((len(w), 0, w[:h]), []).append(w)
            self.at.setdefault((len(w), 1, w[h:]), []).append(w)

    def near(self, word: str) -> set[str]:
        found: set[str] = set()
        n = len(word)
        for m in (n - 1, n, n + 1):
            h = m // 2
            # the second half also where the swap straddles the cut: both halves change, by one known letter each
            turned = word[: h - 1] + word[h : h + 1] if h else ""
            pieces = {(0, word[:h]), (0, turned), *((1, word[h + shift :]) for shift in (-1, 0, 1) if h + shift >= 0)}
            for no, piece in pieces:
                found.update(w for w in self.at.get((m, no, piece), ()) if w != word and one_edit(w, word))
        return found


@dataclass
class Words:
    """What is known of words. ``common``: those that stand beside many others; ``short``: word -> what it may stand
    for; ``ornaments``: what is no part of a name; ``events``: words of decisions and incidents; ``beside``: pairs of
    neighbouring common words."""

    common: frozenset[str] = frozenset()
    short: dict[str, tuple[str, ...]] = field(default_factory=lambda: {k: tuple(v.split()) for k, v in SHORT.items()})
    ornaments: frozenset[str] = ORNAMENTS
    events: frozenset[str] = frozenset()
    beside: frozenset[tuple[str, str]] = frozenset()

    def __post_init__(self) -> None:
        self.index = SegmentIndex(w for w in self.common if len(w) >= 3)
        self.long = frozenset(w for w in self.common if len(w) >= 5)
        self.of: dict[str, list[str]] = {}
        for s, full in self.short.items():
            if len(full) > 1:
                for f in full:
                    self.of.setdefault(f, []).append(s)

    def stands(self, word: str) -> tuple[str, ...]:
        return self.short.get(word, ())

    def known(self, word: str) -> bool:
        return word in self.common or word in self.short

    def meant(self, words: list[str]) -> list[str]:
        """``words`` with misspelt common ones put right; one of under five letters, or of several near, the one that goes
        with a word beside it."""
        out = list(words)
        for i, w in enumerate(words):
            if self.known(w) or len(w) < 3 or w in self.ornaments:
                continue
            near = self.index.near(w)
            fit = {x for x in near if len(x) >= 5}
            if len(fit) != 1:
                fit = {x for x in near if (i and (words[i - 1], x) in self.beside) or (i + 1 < len(words) and (x, words[i + 1]) in self.beside)}
            if len(fit) == 1:
                out[i] = fit.pop()
        return out

    def apart(self, word: str, after: str = "") -> list[str]:
        """A word with common ones written onto its end taken apart; what is left has four letters at least. Common
        ones have five letters at least, four before a word that they go with."""
        if not self.known(word):
            for cut in range(4, len(word) - 3):
                end = word[cut:]
                if end in self.long or (end, after) in self.beside:
                    return [*self.apart(word[:cut], end), end]
        return [word]


_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])|(?<=[a-z]{4})(?=[A-Z]{2}$)")
_ASIDE = re.compile(r"\([^)]*\)|\s-\s.*$")
_INITIALS = re.compile(r"(?<![^\W\d_])((?:[a-z]\.){1,3})(?![^\W\d_])")
_TOKEN = re.compile(r"[^\W_]+(?:[&/][^\W_]+)*")


def fold(name: str) -> str:
    """Without accents and outer blanks, blanks single."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return " ".join(flat.split())


def words(name: str, known: Words) -> tuple[list[str], int]:
    """The words of a name in small letters, and how many stand before a comma (0 without one).

    Asides and marks are gone; handles and words run together by capitals, ``_`` or ``-`` are apart, the last only if
    all of them but one are known: else the hyphen stands inside a word.
    """
    s = _ASIDE.sub(" ", fold(name)).strip().strip("@").replace("_", " ")
    if s.swapcase().istitle() and not s.istitle():
        s = s.swapcase()
    head, comma, rest = s.partition(",")
    if comma and set(_TOKEN.findall(rest.replace(".", "").lower())) <= known.ornaments:
        s, comma = head, ""
    s = _CAMEL.sub(" ", s).lower()
    if " " not in s and re.fullmatch(r"[^\W\d_]{2,}[\w\-]*(\.[^\W\d_][\w\-]+)+", s):
        s = s.replace(".", " ")
    s = _INITIALS.sub(lambda m: " " + " ".join(m.group(1).replace(".", " ").split()) + " ", s)
    out: list[str] = []
    before = 0
    for raw in s.replace(",", " , ").split():
        if raw == ",":
            before = before or (len(out) if comma else 0)
            continue
        parts = [p for p in raw.split("-") if p]
        if len(parts) > 1:
            right = known.meant(parts)
            sure = sum(known.known(r) and (r == p or len(p) > 6) for p, r in zip(parts, right, strict=True))
            parts = parts if sure >= len(parts) - 1 else ["".join(parts)]
        for w in parts:
            for t in _TOKEN.findall(w.replace(".", "").replace("'", "").replace("’", "")):
                out += known.apart(t)
    return out, before


@dataclass
class Reading:
    """``head``: the distinctive words, sorted and run together; ``tail``: the common ones, sorted. ``whole``: nothing
    is shortened in it. ``asks``: (head, tail, rank) under which to look up what it may stand for, best first.
    ``answers``: (head, tail, how) under which a whole name is looked up; how: ``plain``, the same words in written order,
    ``short``, or ``guess``, short where nothing tells which word is the given name or that its end was left out."""

    head: str
    tail: str
    whole: bool
    asks: list[tuple[str, str, int]]
    answers: list[tuple[str, str, str]]


def shortenings(tail: list[str], known: Words) -> set[str]:
    """The tails that a name with the common words ``tail`` may be shortened to: initials or ambiguous short forms for
    any of them, or some left out, one at least staying."""
    if len(tail) > FORESEEN:
        ways = {tuple(w[0] for w in tail), *((w,) for w in tail), *combinations(tail, len(tail) - 1)}
    else:
        ways = set(product(*[(w, w[0], *known.of.get(w, ())) for w in tail]))
        ways |= {c for n in range(1, len(tail)) for c in combinations(tail, n)}
        # the last word, a legal form as a rule, may go while the others are shortened
        ways |= {c[:-1] for c in ways if len(tail) > 2 and len(c) == len(tail) and c[-1] == tail[-1]}
    return {" ".join(sorted(c)) for c in ways} - {" ".join(sorted(tail))}


def read(name: str | None, known: Words) -> Reading | None:
    """The reading of a name; None for null, blank and vague ones and those of decisions and incidents."""
    if name is None or fold(name).lower() in ANYONE:
        return None
    said, before = words(name, known)
    if not said or all(w in ANYONE or w in known.ornaments for w in said):
        return None
    said = known.meant(said)
    full: list[str] = []
    comma = 0
    for i, w in enumerate(said):
        if i == before:
            comma = len(full)
        stands = known.stands(w)
        if w not in known.ornaments or len(said) == 1:
            full += stands[0].split() if len(stands) == 1 else [w]
    if not full:
        return None
    if known.events.intersection(full):
        return None
    letters = [w for w in full if len(w) == 1 and w.isalpha()]
    unsure = [w for w in full if len(known.stands(w)) > 1]
    common = [w for w in full if w in known.common and w not in unsure]
    heads = [w for w in full if w not in common and w not in letters and w not in unsure]
    if not heads and len(unsure) + len(common) > 1 and not letters and not common:
        heads, unsure = unsure[-1:], unsure[:-1]
    if not heads:  # of common words only, these tell it from others
        if letters or unsure:
            return None
        return Reading("".join(sorted(common)), "", True, [], [])
    head, plain = "".join(sorted(heads)), "".join(heads)
    tail = " ".join(sorted(common + letters + unsure))
    if letters or unsure:
        asks = [(head, tail, 0)]
        if letters and (common or unsure or len(heads) > 1):
            asks.append((head, " ".join(sorted(common + unsure)), 1))
        return Reading(head, tail, False, asks, [])
    answers = [(head, t, "short") for t in shortenings(common, known)] if common else []
    if plain != head:
        answers.append((plain, tail, "plain"))
    if not common and 2 <= len(heads) <= 3:
        # unknown words in full: the given name comes first, or first after a comma
        first = full[comma] if comma < len(full) else full[0]
        rest = list(heads)
        rest.remove(first)
        answers += [("".join(sorted(rest)), t, "guess") for t in {first[0], *known.of.get(first, ())}]
    if not common and len(heads) == 1 and len(head) >= 8:
        # a single word may lose its end, a quarter of it at most
        answers += [(head[:n], "", "guess") for n in range(max(6, len(head) - len(head) // 4), len(head))]
    return Reading(head, tail, True, [], answers)


def taught(name: str | None, alias: str | None) -> list[tuple[str, str]]:
    """What an alias teaches beside its object's name: (words of the alias, words of the name) in which alone they
    differ, at most two each and one side perhaps none. Nothing where they share no word of four letters."""
    if name is None or alias is None:
        return []
    plain = Words(short={})
    a, b = words(alias, plain)[0], words(name, plain)[0]
    if not a or not b or len(a) > 12 or len(b) > 12:
        return []
    both = Counter(a) & Counter(b)
    if not any(len(w) >= 4 for w in both):
        return []

    def rest(xs: list[str]) -> list[str]:
        left, out = Counter(both), []
        for x in xs:
            if left[x]:
                left[x] -= 1
            else:
                out.append(x)
        return out

    x, y = rest(a), rest(b)
    if any(len(w) < 2 for w in x) or len(x) > 2 or len(y) > 2 or not (x or y):
        return []
    if len(x) == 1 and len(y) == 2:
        # one word for two neighbours: their initials, or short for one of them, the other left out
        if b.index(y[1]) == b.index(y[0]) + 1 and x[0] == y[0][0] + y[1][0]:
            return [(x[0], " ".join(y))]
        y = [w for w in y if looks_short(x[0], w)][:1]
        return [(x[0], y[0])] if y else []
    return [(" ".join(x), " ".join(y))]
