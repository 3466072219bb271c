"""Filling windows of a fixed size with texts (problem 6).

The texts are cut to pieces no longer than a window, and the pieces' length histogram (at most one entry a length,
whatever the number of texts) is packed on the driver. The configuration linear program is solved by multiplicative
weights, each step priced by a knapsack dynamic program, until its solution covers every length and is proven to be
within EPS of the best; it is rounded down, and what rounding leaves is solved again as long as that is whole fillings.
Only the last remainder is filled longest first. The resulting plan says for each length which windows hold it, so
every piece finds its place from its rank among pieces of its length. Ranks come from counts per partition, so one
frequent length is never gathered in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.llm.tokens import TOKENIZER, token_counts
from mnemora.session import cut

CAPACITY = 2_048
#: The linear program is solved when its windows are proven to be at most this share more than needed.
EPS = 0.15
#: By how much a full covering of a length lowers the logarithm of its weight, and how far a known filling may be from
#: the best one to be taken without pricing anew. As exp and these together allow an error of 1.08, EPS is reached.
STEP, LAZY = 0.12, 0.02


def best_filling(worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The lengths that together fit ``capacity`` and are worth most, repeats allowed: knapsack over capacities.

    ``worth[l]`` is the worth of length ``l``, -inf where there is none. Gives (lengths, their worth).
    """
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        each = worth[1 : c + 1] + best[c - 1 :: -1] if c > 1 else worth[1:2] + best[:1]
        top = int(each.argmax())
        if each[top] > best[c - 1]:
            best[c], choice[c] = each[top], top + 1
        else:
            best[c] = best[c - 1]
    chosen, c = [], capacity
    while c > 0:
        if choice[c]:
            chosen.append(choice[c])
            c -= choice[c]
        else:
            c -= 1
    return np.array(chosen, np.int64), float(best[capacity])


def proven(counts: np.ndarray) -> float:
    """Windows that any packing needs, by dual feasible functions: the tokens themselves, and for k = 1, 2, … lengths
    counted in k-ths of a window, rounded so that no window's pieces can count for more than one."""
    capacity = len(counts) - 1
    lengths = np.arange(capacity + 1)
    best = float((lengths * counts).sum() / capacity)
    for k in range(1, 101):
        scaled = (k + 1) * lengths
        best = max(best, float((np.where(scaled % capacity == 0, lengths / capacity, (scaled // capacity) / k) * counts).sum()))
    return best


def first_fillings(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A filling begun with each length and filled up with the longest that fits, as rows of how often each is in it."""
    rows = np.zeros((len(lengths), len(lengths)), np.int64)
    for i, length in enumerate(lengths):
        rows[i, i], space = 1, capacity - length
        while (at := int(np.searchsorted(lengths, space, side="right")) - 1) >= 0:
            rows[i, at] += space // lengths[at]
            space %= lengths[at]
    return np.unique(rows, axis=0)


def fractional(counts: np.ndarray, eps: float = EPS) -> tuple[np.ndarray, np.ndarray, float]:
    """The configuration program by multiplicative weights: (fillings, times, lower bound on windows).

    Of ``counts[l]`` pieces of length ``l`` each filling is a row: how often it holds each length there is. ``times`` of
    them cover every length, with no more than (1 + eps) times the windows needed. A length's weight falls with the
    share of it covered so far; each round takes the filling worth most at these weights, a known one unless pricing
    by the knapsack finds one better by LAZY, as often as its scarcest length allows. The weights over the best worth
    are a dual solution, so every pricing bounds the windows needed from below.
    """
    capacity = len(counts) - 1
    lengths = np.flatnonzero(counts)
    n, m = counts[lengths].astype(float), len(lengths)
    rows = list(first_fillings(lengths, capacity))
    held = [np.flatnonzero(r) for r in rows]
    # a column a filling: a round changes the prices of one filling's lengths, and by these the worth of all
    of = np.zeros((m, 2 * len(rows) + 64))
    of[:, : len(rows)] = np.array(rows).T
    used = np.zeros(of.shape[1])
    weight, covered, bound = np.log(lengths * n), np.zeros(m), proven(counts)
    weight -= weight.max()
    price = np.exp(weight) / n
    worths, dual = price @ of[:, : len(rows)], float((price * n).sum())
    rounds = 0
    while True:
        rounds += 1
        best = int(worths.argmax())
        if dual > (1 + LAZY) * bound * worths[best]:
            worth = np.full(capacity + 1, -np.inf)
            worth[lengths] = price
            chosen, value = best_filling(worth, capacity)
            bound = max(bound, dual / value)
            if value > worths[best] * (1 + 1e-9):
                best = len(rows)
                rows.append(np.bincount(np.searchsorted(lengths, chosen), minlength=m))
                held.append(np.flatnonzero(rows[best]))
                if best == of.shape[1]:
                    of, used = np.concatenate([of, np.zeros_like(of)], axis=1), np.concatenate([used, np.zeros_like(used)])
                of[:, best] = rows[best]
                worths = np.append(worths, value)
        at = held[best]
        each = rows[best][at]
        often = float((n[at] / each).min())
        used[best] += often
        covered[at] += often * each / n[at]
        weight[at] -= STEP * often * each / n[at]
        change = np.exp(weight[at]) / n[at] - price[at]
        price[at] += change
        worths += change @ of[at, : len(rows)]
        dual += float((change * n[at]).sum())
        if rounds % m == 0:
            # sums made anew, so that errors don't add up
            worths, dual = price @ of[:, : len(rows)], float((price * n).sum())
            if covered.min() > 0 and used.sum() <= (1 + eps) * bound * covered.min():
                return np.array(rows), used[: len(rows)] / covered.min(), bound


@dataclass
class Plan:
    """``fillings``: (lengths, longest first, with repeats; times used). ``bound``: windows any packing needs."""

    capacity: int
    fillings: list[tuple[list[int], int]]
    bound: float

    @property
    def windows(self) -> int:
        return sum(n for _, n in self.fillings)

    @property
    def tokens(self) -> int:
        return sum(sum(f) * n for f, n in self.fillings)


def longest_first(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """(length and how often, times) of windows filled with the longest piece left, then always the longest that fits;
    each filling is used until one of its lengths is gone."""
    capacity, left, out = len(counts) - 1, counts.astype(np.int64).copy(), []
    while left.any():
        space, pairs, length = capacity, [], capacity
        there = np.flatnonzero(left)
        while space > 0:
            at = np.searchsorted(there, min(space, length), side="right") - 1
            if at < 0:
                break
            length = int(there[at])
            a = min(int(left[length]), space // length)
            pairs.append((length, a))
            space -= a * length
            length -= 1
        n = int(min(left[length] // a for length, a in pairs))
        for length, a in pairs:
            left[length] -= a * n
        out.append((pairs, n))
    return out


def plan_windows(counts: np.ndarray, eps: float = EPS) -> Plan:
    """Which fillings to use how often so that each of ``counts[l]`` pieces of length ``l`` has a place."""
    capacity = len(counts) - 1
    left = counts.astype(np.int64).copy()
    fillings: list[tuple[list[int], int]] = []
    bound = 0.0

    def use(pairs: list[tuple[int, int]], n: int) -> None:
        for length, a in pairs:
            left[length] -= a * n
        fillings.append(([int(length) for length, a in sorted(pairs, reverse=True) for _ in range(a)], int(n)))

    # while there are more windows to fill than lengths, so that fillings come whole
    while left.any() and (not fillings or (np.arange(capacity + 1) * left).sum() > capacity * (left > 0).sum()):
        before, lengths = len(fillings), np.flatnonzero(left)
        rows, times, least = fractional(left, eps)
        bound = bound or least
        n = left[lengths]
        over = (rows * times[:, None]).sum(0) / n
        for i in np.argsort(-times):
            held = np.flatnonzero(rows[i])
            # a length is covered more often than needed: a filling counts as much as its most-needed length
            often = min(int(times[i] / over[held].min() + 1e-9), int((left[lengths[held]] // rows[i][held]).min())) if len(held) else 0
            if often > 0:
                use(list(zip(lengths[held].tolist(), rows[i][held].tolist(), strict=True)), often)
        if len(fillings) == before:
            break
    for pairs, n in longest_first(left):
        use(pairs, n)
    # rounding may lose more than the program gains
    plain = longest_first(counts)
    if sum(n for _, n in plain) < sum(n for _, n in fillings):
        fillings.clear()
        for pairs, n in plain:
            use(pairs, n)
    return Plan(capacity, fillings, bound)


def pieces(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece_no, size): each text whole, or, where it exceeds a window, cut into full windows and a rest."""
    full, rest = F.floor(F.col("n_tokens") / capacity), F.col("n_tokens") % capacity
    sizes = F.concat(F.array_repeat(F.lit(capacity), full.cast("int")), F.when(rest > 0, F.array(rest.cast("int"))).otherwise(F.array().cast("array<int>")))
    return sized.select("doc_id", F.posexplode(sizes).alias("piece_no", "size"))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank``, counted from 0 among rows of one ``size``.

    Each partition numbers its own rows; the starts come from the counts per (partition, size), which are summed over
    partitions, not over rows.
    """

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, int] = {}
        for batch in batches:
            if len(batch):
                nth = batch.groupby("size", sort=False).cumcount() + batch["size"].map(seen).fillna(0).astype("int64")
                for size, n in batch["size"].value_counts().items():
                    seen[size] = seen.get(size, 0) + int(n)
                yield batch.assign(nth=nth)

    numbered = cut(rows.withColumn("pid", F.spark_partition_id()).mapInPandas(number, "doc_id long, piece_no int, size int, pid int, nth long"))
    counts = numbered.groupBy("pid", "size").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("pid", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return numbered.join(starts, ["pid", "size"]).select("doc_id", "piece_no", "size", (F.col("start") + F.col("nth")).alias("rank"))


def _places(plan: Plan) -> dict[str, np.ndarray]:
    """The plan as slots: of one length, slots ``start``… lie in windows ``base``…, ``each`` to a window."""
    slots = []
    base, given = 0, np.zeros(plan.capacity + 1, np.int64)
    for no, (lengths, n) in enumerate(plan.fillings):
        ls, first, a = np.unique(-np.array(lengths), return_index=True, return_counts=True)
        offsets = np.r_[0, np.cumsum(lengths)]
        for length, i, each in zip(-ls, first, a, strict=True):
            slots.append((length, given[length], base, each, offsets[i], i, offsets[-1], no))
            given[length] += each * n
        base += n
    slots.sort()
    names = ("size", "start", "base", "each", "offset", "place", "used", "filling")
    return {k: np.array([s[i] for s in slots], np.int64) for i, k in enumerate(names)}


def place(rows: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, piece_no, n_tokens, window_no, position, start_token, window_tokens) of ranked pieces.

    The plan's fillings come from lengths, not from pieces, so its slots are a bounded table that goes with the function.
    """
    at, wide = _places(plan), np.int64(1) << 40

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = at["size"] * wide + at["start"]
        for b in batches:
            size, rank = b["size"].to_numpy(np.int64), b["rank"].to_numpy(np.int64)
            slot = np.searchsorted(keys, size * wide + rank, side="right") - 1
            within = rank - at["start"][slot]
            copy = within % at["each"][slot]
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"], "piece_no": b["piece_no"], "n_tokens": size, "window_no": at["base"][slot] + within // at["each"][slot],
                    "position": at["place"][slot] + copy, "start_token": at["offset"][slot] + copy * size, "window_tokens": at["used"][slot],
                }
            )

    return rows.mapInPandas(run, "doc_id long, piece_no int, n_tokens int, window_no long, position int, start_token int, window_tokens int")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER, eps: float = EPS) -> tuple[DataFrame, DataFrame]:
    """(placements, report). Texts of null or no tokens need no place and have no row; repeated texts have one each.

    Report, one row: windows, tokens, the share of all room left unused, and the windows that any packing needs.
    """
    spark = documents.sparkSession
    cutted = cut(pieces(token_counts(documents, path), capacity))
    counts = np.zeros(capacity + 1, np.int64)
    for r in cutted.groupBy("size").count().collect():  # at most ``capacity`` rows
        counts[r["size"]] = r["count"]
    plan = plan_windows(counts, eps)
    room = plan.windows * capacity
    report = spark.createDataFrame(
        [(plan.windows, plan.tokens, (room - plan.tokens) / room if room else 0.0, int(np.ceil(plan.bound - 1e-6)))],
        "windows long, tokens long, unused_share double, windows_needed long",
    )
    return place(ranked(cutted), plan), report
