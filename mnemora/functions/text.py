"""Text and vector functions as column expressions; everything runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemora.schema import SENSITIVITY

# Fixed value: what separates tokens (Latin and Cyrillic letters and digits stay).
SPLIT = "[^a-zа-яё0-9]+"


def embedding_tokens(text: Column) -> Column:
    """Words of more than two letters in small letters, repeats kept."""
    return F.filter(F.split(F.lower(text), SPLIT), lambda t: F.length(t) > 2)


def tokens(text: Column) -> Column:
    """``embedding_tokens`` with words also parted where a small letter meets a capital."""
    return embedding_tokens(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"))


def words(text: Column) -> Column:
    """What stands between white space; null for null."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"\s+", "-")


def make_id(prefix: str, *values: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), *values)


def content_id(prefix: str, text: Column) -> Column:
    """Prefix and the first twelve hex digits of the text's SHA-256."""
    return make_id(prefix, F.substring(F.sha2(text, 256), 1, 12))


def sensitivity(level: Column) -> Column:
    """A known level as it is, anything else ``internal``."""
    return F.when(level.isin(*SENSITIVITY), level).otherwise(F.lit("internal"))


def sensitivity_rank(level: Column) -> Column:
    rank = F.lit(SENSITIVITY["internal"])
    for name, n in SENSITIVITY.items():
        rank = F.when(level == name, F.lit(n)).otherwise(rank)
    return rank


def clamp(x: Column) -> Column:
    """Between 0 and 1; null and NaN become 0."""
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def bucket(token: Column, dims: int) -> Column:
    """A token's place in a vector: the absolute 32-bit polynomial (31) hash of its code points, modulo ``dims``.

    Kept in 64 bits and wrapped at each step, as overflow is an error in ANSI mode.
    """
    letters = F.filter(F.split(token, ""), lambda c: c != "")
    wrapped = F.aggregate(letters, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + F.ascii(c) + 2147483648, F.lit(4294967296)) - 2147483648)
    return (F.abs(wrapped) % dims).cast("int")


def dot(a: Column, b: Column) -> Column:
    """Sum of products of arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is all zero. Longer vectors are cut to the shorter one's length."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def first_quarter(text: Column) -> Column:
    """The first quarter of a text's words, one at least."""
    w = words(text)
    return F.array_join(F.slice(w, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(w) / 4).cast("int"))), " ")


def first_words(text: Column, n: int = 5) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def overlap(query: list[str], content: Column) -> tuple[Column, Column]:
    """(share of the query's tokens found among ``content``'s, the tokens found), repeats in the query counting."""
    asked = F.array(*[F.lit(t) for t in query]) if query else F.array().cast("array<string>")
    hits = F.filter(asked, lambda t: F.array_contains(content, t))
    return F.size(hits) / F.lit(float(max(1, len(query)))), hits


def query_tokens(text: str) -> list[str]:
    """``tokens`` of a query, on the driver."""
    import re

    return [t for t in re.split(SPLIT, re.sub("([a-z])([A-Z])", r"\1 \2", text).lower()) if len(t) > 2]
