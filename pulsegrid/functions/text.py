"""Text enrichment as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once: a variable of a lambda costs no second evaluation."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is, whatever the engine's rules for other letters."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, shortest: int = 1) -> Column:
    """Words of a-z only, in lower case: a run that touches another letter, a digit or an underscore is none."""
    found = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(r"(?<![\p{L}\p{N}_])([a-z]+)(?![\p{L}\p{N}_])"), F.lit(1))
    return F.filter(found, lambda w: F.length(w) >= shortest)


def lexicon_score(tokens: Column, positive: list[str], negative: list[str], intensifiers: list[str], boost: float = 1.5) -> Column:
    """clamp(5 * (positive - negative) / tokens): each hit counts 1, or `boost` right after an intensifier; 0 without tokens."""

    def scored(t: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            weight = F.when(F.get(t, i - 1).isin(intensifiers), F.lit(boost)).otherwise(F.lit(1.0))
            return F.when(w.isin(positive), weight).when(w.isin(negative), -weight).otherwise(F.lit(0.0))

        total = F.aggregate(F.transform(t, one), F.lit(0.0), lambda s, x: s + x)
        return 5.0 * total / F.nullif(F.size(t).cast("double"), F.lit(0.0))

    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(let(tokens, scored), F.lit(0.0))))


def label(score: Column, band: float = 0.1) -> Column:
    return F.when(score > band, "positive").when(score < -band, "negative").otherwise("neutral")


def tickers(text: Column, symbols: list[str], stop: list[str], ambiguous: list[str]) -> Column:
    """Cashtags in any case that aren't stop words, and bare upper-case symbols of the universe that are neither stop words nor ambiguous; sorted, distinct."""
    cash = F.transform(F.regexp_extract_all(text, F.lit(r"\$([A-Za-z]{1,5})(?![\p{L}\p{N}_])"), 1), F.upper)
    bare = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])([A-Z]{2,5})(?![\p{L}\p{N}_])"), 1)
    cash = F.filter(cash, lambda t: ~t.isin(stop))
    bare = F.filter(bare, lambda t: t.isin(symbols) & ~t.isin(stop + ambiguous))
    return F.array_sort(F.array_union(cash, bare))


def contains(text: Column, query: str) -> Column:
    """Case-insensitive, and the query's characters stand for themselves."""
    return F.contains(F.lower(text), F.lit(query.lower()))


def normalised_key(text: Column, chars: int = 300) -> Column:
    """Key for duplicate posts: lower case, single blanks, the first characters."""
    return F.substring(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 1, chars)
