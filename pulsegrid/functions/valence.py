"""Finance sentiment: valences of words in their surroundings, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.functions import lexicon
from pulsegrid.functions import text as T

# Valences of trading slang.
FINANCE = {
    "moon": 3.0, "mooning": 3.0, "rocket": 2.5, "tendies": 2.5, "calls": 1.5, "bullish": 2.5, "buy": 1.5, "long": 1.2, "squeeze": 2.0, "breakout": 2.0,
    "rip": 1.5, "ripping": 2.0, "green": 1.5, "gains": 2.0, "printing": 2.0, "undervalued": 2.0, "diamond": 1.5, "hold": 1.0, "hodl": 1.5, "yolo": 0.5,
    "pump": 1.0, "rally": 2.0, "beat": 1.5, "upgrade": 2.0,
    "puts": -1.5, "bearish": -2.5, "sell": -1.5, "short": -1.2, "crash": -3.0, "dump": -2.0, "dumping": -2.5, "red": -1.5, "bagholder": -2.5, "bag": -1.5,
    "rug": -3.0, "rugpull": -3.0, "rugged": -3.0, "tank": -2.5, "tanking": -2.5, "drilling": -2.0, "drill": -1.5, "bleeding": -2.5, "overvalued": -2.0,
    "downgrade": -2.0, "miss": -1.5, "bankruptcy": -3.0, "dilution": -2.0, "scam": -3.0, "halt": -1.5,
}
#: General words, our own list.
GENERAL = {
    "good": 1.9, "great": 3.0, "excellent": 2.7, "amazing": 2.8, "best": 3.0, "love": 3.0, "happy": 2.6, "win": 2.6, "strong": 2.2, "profit": 1.9, "solid": 1.6, "safe": 1.8,
    "bad": -2.4, "terrible": -2.2, "awful": -2.1, "worst": -3.0, "hate": -2.7, "sad": -2.0, "loss": -1.6, "weak": -1.8, "fraud": -2.8, "fear": -2.1, "risky": -1.4, "broken": -1.9,
}
#: Words that strengthen or weaken what follows, and words that turn it round; with the shares by which distance tells.
STRONGER = ["absolutely", "completely", "extremely", "really", "so", "totally", "very", "hugely", "insanely"]
WEAKER = ["barely", "hardly", "kinda", "marginally", "slightly", "somewhat", "sorta"]
NEGATIONS = ["not", "no", "never", "none", "nothing", "neither", "nor", "without", "cannot", "aint", "isnt", "wasnt", "dont", "doesnt", "didnt", "wont", "wouldnt"]
# The published constants of the rules.
BOOST, CAPITALS, TURN, SPREAD = 0.293, 0.733, -0.74, 15.0
NEARER = [1.0, 0.95, 0.9]
MARK, MARKS, DOUBT, DOUBTS = 0.292, 4, 0.18, 0.96


def _map(of: dict[str, float]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in of.items()))


def valence(text: Column, valences: dict[str, float] | None = None) -> Column:
    """Score of a text from -1 to 1, rounded to four places; 0 without text or without a word of the lexicon.

    Tokens stand between white space, without the marks at their ends; case matters only as capitals. Each word of the lexicon counts
    its valence v, in these steps: 1. `CAPITALS` more, away from 0, if it is in capitals and other words aren't. 2. For each of the three words
    before it that is itself not in the lexicon, the nearest first: a stronger or weaker word adds or takes `BOOST`, and `CAPITALS` if that
    word is in such capitals, by its distance's share, away from or towards 0; then a negation (also what ends in n't) multiplies by
    `TURN`. 3. Half of it before the first "but", half more behind it. Up to four exclamation marks add `MARK` each to the
    sum s, away from 0; two or three question marks `DOUBT` each, more of them `DOUBTS`. The result is s / sqrt(s * s + SPREAD).

    Only words of the lexicon look at their surroundings, so a text costs one set lookup for each token. The text itself, which may be
    an expression that costs more than all this, is worked out once.
    """
    return T.let(F.coalesce(text, F.lit("")), lambda whole: _valence(whole, valences))


def _valence(whole: Column, valences: dict[str, float] | None) -> Column:
    """valence() of a text that is there."""
    valences = {**GENERAL, **FINANCE} if valences is None else valences
    scores = _map(valences)
    boosts = _map({w: BOOST for w in STRONGER} | {w: -BOOST for w in WEAKER})
    bare = F.regexp_replace(whole, r"(?<!\S)\p{Punct}+|\p{Punct}+(?!\S)", "")
    tokens = F.filter(F.split(bare, r"\s+"), lambda w: w != "")

    def capital(w: Column) -> Column:
        return (w == F.upper(w)) & (w != F.lower(w))

    def lower(w: Column) -> Column:
        """ascii_lower(); where all is ASCII, lower() does the same and is faster."""
        return F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(T.ascii_lower(w))

    def away(v: Column, by: Column | float) -> Column:
        return v + F.when(v > 0, by).when(v < 0, -by).otherwise(0.0)

    def word(tokens: Column, low: Column, mixed: Column, but: Column, i: Column) -> Column:
        def before(v: Column, back: Column) -> Column:
            """One of the words before it, on the score so far."""
            at = F.get(low, i - back)
            boost = F.coalesce(F.try_element_at(boosts, at), F.lit(0.0))
            louder = F.when((boost != 0) & mixed & capital(F.get(tokens, i - back)), F.lit(CAPITALS)).otherwise(0.0)
            near = F.get(F.array(*map(F.lit, NEARER)), back - 1)
            turn = F.when(at.isin(NEGATIONS) | at.endswith("n't"), F.lit(TURN)).otherwise(1.0)
            return F.when((i >= back) & ~at.isin(list(valences)), away(v, (boost + louder) * near) * turn).otherwise(v)

        alone = T.let(F.try_element_at(scores, F.get(low, i)), lambda v: away(v, F.when(mixed & capital(F.get(tokens, i)), F.lit(CAPITALS)).otherwise(0.0)))
        v = F.aggregate(F.array(*map(F.lit, (1, 2, 3))), alone, before)
        return v * F.when((but == 0) | (i == but - 1), 1.0).when(i < but - 1, 0.5).otherwise(1.5)

    def total(tokens: Column, low: Column) -> Column:
        places = F.filter(F.transform(low, lambda w, i: F.when(w.isin(list(valences)), i).otherwise(-1)), lambda i: i >= 0)
        mixed = F.exists(tokens, capital) & F.exists(tokens, lambda w: ~capital(w))
        surroundings = F.struct(mixed.alias("mixed"), F.array_position(low, "but").alias("but"))
        each = T.let(surroundings, lambda s: F.transform(places, lambda i: word(tokens, low, s["mixed"], s["but"], i)))
        return F.aggregate(each, F.lit(0.0), lambda s, v: s + v)

    marks = F.least(F.length(whole) - F.length(F.replace(whole, F.lit("!"), F.lit(""))), F.lit(MARKS)) * MARK
    asks = F.length(whole) - F.length(F.replace(whole, F.lit("?"), F.lit("")))
    louder = marks + F.when(asks > 3, DOUBTS).when(asks > 1, asks * DOUBT).otherwise(0.0)
    s = T.let(tokens, lambda t: T.let(F.transform(t, lower), lambda low: total(t, low)))
    return F.coalesce(F.round(T.let(T.let(s, lambda x: away(x, louder)), lambda x: x / F.sqrt(x * x + SPREAD)), 4), F.lit(0.0))


def label(score: Column, band: float = 0.05) -> Column:
    return F.when(score >= band, "positive").when(score <= -band, "negative").otherwise("neutral")


def finance_sentiment(text: Column) -> Column:
    """(score, label) by valence; where that is 0, as without a word of its lexicon, the plain lexicon sentiment and its label. The text is worked out once."""
    return T.let(text, _finance_sentiment)


def _finance_sentiment(text: Column) -> Column:
    plain = T.lexicon_score(T.words(text), lexicon.POSITIVE, lexicon.NEGATIVE, lexicon.INTENSIFIERS)
    told = T.let(valence(text), lambda v: F.struct(v.alias("score"), label(v).alias("label")))
    other = T.let(plain, lambda p: F.struct(F.round(p, 4).alias("score"), T.label(p).alias("label")))
    return T.let(told, lambda x: F.when(x["score"] != 0, x).otherwise(other))
