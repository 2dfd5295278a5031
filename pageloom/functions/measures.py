"""Text measures as native expressions.

Verbs and nouns come from a closed-class lexicon with suffix rules in place of a trained tagger; pass
another ``has_verb`` or ``noun_ratio`` column to the classifiers to plug one in.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .once import once

STOP_WORDS = ("a", "an", "the", "in", "on", "at", "of", "to", "for", "by")
VERBS = ("is", "are", "was", "were", "be", "been", "being", "am", "has", "have", "had", "do", "does", "did", "will", "would", "can", "could", "may", "might", "must", "shall", "should", "said", "says", "make", "made", "go", "went", "gone", "see", "saw", "seen", "take", "took", "get", "got", "give", "gave", "find", "found", "know", "knew", "show", "shows")
VERB_ENDING = r"^[a-z]{3,}(?:ing|ed|ize|ise|ify)$"


def count(text: Column, pattern: str) -> Column:
    """The number of matches, none of them empty: a mark is put behind each, as ``regexp_count`` copies the text for each."""
    return F.char_length(F.regexp_replace(text, pattern, "$0.")) - F.char_length(text)


def count_of(text: Column, rest: str) -> Column:
    """The number of characters that ``rest``, a repeated class, doesn't cover: what is left is measured, not listed."""
    return F.char_length(F.regexp_replace(text, rest, ""))


#: each takes a text whole, token by token, without looking back or trying a token twice. The groups are: the first
#: letter of a token that has one; such a token; a letter of one that begins with a capital or has no small letter
_WORD = r"(\p{L})\S*+|\P{L}++"
_LETTERED = r"([^\s\p{L}]*+\p{L}\S*+)|\s++|\S++"
_CAPITAL = r"(\p{Lu})\S*+|[^\s\p{L}]*+([\p{L}&&[^\p{Ll}]])[^\s\p{Ll}]*+(?!\S)|\s++|\S++"


def word_total(text: Column) -> Column:
    """The number of blank-separated tokens with at least one letter."""
    return F.char_length(F.regexp_replace(text, _WORD, "$1"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def alpha_ratio(text: Column) -> Column:
    return ratio(count_of(text, r"\P{L}+"), count_of(text, r"\s+"))


def special_ratio(text: Column) -> Column:
    return ratio(count_of(text, r"[\p{L}\p{N}\s]+"), count_of(text, r"\s+"))


def cap_ratio(text: Column) -> Column:
    return ratio(F.char_length(F.regexp_replace(text, _CAPITAL, "$1$2")), word_total(text))


def average_word_length(text: Column) -> Column:
    return ratio(F.char_length(F.regexp_replace(text, _LETTERED, "$1")), word_total(text))


def sentence_count(text: Column, min_words: int = 0) -> Column:
    """Stretches that end in . ! or ? and a blank; those of fewer words don't count."""
    parts = F.filter(F.split(text, r"[.!?]+\s+"), lambda s: F.trim(s) != "")
    return F.size(parts) if not min_words else F.size(F.filter(parts, lambda s: F.size(F.split(F.trim(s), r"\s+")) >= min_words))


def _words(text: Column) -> Column:
    """The runs of small letters of the text in small letters, and maybe an empty one at either end."""
    return F.split(F.lower(text), "[^a-z]+")


def _is_verb(word: Column) -> Column:
    """A verb of the lexicon, or three letters and one of the endings of VERB_ENDING; of a word of letters a to z."""
    n = F.octet_length(word)
    endings = [(n >= 3 + len(e)) & F.endswith(word, F.lit(e)) for e in ("ing", "ed", "ize", "ise", "ify")]
    return reduce(or_, endings, word.isin(*VERBS))


def has_verb(text: Column) -> Column:
    return F.exists(_words(text), _is_verb)


def noun_ratio(text: Column) -> Column:
    """The share of words that are neither verbs nor stop words."""
    words = F.filter(_words(text), lambda w: w != "")
    return once(words, lambda all_: ratio(F.size(F.filter(all_, lambda w: ~(w.isin(*STOP_WORDS) | _is_verb(w)))), F.size(all_)))


def title_case(text: Column) -> Column:
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"(?:^|[^\p{L}])\p{Ll}") & ~text.rlike(r"\p{L}\p{Lu}")


def all_caps(text: Column) -> Column:
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}")


def measured(text: Column) -> dict[str, Column]:
    """All nine measures by name. As columns of a table they are worked out once a row, which a struct isn't promised."""
    return {
        "alpha_ratio": alpha_ratio(text), "cap_ratio": cap_ratio(text), "special_ratio": special_ratio(text), "word_count": word_total(text), "sentence_count": sentence_count(text),
        "avg_word_length": average_word_length(text), "has_verb": has_verb(text), "is_title_case": title_case(text), "is_all_caps": all_caps(text),
    }


def text_stats(text: Column) -> Column:
    """All nine measures; zeros and false for an empty text."""
    return F.struct(*[c.alias(k) for k, c in measured(text).items()])


def text_metrics(text: Column) -> Column:
    """Mean word length, share of words with a capital first, and of . , ; : ! ? in all but the blanks."""
    words, chars = count(text, r"\S+"), count_of(text, r"\s+")
    return F.struct(ratio(chars, words).alias("avg_word_length"), ratio(count(text, r"(?<!\S)\p{Lu}"), words).alias("cap_ratio"), ratio(count_of(text, "[^.,;:!?]+"), chars).alias("punct_ratio"))


def exceeds_cap_ratio(text: Column, threshold: float = 0.5, known: dict[str, Column] | None = None) -> Column:
    """``known`` are measures that are at hand."""
    s = known or measured(text)
    return F.when(s["is_all_caps"], True).when(s["sentence_count"] > 1, False).when(s["word_count"] == 0, True).otherwise(s["cap_ratio"] > threshold)


def under_alpha_ratio(text: Column, threshold: float = 0.5, known: dict[str, Column] | None = None) -> Column:
    s = known or measured(text)
    return text.rlike(r"\S") & (s["alpha_ratio"] < threshold)


def without_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"[!-/:-@\[-`{-~]", "")


def tokens(text: Column) -> Column:
    return F.array_except(F.array_distinct(F.split(F.lower(F.trim(text)), r"\s+")), F.array(*map(F.lit, STOP_WORDS)))


def similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, 0 for lengths beyond a factor of two, else Jaccard without stop words."""
    p, q = F.lower(F.trim(a)), F.lower(F.trim(b))
    near = F.least(F.char_length(p), F.char_length(q)) * 2 >= F.greatest(F.char_length(p), F.char_length(q))
    s, t = tokens(a), tokens(b)
    jaccard = F.size(F.array_intersect(s, t)) / F.size(F.array_union(s, t))
    return F.when(p == q, 1.0).when(near & (F.size(s) > 0) & (F.size(t) > 0), jaccard).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def weighted_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard, trigrams, bigrams and longest common subsequence of the words, and a bonus for equal digits."""

    def one(x: str, y: str) -> float:
        x, y = x.lower().strip(), y.lower().strip()
        if x == y:
            return 1.0
        if min(len(x), len(y)) * 2 < max(len(x), len(y)):
            return 0.0
        s, t = x.split(), y.split()

        def share(p: set, q: set) -> float:
            return len(p & q) / len(p | q) if p or q else 0.0

        def grams(v: str, n: int) -> set:
            return {v[i : i + n] for i in range(len(v) - n + 1)}

        # bit j of ends is cleared where a longest common subsequence grows at the j-th word of t
        places: dict[str, int] = {}
        for j, v in enumerate(t):
            places[v] = places.get(v, 0) | 1 << j
        ends = whole = (1 << len(t)) - 1
        for w in s:
            met = ends & places.get(w, 0)
            ends = (ends + met | ends - met) & whole
        common = (len(t) - ends.bit_count()) / max(len(s), len(t), 1)
        digits = ["".join(c if c.isdigit() else " " for c in v).split() for v in (x, y)]
        bonus = 0.3 if digits[0] and digits[0] == digits[1] else 0.0
        stop = set(STOP_WORDS)
        return min(1.0, 0.35 * share(set(s) - stop, set(t) - stop) + 0.25 * share(grams(x, 3), grams(y, 3)) + 0.15 * share(grams(x, 2), grams(y, 2)) + 0.25 * common + bonus)

    return pd.Series([None if p is None or q is None else one(p, q) for p, q in zip(a, b)])


def scored_clean(text: Column) -> Column:
    """The scored analyser's cleaning: marker, breaks, hyphens, dot leaders, references, blanks."""
    text = F.regexp_replace(text, r"^[\x{2022}\x{25CF}\x{25CB}\x{25C6}\x{25AA}-]\s*", "")
    text = F.regexp_replace(text, r"\\n|\s*\n\s*", " ")
    text = F.regexp_replace(text, r"-\s+([a-z])", "$1")
    text = F.regexp_replace(text, r"\.\s*\.\s*\.+\s*$", "")
    text = F.regexp_replace(text, r"\[[0-9]+\]\s*", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def block_features(text: Column) -> Column:
    """Lines, characters, mean line length, indentation and capitals of a block."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    return F.struct(n.alias("line_count"), F.char_length(text).alias("char_count"), (F.aggregate(lines, F.lit(0), lambda s, x: s + F.char_length(x)) / n).alias("mean_line_length"), (F.char_length(text) - F.char_length(F.ltrim(text))).alias("indentation"), all_caps(text).alias("is_all_caps"))
