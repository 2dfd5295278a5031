"""Text cleaning and extraction as native expressions; Arrow UDFs only where Spark has no counterpart."""

from __future__ import annotations

import quopri
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .once import once

_AT_ONCE = 1 << 20
_SPACE = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]+"
_BULLETS = r"[\x{2022}\x{2023}\x{25E6}\x{2043}\x{2219}*\x{00B7}]"
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ʪ": "ls", "ʦ": "ts", "ȹ": "qp"}


def strip(text: Column) -> Column:
    """Without blanks and breaks at either end (``trim`` takes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def extra_whitespace(text: Column) -> Column:
    """Runs of blanks become one, blank lines go."""
    lines = F.transform(F.split(text, "\n"), squeeze)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


_BLANKS = np.array([k for k in range(0x3001) if chr(k).isspace()], dtype=np.uint32)


def _moves(text: str, clean: str) -> np.ndarray:
    """For each character of clean, how many of text were dropped before it: blanks follow what stands before them."""
    dark = [~np.isin(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32), _BLANKS) for t in (text, clean)]
    before, after = map(np.flatnonzero, dark)
    return (before - after)[np.cumsum(dark[1]) - 1]


@F.pandas_udf(T.StructType().add("text", T.StringType()).add("moved", T.ArrayType(T.LongType())))
def extra_whitespace_moved(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The text of ``extra_whitespace`` and, for each of its characters, how many were dropped before it.

    Moves take eight bytes a character, so they are handed over whenever those of ``_AT_ONCE`` characters are ready.
    """
    def one(t: str | None) -> tuple[str | None, np.ndarray | None]:
        if t is None:
            return None, None
        lines = [" ".join(x.split()) for x in t.strip().split("\n")]
        clean = "\n".join(x for x in lines if x)
        return clean, _moves(t, clean)

    for texts in batches:
        out, size = [], 0
        for t in texts:
            out.append(one(t))
            size += len(t or "")
            if size >= _AT_ONCE:
                yield pd.DataFrame(out, columns=["text", "moved"])
                out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=["text", "moved"])


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def _apart(text: Column) -> Column:
    for a, b in LIGATURES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def ligatures(text: Column) -> Column:
    """Ligatures apart, then compatibility composition, which leaves ASCII alone."""
    return _compose(_apart(text))


def dehyphenated(text: Column) -> Column:
    return F.regexp_replace(text, r"([\p{L}\p{N}_]+)-\n([\p{L}\p{N}_]+)", "$1$2")


def printable(text: Column, keep_breaks: bool = True) -> Column:
    kept = r" \n\r\t" if keep_breaks else " "
    return F.regexp_replace(text, rf"[\p{{C}}\p{{Z}}&&[^{kept}]]", "")


@F.pandas_udf(T.StringType())
def _quoted(texts: pd.Series) -> pd.Series:
    def one(t: str) -> str:
        try:
            return quopri.decodestring(t.encode()).decode() if "=" in t else t
        except ValueError:
            return t

    return texts.map(one, na_action="ignore")


def mime_decoded(text: Column) -> Column:
    """Quoted-printable decoded, or the text itself where that fails."""
    return _quoted(text)


def bullets(text: Column) -> Column:
    cleaned = strip(F.regexp_replace(text, rf"^\s*(?:{_BULLETS}\s*)+", ""))
    return F.when(text.rlike(rf"^\s*{_BULLETS}"), cleaned).otherwise(text)


def _ordered_parts(text: Column) -> tuple[Column, Column, Column]:
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    head = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
    parts = F.split(F.regexp_replace(head, r"\.$", ""), r"\.")
    return words, head, parts


def ordered_bullets(text: Column) -> Column:
    """A leading 1. or 1.1.2 or a. goes; the rest is joined by single blanks."""
    def of(words: Column) -> Column:
        head = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
        return once(head, lambda head: once(F.split(F.regexp_replace(head, r"\.$", ""), r"\."), lambda parts: drop(words, head, parts)))

    def drop(words: Column, head: Column, parts: Column) -> Column:
        dotted = head.contains(".") & ~head.contains("..") & (head != ".")
        valid = F.forall(parts, lambda p: (p == "") | p.rlike(r"^[\p{L}\p{N}]+$"))
        goes = (F.size(words) >= 2) & dotted & (F.char_length(F.get(parts, F.lit(0))) <= 2) & valid
        return F.when(goes, F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " "))

    return F.coalesce(once(F.filter(F.split(text, _SPACE), lambda w: w != ""), of), text)


def ordered_bullet_parts(text: Column) -> Column:
    """struct(a, b, c) of a leading a.b.c; nulls where there is none."""
    _, head, parts = _ordered_parts(text)
    ok = head.contains(".") & ~head.contains("..") & (F.char_length(F.get(parts, F.lit(0))) <= 2)
    return F.struct(*[F.when(ok, F.get(parts, F.lit(k))).alias(n) for k, n in enumerate("abc")])


def dashes(text: Column) -> Column:
    return strip(F.translate(text, "-–—", "   "))


def trailing_punctuation(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"[.,:;]+$", "")


def clean(text: Column, lowercase: bool = False, clean_bullets: bool = True, clean_dashes: bool = True, clean_trailing: bool = True, whitespace: bool = True) -> Column:
    """All cleaners in their order; each names the text once or has it worked out once, as copies would multiply."""
    steps = [printable, ligatures, dehyphenated, mime_decoded]
    steps += [F.lower] * lowercase + [bullets, ordered_bullets] * clean_bullets + [dashes] * clean_dashes + [trailing_punctuation] * clean_trailing + [extra_whitespace] * whitespace
    for s in steps:
        # a Python UDF can't be called within once, and these steps name the text once
        text = s(text) if s in (printable, ligatures, dehyphenated, mime_decoded) else once(text, s)
    return strip(text)


def without_prefix(text: Column, pattern: str) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^(?:{pattern})", ""), r"^\s+", "")


def without_postfix(text: Column, pattern: str) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"(?:{pattern})$", ""), r"\s+$", "")


def bullet_paragraphs(text: Column) -> Column:
    """The bulleted parts of a paragraph, line breaks become blanks."""
    text = strip(F.regexp_replace(text, r"^e\s", "·"))
    parts = F.filter(F.split(text, _BULLETS, -1), lambda p: p != "")
    return F.transform(parts, lambda p: F.translate(p, "\n", " "))


def broken_paragraphs(text: Column) -> Column:
    """Blank lines part paragraphs; short lines stay apart, others are joined."""
    def each(p: Column) -> Column:
        lines = F.split(p, "\n")
        short = F.forall(lines, lambda x: F.size(F.filter(F.split(x, _SPACE), lambda w: w != "")) < 5)
        listed = strip(p).rlike(rf"^(?:{_BULLETS}|e\s)")
        return F.when(listed, bullet_paragraphs(p)).when(short, F.filter(lines, lambda x: x.rlike(r"\S"))).otherwise(F.array(F.translate(p, "\n", " ")))

    paragraphs = F.filter(F.split(text, r"\n\s*\n"), lambda p: p.rlike(r"\S"))
    return F.array_join(F.flatten(F.transform(paragraphs, each)), "\n\n")


def line_paragraphs(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S")), "\n\n")


def blank_ratio(text: Column, most: int = 2000) -> Column:
    lines = F.slice(F.split(text, "\n"), 1, most)
    return F.size(F.filter(lines, lambda x: ~x.rlike(r"\S"))) / F.size(lines)


def auto_paragraphs(text: Column, threshold: float = 0.1) -> Column:
    return F.when(blank_ratio(text) < threshold, line_paragraphs(text)).otherwise(broken_paragraphs(text))


EMAIL = r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"
IP = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
PHONE = r"[0-9]{3}[-.]?[0-9]{3}[-.]?[0-9]{4}"
IMG = r"<img[^>]+src=[\"']([^\"'>]+)[\"'][^>]*>"
MAPI_ID = r"([0-9A-F]{8}-?(?:[0-9A-F]{4}-?){3}[0-9A-F]{12});"
RFC_DATE = r"[A-Za-z]{3},\s+([0-9]{1,2}\s+[A-Za-z]{3}\s+[0-9]{4}\s+[0-9]{2}:[0-9]{2}:[0-9]{2}\s+[+-][0-9]{4})"


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))


def ip_addresses(text: Column) -> Column:
    """Four groups of up to three digits at word edges; the range isn't checked."""
    return F.regexp_extract_all(text, F.lit(rf"\b{IP}\b"), F.lit(0))


def phone_numbers(text: Column) -> Column:
    """The first only, as a list of at most one."""
    found = F.regexp_extract(text, rf"\b{PHONE}\b", 0)
    return F.when(found == "", F.array().cast("array<string>")).otherwise(F.array(found))


def image_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IMG), F.lit(1))


def mapi_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MAPI_ID), F.lit(1))


def first_date(text: Column) -> Column:
    """The first RFC 822 date as a timestamp; null if there is none or it isn't a date."""
    found = F.regexp_replace(F.regexp_extract(text, RFC_DATE, 1), r"\s+", " ")
    return F.when(found != "", F.try_to_timestamp(found, F.lit("d MMM yyyy HH:mm:ss Z")))


def text_before(text: Column, pattern: str, index: int = 0) -> Column:
    """What stands before the index-th match; null if there is no such match."""
    start = F.char_length(text) - F.char_length(F.element_at(F.split(text, pattern, index + 2), -1))
    matched = F.element_at(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), index + 1)
    return F.when(F.size(F.split(text, pattern, index + 2)) == index + 2, F.regexp_replace(F.substr(text, F.lit(1), start - F.char_length(matched)), r"\s+$", ""))


def text_after(text: Column, pattern: str, index: int = 0) -> Column:
    """What stands after the index-th match; null if there is no such match."""
    parts = F.split(text, pattern, index + 2)
    return F.when(F.size(parts) == index + 2, F.regexp_replace(F.get(parts, F.lit(index + 1)), r"^\s+", ""))
