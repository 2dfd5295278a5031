"""Text predicates: native regular expressions in the common ground of Java and RE2 (no lookaround)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = r"(?:\d+|[A-Za-z]|[ivxIVX]+)"
LIST_START = rf"^\s*(?:[\x{{2022}}\x{{2023}}\x{{25E6}}\x{{2043}}\x{{2219}}\x{{25AA}}\x{{25AB}}\x{{25B8}}\x{{2027}}\x{{2218}}*\x{{00B7}}-]|{_MARK}[.:)]|\({_MARK}\)|\[{_MARK}\])\s+"
BULLET = r"^[\x{0095}\x{2022}\x{2023}\x{2043}\x{3164}\x{204C}\x{204D}\x{2219}\x{25CB}\x{25CF}\x{25D8}\x{25E6}\x{2619}\x{2765}\x{2767}\x{29BE}\x{29BF}\x{F0B7}\x{00B7}*-]"
TITLE_SEARCH = r"(?i)^(?:chapter|section|appendix)\s+\d+|^(?:table|figure|appendix)\s+\d+[.:-]|^(?:(?:table of contents)|index|glossary|references|bibliography)$|^\d+\.\d+\s+[A-Z]"
TITLE_LOWER = r"^(?:chapter|section|appendix)\s+\d+|^(?:table|figure|appendix)\s+\d+[.:-]|^(?:(?:table of contents)|index|glossary|references|bibliography)$"
TITLE_TEXT = TITLE_SEARCH + r"|^item\s+\d+[a-z]?\.|^[A-Z\s]{10,}$"
MARGIN_WORDS = r"(?i)confidential|draft|private|copyright\s+\d{4}|all\s+rights\s+reserved|internal\s+use\s+only|page\s+\d+\s+of\s+\d+"
FOOTNOTE_START = r"^\s*(?:\d+|[*\x{2020}\x{2021}\x{00A7}]|[a-z]\)|\[\d+\])\s+"
HEADING_LINE = r"(?i)^[a-z][a-z0-9 _-]*$|^[a-z]+(?:\s+[a-z]+)*$|^[ivx]+\.?\s+[a-z]|^\d+\.\s+[a-z]|^[a-z][a-z0-9 ]*:$"
REFERENCE = r"\[(?:\d+|[a-z])\]"
PAGE_NUMBER = r"(?i)^(?:\d+|-\s*\d+\s*-|\[\d+\]|page\s+\d+(?:\s+of\s+\d+)?|\d+\s*/\s*\d+|p\.?\s*\d+)$"
FOOTER = r"(?i)confidential|internal\s+use\s+only|all\s+rights\s+reserved|copyright\s+\d{4}|page\s+\d+\s+of\s+\d+|^(?:\d+|-\s*\d+\s*-|\[\d+\]|page\s+\d+)$"
ADDRESS_START = r"^[a-z0-9.+_-]+@[a-z0-9.+_-]+\.[a-z]+"
PHONE_END = r"(?:\d{3}[. -]*\d{4})(?: *x\d+)?\s*$"
PLACE = r"(?i)^(?:[a-z][a-z.-]{1,15} ?){1,5},\s?(?:[a-z]{2}|[a-z]+(?: [a-z]+)?)(?:, |\s)?\d{5}(?:-\d{4})?"
CAPTION = r"(?i)^(?:(?:figure|fig\.?|table|tbl\.?|tab\.?)\s*\d+|(?:chart|diagram|image|photo|illustration|equation|eqn?\.?)|(?:source|note|caption)|\s*\d+(?:[.-]\d+)*(?:[.-][a-z])?[:.-]?\s*[a-z])"
CAPTION_WORDS = r"figure|fig\.|table|tbl\.|tab\.|chart|diagram|image|photo|source:|caption:"
SECTION_NUMBER = r"^(\d+(?:\.\d+)+)\s+"
ENUMERATED = r"^(?:\d|[a-z][A-Z])"
LETTERED = r"^[A-Za-z][.)]\s+"
IP_STRICT = r"(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)){3}"
MAIL_DATE = r"[A-Za-z]{3},\s\d{1,2}\s[A-Za-z]{3}\s\d{4}\s\d{2}:\d{2}:\d{2}\s[+-]\d{4}"
MAPI = r"[0-9]*\.[0-9]*\.[0-9]*\.[0-9]*;"
IMAGE_LINK = r"(?i)https?://[a-z0-9$_@.&+!*(),%/-]+\.(?:jpg|jpeg|png|gif|bmp|heic)"
PUNCT_END = r"[^\p{L}\p{N}_\s]$"
DICT_LIST = r"^\s*\[\s*\{?"
NUMBERED = r"^\d+[.)]\s.+"
CONTINUED = (r"(?i)continued\s+on\s+next\s+page", r"(?i)to\s+be\s+continued", r"(?i)cont\.?\s*$", r"(?i)continues\s+next")
TABLE_MENTION = r"(?i)table\s+\d+|tab\s*\d+|tbl\s*\d+"
PATTERN_FLAGS = {
    "list_start": LIST_START, "title_pattern": TITLE_SEARCH, "margin_words": MARGIN_WORDS, "footnote_start": FOOTNOTE_START, "heading_line": HEADING_LINE, "reference": REFERENCE,
    "page_number_like": PAGE_NUMBER, "footer_like": FOOTER, "caption_start": CAPTION, "ip_address": IP_STRICT, "mail_date": MAIL_DATE, "mapi_id": MAPI, "image_link": IMAGE_LINK,
    "punct_end": PUNCT_END, "dict_list": DICT_LIST, "numbered": NUMBERED, "title_text": TITLE_TEXT,
}


#: what Java runs in place of a pattern whose repeated groups it would match by recursion, once for each word or
#: number, so that a long line overflows the stack and ends the executor; RE2 has no such forms, so SQL keeps the others
_JAVA = (
    (r"^[a-z]+(?:\s+[a-z]+)*$", r"^[a-z][a-z\s]*(?<=[a-z])$"),
    (r"\d+(?:[.-]\d+)*(?:", r"\d+(?:[.-]\d+)*+(?:"),
    (r"(?:\.\d+)+)\s", r"(?:\.\d+)++)\s"),
    (r"(?:\.\d+)*)\s", r"(?:\.\d+)*+)\s"),
    (r"[0-9]*\.[0-9]*\.[0-9]*\.[0-9]*;", r"\.[0-9]*+\.[0-9]*+\.[0-9]*+;"),
)


def java(pattern: str) -> str:
    """The pattern in a form that finds the same in Java in constant stack and time in proportion to the text."""
    for a, b in _JAVA:
        pattern = pattern.replace(a, b)
    return pattern


def matches(text: Column, *patterns: str) -> Column:
    """Any of the patterns occurs."""
    out = text.rlike(java(patterns[0]))
    for p in patterns[1:]:
        out = out | text.rlike(java(p))
    return out


def first_token(text: Column) -> Column:
    return F.regexp_extract(text, r"^\S+", 0)


def upper_start(text: Column) -> Column:
    return text.rlike(r"^\p{Lu}")


def list_item(text: Column) -> Column:
    """Bullets, and enumerations that are not section numbers and aren't followed by a capital."""
    text = F.trim(text)
    token = first_token(text)
    rest = F.trim(F.substr(text, F.char_length(token) + 1))
    dots = F.char_length(token) - F.char_length(F.translate(token, ".", ""))
    section = (dots > 1) | ((dots > 0) & (F.char_length(token) > 2)) | token.rlike(r"[)\]]")
    enumerated = token.rlike(ENUMERATED) & (rest != "")
    lettered = text.rlike(LETTERED) & ~upper_start(F.trim(F.substr(text, F.lit(3))))
    return F.when(text == "", False).when(text.rlike(BULLET), True).when(enumerated, ~section & ~upper_start(rest)).otherwise(lettered)


def contact_info(text: Column) -> Column:
    return matches(F.trim(text), PLACE, ADDRESS_START, PHONE_END)


def margin_heading(text: Column, relative_y: Column) -> Column:
    return ((relative_y <= 0.1) | (relative_y >= 0.9)) & matches(text, HEADING_LINE)


def short_page_number(text: Column) -> Column:
    t = F.trim(text)
    return (F.char_length(t) <= 10) & t.rlike(r"(?i)^(?:[+-]?\d+|page\s+\d+|\d+\s*/\s*\d+|-\s*\d+\s*-|\[\d+\])$")


def footnote_at(text: Column, y0: Column, height: Column) -> Column:
    return text.rlike(FOOTNOTE_START) & (y0 < height * 0.2)


def potential_list_item(text: Column, indent_ratio: Column, monospace: Column) -> Column:
    return text.rlike(LIST_START) & (indent_ratio <= 0.15) & (F.size(F.split(text, "\n")) <= 5) & ~monospace


def equation(text: Column) -> Column:
    return text.contains("=") & (text.contains("\\") | text.contains("$"))


ENGLISH = ("the", "a", "an", "in", "on", "at", "of", "to", "for", "and", "is", "are", "was", "were", "be", "with", "by", "this", "that", "it")


def english_word(text: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z]+", " "), " ")
    return F.exists(words, lambda w: (F.char_length(w) > 1) & w.isin(*ENGLISH))


_BOLD, _ITALIC, _HEADER = ("bold", "heavy", "black", "b"), ("italic", "oblique", "it", "i"), ("header", "title", "heading", "display")


def _names(font: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(font), p))


def font_is_bold(font: Column) -> Column:
    """By substring, and "b" is one of them, so most names that hold a b count."""
    return _names(font, _BOLD)


def font_is_italic(font: Column) -> Column:
    return _names(font, _ITALIC)


def font_is_header(font: Column) -> Column:
    return _names(font, _HEADER)


def list_pattern(text: Column) -> Column:
    """struct(type, number): bullet, number, letter (its ordinal) or roman; null if none."""
    t = F.lower(F.trim(text))
    digits = F.regexp_extract(t, r"^(\d+)[.)]", 1)
    letter = F.regexp_extract(t, r"^([a-z])[.)]", 1)
    none = F.lit(None).cast("long")

    def kind(name: str, number: Column) -> Column:
        return F.struct(F.lit(name).alias("type"), number.alias("number"))

    bullet = t.rlike(r"^[\x{2022}*\x{2023}\x{2043}\x{204C}\x{204D}\x{2219}\x{25AA}\x{25CF}\x{25E6}\x{29BE}\x{29BF}-]")
    return (
        F.when(bullet, kind("bullet", none))
        .when(digits != "", kind("number", digits.try_cast("long")))
        .when(letter != "", kind("letter", (F.ascii(letter) - 96).cast("long")))
        .when(t.rlike(r"^(?:i|ii|iii|iv|v|vi|vii|viii|ix|x)+[.)]"), kind("roman", none))
    )


LISTED = r"^\s*(?:[\x{2022}\x{2023}\x{25E6}\x{2043}\x{2219}*+~-]|\d+[.)]|\(\d+\)|\[\d+\]|[a-zA-Z][.)]|\([a-zA-Z]\)|\[[a-zA-Z]\]|(?:i{1,3}|iv|v|vi{1,3}|ix|x)[.)]|Step\s+\d+[:.)]|\d+\.\d+(?:\.\d+)*)\s+"
GOES_ON = r"^(?:and|or|but|nor|for|so|yet)"
SUB_ITEM = r"^[a-z]\)|^\d+\)|^[A-Z]\)|^\s+[\p{L}\p{N}_]"


def listed(text: Column) -> Column:
    """One of eleven list marks and a blank."""
    return matches(text, LISTED)


def listed_on(text: Column) -> Column:
    """Wording that goes on with the list item before: a conjunction, a sub-item, or no capital and no digit."""
    t = F.trim(text)
    return (t != "") & (t.rlike(GOES_ON) | text.rlike(SUB_ITEM) | (~text.rlike(r"^\p{Lu}") & ~t.rlike(r"^\p{Nd}")))
