"""Text functions as Column expressions: cleaning, sentences, words. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.constants import ABBREVIATIONS, FOLIO_BAND
from quire.functions.vector import let

_CLOSERS = "[\"'”’)\\]]"
_OPENERS = "[\"'“‘(\\[]"
_ABBREVIATION = "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS)
#: A boundary: terminators and closers, white space, then what opens a sentence; not after an abbreviation. The
#: look-ahead in front rejects nearly all places before the costly look-behind is tried.
BOUNDARY = (
    f"(?=[.!?]+{_CLOSERS}*\\s+{_OPENERS}*[A-Z0-9])(?<![.!?])(?<!(?<![A-Za-z.])\\.{{0,6}}(?i:{_ABBREVIATION}|[A-Z])\\.{{0,6}})"
    f"([.!?]+)({_CLOSERS}*)(\\s+)(?={_OPENERS}*[A-Z0-9])"
)
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
SEGMENT_BREAK = "(?U)[^\\w\\s'’-]+|\\s[-–—]+\\s|[–—]"
WORD = "(?U)([^\\W\\d_]+(?:['’-][^\\W\\d_]+)*)"

#: Ligature glyphs, two of them in the private-use slots that one typesetting was seen to use.
_GLYPHS = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st",
    chr(0xF0DE): "fi", chr(0xF0DF): "fl",
}


def squeeze(c: Column) -> Column:
    """White space collapsed to single spaces and trimmed, Unicode-aware."""
    return F.regexp_replace(F.regexp_replace(c, "(?U)\\s+", " "), "^ | $", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def lines(c: Column) -> Column:
    """Lines of a text; a last empty one doesn't count."""
    last = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    return let(F.split(c, LINE_BREAK), last)


def normalize_ligatures(c: Column) -> Column:
    """Ligature glyphs to letters; one white space after a glyph goes if a letter follows."""
    for glyph, letters in _GLYPHS.items():
        c = F.regexp_replace(c, f"{glyph}(?:(?U:\\s)(?=[A-Za-z]))?", letters)
    return c


_ENDNOTE = "([a-z][.,;:!?)\\]\"'”’]{0,2})(\\d{1,3})(?=(?U:\\s)|$)"


def strip_endnotes(c: Column) -> Column:
    """Endnote digits glued to a word's end go."""
    return F.regexp_replace(c, _ENDNOTE, "$1")


def count_endnotes(c: Column) -> Column:
    return F.regexp_count(c, F.lit(_ENDNOTE))


def normalize_title(c: Column) -> Column:
    """Letter-spaced runs of three or more single characters are joined; white space is collapsed."""
    spaced = "(?U)(?<=(?<!\\S)\\w \\w) (?=\\w(?!\\S))|(?<=(?<!\\S)\\w) (?=\\w \\w(?!\\S))"
    joined = F.regexp_replace(c, spaced, "\u0001")
    # the pattern sees each space on its own, so a longer run needs the inner spaces as well
    inner = "(?U)(?<=\\w\u0001\\w) (?=\\w(?!\\S))|(?<=(?<!\\S)\\w) (?=\\w\u0001)"
    return squeeze(F.regexp_replace(F.regexp_replace(joined, inner, "\u0001"), "\u0001", ""))


def parse_folio(c: Column) -> Column:
    """A bare page number, decoration aside; Roman numerals and anything else are null."""
    bare = F.regexp_replace(strip(c), "^[\\[\\]()\\-–—•. \\t]+|[\\[\\]()\\-–—•. \\t]+$", "")
    # four digits at most, so never above MAX_FOLIO; what it is made from is worked out once
    return let(bare, lambda b: F.when(b.rlike("^\\d{1,4}$") & ~b.rlike("^0+$"), b.cast("int")))


def printed_page(c: Column) -> Column:
    """The folio in the footer or header band of a page; on a short page only the outermost lines count."""
    return let(F.filter(lines(c), lambda x: x.rlike("(?U)\\S")), _folio_of)


def _folio_of(full: Column) -> Column:
    n = F.size(full)
    footer = F.when(n > 2 * FOLIO_BAND, F.reverse(F.slice(full, -FOLIO_BAND, FOLIO_BAND))).otherwise(F.slice(full, -1, 1))
    header = F.when(n > 2 * FOLIO_BAND, F.slice(full, 1, FOLIO_BAND)).otherwise(F.slice(full, 1, 1))
    found = F.filter(F.transform(F.concat(footer, header), parse_folio), lambda x: x.isNotNull())
    return F.when(n > 0, F.try_element_at(found, F.lit(1)))


def dehyphenate(c: Column) -> Column:
    """Words cut by a hyphen at a line's end are joined."""
    return F.regexp_replace(c, "(?U)(\\w)-\\s*\\n\\s*(\\w)", "$1$2")


def is_digits(c: Column) -> Column:
    return c.rlike("^\\p{Nd}+$")


def sentences(c: Column) -> Column:
    """Sentences of a text, verbatim but for collapsed white space."""
    marked = F.regexp_replace(squeeze(c), BOUNDARY, "$1$2\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: s != "")


def tokens(c: Column) -> Column:
    """Search tokens: ASCII letters and digits of the lower-case text."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def word_segments(c: Column) -> Column:
    """Words by segment; a phrase never crosses a segment. Empty segments are left out."""
    parts = F.transform(F.split(c, SEGMENT_BREAK), lambda p: F.regexp_extract_all(p, F.lit(WORD), F.lit(1)))
    return F.filter(parts, lambda x: F.size(x) > 0)


def singular(c: Column) -> Column:
    """What a regular English plural would be the plural of; null if it doesn't look like one."""
    short = F.regexp_replace(c, "ies$", "y")
    return F.when(c.endswith("ies"), short).when(c.endswith("s") & ~c.endswith("ss"), F.regexp_replace(c, "s$", ""))


def truncate(c: Column, limit: int) -> Column:
    """At most `limit` characters, the last one an ellipsis when something was cut."""
    s = strip(c)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.regexp_replace(F.substring(s, 1, limit - 1), "(?U)\\s+$", ""), F.lit("…")))
