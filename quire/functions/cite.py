"""Citation strings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.constants import MAX_NAMED_AUTHORS
from quire.functions.text import strip


def _given(c: Column) -> Column:
    """A value that isn't blank, stripped; else null."""
    s = strip(c)
    return F.when(s != "", s)


def title_from_filename(c: Column) -> Column:
    """A readable title: the stem, separators as spaces, letters and digits apart, first letter capital."""
    name = F.regexp_replace(c, "^.*/", "")
    stem = F.regexp_replace(name, "(?<=.)\\.[^.]*$", "")
    spaced = F.regexp_replace(stem, "[_-]+", " ")
    apart = F.regexp_replace(spaced, "(?U)(?<=[^\\W\\d_])(?=\\d)|(?<=\\d)(?=[^\\W\\d_])", " ")
    flat = strip(F.regexp_replace(apart, "(?U)\\s+", " "))
    return F.concat(F.upper(F.substring(flat, 1, 1)), F.regexp_replace(flat, "^.", ""))


def resolve_author(explicit: Column, embedded: Column) -> Column:
    return F.coalesce(_given(explicit), _given(embedded), F.lit(""))


def resolve_title(explicit: Column, embedded: Column, filename: Column) -> Column:
    return F.coalesce(_given(explicit), _given(embedded), title_from_filename(filename))


def _invert(c: Column) -> Column:
    parts = F.filter(F.split(c, "(?U)\\s+"), lambda x: x != "")
    return F.when(F.size(parts) < 2, c).otherwise(F.concat(F.element_at(parts, -1), F.lit(", "), F.array_join(F.slice(parts, 1, F.size(parts) - 1), " ")))


def format_author(c: Column) -> Column:
    """MLA order: the first author inverted, two joined by "and", more as "et al"; inverted names stay."""
    name = F.coalesce(strip(c), F.lit(""))
    people = F.filter(F.transform(F.split(name, " and "), strip), lambda x: x != "")
    first = _invert(F.coalesce(F.try_element_at(people, F.lit(1)), F.lit("")))
    return (
        F.when(name == "", "")
        .when(name.contains(","), F.regexp_replace(name, "\\.+$", ""))
        .when(F.size(people) > MAX_NAMED_AUTHORS, F.concat(first, F.lit(", et al")))
        .when(F.size(people) == MAX_NAMED_AUTHORS, F.concat(first, F.lit(", and "), F.try_element_at(people, F.lit(2))))
        .otherwise(first)
    )


def page_reference(printed: Column, pdf: Column) -> Column:
    return F.when(printed.isNotNull(), F.concat(F.lit("p. "), printed.cast("string"))).otherwise(F.concat(F.lit("PDF p. "), pdf.cast("string")))


def page_label(printed: Column, pdf: Column) -> Column:
    both = F.format_string("p. %d (PDF %d)", printed, pdf)
    return F.when(printed.isNotNull(), both).otherwise(F.concat(F.lit("PDF p. "), pdf.cast("string")))


def mla(author: Column, title: Column, printed: Column, pdf: Column) -> Column:
    """Author. *Title*. page. with unknown parts left out."""
    who, what = format_author(author), strip(title)
    return F.concat_ws(
        " ",
        F.when(who != "", F.concat(who, F.lit("."))),
        F.when(what != "", F.concat(F.lit("*"), what, F.lit("*."))),
        F.concat(page_reference(printed, pdf), F.lit(".")),
    )


def quotation(sentence: Column) -> Column:
    return F.concat(F.lit("“"), strip(sentence), F.lit("”"))


def parenthetical(author: Column, printed: Column) -> Column:
    """(Surname 47); unknown parts left out, nothing if both are."""
    surname = strip(F.element_at(F.split(format_author(author), ","), 1))
    inner = F.concat_ws(" ", F.when(surname != "", surname), printed.cast("string"))
    return F.when(inner != "", F.concat(F.lit("("), inner, F.lit(")"))).otherwise("")


def quoted_line(sentence: Column, author: Column, printed: Column) -> Column:
    """The sentence in quotes and its in-text citation; a final full stop moves to the end."""
    inline, s = parenthetical(author, printed), strip(sentence)
    cited = F.concat(F.lit("“"), F.regexp_replace(s, "\\.$", ""), F.lit("” "), inline, F.lit("."))
    return F.when(inline == "", quotation(sentence)).otherwise(cited)


def citation_block(sentence: Column, author: Column, title: Column, printed: Column, pdf: Column) -> Column:
    return F.concat(mla(author, title, printed, pdf), F.lit("\n"), quoted_line(sentence, author, printed))


def best_sentence_text(sentences: Column, best: Column, text: Column) -> Column:
    """The sentence at a 0-based index, else the whole text."""
    return F.coalesce(F.when(best >= 0, F.get(sentences, best)), text)
