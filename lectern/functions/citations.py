"""Citation and context text of a material."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import bind, strip, text_or_empty


def author_line(authors: Column) -> Column:
    """First author inverted, the rest as written, ending in a period."""
    names = F.filter(F.transform(authors, strip), lambda n: n != "")

    def invert(name: Column) -> Column:
        last = F.substring_index(name, " ", -1)
        rest = name.substr(F.lit(1), F.length(name) - F.length(last) - 1)
        plain = name.contains(",") | ~name.contains(" ")
        return F.when(plain, name).otherwise(F.concat(last, F.lit(", "), rest))

    def joined(n: Column) -> Column:
        shown = F.transform(n, lambda x, i: F.when(i == 0, invert(x)).otherwise(x))
        count = F.size(shown)
        head = F.array_join(F.slice(shown, F.lit(1), F.greatest(count - 1, F.lit(0))), ", ")
        return (
            F.when(count == 0, "")
            .when(count == 1, F.concat(F.get(shown, F.lit(0)), F.lit(".")))
            .otherwise(F.concat(head, F.lit(", and "), F.get(shown, count - 1), F.lit(".")))
        )

    return bind(names, joined)


def _some(c: Column) -> Column:
    return F.nullif(text_or_empty(c), F.lit(""))


def _sentence(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def _imprint(place: Column, publisher: Column, year: Column) -> Column:
    known = F.array_compact(F.array(_some(place), _some(publisher), _some(year)))
    tail = F.when(F.size(known) > 2, F.concat(F.lit(", "), F.get(known, F.lit(2)))).otherwise("")
    return F.when(F.size(known) > 0, F.concat(F.array_join(F.slice(known, 1, 2), ": "), tail, F.lit(".")))


def page_range(start: Column, end: Column) -> Column:
    both = _some(start).isNotNull() & _some(end).isNotNull()
    return F.when(both, F.concat(start, F.lit("–"), end)).otherwise(F.coalesce(_some(start), _some(end), F.lit("")))


def citation(m: dict[str, Column]) -> Column:
    """Journal article, chapter, book or plain fallback, in that order."""
    authors = F.nullif(author_line(m["authors"]), F.lit(""))
    quoted = F.concat(F.lit('"'), text_or_empty(m["title"]), F.lit('."'))
    italic = F.concat(F.lit("_"), text_or_empty(m["title"]), F.lit("_."))
    year, kind = m["year"], text_or_empty(m["document_type"])
    pages = page_range(m["start_page"], m["end_page"])

    when = F.when(_some(year).isNotNull(), F.concat(F.lit("("), year, F.lit(")"))).otherwise("")
    when = F.concat(when, F.when(pages != "", F.concat(F.lit(": "), pages)).otherwise(""))
    volume = F.concat(text_or_empty(m["volume"]), F.when(_some(m["issue"]).isNotNull(), F.concat(F.lit(", no. "), m["issue"])).otherwise(""))
    journal = F.concat(
        F.lit("_"), m["journal"], F.lit("_ "), F.when(volume != "", F.concat(volume, F.lit(" "))).otherwise(""), when, F.lit("."))
    doi = F.concat(F.lit("https://doi.org/"), F.regexp_replace(_some(m["doi"]), "^https://doi.org/", ""))

    editors = F.array_join(m["editors"], ", ")
    chapter = F.concat(
        F.lit("In _"), m["book_title"], F.lit("_"),
        F.when(editors != "", F.concat(F.lit(", edited by "), editors)).otherwise(""),
        F.when(pages != "", F.concat(F.lit(", "), pages)).otherwise(""), F.lit("."))
    edition = F.when(_some(m["edition"]).isNotNull() & ~m["edition"].isin("1", "1st"), F.concat(m["edition"], F.lit(" ed.")))
    imprint = _imprint(m["place"], m["publisher"], year)
    plain = F.when(_some(m["title"]).isNotNull(), F.when(kind == "paper", quoted).otherwise(italic))
    return (
        F.when(_some(m["journal"]).isNotNull(), _sentence(authors, quoted, journal, doi))
        .when(_some(m["book_title"]).isNotNull() & ~kind.isin("monograph", "book"), _sentence(authors, quoted, chapter, imprint))
        .when(_some(m["publisher"]).isNotNull() | _some(m["place"]).isNotNull(), _sentence(authors, italic, edition, imprint))
        .otherwise(_sentence(authors, plain, F.concat(_some(year), F.lit("."))))
    )


def context_header(fields: list[tuple[str, Column]], bridges: Column, toc: Column, headings: Column) -> Column:
    """Labelled lines, up to 12 bridge names, contents, else up to 50 headings."""
    lines = [F.concat(F.lit(f"{label}: "), text_or_empty(value)) for label, value in fields]
    named = F.filter(F.slice(bridges, 1, 12), lambda b: text_or_empty(b) != "")
    if_named = F.when(F.size(named) > 0, F.concat(F.lit("Bridge concepts: "), F.array_join(named, ", ")))
    shown = F.array_join(F.transform(F.slice(headings, 1, 50), lambda h: F.concat(F.lit("  - "), h)), "\n")
    no_toc = (toc == "Not available") & (F.size(headings) > 0)
    return F.concat_ws(
        "\n", *lines, if_named, F.lit(""), F.lit("Table of Contents:"), toc,
        F.when(no_toc, F.concat(F.lit("\nSection headings:\n"), shown)))
