"""Text expressions: Column in, Column out, all evaluated inside the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions.fixed import STOP_WORDS, YEAR_PATTERNS, YEAR_RANGE

WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
SPACE_RUN = r"[\s\p{Z}]+"
WORD = r"[\p{L}\p{N}]+"
KEYWORD = r"[a-zA-ZÀ-ÿ]{3,}"
ODD_LETTERS = r"\x{300}-\x{36F}\x{370}-\x{3FF}\x{180}-\x{2AF}"
ODD_OR_CONTROL = rf"[[\p{{C}}&&[^\s]]{ODD_LETTERS}]"
SOFT_HYPHEN = "­"


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use`` as a lambda variable.

    Catalyst inlines a projected expression into every later reference, which
    would tokenise a text again for each of them; a lambda argument is not
    inlined.
    """
    return F.get(F.transform(F.array(value), lambda bound: use(bound)), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def squeeze(c: Column) -> Column:
    """Collapse every whitespace run to one blank and trim."""
    return strip(F.regexp_replace(c, SPACE_RUN, " "))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _accent_pairs() -> tuple[str, str]:
    """Lower-case letters whose canonical decomposition is base + marks."""
    source, target = [], []
    for code in range(0xC0, 0x250):
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)
        if len(base) > 1 and all(unicodedata.combining(m) for m in base[1:]):
            source.append(letter)
            target.append(base[0])
    return "".join(source), "".join(target)


ACCENTS = _accent_pairs()


def fold(c: Column) -> Column:
    """Lower case without diacritics; plain ASCII text skips the mapping."""
    low = F.lower(c)
    stripped = F.regexp_replace(F.translate(low, *ACCENTS), r"\p{M}", "")
    return F.when(low.rlike(r"[^\x00-\x7F]"), stripped).otherwise(low)


def fold_text(text: str) -> str:
    """The same folding for a query string."""
    decomposed = unicodedata.normalize("NFD", text.lower())
    return "".join(ch for ch in decomposed if not unicodedata.combining(ch))


def word_tokens(c: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    return F.regexp_extract_all(fold(text_or_empty(c)), F.lit(WORD), F.lit(0))


def keyword_tokens(c: Column) -> Column:
    """Words of three or more letters without stop words or soft hyphens."""
    plain = F.lower(F.translate(text_or_empty(c), SOFT_HYPHEN, ""))
    words = F.regexp_extract_all(plain, F.lit(KEYWORD), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def lines(c: Column) -> Column:
    text = text_or_empty(c)
    plain = F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)
    return F.split(plain, "\n")


def first_line(c: Column) -> Column:
    """Trimmed first line, found without splitting the rest of the text."""
    return strip(F.regexp_extract(text_or_empty(c), r"^[^\r\n]*", 0))


def paragraphs(c: Column) -> Column:
    """Blocks between empty lines, trimmed, empties dropped."""
    return F.filter(F.transform(F.split(c, "\n\n"), strip), lambda p: p != "")


def blank_line_paragraphs(c: Column) -> Column:
    """Variant that splits on blank (whitespace-only) lines and keeps indents."""
    blocks = F.split(c, r"\n\s*\n")
    return F.transform(
        F.filter(blocks, lambda p: strip(p) != ""), lambda p: F.btrim(p, F.lit("\n"))
    )


@F.pandas_udf(StringType())
def compatibility_form(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition; Spark has no built-in for it."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def tidy_line(c: Column) -> Column:
    """Clean one already composed line: dashes, zero-width marks, blanks."""
    out = F.translate(text_or_empty(c), "‐‑‒–—", "-----")
    out = F.translate(out, "­​‌‍⁠\u0000", "")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"[\s\p{Z}]+([,.;:!?])", "$1")
    return strip(out)


def is_page_number(c: Column) -> Column:
    return c.rlike(r"^\s*[0-9]+\s*$")


def ends_sentence(c: Column) -> Column:
    return F.rtrim(c).endswith(".")


def join_wrapped(parts: Column) -> Column:
    """Fold wrapped lines to one paragraph, undoing end-of-line hyphens.

    What follows a line depends on that line and the next, so every line is
    rendered by itself and the text is put together once.
    """
    def rendered(kept: Column) -> Column:
        def piece(line: Column, i: Column) -> Column:
            following = F.get(kept, i + 1)
            hyphen = line.endswith("-") & following.rlike(r"^\p{Ll}")
            return F.when(following.isNull(), line).when(hyphen, line.substr(F.lit(1), F.length(line) - 1)).otherwise(
                F.concat(line, F.lit(" ")))

        return F.array_join(F.transform(kept, piece), "")

    return strip(bind(F.filter(parts, lambda p: p != ""), rendered))


def reflow(line_array: Column) -> Column:
    """Paragraphs of tidy lines, split at blank lines and sentence stops.

    Without page numbers, a line opens a paragraph if the one before it is
    blank or ends a sentence; so each line is rendered from its neighbours and
    the text is put together once.
    """
    def rendered(kept: Column) -> Column:
        def piece(line: Column, i: Column) -> Column:
            before, after = F.get(kept, i - 1), F.coalesce(F.get(kept, i + 1), F.lit(""))
            opens = (before == "") | ends_sentence(before)
            glued = before.endswith("-") & line.rlike(r"^\p{Ll}")
            gap = F.when(before.isNull(), "").when(opens, "\n\n").when(glued, "").otherwise(" ")
            cut = line.endswith("-") & after.rlike(r"^\p{Ll}") & ~ends_sentence(line)
            return F.when(line == "", "").otherwise(
                F.concat(gap, F.when(cut, line.substr(F.lit(1), F.length(line) - 1)).otherwise(line)))

        return F.regexp_replace(F.array_join(F.transform(kept, piece), ""), r"^\n\n", "")

    return bind(F.filter(line_array, lambda line: ~is_page_number(line)), rendered)


def matching_form(c: Column) -> Column:
    """Comparable form of quoted text: no controls, no stray single letters."""
    out = F.regexp_replace(text_or_empty(c), r"\p{C}", "")
    out = F.regexp_replace(out, SPACE_RUN, " ")
    out = F.regexp_replace(out, r"(?U)\b[a-z]\b", "")
    return F.lower(squeeze(out))


def quality(c: Column) -> Column:
    """Readability 0..1 from word shape, letter share and odd code points."""
    one = F.lit(1)

    def score(body: Column) -> Column:
        visible = F.length(F.regexp_replace(body, SPACE_RUN, ""))
        odd = F.regexp_count(body, F.lit(ODD_OR_CONTROL))
        tokens = F.regexp_count(body, F.lit(r"[^\s\p{Z}]+"))
        alpha = F.regexp_count(body, F.lit(r"[^\s\p{Z}\p{L}]*\p{L}[^\s\p{Z}]*"))
        normal = F.regexp_count(body, F.lit(r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'’\-]+"))
        return bind(
            F.struct(visible.alias("v"), odd.alias("o"), tokens.alias("t"), alpha.alias("a"), normal.alias("n")),
            lambda k: F.when(k["v"] == 0, F.lit(0.0)).otherwise(
                k["n"] / F.greatest(k["a"], one) * 0.6
                + k["a"] / F.greatest(k["t"], one) * 0.25
                + (1 - k["o"] / F.greatest(k["v"], one)) * 0.15
            ),
        )

    return bind(strip(text_or_empty(c)), score)


def odd_share(c: Column) -> Column:
    def share(body: Column) -> Column:
        visible = F.length(F.regexp_replace(body, SPACE_RUN, ""))
        return F.regexp_count(body, F.lit(f"[{ODD_LETTERS}]")) / F.greatest(visible, F.lit(1))

    return bind(strip(text_or_empty(c)), share)


def needs_ocr(c: Column) -> Column:
    return bind(
        strip(text_or_empty(c)),
        lambda body: F.when(body == "", True)
        .when(F.length(body) < 40, False)
        .otherwise((quality(body) < 0.45) | (odd_share(body) > 0.12)),
    )


def prefers_ocr(native: Column, ocr: Column) -> Column:
    return (
        F.when(strip(text_or_empty(ocr)) == "", False)
        .when(strip(text_or_empty(native)) == "", True)
        .otherwise(quality(ocr) >= quality(native) + 0.15)
    )


def years(c: Column) -> Column:
    """Every plausible publication year named in the text, with repeats."""
    low, high = YEAR_RANGE
    found = [F.regexp_extract_all(text_or_empty(c), F.lit(p), F.lit(1)) for p in YEAR_PATTERNS]
    numbers = F.transform(F.concat(*found), lambda y: y.cast("int"))
    return F.filter(numbers, lambda y: y.between(low, high))


def date_year(c: Column) -> Column:
    """Year from the first four digits of a document date, else empty."""
    digits = F.regexp_extract(text_or_empty(c), r"([0-9]{4})", 1)
    value = digits.try_cast("int")
    low, high = YEAR_RANGE
    return F.when(value.between(low, high), digits).otherwise("")


def clean_quote(c: Column) -> Column:
    """Drop one- and two-letter noise lines; rejoin a drop cap with its word."""
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("cap"))

    def add(done: Column, part: Column) -> Column:
        return F.when(done == "", part).otherwise(F.concat(done, F.lit(" "), part))

    def step(acc: Column, pair: Column) -> Column:
        part, following = pair["part"], pair["next"]
        done, cap = acc["done"], acc["cap"]
        short = F.length(part) <= 2
        is_cap = part.rlike(r"^\p{Lu}$") & following.rlike(r"^\p{Ll}")
        lower_start = part.rlike(r"^\p{Ll}")
        longer = (
            F.when((cap != "") & lower_start, add(done, F.concat(cap, part)))
            .when(cap != "", add(add(done, cap), part))
            .otherwise(add(done, part))
        )
        return F.struct(
            F.when(short, done).otherwise(longer).alias("done"),
            F.when(short & is_cap, part).when(short, cap).otherwise(F.lit("")).alias("cap"),
        )

    trimmed = F.filter(F.transform(lines(c), strip), lambda p: p != "")
    pairs = bind(trimmed, lambda parts: F.transform(parts, lambda p, i: F.struct(
        p.alias("part"), F.coalesce(F.get(parts, i + 1), F.lit("")).alias("next"))))
    joined = F.aggregate(
        pairs, start, step,
        lambda acc: F.when(acc["cap"] == "", acc["done"]).otherwise(add(acc["done"], acc["cap"])),
    )
    return strip(F.regexp_replace(joined, " {2,}", " "))


def authors(c: Column) -> Column:
    parts = F.transform(F.split(text_or_empty(c), "[,;&]| and "), strip)
    return F.filter(parts, lambda p: p != "")


def estimated_tokens(c: Column) -> Column:
    return F.floor(F.length(text_or_empty(c)) / 4).cast("bigint")


def truncate(c: Column, limit: int = 220) -> Column:
    body = strip(text_or_empty(c))
    cut = F.concat(F.rtrim(body.substr(1, max(0, limit - 1))), F.lit("…"))
    return F.when(F.length(body) <= limit, body).otherwise(cut)


def truncate_words(c: Column, limit: int = 42) -> Column:
    words = F.split(squeeze(text_or_empty(c)), " ")
    head = F.array_join(F.slice(words, 1, limit), " ")
    cut = F.concat(F.regexp_replace(head, r"[.,;: ]+$", ""), F.lit("..."))
    return F.when(F.size(words) <= limit, F.array_join(words, " ")).otherwise(cut)


def query_terms(query: str) -> list[str]:
    """Distinct words of a query, inner hyphens and apostrophes kept."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+(?:[-'][^\W_]+)*", query)))


def excerpt(c: Column, query: str, window: int = 260, lead: int = 90) -> Column:
    """Window around the earliest query word, with the words marked."""
    terms = sorted(query_terms(query), key=len, reverse=True)

    def placed(body: Column) -> Column:
        size = F.length(body)
        if terms:
            low = F.lower(body)
            spots = [F.nullif(F.locate(t.lower(), low), F.lit(0)) for t in terms]
            first = spots[0] if len(spots) == 1 else F.least(*spots)
            begin = F.coalesce(F.greatest(first - 1 - lead, F.lit(0)), F.lit(0))
        else:
            begin = F.lit(0)
        return bind(begin, lambda b: F.struct(
            body.alias("body"), size.alias("size"),
            F.greatest(F.lit(0), F.least(size, b + window) - window).alias("begin"),
            F.least(size, b + window).alias("end"),
        ))

    def shown(w: Column) -> Column:
        snippet = strip(w["body"].substr(w["begin"] + 1, w["end"] - w["begin"]))
        for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            snippet = F.replace(snippet, F.lit(raw), F.lit(entity))
        if terms:
            pattern = "(?i)" + "|".join(re.escape(t) for t in terms)
            snippet = F.regexp_replace(snippet, pattern, "<mark>$0</mark>")
        return F.when(w["body"] == "", F.lit("")).otherwise(
            F.concat(
                F.when(w["begin"] > 0, F.lit("...")).otherwise(F.lit("")),
                snippet,
                F.when(w["end"] < w["size"], F.lit("...")).otherwise(F.lit("")),
            )
        )

    return bind(bind(squeeze(text_or_empty(c)), placed), shown)


def pages_label(pages: Column) -> Column:
    listed = F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ")
    return (
        F.when(F.size(pages) == 0, "")
        .when(F.size(pages) == 1, F.concat(F.lit("p. "), listed))
        .otherwise(F.concat(F.lit("pp. "), listed))
    )


def iso_timestamp(c: Column) -> Column:
    """ISO-8601 text to timestamp; unreadable text gives null, no zone is UTC."""
    return F.try_to_timestamp(F.regexp_replace(strip(text_or_empty(c)), "Z$", "+00:00"))


def inject_annotations(text: Column, annotations: Column, page: Column) -> Column:
    """Wrap the first occurrence of each of the page's quotes in markers."""

    def step(acc: Column, ann: Column) -> Column:
        quote = text_or_empty(ann["quoted_text"])
        note = text_or_empty(ann["comment"])
        marked = F.concat(
            F.lit("[HIGHLIGHTED]"), quote, F.lit("[/HIGHLIGHTED]"),
            F.when(note == "", F.lit("")).otherwise(F.concat(F.lit(" [NOTE: "), note, F.lit("]"))),
        )
        at = F.position(quote, acc)
        usable = (ann["page"] == page) & (quote != "") & (at > 0)
        return F.when(usable, F.overlay(acc, marked, at, F.length(quote))).otherwise(acc)

    return F.aggregate(annotations, text, step)


def caption_lines(c: Column) -> Column:
    trimmed = F.transform(lines(c), strip)
    return F.filter(trimmed, lambda p: F.lower(p).contains("fig"))


def marked_section(c: Column, marker: str) -> Column:
    begin, end = f"<!-- phase6:{marker}:start -->", f"<!-- phase6:{marker}:end -->"
    inner = F.regexp_extract(text_or_empty(c), f"(?s){begin}(.*?){end}", 1)
    return strip(inner)


def fenced(c: Column) -> Column:
    """Wrap plain text in a code fence longer than any backtick run inside."""
    runs = F.transform(F.regexp_extract_all(c, F.lit("`{3,}"), F.lit(0)), lambda r: F.length(r))
    ticks = F.greatest(F.coalesce(F.array_max(runs) + 1, F.lit(3)), F.lit(3))
    fence = F.repeat(F.lit("`"), ticks)
    return F.concat(fence, F.lit("\n"), c, F.lit("\n"), fence, F.lit("\n"))


def table_markdown(header: Column, rows: Column) -> Column:
    """Pipe table with escaped cells; short rows are padded to the widest."""

    def cell(value: Column) -> Column:
        return F.regexp_replace(squeeze(text_or_empty(value)), r"\|", r"\\|")

    width = F.greatest(F.size(header), F.array_max(F.transform(rows, lambda r: F.size(r))))

    def line(row: Column) -> Column:
        padded = F.concat(F.transform(row, cell), F.array_repeat(F.lit(""), width - F.size(row)))
        return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(header), rule), F.transform(rows, line)), "\n")


def toc_text(entries: Column) -> Column:
    """Indented table of contents, one 'title (p. n)' line per entry."""
    kept = F.filter(entries, lambda e: text_or_empty(e["title"]) != "")
    rows = F.transform(
        kept,
        lambda e: F.concat(
            F.repeat(F.lit("  "), e["level"]), e["title"],
            F.lit(" (p. "), e["page"].cast("string"), F.lit(")"),
        ),
    )
    return F.when(F.size(kept) > 0, F.array_join(rows, "\n")).otherwise("Not available")
