from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.functions import lists, names, text
from lectern.functions.stem import stem
from lectern.operators import doctypes, packing
from lectern.operators.ranking import query_phrases


def test_tidy_line_repairs_hyphens_and_blanks(value):
    assert value(text.tidy_line, "  build­ing   with  wide​ gaps , and – dash ") == "building with wide gaps, and - dash"


def test_reflow_joins_wrapped_words_and_keeps_breaks(value):
    tidy = lambda c: text.reflow(F.transform(text.lines(c), text.tidy_line))
    assert value(tidy, "archi-\ntecture is\nbroad\n\nsecond block") == "architecture is broad\n\nsecond block"
    assert value(tidy, "First line ends.\nNext starts") == "First line ends.\n\nNext starts"
    assert value(tidy, "12\nbody\n 7 ") == "body"
    assert value(tidy, "") == ""


def test_concept_keys_disagree_by_design(value):
    assert value(names.concept_key, "  Glass ") == "glass"
    assert value(names.cluster_name_key, "glass") == "glas"
    assert value(names.concept_key, "Public   Spaces") == "public space"
    assert value(names.cluster_name_key, "spaces") == "spac"
    assert value(names.concept_key, "cities") == "city"
    assert value(names.concept_key, "churches") == "church"
    assert value(names.concept_key, "bus") == "bus"


def test_slug_and_paths(value):
    assert value(names.slugify, " Thermal  Mass & Comfort! ") == "thermal-mass-comfort"
    assert value(lambda c: names.material_path(c, F.lit(" "), F.lit("m1")), None) == "wiki/practice/_general/m1.md"


def test_links_and_resolution(value):
    md = "[a](x.md) ![img](y.png) ```[no](z.md)``` [b](../q%20r.md#top)"
    assert value(names.markdown_links, md) == ["x.md", "../q%20r.md#top"]
    page = F.lit("wiki/en/one/two.md")
    assert value(lambda c: names.resolve_link(page, c), "../q%20r.md#top") == "wiki/en/q r.md"
    assert value(lambda c: names.resolve_link(page, c), "#top") is None
    assert value(lambda c: names.resolve_link(page, c), "https://x.org") is None
    assert value(lambda c: names.resolve_link(page, c), "../../../../up.md") is None
    assert value(lambda c: names.relative_link(c, F.lit("wiki/en/two/x.md")), "wiki/en/one/_index.md") == "../two/x.md"
    assert value(lambda c: names.relative_link(c, F.lit("wiki/en/one/x.md")), "wiki/en/one/_index.md") == "x.md"


def test_matching_form_drops_controls_before_blanks(value):
    assert value(text.matching_form, "Some­thing a  b\nOther x Y") == "something bother y"


def test_quality_and_ocr(value):
    assert value(text.quality, "") == 0.0
    assert value(text.quality, "plain readable words here") == pytest.approx(1.0)
    assert value(text.needs_ocr, "short") is False
    assert value(text.needs_ocr, "  ") is True
    assert value(text.needs_ocr, "αβγδ εζηθ ικλμ νξοπ ρστυ φχψω αβγδ εζηθ ικλμ") is True


def test_clean_quote_keeps_drop_cap(value):
    assert value(text.clean_quote, "T\nhe house\nx\nstands  here") == "The house stands here"


def test_years_and_authors(value):
    assert value(text.years, "Published: 2019 (c) 2020 Received 3 May 1999") == [2019, 2020, 1999, 1999]
    assert value(text.date_year, "D:20190102") == "2019"
    assert value(text.date_year, "D:99990102") == ""
    assert value(text.authors, "Ann Bo, Cy Do & Ed Fu and Gi Ha") == ["Ann Bo", "Cy Do", "Ed Fu", "Gi Ha"]


def test_excerpt_marks_and_cuts(value):
    body = "x" * 200 + " thermal mass " + "y" * 300
    shown = value(lambda c: text.excerpt(c, "mass thermal"), body)
    assert shown.startswith("...") and shown.endswith("...")
    assert "<mark>thermal</mark> <mark>mass</mark>" in shown
    assert value(lambda c: text.excerpt(c, "none"), "a < b") == "a &lt; b"


def test_truncation(value):
    assert value(lambda c: text.truncate(c, 5), "abcdefgh") == "abcd…"
    assert value(lambda c: text.truncate_words(c, 2), "one two, three") == "one two..."


def test_inject_annotations(value):
    notes = F.array(
        F.struct(F.lit("cold").alias("quoted_text"), F.lit("why").alias("comment"), F.lit(1).alias("page")),
        F.struct(F.lit("wall").alias("quoted_text"), F.lit("").alias("comment"), F.lit(2).alias("page")))
    assert value(lambda c: text.inject_annotations(c, notes, F.lit(1)), "cold wall cold") == (
        "[HIGHLIGHTED]cold[/HIGHLIGHTED] [NOTE: why] wall cold")


def test_lists(value):
    assert value(lists.json_list, '["a", " b ", ""]') == ["a", "b"]
    assert value(lists.json_list, "{}") == []
    assert value(lambda c: lists.dedupe_folded(F.split(c, ",")), "A, a ,b,,B") == ["A", "b"]
    assert value(lambda c: lists.first_text(F.lit(" "), c), " x ") == "x"


def test_chunks_pack_greedily(value):
    paragraphs = "\n\n".join("p" * 30 for _ in range(5))
    packed = lambda c: packing.chunks(text.paragraphs(c), 20)
    assert [len(x) for x in value(packed, paragraphs)] == [62, 62, 30]


def test_document_type(value):
    paper = "Abstract. Keywords: x. Introduction and methodology. References, doi, journal volume."
    assert value(lambda c: doctypes.document_type(c, F.lit("")), paper) == "paper"
    assert value(lambda c: doctypes.document_type(c, F.lit("")), "nothing to see") == "unknown"


def test_query_phrases():
    assert query_phrases("the buildings for thermal mass") == [["buildings"], ["thermal"], ["mass"]]
    assert query_phrases("non-Western") == [["non", "western"]]
    assert query_phrases("non-Western architecture") == [["non", "western"], ["architecture"]]
    assert query_phrases("that the") == [["that", "the"]]
    assert query_phrases("thermal AND mass") == [["thermal", "and", "mass"]]
    assert query_phrases('"exact words"') == [["exact", "words"]]
    assert query_phrases("  ") == []


@pytest.mark.parametrize("word,expected", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"),
    ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"),
    ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"),
    ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"),
    ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("buildings", "build"),
    ("sky", "sky"), ("bled", "bled"), ("sing", "sing"), ("conflated", "conflat"), ("tanned", "tan"),
])
def test_stem(word, expected):
    assert stem(word) == expected
