"""Very long odd inputs in linear time, distinct rows only where they are needed, names that clash."""

import math
import random
import re
import time

import pytest

from lattica.llm import html, linededup, pii

MB = 1_000_000


@pytest.mark.parametrize("text", ["1" * MB, "1." * (MB // 2), "+1" * (MB // 2), "a@" * (MB // 2), "0" * MB + ".1.1.1", "1 (" * (MB // 3)], ids=["digits", "dots", "plus", "at", "zeros", "marks"])
def test_patterns_of_a_megabyte(text):
    began = time.process_time()
    pii.pattern_spans(text)
    assert time.process_time() - began < 2


def test_addresses_equal_the_pattern():
    pattern, r = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), random.Random(1)
    for _ in range(20_000):
        x = "".join(r.choice("0125.. a") for _ in range(r.randrange(24)))
        assert pii.addresses(x) == [m.span() for m in pattern.finditer(x) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]


@pytest.mark.parametrize("tail", ["<a " * (MB // 3), '<a href="' * (MB // 9), "<!--" * (MB // 4), "<a " * (MB // 3) + ">", '<a href="' * (MB // 9) + ">", "<" * MB + ">", "&#" + "1" * MB + ";", "<script>" * (MB // 8) + ">", "<a b='" * (MB // 12) + '"' * (MB // 2) + ">"])
def test_pages_of_a_megabyte(tail):
    began = time.process_time()
    assert html.extract("<p>hello world</p>" + tail).startswith("hello world")
    assert time.process_time() - began < 2


def test_markup_is_cut_as_browsers_cut_it():
    for page, text in (
        ("a &lt;b&gt; &#65;&#x42;&#0000067; &#99999999999; &copy;", "a <b> ABC � ©"),
        ("1 < 2 <3 <p class=x>y</P >z", "1 < 2 <3 y z"),
        ("<p a=\"x>y\" b='>' c=d>t<br/>u", "t u"),
        ("x<!-- <p>no</p> -->y<!---->z<!-->w", "xyzw"),
        ("<!doctype html><?x y?>t</>u", "tu"),
        ("<script>if (a < b) { '</div>' }</SCRIPT >v<style>p > a</style>", "v"),
        ("<div id=nav/ >v</div>w", "w"),
        ("open <b title=\"it's", "open <b title=\"it's"),
    ):
        assert html.extract(page) == text, page


def brute_extract(sections):
    """Which section has the greatest sum of densities, by the formula for text without links, written out once more."""
    density = lambda c: c * math.log(c)  # noqa: E731  characters per tag, of one tag

    return max(range(len(sections)), key=lambda i: (sum(map(density, sections[i])), -i))


def test_the_densest_section_by_its_own_formula():
    """Without links the density of a block of c characters is c log(c) but for a common factor; nothing of the module is called."""
    r = random.Random(8)
    for _ in range(40):
        sections = [[r.randint(5, 60) for _ in range(r.randint(1, 6))] for _ in range(r.randint(1, 4))]
        page = "<body>" + "".join("<div>" + "".join(f"<p>{'abcd'[i] * n}</p>" for n in s) + "</div>" for i, s in enumerate(sections)) + "</body>"
        best = brute_extract(sections)
        assert all("abcd"[best] * n in html.extract(page).split() for n in sections[best])


def test_distinct_sites_are_listed_for_near_lines_only(spark):
    rows = [(i, f"far and wide\nunique {i}\n" + ("near the threshold" if i < 30 else "x"), f"s{i if i >= 30 else i % 5}") for i in range(90)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    places = linededup.places_of(d)
    told = linededup.estimates(places, linededup.candidates(places))
    low, high = linededup.SITES * (1 - linededup.MARGIN), linededup.SITES * (1 + linededup.MARGIN)
    near = told.where(f"est between {low} and {high}")
    # Of some 270 (line, site) rows only the five of the one near line are made.
    assert near.count() == 1 and linededup.near_sites(places, near).count() == 5
    assert linededup.repeated(d).count() == 3  # "far and wide", "near the threshold", "x"


def test_columns_of_any_name(spark):
    import corpus_pipeline as cp

    names = ["doc_id", "text", "lang", "source", "n_chars", "_t", "_u", "_gone", "_all", "_lines", "_removed", "_row", "_i", "n", "h1", "c0", "fp", "_hot"]
    rows = [(i, f"boiler line\nown text {i} {'word ' * 30}", "en", f"s{i}", 1, *range(len(names) - 5)) for i in range(12)] + [(50, rows_text := "own words of two copies " * 9, "en", "a", 1, *range(len(names) - 5)), (51, rows_text, "en", "b", 1, *range(len(names) - 5))]
    d = spark.createDataFrame(rows, names)
    for stage in (cp.line_stage, cp.near_duplicate_stage):
        out = stage(spark, d, "")
        assert out.columns == names and all(tuple(r)[5:] == tuple(range(len(names) - 5)) for r in out.collect()), stage
    assert all("boiler" not in r.text for r in cp.line_stage(spark, d, "").collect())
    assert {50, 51} & {r.doc_id for r in cp.near_duplicate_stage(spark, d, "").collect()} == {50}
