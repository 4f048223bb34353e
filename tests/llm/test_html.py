"""Layout of pages against a plain reference."""

import random
import time

import pytest

from jobloom.llm.html_text import page_text, read_page


def drawn(rows):
    """Rows of (text, columns, rows) on a sheet of characters."""
    sheet, where = {}, []
    for r, row in enumerate(rows):
        c = 0
        for text, across, down in row:
            while (r, c) in sheet:
                c += 1
            for i in range(down):
                for j in range(across):
                    sheet[r + i, c + j] = True
            where.append((r, c, across, text))
            c += across
    columns = max((c + across for _, c, across, _ in where), default=0)
    wide = [max([len(text) for _, c, across, text in where if c == k and across == 1], default=0) for k in range(columns)]
    lines = []
    for r in range(len(rows)):
        line = [" "] * 2000
        for row, c, _, text in where:
            if row == r:
                begin = sum(wide[:c]) + 2 * c
                line[begin : begin + len(text)] = text
        lines.append("".join(line).rstrip())
    return "\n".join(line for line in lines if line)


def test_tables_equal_a_drawn_sheet():
    rng = random.Random(4)
    for _ in range(300):
        width, rows = rng.randrange(1, 6), []
        for _ in range(rng.randrange(1, 6)):
            # one cell of each column is narrow, and spanning cells are no wider than their columns
            rows.append([("x" * rng.randrange(1, 9), 1, rng.choice((1, 1, 1, 2, 3))) for _ in range(width)])
        if rng.random() < 0.5:
            rows.insert(0, [("y" * 3, width, 1)])
        cells = ["".join(f"<td colspan={a} rowspan={d}>{t}" for t, a, d in row) for row in rows]
        assert page_text("<table>" + "".join(f"<tr>{c}</tr>" for c in cells) + "</table>") == drawn(rows)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"),
        ("<table><tr><td rowspan=0>A<td>B<tr><td>C<tr><td>D</table>", "A  B\n   C\n   D"),
        ("<table><tbody><tr><td rowspan=9>A<td>B<tbody><tr><td>C<td>D</table>", "A  B\nC  D"),
        ("<table><tr><td colspan=2>head<td>z<tr><td>a<td>b<td>c</table>", "head  z\na  b  c"),
        ("<style>.h{display:none}</style><p class=h>no<p>yes", "yes"),
        ("<p class='a h'>no<p id=i>no<p>yes<style>#i,.h { color: red; DISPLAY : none }</style>", "yes"),
        ("<style>p{display:none} .s{display:block}</style><p>no<p class=s>yes", "yes"),
        ("<style>.s{display:block} p{display:none}</style><p>no<p class=s>yes", "yes"),
        ("<style>@media print{.h{display:none}} @media screen{.g{display:none}}</style><p class=h>yes<p class=g>no", "yes"),
        ("<style>/* .h{display:none} */ .a .b{display:none}</style><p class=h>yes<p class=b>too", "yes\n\ntoo"),
        ("<style>.v{visibility:hidden}</style><p class=v>no<b style='visibility:visible'>yes</b>", "yes"),
        ("<style>.h{display:none}</style><p class=h style='display:block'>yes", "yes"),
        ("<p title='a > b' hidden=''>no<p data-x=\"<b>\">yes", "yes"),
        ("1 < 2 <3 </ >w<!-->q<!--->r<!-- c --!>s<!-- - -- -->t", "1 < 2 <3 wqrst"),
        ("yes<a href='never closed>no <b>no", "yes"),
        ("yes<b <i <u", "yes"),
    ],
)
def test_layout_and_visibility(html, text):
    assert page_text(html) == text


def test_titles():
    assert read_page("<title> A &amp;\n B </title><title>C</title>x") == ("A & B", "x")
    assert read_page("<svg><title>no</title></svg><TITLE >T</TITLE\n>x")[0] == "T"
    assert read_page("<p>x") == (None, "x") and read_page(None) == (None, "") == read_page("")


@pytest.mark.parametrize("part", ["<a ", "<!", "</x", "<", '<a x="', "<!--", "<style>", "<title>", "<style>a{b", "<a href='x", "</p>", "&", "<td rowspan=2 "])
def test_a_megabyte_of_open_tags_is_read_in_one_pass(part):
    began = time.time()
    page_text(part * ((1 << 20) // len(part)))
    assert time.time() - began < 8


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><caption>cap</caption><tr><td>a</table>", "cap\na"),
        ("<table><caption>cap <b>two</b><p>more</caption><tr><td>a<td>b</table>", "cap two\n\nmore\n\na  b"),
        ("<table><caption></caption><tr><td>a</table>", "a"),
        ("<table><caption>cap", "cap"),
        ("<caption>bare</caption>x", "bare\nx"),
        ("<table><tr><td><table><caption>in<tr><td>a</table><td>b</table>", "in  b\na"),
        ("<details><summary>S</summary>no<p>no</details>x", "S\nx"),
        ("<details>no<summary>S</summary><summary>no</summary></details>", "S"),
        ("<details open><summary>S</summary>yes</details>", "S\nyes"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<ol start=5><li>a<li value=9>b<li>c</ol>", "5. a\n9. b\n10. c"),
        ("<ol start=x><li>a<li hidden>no<li>b</ol>", "1. a\n2. b"),
        ("<style>.h{display:none!important}</style><p class=h style='display:block'>no<p class=h style='display:block ! important'>yes", "yes"),
        ("<style>.h{display:none !important} p.h{display:block}</style><p class=h>no<p>yes", "yes"),
        ("<style>.h{display:none} .h{display:block}</style><p class=h>yes", "yes"),
        ("<pre>\na\n\n b</pre>", "a\n\n b"),
        ("<ul><li><p>one<p>two<li><ul><li>in</ul><li>", "- one\n\n  two\n- - in"),
        ("<blockquote>a<ul><li>b<br>c</ul>d</blockquote>e", "  a\n\n  - b\n    c\n\n  d\n\ne"),
        ("<b hidden><li>x</b>shown</li>more", "- shown\nmore"),
    ],
)
def test_captions_lists_and_closed_elements(html, text):
    assert page_text(html) == text


def test_deep_items_show_their_level():
    lines = page_text("<ul><li>x" * 30).split("\n")
    assert lines[1] == "  - x" and lines[11] == "  " * 11 + "- x"
    assert lines[12] == "  " * 11 + "[13] - x" and lines[29] == "  " * 11 + "[30] - x"
    assert page_text("<ul><li>" * 30 + "x").split("- ")[-1] == "x"


def test_cells_after_very_wide_ones_begin_a_line():
    wide = "w" * 20_000
    rows = "<tr><td>aa<td>b" * 4000
    text = page_text(f"<table><tr><td>{wide}<td>x{rows}</table>")
    assert text.startswith(f"{wide}\n    x\naa  b\naa  b") and len(text) < 60_000


_M = 1 << 20
SHAPES = {
    "lists": "<ul><li>x" * (_M // 9),
    "numbered": "<ol><li>x" * (_M // 9),
    "quotes": "<blockquote>x" * (_M // 13),
    "misnested": "<i>" * 100_000 + "<b>" * 100_000 + "</i>" * 80_000 + "x",
    "spans": ("<span>" + "<b>" * 20) * 8000 + "</span>" * 8000 + "x",
    "image": "<svg>" + "<g>" * 500 + "<g></g>" * 140_000 + "</svg>x",
    "tables": "<table><tr><td>x<td>y" * (_M // 21),
    "wide cell": "<table><tr><td>" + "w" * 20_000 + "<td>x" + "<tr><td>a<td>b" * 60_000,
    "wide columns": "<table><tr>" + ("<td>" + "c" * 90) * 1000 + "<tr><td colspan=999><td>x" * 30_000,
    "spanning": "<table><tr>" + "<td rowspan=0>x" * 30_000 + "<tr><td>y" * 60_000,
    "very many columns": "<td colspan=1000>x" * (_M // 18),
    "tall cell": "<table><tr>" + "<td>x" * 50_000 + "<td>" + "y<br>" * 100_000,
    "captions": "<caption>x" * (_M // 10),
    "rules": "<style>" + "".join(f".a.b{i}{{display:none}}" for i in range(20_000)) + "</style>" + "".join(f"<i class='a c{i}'>x" for i in range(20_000)),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_a_megabyte_of_each_shape_is_linear(shape):
    html = SHAPES[shape]
    began = time.time()
    text = page_text(html)
    assert time.time() - began < 30 and len(text) <= 8 * len(html)
    assert sum(text.count(c) for c in "xyw") >= sum(html.count(f">{c}") for c in "xyw")  # no text is dropped
