"""A year page with every irregularity, against records written by hand."""

import html as stdlib

import pytest
from pyspark.sql import functions as F

from seatflow.functions import parsing as P
from seatflow.sources.result_pages import parse_pages

PAGE = """<html><table class="r"><thead><tr><th>School</th><th> Phase 1 </th><th>2C</th><th>3</th></tr></thead>
<tbody>
<tr><td>&#8627; nothing ↳ stray row</td></tr>
<tr><td><a href="/x?a=1&amp;b=2"><strong> Ai Tong </strong></a><br>more</td></tr>
<tr><td>↳ Vacancy (300)</td><td>1,240</td><td>&nbsp;</td></tr>
<tr><td>↳ Applied</td><td>200</td><td>33</td><td>x</td></tr>
<tr><td>↳ Taken</td><td>150<br><span class="a tt b" data-tt-title="SC&lt;1" data-tt="SC > 1km ballots
Applicants: 56
Vacancies: 20
Ballot Chance: 36%">12<b>!</b></span></td><td><b>7</b> left</td><td></td></tr>
<tr><td>Plain &amp; Simple</td></tr>
<tr><td>↳ Vacancy</td><td>1<td>2<td>3</tr>
<tr><td>↳ Applied</td></tr>
<tr><td>↳ Taken</td><td> 5 </td><td><span class='tt' data-tt-title='SC#'>?</span></td></tr>
<tr><td>Cut short</td></tr>
<tr><td>↳ Vacancy (1)</td></tr>
</tbody></table><table><tbody><tr><td>other</td></tr></tbody></table></html>"""

NONE = (None,) * 5
EXPECTED = [
    ("Ai Tong", 300, "Phase 1", 1240, 200, 150, "SC<1", "SC > 1km ballots", 56, 20, 36.0, 2024),
    ("Ai Tong", 300, "2C", None, 33, 7, *NONE, 2024),
    ("Ai Tong", 300, "3", None, None, None, *NONE, 2024),
    ("Plain & Simple", None, "Phase 1", 1, None, 5, *NONE, 2024),
    ("Plain & Simple", None, "2C", 2, None, None, "SC#", None, None, None, None, 2024),
    ("Plain & Simple", None, "3", 3, None, None, *NONE, 2024),
]


def test_year_page(rows):
    pages = rows([(2024, PAGE), (2023, "<p>no table</p>")], "year int, html string")
    got = [tuple(r) for r in parse_pages(pages, "html", "year").collect()]
    assert sorted(got, key=repr) == sorted(EXPECTED, key=repr)


def test_hidden_markup_is_no_data(rows):
    hidden = PAGE.replace(
        "<tr><td>Plain", "<!-- <tr><td>Hidden</td></tr><tr><td>v</td></tr><tr><td>a</td></tr><tr><td>t</td></tr> -->"
        "<script>var x = '<tr><td>no</td></tr>';</script><tr><td><style>b{}</style>Plain",
    )
    pages = rows([(2024, hidden)], "year int, html string")
    got = [tuple(r) for r in parse_pages(pages, "html", "year").collect()]
    assert sorted(got, key=repr) == sorted(EXPECTED, key=repr)
    kept = rows([(hidden,)], "h string").select(P.without_hidden(F.col("h"))).first()[0]
    assert "Hidden" not in kept and "var x" not in kept and "b{}" not in kept and "Plain" in kept


@pytest.mark.parametrize(
    "text",
    ["&amp B", "&ampB", "&notit;", "&copy2", "&hearts;", "&nosuch;", "&#65", "&#x41;z", "&#150;", "a & b", "&", "&&lt;", "&lt&gt",
     "&NotEqualTilde;", "&#0;", "&#x110000;", "&frac12", "&AMP;"],
)
def test_entities_as_in_the_standard_library(rows, text):
    assert rows([(text,)], "t string").select(P.decode_entities(F.col("t"))).first()[0] == stdlib.unescape(text)


@pytest.mark.parametrize(
    ("html", "text"),
    [("<b>1<b>2</b>3</b>7", "7"), ("4<b>x</b>", "4"), ("<br>5", "5"), ("<i/>6", "6"), ("<b>x</b>", None), ("<b>x", None)],
)
def test_direct_text(rows, html, text):
    assert rows([(html,)], "h string").select(P.direct_text(F.col("h"))).first()[0] == text
