"""The column functions that read detail pages, held against a plain walk of the same pages."""

import html
import random

from adlake.operators import page_outline, pages
from adlake.operators.detail_page import FIELDS, read_fields

_TAGS = ["div", "p", "span", "ul", "li", "table", "tr", "td", "th", "h1", "b", "a", "br", "img", "section", "template", "dl", "dt", "dd",
         "select", "option", "button", "tbody", "thead"]
_CLASSES = ["company", "company-name", "title", "job-description", "description", "about us", "requirements", "salary", "salary-range",
            "tags", "tag", "skill", "tech-x", "location", "city", "money", "posting-title", "x"]
_TEXTS = ["one", " two ", "12 000 PLN", "\n", "a &amp; b", "&lt;", "c&nbsp;d", "x < 3", "&#243;", "&#x142;", "&copy 2", "Łódź", "&unknown;", "AT&T", "\xa0"]


def _page(rng):
    out = []
    for _ in range(rng.randrange(60)):
        kind = rng.random()
        if kind < 0.45:
            tag = rng.choice(_TAGS)
            cls = rng.choice(["", f' class="{rng.choice(_CLASSES)}"', f" class='{rng.choice(_CLASSES)} {rng.choice(_CLASSES)}'",
                              f" CLASS={rng.choice(_CLASSES).split()[0]}", ' title="a > b"', ' href="/company/1?a=1&amp;b=2" id=i'])
            out.append(f"<{tag}{cls}{rng.choice(['', '', '', '/'])}>")
        elif kind < 0.65:
            out.append(f"</{rng.choice(_TAGS)}>")
        elif kind < 0.7:
            out.append(rng.choice(["<!-- <p>no</p> -->", "<!DOCTYPE html>", "<script>if (a<b) '<p>';</script>", "<style>p{}</style>"]))
        else:
            out.append(rng.choice(_TEXTS))
    return "".join(out)


def _rows(spark, given):
    frame = spark.createDataFrame([(i, "u", h) for i, h in enumerate(given)], "page_id bigint, url string, html string").repartition(4)
    return {r.page_id: tuple(r[f] for f in FIELDS) for r in pages.field_texts(frame, python=False).collect()}


def test_random_pages_as_the_walk_reads_them(spark):
    rng = random.Random(5)
    given = [_page(rng) for _ in range(1500)]
    found = _rows(spark, given)
    wrong = [(h, read_fields(h), found[i]) for i, h in enumerate(given) if read_fields(h) != found[i]]
    assert not wrong, (len(wrong), wrong[0])


def test_edges(spark):
    deep = "<div class='description'>" * 300 + "x" + "</div>" * 300
    long = "<ul class='requirements'>" + "".join(f"<li>{i}" for i in range(3000)) + "</ul>"
    wide = "<h1 " + " ".join(f'data-{i}="{i}"' for i in range(400)) + ">Title of it</h1>"
    given = [None, "", "   ", "text only", "<", "<<b", "</p></div>", deep, long, wide, "<p>" * 1000, "<div class=tags><b><span>ab</span></b></div><span>cd</span>",
             "<template><h1>hidden one</h1></template><h1>shown one</h1>", "<h1 class='a' class='title'>Twice given</h1>"]
    found = _rows(spark, given)
    assert len(found) == len(given)
    for i, h in enumerate(given):
        assert found[i] == read_fields(h), (h or "")[:80]


def test_character_references(spark):
    given = ["&amp;&lt;&gt;&quot;&#39;", "&ampx", "&notit;", "&NewLine;&hellip;&nbsp", "&#0;&#x80;&#xD800;&#1114112;&#x1F600;", "&#99999999999;", "&;&#;&#x;", "&"]
    frame = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    found = {r.i: r.t for r in frame.select("i", page_outline.decoded(frame.t).alias("t")).collect()}
    assert [found[i] for i in range(len(given))] == [html.unescape(t) for t in given]


def test_no_python_worker(spark):
    frame = spark.range(3).selectExpr("id AS page_id", "'u' AS url", "concat('<p>', id) AS html")
    plan = pages.parse_details(frame, python=False)._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("InPandas", "InArrow", "EvalPython"))
    assert "InPandas" in pages.parse_details(frame)._jdf.queryExecution().executedPlan().toString()
