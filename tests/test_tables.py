"""Cells of HTML tables against a plain parser."""

from __future__ import annotations

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import tables


class Plain(HTMLParser):
    """Tables by the events of the standard library's parser, with a grid of what is taken."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.stack, self.out, self.n, self.mute = [], [], 0, 0

    def end_cell(self):
        t = self.stack[-1]
        if t["text"] is not None:
            self.out.append((t["n"], t["row"], t["col"], t["w"], t["h"], t["head"], " ".join(t["text"].split())))
            t["taken"] |= {(t["row"] + i, t["col"] + j) for i in range(t["h"]) for j in range(t["w"])}
            t["col"] += t["w"]
            t["text"] = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.stack.append({"n": self.n, "row": -1, "col": 0, "text": None, "taken": set()})
            self.n += 1
        elif self.stack and tag == "tr":
            self.end_cell()
            self.stack[-1] |= {"row": self.stack[-1]["row"] + 1, "col": 0}
        elif self.stack and tag in ("td", "th"):
            self.end_cell()
            t = self.stack[-1]
            t["row"] = max(t["row"], 0)
            while (t["row"], t["col"]) in t["taken"]:
                t["col"] += 1
            t |= {"w": int(a.get("colspan", 1)), "h": int(a.get("rowspan", 1)), "head": tag == "th", "text": ""}
        elif tag in ("br", "p", "div"):
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if self.stack and tag in ("td", "th", "tr", "table"):
            self.end_cell()
            if tag == "table":
                self.stack.pop()
        elif tag in ("p", "div"):
            self.handle_data(" ")

    def handle_data(self, data):
        if self.stack and self.stack[-1]["text"] is not None:
            self.stack[-1]["text"] += data


def plain(html):
    p = Plain()
    p.feed(html)
    return sorted(p.out)


def table(r, depth=0):
    rows = []
    for _ in range(r.randint(1, 4)):
        row = ""
        for _ in range(r.randint(0, 4)):
            tag = r.choice(["td", "th", "TD"])
            attrs = r.choice(["", "", f' colspan="{r.randint(1, 3)}"', f" rowspan={r.randint(1, 3)}", f" class='x' rowspan='{r.randint(1, 3)}' colspan=2"])
            inner = r.choice(["a", " b  c ", "", "d<br>e", "<b>f</b>g", "<p>h</p>", "i\nj"]) + (table(r, depth + 1) + "after" if depth < 2 and r.random() < 0.15 else "")
            row += f"<{tag}{attrs}>{inner}" + (f"</{tag}>" if r.random() < 0.8 else "")
        rows.append(f"<tr>{row}" + ("</tr>" if r.random() < 0.8 else ""))
    return "<table border=1>" + "".join(rows) + "</table>"


def test_cells_equal_the_plain_parser(spark):
    r = random.Random(2)
    pages = [" x ".join(table(r) for _ in range(r.randint(1, 3))) for _ in range(60)]
    pages += ["<table><td>no row<td>second</table>", "<p>none</p>", "", "<table></table>", "<tr><td>outside</td></tr><table><tr><td>in", "<table><tr><td>a < b</td></tr></table>"]
    got = {}
    for x in tables.table_cells(spark.createDataFrame(list(enumerate(pages)), "id int, html string"), "id").collect():
        got.setdefault(x["id"], []).append(tuple(x)[1:])
    for i, html in enumerate(pages):
        want = plain(html)
        assert sorted(got.get(i, [])) == want, html


def test_comments_scripts_and_null(spark):
    html = "<!-- <table><tr><td>no</td></tr></table> --><table><tr><td>a<!-- b --><script>var x = '<td>';</script><style>td{}</style>c</td></tr></table>"
    df = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    assert [(x["id"], x["text"]) for x in tables.table_cells(df, "id").collect()] == [(1, "ac")]


@pytest.mark.parametrize(("names", "want"), [(["County", "Total budget", "Spent", "x"], {"entity": 0, "amount": 2}), (["x"], {}), (["Name of item", "County total"], {"entity": 1, "amount": 1})])
def test_last_header_takes_the_role(spark, names, want):
    df = spark.createDataFrame([(names,)], "h array<string>")
    assert df.select(tables.column_roles(F.col("h"), tables.ROLES).alias("m")).first()["m"] == want


def test_wide_headers_name_each_column(spark):
    html = "<table><tr><th>Item<th colspan=2>Amount</tr><tr><td>x<td>1<td>2</table>"
    found = tables.table_cells(spark.createDataFrame([(1, html)], "id int, html string"), "id")
    assert tables.headers(found, "id").first()["headers"] == ["Item", "Amount", "Amount"]
