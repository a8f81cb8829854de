"""Tables of HTML pages as rows, one for each cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import Roles, query
from .parsing_more import CELL, REPORT, _report

TOKEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|</?[a-zA-Z!?][^>]*>|[^<]+|<"
SPACED = ("br", "p", "div", "li", "h1", "h2", "h3", "h4")
SPAN = "struct<first: int, last: int, col: int, width: int>"
OPEN = f"struct<table: int, row: int, col: int, width: int, height: int, head: boolean, text: string, spans: array<{SPAN}>>"
OUT = "struct<table: int, row: int, col: int, colspan: int, rowspan: int, head: boolean, text: string>"


def _with(s: Column, **changes: Column) -> Column:
    names = ("table", "row", "col", "width", "height", "head", "text", "spans")
    return F.struct(*(changes.get(n, s[n]).alias(n) for n in names))


def cells(html: Column) -> Column:
    """All cells of all tables of a page, in one fold over its tags and texts: table, row and col from 0, spans, head, text.

    The state is a stack of open tables, so a nested table is one of its own (numbered where it starts) and its text isn't the
    outer cell's.  A cell starts at the first column that no cell from an earlier row reaches into.  Cells and rows that aren't
    closed end where the next one starts.  Comments, scripts and styles have no text; null has no cells.
    """

    def attribute(tag: Column, name: str) -> Column:
        n = F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*[\"']?\s*(\d{{1,4}})", 1).try_cast("int")
        return F.coalesce(F.when(n > 0, n), F.lit(1))

    def step(state: Column, token: Column) -> Column:
        tag = F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
        closing, markup = token.startswith("</"), token.rlike("^</?[a-zA-Z!?]") & token.endswith(">")
        depth = F.size(state["open"])
        top = F.try_element_at(state["open"], F.lit(-1))
        outer = F.slice(state["open"], 1, F.greatest(depth - 1, F.lit(0)))
        is_cell, is_row, is_table = tag.isin("td", "th"), tag == "tr", tag == "table"
        ends = top["text"].isNotNull() & (is_cell | is_row | (is_table & closing))
        text = F.trim(F.regexp_replace(top["text"], r"\s+", " "))
        cell = F.struct(top["table"].alias("table"), top["row"].alias("row"), top["col"].alias("col"), top["width"].alias("colspan"), top["height"].alias("rowspan"), top["head"].alias("head"), text.alias("text"))
        out = F.when(ends, F.array_append(state["out"], cell)).otherwise(state["out"])
        reach = F.struct((top["row"] + 1).alias("first"), (top["row"] + top["height"] - 1).alias("last"), top["col"].alias("col"), top["width"].alias("width"))
        spans = F.when(ends & (top["height"] > 1), F.array_append(top["spans"], reach)).otherwise(top["spans"])
        none = F.lit(None).cast("string")
        left = _with(top, text=F.when(ends, none).otherwise(top["text"]), col=F.when(ends, top["col"] + top["width"]).otherwise(top["col"]), spans=spans)
        row = F.greatest(left["row"], F.lit(0))
        held = lambda c: F.exists(left["spans"], lambda s: (s["first"] <= row) & (row <= s["last"]) & (s["col"] <= c) & (c < s["col"] + s["width"]))
        free = F.array_min(F.filter(F.concat(F.array(left["col"]), F.transform(left["spans"], lambda s: s["col"] + s["width"])), lambda c: (c >= left["col"]) & ~held(c)))
        started = _with(left, row=row, col=free, width=attribute(token, "colspan"), height=attribute(token, "rowspan"), head=tag == "th", text=F.lit(""))
        more = F.when(~markup & ~token.startswith("<!--"), token).when(tag.isin(*SPACED), " ").otherwise("")
        now = (
            F.when(is_row & ~closing, _with(left, row=left["row"] + 1, col=F.lit(0)))
            .when(is_cell & ~closing, started)
            .when(is_cell | is_row, left)
            .otherwise(_with(top, text=F.concat(top["text"], more)))
        )
        fresh = F.struct(state["n"].alias("table"), F.lit(-1).alias("row"), F.lit(0).alias("col"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit(False).alias("head"), none.alias("text"), F.array().cast(f"array<{SPAN}>").alias("spans"))
        stack = F.when(is_table & ~closing, F.array_append(state["open"], fresh)).when(depth == 0, state["open"]).when(is_table, outer).otherwise(F.array_append(outer, now))
        return F.struct(F.when(is_table & ~closing, state["n"] + 1).otherwise(state["n"]).alias("n"), stack.alias("open"), out.alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.array().cast(f"array<{OPEN}>").alias("open"), F.array().cast(f"array<{OUT}>").alias("out"))
    tokens = F.filter(F.regexp_extract_all(html, F.lit(f"({TOKEN})"), 1), lambda t: t != "")
    return F.when(html.rlike("(?i)<table"), F.aggregate(tokens, start, step, lambda s: s["out"])).otherwise(F.array().cast(f"array<{OUT}>"))


def table_cells(pages: DataFrame, *keys: str) -> DataFrame:
    """A row for every cell of the pages (keys, html)."""
    return pages.select(*keys, F.explode(cells(F.col("html"))).alias("c")).select(*keys, "c.*")


def headers(found: DataFrame, *keys: str) -> DataFrame:
    """(keys, table, headers): the cells of each table's first row, in order, a wide one once for each of its columns."""
    first = found.where("row = 0").groupBy(*keys, "table").agg(F.sort_array(F.collect_list(F.struct("col", "colspan", "text"))).alias("h"))
    return first.select(*keys, "table", F.flatten(F.transform("h", lambda x: F.array_repeat(x["text"], x["colspan"]))).alias("headers"))


def column_roles(names: Column, roles: list[tuple[str, str]]) -> Column:
    """role -> column: the last header with a word of a role takes it, a header may have several roles."""
    at = lambda pattern: F.size(names) - F.array_position(F.reverse(F.transform(names, lambda h: F.lower(h).rlike(pattern))), True)
    pairs = [F.struct(F.lit(role).alias("role"), F.when(at(p) < F.size(names), at(p)).cast("int").alias("col")) for role, p in roles]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["col"].isNotNull()))


ROLES = [("entity", "item|county|name"), ("amount", "amount|budget|spent|total")]


@query(rf"""WITH h AS (SELECT 'report' AS kind, CAST(entity_id AS BIGINT) AS id, html FROM ({REPORT}) UNION ALL SELECT 'page', page_id, html FROM pages), x AS (SELECT kind, id, unnest(l) AS row_, generate_subscripts(l, 1) - 1 AS row FROM (SELECT kind, id, regexp_extract_all(html, '(?s)<tr>(.*?)</tr>', 1) AS l FROM h))
    SELECT kind, id, 0 AS "table", CAST(row AS INTEGER) AS row, col, col = 0 AS head, CASE col WHEN 0 THEN {CELL.format("regexp_extract(row_, '(?s)<th>(.*?)</th>', 1)")} ELSE {CELL.format("regexp_extract(row_, '(?s)<td>(.*?)</td>', 1)")} END AS text FROM x, (SELECT unnest([0, 1]) AS col)""")
def html_table_cells(r: Roles):
    """The cells of all pages and of the debt reports of all entities."""
    reports = _report(r).select(F.lit("report").alias("kind"), F.col("entity_id").cast("long").alias("id"), "html")
    pages = r.table("pages").select(F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id"), "html")
    return table_cells(reports.unionByName(pages), "kind", "id").select("kind", "id", "table", "row", "col", "head", "text")


@query(f"SELECT entity_id, 'Item|Amount' AS headers, 0 AS entity, 1 AS amount FROM ({REPORT}) WHERE html IS NOT NULL")
def report_columns(r: Roles):
    """The headers of each report's table and the columns of their roles."""
    h = headers(table_cells(_report(r), "entity_id"), "entity_id").withColumn("roles", column_roles(F.col("headers"), ROLES))
    return h.select("entity_id", F.array_join("headers", "|").alias("headers"), F.try_element_at("roles", F.lit("entity")).alias("entity"), F.try_element_at("roles", F.lit("amount")).alias("amount"))
