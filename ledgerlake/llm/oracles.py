"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from .decontaminate import WINDOW
from .suffix_dedup import LENGTH
from .url_filters import RULES

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _FOLD.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, m, w[i:i + m - 1] AS g FROM (SELECT item, w, least({WINDOW}, len(w)) AS m, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, i, w[i:i + m - 1] AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
h AS (SELECT doc_id, i, dw.m AS m, item FROM dw JOIN bw ON dw.g = bw.g AND dw.m = bw.m),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT doc_id, i, m FROM h)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h WHERE item IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP3 = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS g FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) // 2 AS BIGINT) - {LENGTH - 1})) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
s AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS fresh FROM r)),
z AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM s GROUP BY doc_id, span),
y AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM z),
k AS (SELECT y.doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS head FROM y JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

_HOST = "coalesce(" + _FOLD.format(r"regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1)") + ", '')"
_PATH = r"coalesce(regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_NODE = "CASE WHEN contains({0}, '://') THEN " + _FOLD.format("regexp_extract({0}, '(?s)^(.*?)://', 1)") + " || '://' || " + _HOST + r" || regexp_extract({0}, '(?s)^.*?://[^/?#]*([^#]*)', 1) END"
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)


def _own(src: str, key: str) -> str:
    """The longest rule that fits each row of ``src`` (key, host, path)."""
    return f"SELECT {key}, arg_max(struct_pack(verdict := v.verdict, rule := v.h || v.p), len(v.h || v.p)) AS own FROM {src} JOIN rules v ON (host = v.h OR ends_with(host, '.' || v.h)) AND starts_with(path, v.p) GROUP BY {key}"


_W = r"[ \t\n\f\r]"
_INERT = r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))" + "".join(rf"|<{t}[ \t\n\f\r/>].*?(?:</{t}[ \t\n\f\r/>]|\z)" for t in ("script", "style", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"))
_TAGS = rf"""(?is)(<(?:link|meta|base)(?:[ \t\n\f\r/](?:[^>=]|={_W}*"[^"]*"|={_W}*''[^'']*''|={_W}*[^ \t\n\f\r"''>])*(?:={_W}*)?)?>)|<(?:link|meta|base)[ \t\n\f\r/>].*"""
_PAIRS = rf"""(?s)[^ \t\n\f\r/>=]+(?:{_W}*={_W}*(?:"[^"]*"|''[^'']*''|[^ \t\n\f\r>]*))?"""


def _attribute(name: str) -> str:
    """The first attribute of that name in the list ``pairs``, unquoted, its references resolved."""
    first = rf"regexp_extract(list_filter(pairs, lambda q: lower(regexp_extract(q, '^[^ \t\n\f\r=]+')) = '{name}')[1], '(?s)^[^ \t\n\f\r=]+{_W}*={_W}*(.*)$', 1)"
    bare = f"""list_transform([{first}], lambda v: CASE WHEN v[1] = '"' OR v[1] = '''' THEN substr(v, 2, len(v) - 2) ELSE v END)[1]"""
    code = "list_transform([CAST(CASE WHEN regexp_matches(r, '(?i)^&#x[0-9a-f]+') THEN '0x' || regexp_extract(r, '(?i)^&#x([0-9a-f]+)', 1) WHEN regexp_matches(r, '^&#[0-9]') THEN regexp_extract(r, '[0-9]+') END AS INT)], lambda c: CASE WHEN c < 1 OR c > 1114111 OR c BETWEEN 55296 AND 57343 THEN chr(65533) ELSE chr(c) END)[1]"
    one = f"""CASE lower(r) WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN '"' WHEN '&apos;' THEN '''' ELSE coalesce({code}, r) END"""
    parts = "regexp_extract_all(v, '(?is)&(?:#[0-9]{1,7};?|#x[0-9a-f]{1,6};?|(?:amp|lt|gt|quot|apos);)|[^&]+|&')"
    return f"list_transform([{bare}], lambda v: CASE WHEN v = '' THEN v ELSE array_to_string(list_transform({parts}, lambda r: {one}), '') END)[1]"


def _plain(url: str) -> str:
    """The url with the path that a browser would ask for."""
    path = "regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    kept = f"list_reduce(list_transform(string_split({path}, '/')[2:], lambda s: [s]), lambda k, s: CASE regexp_replace(s[1], '(?i)%2e', '.', 'g') WHEN '.' THEN k WHEN '..' THEN k[1:len(k) - 1] ELSE k || s END, CAST([] AS VARCHAR[]))"
    clean = rf"CASE WHEN regexp_matches({path}, '(?i)/(\.|%2e)(\.|%2e)?(/|$)') THEN list_transform([{kept}], lambda k: '/' || array_to_string(k, '/') || CASE WHEN len(k) > 0 AND regexp_matches({path}, '(?i)/(\.|%2e)(\.|%2e)?$') THEN '/' ELSE '' END)[1] WHEN {path} = '' THEN '/' ELSE {path} END"
    return f"list_transform([{url}], lambda u: CASE WHEN contains(u, '://') THEN regexp_extract(u, '(?s)^.*?://[^/?#]*') || {clean} || regexp_extract(u, '(?s)^.*?://[^/?#]*[^?#]*(.*)$', 1) END)[1]"


def _absolute(link: str, base: str) -> str:
    to = rf"regexp_replace(regexp_replace({link}, '[\t\n\r]', '', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
    site, path = f"regexp_extract({base}, '(?s)^.*?://[^/?#]*')", _PATH.format(base)
    whole = rf"""CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN t WHEN t = '' OR regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN NULL WHEN starts_with(t, '//') THEN regexp_extract({base}, '(?s)^(.*?)://', 1) || ':' || t
  WHEN starts_with(t, '/') THEN {site} || t WHEN starts_with(t, '?') THEN {site} || {path} || t WHEN starts_with(t, '#') THEN regexp_extract({base}, '(?s)^[^#]*') ELSE {site} || coalesce(nullif(regexp_replace({path}, '[^/]*$', ''), ''), '/') || t END"""
    return _plain(f"list_transform([{to}], lambda t: {whole})[1]")


OP5 = rf"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {_RULES}) v(verdict, h, p)),
l AS MATERIALIZED (SELECT row_number() OVER () AS row, page_id, url, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path, list_filter(regexp_extract_all(regexp_replace(html, '{_INERT}', ' ', 'g'), '{_TAGS}', 1), lambda x: x <> '') AS tags FROM pages),
t AS (SELECT row, url, i, lower(tags[i][2:5]) AS tag, regexp_extract_all(tags[i][6:], '{_PAIRS}') AS pairs FROM (SELECT row, url, tags, unnest(range(1, len(tags) + 1)) AS i FROM l)),
v AS (SELECT row, url, i, tag, {_attribute("href")} AS href, {_attribute("rel")} AS rel, {_attribute("http-equiv")} AS equiv, regexp_extract({_attribute("content")}, '(?is)^{_W}*(?:[0-9]+[0-9.]*|\.[0-9.]*){_W}*[;, \t\n\f\r]{_W}*(?:url{_W}*={_W}*)?(.*)$', 1) AS rest FROM t),
z AS (SELECT row, arg_min(href, i) AS base FROM v WHERE tag = 'base' AND href IS NOT NULL GROUP BY 1),
y AS (SELECT v.row, url, coalesce({_absolute("base", "url")}, url) AS base, CASE WHEN tag = 'link' THEN href WHEN rest[1] = '"' OR rest[1] = '''' THEN string_split(rest[2:], rest[1])[1] ELSE rest END AS link
  FROM v LEFT JOIN z USING (row) WHERE tag = 'link' AND list_contains(regexp_split_to_array(lower(rel), '{_W}+'), 'canonical') OR tag = 'meta' AND lower(equiv) = 'refresh'),
x AS (SELECT url, {_absolute("link", "base")} AS target FROM y UNION ALL SELECT url, {_plain("url")} FROM l),
p AS (SELECT row, page_id, host, path, {_NODE.format("url")} AS node FROM l),
g AS (SELECT {_NODE.format("url")} AS node, {_NODE.format("target")} AS goal FROM x),
own AS ({_own("p", "row")}),
e AS (SELECT DISTINCT node AS a, goal AS b FROM g WHERE node <> goal UNION SELECT DISTINCT goal, node FROM g WHERE node <> goal),
reach AS (SELECT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
n AS (SELECT DISTINCT a AS node, {_HOST.format("a")} AS host, {_PATH.format("a")} AS path FROM e),
ruled AS ({_own("n", "node")}),
alias AS (SELECT reach.a AS node, bool_or(own.verdict = 'block') AS blocked, bool_or(own.verdict = 'allow') AS allowed FROM reach JOIN ruled ON reach.b = ruled.node GROUP BY 1)
SELECT page_id, host, path, own.rule AS rule, coalesce(own.verdict, CASE WHEN blocked AND NOT allowed THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN own USING (row) LEFT JOIN alias USING (node)
"""

OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, good, toxic, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask FROM d LEFT JOIN k USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, CAST(list_sum(bits[1:step]) AS INT) - bits[step] AS before FROM (SELECT filter_order, bits, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed, sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant,
  sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (mask & before = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic_lost FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""

OP12 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 2], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT d.doc_id AS doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, first) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS first FROM reach GROUP BY 1) USING (doc_id)
"""

OP13 = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.row <> b.row WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor, anchor_id, id, score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

ORACLE_SQL = {
    "op2_benchmark_decontamination": OP2,
    "op3_suffix_array_dedup": OP3,
    "op5_url_filters": OP5,
    "op11_filter_interaction_audit": OP11,
    "op12_ngram_jaccard_join": OP12,
    "op13_hard_negative_mining": OP13,
}
