"""SQL (DuckDB's) that gives the rows of the queries that SQL can express. op10 shares its patterns, bounds and allow-list with the operator; all else is worked out on its own."""

from __future__ import annotations

from . import secret_scan

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _small(text: str) -> str:
    return f"translate({text}, {_UPPER}, {_LOWER})"


# fingerprints


def _tree(text: str) -> str:
    leaves = "list_transform(list_concat(regexp_extract_all(left(p, 32), '(?s).{1,8}'), regexp_extract_all(substr(p, 33), '(?s).{1,32}')), lambda b: md5(b))"
    return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: {leaves}))"


_PARAGRAPH = "md5('p' || coalesce(array_to_string(p, ''), ''))"
_SECTION = f"md5('s' || array_to_string(list_transform(s, lambda p: {_PARAGRAPH}), ''))"
_TAGS = "array_to_string(list_transform(s, lambda p: coalesce(array_to_string(list_transform(p, lambda b: b[1:8]), ''), '')), ';')"


def _print(tree: str) -> str:
    return f"md5('r' || array_to_string(list_transform({tree}, lambda s: {_SECTION}), '')) || '|' || array_to_string(list_transform({tree}, lambda s: {_TAGS}), '/')"


def _likeness(a: str, b: str) -> str:
    tags = lambda fp: f"list_distinct(regexp_extract_all(split_part({fp}, '|', 2), '[0-9a-f]{{8}}'))"
    both, sizes = f"len(list_intersect({tags(a)}, {tags(b)}))", f"(len({tags(a)}) + len({tags(b)}))"
    return f"CASE WHEN {a} = {b} THEN 1e0 WHEN {sizes} = 0 THEN 0e0 ELSE 2e0 * {both} / {sizes} END"


FINGERPRINTS = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    n AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nxt FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    e AS (SELECT *, substr(text, 1, n - n // 3) || substr(nxt, 1, n // 3) AS edited FROM n),
    t AS (SELECT doc_id, n, edited, {_tree("text")} AS a, {_tree("edited")} AS b, {_tree("nxt")} AS c FROM e),
    f AS (SELECT doc_id, n, edited, {_print("a")} AS fa, {_print("b")} AS fb, {_print("c")} AS fc FROM t)
    SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint, {_likeness("fa", "fb")} AS near_edited, {_likeness("fa", "fc")} AS near_next FROM f"""

# line dedup

_KEY = _small("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")
LINES = f"""
    WITH l AS (
        SELECT doc_id, i, line, {_KEY} AS key
        FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
    ), frequent AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
    FROM l LEFT JOIN frequent f USING (key) GROUP BY doc_id"""

# urls

URLS = f"""
    WITH u AS (
        SELECT page_id,
               CASE WHEN url LIKE '%://%' THEN {_small("regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)")} ELSE '' END AS host,
               CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
        FROM pages
    ), r(rule, verdict) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'), ('example.net/de/8', 'block'), ('org/es/', 'block')),
    fit AS (
        SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
        FROM u JOIN r ON ('.' || host) LIKE ('%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, strpos(rule, '/')))
        GROUP BY page_id)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN fit USING (page_id)"""

# near-duplicates: candidates share one of each set's rarest shingles, as sets that are 0.8 alike must

NEAR = f"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_small("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
    g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
    c AS (SELECT g, count(*) AS c FROM g GROUP BY g),
    p AS (SELECT doc_id, n, g FROM g JOIN c USING (g) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c, g) <= n - (8 * n + 9) // 10 + 1),
    pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
    counted AS (SELECT a, b, len(list_intersect(x.s, y.s)) AS common, len(x.s) + len(y.s) AS n FROM pairs JOIN s x ON a = x.doc_id JOIN s y ON b = y.doc_id),
    links AS MATERIALIZED (SELECT a, b FROM counted WHERE 100 * common >= 80 * (n - common) UNION ALL SELECT b, a FROM counted WHERE 100 * common >= 80 * (n - common)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(reach.b) AS component_id, min(reach.b) = s.doc_id AS kept FROM s JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id, s.s"""

# secrets


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _any_case(pattern: str) -> str:
    """The pattern with its words' letters in either case, as the database's (?i) also folds letters beyond ASCII."""
    head, sep, tail = pattern.removeprefix("(?i)").partition(")")
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in head) + sep + tail


def _spans(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    p = _quoted(_any_case(pattern) if pattern.startswith("(?i)") else pattern)
    total = lambda items: f"coalesce(list_sum(list_transform({items}, lambda x: length(x))), 0)"
    start = f"{total('pieces[1:i]')} + {total('found[1:i - 1]')}"
    made = f"list_transform(range(1, len(found) + 1), lambda i: {{'s': CAST({start} AS BIGINT), 'o': {order}, 'e': CAST({start} + length(found[i]) AS BIGINT), 'm': found[i], 'w': wanted[i]}})"
    return f"(SELECT list_filter({made}, lambda x: length(x.w) >= {least}) FROM (SELECT string_split_regex(t, {p}) AS pieces, regexp_extract_all(t, {p}) AS found, regexp_extract_all(t, {p}, {group}) AS wanted))"


_KINDS = [*secret_scan.BASE, "entropy"]
_BOUND = "CASE " + " ".join(f"WHEN regexp_matches(x.m, '{p}') THEN {secret_scan.BOUNDS[k]}" for p, k in (("^([0-9a-f]+|[0-9A-F]+)$", "hex"), ("^[A-Za-z0-9]+$", "alnum"))) + f" ELSE {secret_scan.BOUNDS['base64']} END"
_MOST = f"list_max(list_transform(range(1, length(x.m) - {secret_scan.WINDOW} + 2), lambda i: list_entropy(string_split(substr(x.m, i, {secret_scan.WINDOW}), ''))))"
_ALLOWED = " OR ".join(f"regexp_matches(x.m, {_quoted(p)})" for p in secret_scan.ALLOWED)
_SUSPICIOUS = f"regexp_matches(x.m, '[0-9]') AND regexp_matches(x.m, '[A-Za-z]') AND NOT ({_ALLOWED}) AND {_MOST} >= {_BOUND}"
_NAMES = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "]"


def _joined(spans: str) -> str:
    return f"coalesce(array_to_string(list_transform(list_sort(list_transform({spans}, lambda x: {{'s': x.s, 'o': x.o, 'e': x.e}})), lambda x: {_NAMES}[x.o + 1] || ':' || x.s || ':' || x.e), ','), '')"


SECRETS = f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    f AS (SELECT doc_id, {", ".join(f"{_spans(k, i, *secret_scan.BASE[k])} AS f_{k}" for i, k in enumerate(secret_scan.BASE))}, {_spans("entropy", 3, secret_scan.CANDIDATE, 0, secret_scan.WINDOW)} AS cand FROM t),
    b AS (SELECT *, list_concat({", ".join(f"f_{k}" for k in secret_scan.BASE)}) AS base FROM f),
    m AS (SELECT *, list_filter(cand, lambda x: {_SUSPICIOUS} AND len(list_filter(base, lambda y: y.s < x.e AND x.s < y.e)) = 0) AS extra FROM b)
    SELECT doc_id, {", ".join(f"len(f_{k}) AS n_{k}" for k in secret_scan.BASE)}, len(extra) AS n_entropy, sha256({_joined("base")}) AS base_sha256, {_joined("list_concat(base, extra)")} AS spans FROM m"""

ORACLE_SQL = {"op5_fingerprints": FINGERPRINTS, "op6_line_dedup": LINES, "op7_url_filters": URLS, "op9_near_duplicates": NEAR, "op10_secret_scan": SECRETS}
