"""DuckDB SQL with the same rows as the queries of the same name."""

from __future__ import annotations

from .functions.text import IMPALA_SIGNS, SPARK_SIGNS, UNSAFE
from .plans.corpus import TEMPLATES
from .queries import CALL_CASES, CLAUSES, LITERALS, PLACES, ROUTE_CASES

STOP = "['ID', 'IDENTIFIER', 'CODE', 'KEY', 'SK', 'NO', 'NUM']"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens(c: str) -> str:
    return rf"list_distinct([x FOR x IN regexp_split_to_array(trim(regexp_replace(replace(upper({c}), '_', ' '), '([A-Z]+)(\d+)', '\1 \2', 'g')), '\s+') IF x <> '' AND NOT regexp_full_match(x, '[0-9]+')])"


def meaningful(c: str) -> str:
    return f"[x FOR x IN {tokens(c)} IF NOT list_contains({STOP}, x)]"


def norm(c: str) -> str:
    return f"coalesce(trim(regexp_replace(upper({c}), '[_ ]', '', 'g')), '')"


#: The fields of each clause as rows (clause, place in it, column, kind, remark).
CLAUSE_ROWS = ", ".join(f"({k}, {o}, " + ", ".join(map(quoted, row)) + ")" for k, (_, rows) in enumerate(CLAUSES) for o, row in enumerate(rows))


def lineage(name: str) -> str:
    """The hand-made rows of a template for each supplier."""
    rows = ", ".join("(" + ", ".join(quoted(x) for x in (*r[:5], "|".join(sorted(r[5].split("|"))))) + ")" for r in TEMPLATES[name][1])
    fill = lambda c: f"replace({c}, '{{k}}', s_suppkey::VARCHAR)"
    return f"""SELECT s_suppkey AS query_no, {fill('a')} AS "databaseName", {fill('b')} AS "tableName", {fill('c')} AS "tableAliasName",
  {fill('d')} AS "columnName", {fill('e')} AS "aliasName", f AS remarks
FROM supplier, (VALUES {rows}) v(a, b, c, d, e, f)"""


NAMES = "SELECT p_partkey, p_brand, regexp_replace(concat_ws('_', p_name, p_brand, 'ID'), '[^A-Za-z0-9_ ]', '', 'g') AS s FROM part"
DOTTED = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a.b.' || p_brand WHEN 1 THEN 'a.' || p_brand ELSE p_brand END AS s FROM part"
SQL_TEXT = """SELECT p_partkey, 'SELECT ndv(a), len(b) -- note ' || p_partkey || chr(10) || 'FROM t /* x' || chr(10) || 'y */ WHERE d = ''#START_DATE#'' AND now() > DATE ''2024-01-01'';  SELECT isnull(c, '';'') FROM u OFFSET 5 ROWS' AS sql FROM part"""
#: Whole document lines with marks and blank lines between; what follows has them as n(file, line_no, line).
LOG_LINES = r"""
WITH l AS (
  SELECT doc_id AS file, unnest(generate_series(0, len(x) - 1)) AS p, unnest(x) AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), m AS (
  SELECT file, 2 * p AS line_no, CASE p % 7 WHEN 1 THEN 'ERROR at ' || t WHEN 3 THEN 'Caused by: x' || p || ' ' || t ELSE t END AS line FROM l
  UNION ALL SELECT file, 2 * p + 1, '' FROM l WHERE p % 7 = 5
)"""
LOG_BLOCKS = r""", s AS (
  SELECT *, regexp_matches(line, 'Exception|ERROR|Caused by') AS start, coalesce(lag(trim(line) = '') OVER (PARTITION BY file ORDER BY line_no), false) AS after FROM n
), g AS (
  SELECT *, sum((start OR after)::INT) OVER (PARTITION BY file ORDER BY line_no) AS seg FROM s
), i AS (
  SELECT *, first_value(start) OVER (PARTITION BY file, seg ORDER BY line_no) AS inside FROM g
), b AS (SELECT file, dense_rank() OVER (PARTITION BY file ORDER BY seg) AS block_id, line_no, line FROM i WHERE inside)
"""
LOG = LOG_LINES + ", n AS (SELECT * FROM m)" + LOG_BLOCKS
LOG_ONE = LOG_LINES + ", n AS (SELECT 'all' AS file, file * 1000000 + line_no AS line_no, line FROM m)" + LOG_BLOCKS
ROOT = r"coalesce(regexp_extract_all(string_agg(line, chr(10) ORDER BY line_no), 'Caused by:\s+([^\n]*)', 1)[-1], 'NO ROOT CAUSE FOUND') AS root_cause"
MATCH = """
WITH f AS (
  SELECT n_nationkey AS field_no, 'brand_' || ['name', 'type', 'key', 'size', 'zone'][n_nationkey % 5 + 1] || '_' || n_name AS m, 'f' || n_nationkey AS fact FROM nation
  UNION ALL SELECT n_nationkey + 100, n_name, 'g' FROM nation WHERE n_nationkey % 5 = 2
), p AS (
  SELECT p_partkey AS row_no, CASE WHEN p_partkey % 7 = 0 THEN 'gfolyreg_work_x' WHEN p_partkey % 11 = 0 THEN '' ELSE 'db' END AS db,
         ['brand_name', 'brand_type', '*', 'part_size', 'brandname'][p_partkey % 5 + 1] AS c FROM part
), r AS (SELECT *, CASE WHEN row_no % 2 = 0 THEN c || '_' || row_no % 25 ELSE '' END AS a FROM p),
u AS (SELECT * FROM r WHERE db <> '' AND NOT contains(lower(db), 'gfolyreg_work') AND trim(CASE WHEN trim(a) <> '' THEN a ELSE c END) <> '*')
"""
GATE = f"""
, g AS (
  SELECT field_no, row_no FROM f, u WHERE list_has_any({meaningful('m')}, {meaningful("CASE WHEN trim(a) <> '' THEN a ELSE c END")})
     OR (trim(a) <> '' AND trim(c) <> '*' AND list_has_any({meaningful('m')}, {meaningful('c')}))
)"""


#: Pairs of the sized names, scored by lengths: the word is all that both have in common.
SIZED = """
WITH f AS (
  SELECT n_nationkey AS field_no, ['brand', 'size', 'zone'][n_nationkey % 3 + 1] AS w, w || '_' || repeat(translate(n_nationkey::VARCHAR, '0123456789', 'ABCDEFGHIJ'), (n_nationkey % 4 * 4 + 1)::BIGINT) AS m, 'f' || n_nationkey AS fact FROM nation
), r AS (
  SELECT p_partkey AS row_no, CASE WHEN p_partkey % 7 = 0 THEN 'staging' WHEN p_partkey % 11 = 0 THEN '' ELSE 'db' END AS db,
         CASE WHEN p_partkey % 3 = 0 THEN 'size' ELSE 'brand' END AS cw, cw || '_' || p_partkey % 100 AS c, CASE WHEN p_partkey % 2 = 0 THEN 'size_' || p_partkey ELSE '' END AS a FROM part
), g AS (
  SELECT *, CASE WHEN a <> '' AND w = 'size' THEN a ELSE c END AS compared FROM f, r WHERE db = 'db' AND (a <> '' AND w = 'size' OR w = cw)
), s AS (
  SELECT *, 2.0::DOUBLE * length(w) / (length(replace(m, '_', '')) + length(replace(compared, '_', ''))) * 100.0::DOUBLE AS score, printf('%.1f%%', score) AS percent FROM g
), strong AS (SELECT * FROM s WHERE score >= 40),
weak AS (SELECT * FROM s WHERE field_no NOT IN (SELECT field_no FROM strong) QUALIFY row_number() OVER (PARTITION BY field_no ORDER BY score DESC, length(compared) DESC, row_no) = 1),
found AS (SELECT *, 'fuzzy' AS kind FROM strong UNION ALL SELECT *, 'weak' FROM weak),
matches AS (
  SELECT field_no, 'REG' AS regulation, 'k1' AS key, m AS "mapperColumn", fact AS "mapperFactField", db AS "dbName", 'part' AS "tableName", c AS "columnName", a AS "columnAliasName",
         CASE WHEN compared = a THEN 'alias' ELSE 'columnName' END AS "matchedOn", percent AS "matchPercentage", kind AS "matchType" FROM found
  UNION ALL SELECT field_no, 'REG', 'k1', m, fact, '', '', '', '', '', '0.0%', 'no_match' FROM f WHERE field_no NOT IN (SELECT field_no FROM g)
)
"""
LITERAL_ROWS = ", ".join(f"({k}, {o}, {quoted(v)})" for k, (_, values) in enumerate(LITERALS) for o, v in enumerate(values))
ROUTE_ROWS = ", ".join(f"({k}, {quoted(kind)}, {quoted(engine)}, {safe})" for k, (_, kind, engine, safe) in enumerate(ROUTE_CASES))
PLACE_ROWS = ", ".join(f"({k}, {quoted(t)}, {unknown})" for k, (_, t, unknown) in enumerate(PLACES))


def signs(c: str, of: list[str]) -> str:
    return " + ".join(f"contains(lower({c}), {quoted(s)})::INT" for s in of)


RECON = """
WITH g AS (
  SELECT o_custkey::VARCHAR AS uitid, (o_orderkey % 4)::INT AS version, o_orderpriority AS break_type, o_orderkey || '_202501010' AS msg
  FROM orders WHERE o_orderstatus <> 'F'
), s AS (
  SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS uitid, ((o_orderkey + o_custkey) % 4)::INT AS version, ['ACK', 'NACK', 'NON_REPORTABLE'][o_orderkey % 3 + 1] AS status,
         dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rk FROM orders
), j AS (
  SELECT g.uitid, g.version, g.break_type, substr(msg, 1, length(msg) - 10) AS linked, lr.version AS lv, lt.version AS tv, lt.id AS tid, lt.status
  FROM g LEFT JOIN s lr ON lr.id = substr(msg, 1, length(msg) - 10) AND lr.uitid = g.uitid LEFT JOIN (SELECT * FROM s WHERE rk = 1) lt ON lt.uitid = g.uitid
)
SELECT uitid, version AS olympus_version, lv AS dtcc_reflected_version, tv AS reghub_latest_version, status AS reghub_latest_status, break_type,
  CASE WHEN version = lv AND linked = tid THEN 'value_mismatch_reghub_error'
       WHEN version > lv AND linked <> tid AND status = 'ACK' THEN 'false_break_timing_issue'
       WHEN version > lv AND linked <> tid AND status = 'NACK' THEN 'pending_nack_resolution'
       WHEN version > lv AND linked <> tid AND status = 'NON_REPORTABLE' THEN 'non_reportable_review'
       WHEN version > lv AND linked = tid THEN 'missing_from_source'
       WHEN version < lv THEN 'olympus_data_issue' ELSE 'cannot_be_determined' END AS field_control_break_reason
FROM j"""
FLAT = "SELECT 'm' || p_partkey AS name, p_brand AS regulation, p_type AS classname, p_name AS view_name, 'SELECT a FROM db.t' || p_partkey AS sql FROM part"
BRANCHES = """
WITH e AS (SELECT event_id, user_id::VARCHAR AS u, props, event_id % 2 AS half FROM events),
s AS (SELECT half, u AS name, arg_max(props, event_id) AS v FROM e GROUP BY half, u),
a AS (SELECT name, v FROM s WHERE half = 1), b AS (SELECT name, v FROM s WHERE half = 0)"""
REWRITTEN = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(sql, '#START_DATE#', '20231101'), 'now\\(\\)', 'CURRENT_TIMESTAMP', 'gi'),"
    " '\\bisnull\\(', 'nvl(', 'gi'), '\\blen\\(', 'length(', 'gi'), '\\bndv\\(', 'approx_count_distinct(', 'gi'), 'DATE ''([^'']+)''', 'DATE(''\\1'')', 'g'), 'OFFSET (\\d+) ROWS', 'OFFSET \\1', 'g')"
)
ROUTES = """['{"find": 1}', '[1]', 'select map(a, b) from t', 'select a from t'][p_size % 4 + 1]"""
DIALECTS = "['select ndv(a) from t', 'select collect_list(a) from t', 'select a from t', 'refresh table t; select len(a), now() from t'][p_size % 4 + 1]"

ORACLES: dict[str, str] = {name: lineage(name) for name in TEMPLATES} | {
    "dq_null_counts": """WITH j AS (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))
SELECT * FROM (SELECT 'doc_id' AS "column", count(*) - count(doc_id) AS nulls FROM j UNION ALL SELECT 'quality', count(*) - count(quality) FROM j UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM j) WHERE nulls > 0""",
    "dq_duplicates": "SELECT text, lang FROM (SELECT text, lang, row_number() OVER (PARTITION BY text, lang) AS n FROM documents) WHERE n > 1",
    "dq_range": "SELECT p_partkey, nullif(p_size, 1) AS p_size FROM part WHERE nullif(p_size, 1) < 5 OR nullif(p_size, 1) > 45",
    "dq_pattern": "SELECT p_partkey, nullif(p_brand, 'Brand#11') AS p_brand FROM part WHERE NOT regexp_matches(coalesce(nullif(p_brand, 'Brand#11'), 'nan'), '^(?:Brand#[1-3])')",
    "dq_domain": "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS o_orderstatus FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus NOT IN ('O')",
    "dq_run_checks": """SELECT 'domain:p_type' AS "check", count(*) AS n FROM part WHERE p_type NOT IN ('ECONOMY')
UNION ALL SELECT 'duplicates', (SELECT count(*) FROM part) - (SELECT count(*) FROM (SELECT DISTINCT * FROM part)) UNION ALL SELECT 'nulls', 0
UNION ALL SELECT 'pattern:p_brand', count(*) FROM part WHERE NOT regexp_matches(p_brand, '^(?:Brand#[1-3])') UNION ALL SELECT 'range:age', 1
UNION ALL SELECT 'range:p_size', count(*) FROM part WHERE p_size < 5 OR p_size > 45""",
    "recon_classify": RECON,
    "recon_extract": "SELECT 'rhoo_' || o_orderkey || o_orderpriority AS id, CASE o_orderstatus WHEN 'O' THEN 'MASKING' WHEN 'P' THEN 'NON_MASKING' END AS reporting_type, o_totalprice AS amount FROM orders WHERE o_orderstatus IN ('O', 'P')",
    "recon_latest": "SELECT event_id, user_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "recon_load_rank": "SELECT o_orderkey, o_custkey, o_orderdate, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC)::INT AS load_rank FROM orders",
    "recon_running_sum": "SELECT event_id, (sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS running FROM events",
    "recon_rank_spread": "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC)::BIGINT AS price_rank, count(*) OVER (PARTITION BY o_orderstatus) AS n_status FROM orders",
    "recon_rank": "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC)::INT AS price_rank, count(*) OVER (PARTITION BY o_orderstatus) AS n_status FROM orders",
    "meta_flatten": f"SELECT name, regulation, classname, 'create' AS kind, view_name, sql FROM ({FLAT})",
    "meta_filter": f"SELECT name, regulation, classname FROM ({FLAT}) WHERE regulation = 'Brand#11'",
    "meta_filter_view": f"SELECT name, CASE WHEN regulation = 'Brand#12' THEN '' ELSE classname END AS classname FROM ({FLAT}) WHERE regulation = 'Brand#12' OR classname IN ('ECONOMY ANODIZED STEEL', 'PROMO', 'SMALL')",
    "meta_class_by_reg": "SELECT p_type AS classname FROM part WHERE p_brand = 'Brand#11' ORDER BY p_partkey LIMIT 1",
    "meta_json_walk_deep": """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'own' ELSE 'near' END || p_partkey AS name, 'c' || p_partkey AS classname, 'v' || p_partkey AS view_name, '' AS sql_query
  FROM part WHERE p_partkey % 10 <> 9""",
    "meta_json_walk": "SELECT 'm' || p_partkey AS name, p_type AS classname, p_name AS view_name, to_base64(encode('SELECT a FROM db.t' || p_partkey)) AS sql_query FROM part",
    "meta_diff": BRANCHES + """ SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'new' WHEN a.name IS NULL THEN 'purged' ELSE 'diff' END AS change
FROM a FULL JOIN b USING (name) WHERE a.name IS NULL OR b.name IS NULL OR replace(a.v, ' ', '') <> replace(b.v, ' ', '')""",
    "meta_count": "SELECT count(*) AS total_records, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names FROM nation",
    "meta_registry_upsert": """WITH r AS (SELECT sha256(p_brand || '|' || p_name || '|' || p_type) AS id, p_size, p_partkey FROM part), f AS (SELECT id, p_size FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY p_partkey) = 1)
SELECT id, CASE WHEN p_size > 40 THEN 'new' WHEN p_size > 25 THEN 'approved' ELSE 'rejected' END AS status FROM f""",
    "lin_na_filter": "SELECT * FROM (SELECT p_partkey, CASE WHEN p_size < 10 THEN 'N/A' ELSE 'db' END AS a, CASE WHEN p_size < 20 THEN 'N/A' ELSE 't' END AS b FROM part) WHERE NOT (a = 'N/A' AND b = 'N/A')",
    "fn_norm": f"SELECT p_partkey, {norm('s')} AS norm FROM ({NAMES})",
    "fn_tokens": f"SELECT p_partkey, array_to_string(list_sort({tokens('s')}), ',') AS tokens FROM ({NAMES})",
    "fn_overlap": f"SELECT p_partkey, list_has_any({meaningful('s')}, {meaningful(chr(39) + 'brand_key_' + chr(39) + ' || p_brand')}) AS meets FROM ({NAMES})",
    "fn_b64": "SELECT c_custkey, c_name AS plain, 'select *, ' || c_name AS raw, '' AS short, to_base64(encode(c_mktsegment)) AS coded FROM customer",
    "fn_b64_lenient": "SELECT c_custkey, c_name AS plain FROM customer",
    "fn_clean_sql": rf"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(sql, '--[^\n]*', '', 'g'), '(?s)/\*.*?\*/', '', 'g'), '\s+', ' ', 'g')) AS clean FROM ({SQL_TEXT})",
    "fn_params": f"SELECT p_partkey, replace(sql, '#START_DATE#', '20240101') AS filled FROM ({SQL_TEXT})",
    "fn_split_stmts": """SELECT p_partkey, o AS ordinal, s AS statement FROM part, (VALUES (0, 'select ndv(a), len(b) from t where d = ''#start_date#'' and now() > date ''2024-01-01'''), (1, 'select isnull(c, '';'') from u offset 5 rows')) v(o, s)""",
    "fn_split_cols": "SELECT p_partkey, o AS ordinal, CASE o WHEN 0 THEN 'a' WHEN 1 THEN 'f(b, c) AS x' ELSE '''q,r'' || ' || p_partkey END AS item FROM part, (VALUES (0), (1), (2)) v(o)",
    "fn_tsr_strip": "SELECT o_orderkey, o_orderkey::VARCHAR AS id FROM orders",
    "fn_parse_table": f"SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN 'N/A' ELSE 'a' END AS db, CASE p_partkey % 3 WHEN 0 THEN 'b' ELSE 'dbo' END AS \"schema\", string_split(s, '.')[-1] AS \"table\" FROM ({DOTTED})",
    "fn_parse_entity": f"SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a' ELSE '' END AS db, CASE p_partkey % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'a' ELSE '' END AS \"table\", string_split(s, '.')[-1] AS \"column\" FROM ({DOTTED})",
    "fn_remark_rule": """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Spark complex SQL -MAP function' WHEN 1 THEN 'derived_column_window_function' WHEN 2 THEN 'derived_expression' WHEN 3 THEN 'constant_value'
  ELSE CASE WHEN p_size > 25 THEN 'column_selected_with_database' ELSE 'database_not_specified_in_query' END END AS remark FROM part""",
    "dialect_rewrite": f"SELECT p_partkey, {REWRITTEN} AS spark_sql FROM ({SQL_TEXT})",
    "dialect_detect": f"SELECT p_partkey, CASE WHEN i > s THEN 'impala' WHEN s > i THEN 'sparksql' ELSE 'unknown' END AS dialect FROM (SELECT p_partkey, {signs('q', IMPALA_SIGNS)} AS i, {signs('q', SPARK_SIGNS)} AS s FROM (SELECT p_partkey, {DIALECTS} AS q FROM part))",
    "lin3_detect": f"SELECT p_partkey, t AS query_type, e AS engine, s AS safe FROM part JOIN (VALUES {ROUTE_ROWS}) x(k, t, e, s) ON p_partkey % {len(ROUTE_CASES)} = k",
    "prj_route": f"SELECT p_partkey, ['mongo', 'elastic', 'map', 'sql'][p_size % 4 + 1] AS query_type, 'sql' AS engine, p_size <= 40 AS safe FROM part WHERE {ROUTES} IS NOT NULL AND {len(UNSAFE)} > 0",
    "match_gate": MATCH + GATE + "SELECT DISTINCT field_no, row_no FROM g",
    "match_key": f"""{MATCH}, g AS (
  SELECT field_no FROM f, u WHERE field_no % 2 = row_no % 3 AND (list_has_any({meaningful('m')}, {meaningful("CASE WHEN trim(a) <> '' THEN a ELSE c END")})
     OR (trim(a) <> '' AND trim(c) <> '*' AND list_has_any({meaningful('m')}, {meaningful('c')})))
) SELECT 'k' || field_no % 2 AS key, field_no, (field_no NOT IN (SELECT field_no FROM g))::BIGINT AS n_none FROM f""",
    "match_exact": f"""{MATCH}, n AS (SELECT row_no, db, c, CASE WHEN row_no % 2 = 0 THEN upper(c) ELSE '' END AS a FROM u WHERE c <> '*'), w AS (SELECT field_no, ['Brand_Name', 'PART SIZE', 'zzz'][field_no % 3 + 1] AS m FROM f)
SELECT field_no, m AS "mapperColumn", c AS "columnName", a AS "columnAliasName", '100.0%' AS "matchPercentage", 'exact' AS "matchType" FROM w, n WHERE {norm('m')} = {norm("CASE WHEN a <> '' THEN a ELSE c END")}
  AND list_has_any({meaningful('m')}, {meaningful("CASE WHEN a <> '' THEN a ELSE c END")})""",
    "match_nomatch": MATCH + GATE + """SELECT field_no, m AS "mapperColumn", '0.0%' AS "matchPercentage", 'no_match' AS "matchType" FROM f WHERE field_no NOT IN (SELECT field_no FROM g)""",
    "match_columns_sized": SIZED + "SELECT * FROM matches",
    "match_summary_sized": SIZED + """SELECT count(*) AS total, count(*) FILTER ("matchType" = 'exact') AS exact, count(*) FILTER ("matchType" = 'fuzzy') AS fuzzy, count(*) FILTER ("matchType" = 'weak') AS weak, count(*) FILTER ("matchType" = 'no_match') AS no_match FROM matches""",
    "match_topn_sized": SIZED + "SELECT field_no, row_no, compared, percent, row_number() OVER (PARTITION BY field_no ORDER BY score DESC, length(compared) DESC, row_no)::INT AS rank FROM s QUALIFY rank <= 3",
    "fn_ratio_sized": f"""SELECT p_partkey, 2.0::DOUBLE * length(a) / (length(a) + length(b)) * 100.0::DOUBLE AS ratio, printf('%.1f%%', ratio) AS percent
  FROM (SELECT p_partkey, {norm('p_name')} AS a, {norm("p_brand || '_' || p_name || '_' || p_type")} AS b FROM part)""",
    "match_key_summary": "SELECT p_brand AS key, count(*) AS total, count(*) FILTER (p_size % 4 <> 3) AS matched, count(*) FILTER (p_size % 4 = 3) AS no_match FROM part GROUP BY 1",
    "match_flatten": """SELECT i::BIGINT AS row_no, 'db' AS db, event_type AS "table", event_id::VARCHAR AS "column", 'al' AS alias, 'f.sql' AS file, 'v' AS view, 'app' AS application FROM events, (VALUES (0), (1)) x(i)""",
    "match_mapper": """SELECT i AS field_no, CASE i WHEN 0 THEN n_name ELSE 'x' END AS "mapperColumn", CASE i WHEN 0 THEN 'f' ELSE 'g' END AS "mapperFactField" FROM nation, (VALUES (0), (1)) x(i)""",
    "src_http_guard": "SELECT * FROM (VALUES ('https://a.example.org/x', 'allowed'), ('http://a.example.org/x', 'blocked'), ('https://localhost/', 'blocked'), ('https://10.0.0.1/', 'blocked'), ('https://other.net/', 'blocked'), ('https://sub.a.example.org/', 'allowed')) v(url, verdict)",
    "src_url_build": "SELECT n_nationkey, 'https://h/' || n_name || '/metadata-service/metadata/m' || n_nationkey AS url FROM nation",
    "src_payload_build": """SELECT n_nationkey, '{"winkeys:currBranch":"b","winkeys:windowType":"w","winkeys:olympusApplication":"' || n_name || '"' || CASE WHEN n_nationkey % 2 = 0 THEN ',"windata:a6":["f.sql"]' ELSE '' END || '}' AS body FROM nation""",
    "src_payload_filter": "SELECT event_id, event_type AS branch, 'w' AS window_type, 'app' AS application, 'f' || user_id % 3 AS file FROM events WHERE event_type = 'click' AND user_id % 3 < 2",
    "src_http": """SELECT 'https://h/' || n_name AS url, CASE WHEN n_name[-1] IN ('A', 'E', 'I', 'O', 'U') THEN 200 ELSE 404 END::INT AS status,
  CASE WHEN n_name[-1] IN ('A', 'E', 'I', 'O', 'U') THEN '{"u": "' || n_name[-1] || '"}' END AS body, CASE WHEN n_name[-1] NOT IN ('A', 'E', 'I', 'O', 'U') THEN 'none' END AS error FROM nation""",
    "snk_json": """SELECT true AS success, 'ok' AS message, (SELECT count(*) FROM region) AS total_records, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS record FROM region""",
    "log_blocks_whole": LOG + "SELECT file, block_id, line_no FROM b",
    "log_root_whole": LOG + f"SELECT file, block_id, {ROOT} FROM b GROUP BY file, block_id",
    "log_count_whole": LOG + "SELECT file, count(DISTINCT block_id) AS n_blocks FROM b GROUP BY file",
    "log_stream": LOG + f"SELECT file, block_id, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_lines, {ROOT}, substr(string_agg(line, chr(10) ORDER BY line_no), 1, 5000) AS trace FROM b GROUP BY file, block_id",
    "log_one_file": LOG_ONE + "SELECT block_id, line_no FROM b",
    "log_one_file_root": LOG_ONE + f"SELECT block_id, {ROOT}, substr(string_agg(line, chr(10) ORDER BY line_no), 1, 5000) AS trace FROM b GROUP BY block_id",
    "nosql_mongo": """SELECT n_nationkey, o AS ordinal, n_name AS "tableName", c AS "columnName", a AS "aliasName", r AS remark FROM nation JOIN
(VALUES (0, 0, 'a', '', 'Mongo Query'), (0, 1, 'b', 'b', 'Mongo Query'), (1, 0, '*', '', 'Mongo query'), (2, 0, 'x', '', 'project_included'), (2, 1, '$lookup->o', 'z', 'lookup_join')) v(k, o, c, a, r) ON n_nationkey % 3 = k""",
    "nosql_elastic_kinds": f"""SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY place, o) - 1)::INT AS ordinal, c AS "columnName", t AS clause, r AS remark
  FROM (SELECT p_partkey, 0 AS place, v.o, v.c, v.t, v.r FROM part JOIN (VALUES {CLAUSE_ROWS}) v(k, o, c, t, r) ON p_partkey % {len(CLAUSES)} = v.k
        UNION ALL SELECT p_partkey, x.place, 0, x.c, x.t, x.r FROM part, (VALUES (1, 'second', 'range', 'range:from=a,to=b'), (2, 'last', 'term', 'Mongo query')) x(place, c, t, r))""",
    "nosql_elastic": """SELECT n_nationkey, o AS ordinal, CASE o WHEN 0 THEN 'f' || n_nationkey ELSE c END AS "columnName", t AS clause FROM nation, (VALUES (0, '', 'match'), (1, 'g', 'range'), (2, 'h', 'exists'), (3, 't', 'term')) v(o, c, t)""",
    "lin_meta": f"""SELECT 'db' AS "databaseName", 't' || substr(name, 2) AS "tableName", 'a' AS "columnName", name AS metadatakey, regulation, view_name AS "viewName" FROM ({FLAT})""",
    "lin_dedup": "SELECT s_suppkey AS query_no, 4 AS n_rows, 6 AS n_emitted FROM supplier",
    "lin_titled": """SELECT 'd' || s_suppkey AS "Database Name", 't' AS "Table Name", '' AS "Table Alias Name", c AS "Column Name", a AS "Alias Name" FROM supplier, (VALUES ('a', ''), ('b', 'x')) v(c, a)""",
    "lin_route": """SELECT s_suppkey AS query_no, '' AS "databaseName", CASE s_suppkey % 4 WHEN 3 THEN 't' ELSE '' END AS "tableName", '' AS "tableAliasName", CASE s_suppkey % 4 WHEN 3 THEN 'a' ELSE '' END AS "columnName", '' AS "aliasName",
  ['ignored_mongo_query', 'ignored_elastic_query', 'Spark complex SQL -MAP function', 'database_not_specified_in_query'][s_suppkey % 4 + 1] AS remarks FROM supplier""",
    "src_csv": "SELECT p_partkey, p_name, p_size FROM part",
    "src_json_dir": "SELECT CASE WHEN n_nationkey <> 3 THEN n_name END AS name, n_nationkey = 3 AS bad FROM nation",
    "src_log": "SELECT line, count(*) AS n FROM (SELECT 'ERROR ' || r_name AS line FROM region UNION ALL SELECT ' at x' FROM region) GROUP BY 1",
    "src_sql_dict": "SELECT * FROM (VALUES ('A', 'select 1', 'va', '', 'r', ''), ('B', 'select 2', 'B', '', '', '')) v(query_key, sql, view_name, metadatakey, regulation, class_name)",
    "src_yaml": "SELECT p_partkey, p_size FROM part WHERE p_size < 5 OR p_size > 45",
    "lin_trace": """SELECT s_suppkey AS query_no, 'd' || s_suppkey AS "databaseName", 't' AS "tableName", 'a' AS "columnName", 'out' AS "aliasName", 'via_subquery:s|via_subquery:c' AS remarks FROM supplier""",
    "lin_map_pairs": """SELECT s_suppkey AS query_no, q AS qualifier, c AS "columnName", replace(a, '?', s_suppkey::VARCHAR) AS "aliasName" FROM supplier, (VALUES ('', 'a', 'k?'), ('t', 'b', 'l'), ('', 'c', 'l')) v(q, c, a)""",
    "lin_tables_cols": """SELECT s_suppkey AS query_no, k AS kind, replace(q, '?', s_suppkey::VARCHAR) AS qualifier, n AS name FROM supplier,
(VALUES ('table', 'd?', 't'), ('table', 'e', 'u'), ('column', 'x', 'a'), ('column', '', 'b'), ('column', 'x', 'i'), ('column', 'y', 'j')) v(k, q, n)""",
    "lin3_layers": """SELECT s_suppkey AS query_no, l AS layer_order, replace(d, '?', s_suppkey::VARCHAR) AS "databaseName", t AS "tableName", ta AS "tableAliasName", c AS "columnName", a AS "aliasName", r AS remarks FROM supplier,
(VALUES (1, 'd?', 't', 's', 'col_a', 'x', 'column_selected_with_database'), (2, '', 's', 's', 'col_a', 'x', 'Inner Query Alias Layer'), (3, 'd?', 't', 's', 'col_a', 'x', 'Subquery Layer'), (1, 'd?', 't', '', 'col_a', '', 'column_selected_with_database')) v(l, d, t, ta, c, a, r)""",
    "lin3_joins": """SELECT s_suppkey AS query_no, 'LEFT' AS join_type, 'e' AS "databaseName", 'u' AS "tableName", 'x.i = y.j' AS condition FROM supplier""",
    "lin3_status": "SELECT s_suppkey AS query_no, 'failed' AS status FROM supplier",
    "edge_many": """SELECT s_suppkey AS query_no, replace(a, '?', s_suppkey::VARCHAR) AS source_db, b AS source_table, c AS source_column, d AS target_db, e AS target_table, f AS target_column, g AS edge_type, 'success' AS status FROM supplier,
(VALUES ('d?', 't', 'a', 'f', 'g', 'x', 'column'), ('d?', 't', 'b', 'f', 'g', 'y', 'column'), ('static', 'static_value', '5', 'f', 'g', 'y', 'static'), ('e', 'u', 'c', 'dummy', 'dummy_table', 'z', 'column'), ('static', 'static_value', 'v', 'dummy', 'dummy_table', 'z', 'static')) v(a, b, c, d, e, f, g)""",
    "edge_literals": f"""SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY o) - 1)::INT AS ordinal, 'static' AS source_db, 'static_value' AS source_table, v AS source_column, 'z' AS target_table, col AS target_column, 'static' AS edge_type
  FROM (SELECT p_partkey, o, v, 'k' AS col FROM part JOIN (VALUES {LITERAL_ROWS}) x(k, o, v) ON p_partkey % {len(LITERALS)} = k UNION ALL SELECT p_partkey, 100, p_size::VARCHAR, 'n' FROM part)""",
    "edge_ambiguous": f"SELECT p_partkey, t AS source_table, 'success' AS status, a AS ambiguous FROM part JOIN (VALUES {PLACE_ROWS}) x(k, t, a) ON p_partkey % {len(PLACES)} = k",
    "edge_status": "SELECT p_partkey, ['EMPTY', 'non_sql', 'map_skipped', 'lineage_failed', 'success'][p_size % 5 + 1] AS status, false AS ambiguous FROM part",
    "edge_extract": """SELECT CASE WHEN n_nationkey % 2 = 1 THEN upper(n_name) || '__CREATE__0' WHEN i = 0 THEN upper(n_name) || '__CREATE__0' ELSE 'K' END AS query_key, 'select ' || CASE WHEN n_nationkey % 2 = 1 THEN 3 ELSE i + 1 END AS sql
FROM nation, (VALUES (0), (1)) x(i) WHERE n_nationkey % 2 = 0 OR i = 0""",
}


def corpus_rows() -> str:
    """The hand-made rows of all templates for each part, as r(rule, databaseName, tableName, columnName)."""
    rows = ", ".join("(" + ", ".join(quoted(x) for x in (rule, r[0], r[1], r[3])) + ")" for rule, (_, found) in TEMPLATES.items() for r in found)
    fill = lambda c: f"replace({c}, '{{k}}', p_partkey::VARCHAR)"
    return f"""WITH r AS (SELECT rule, {fill('a')} AS "databaseName", {fill('b')} AS "tableName", {fill('c')} AS "columnName" FROM part, (VALUES {rows}) v(rule, a, b, c)) """


def dialect_calls() -> str:
    values = ", ".join(f"({i}, {quoted(made)})" for i, (_, made) in enumerate(CALL_CASES))
    return f"SELECT p_partkey, replace('SELECT ' || made || ' AS c FROM t', '{{k}}', p_partkey::VARCHAR) AS spark_sql FROM part JOIN (VALUES {values}) v(i, made) ON p_partkey % {len(CALL_CASES)} = i"


LETTERS = "translate(n_nationkey::VARCHAR, '0123456789', 'ABCDEFGHIJ')"
ORACLES |= {
    "lin_corpus": corpus_rows() + 'SELECT "databaseName", "tableName", count(*) AS n_rows, count(DISTINCT "columnName") AS n_columns FROM r GROUP BY 1, 2',
    "lin_summary": corpus_rows() + 'SELECT count(*) AS n_rows, count(DISTINCT "databaseName") AS n_databases, count(DISTINCT "tableName") AS n_tables, count(DISTINCT "columnName") AS n_columns FROM r',
    "lin_counts": corpus_rows() + """SELECT rule, count(*) AS n_rows, count(*) FILTER ("databaseName" = '') AS n_no_database FROM r GROUP BY 1""",
    "dialect_calls": dialect_calls(),
    "match_registry": f"""SELECT 'r' || n_regionkey AS key, p || {LETTERS} AS "mapperColumn", f AS "mapperFactField", CASE WHEN hit THEN lower(p || {LETTERS}) ELSE '' END AS "columnName",
  CASE WHEN hit THEN '100.0%' ELSE '0.0%' END AS "matchPercentage", CASE WHEN hit THEN 'exact' ELSE 'no_match' END AS "matchType"
FROM (SELECT *, p = 'Q' AND n_nationkey % 2 = 0 AS hit FROM nation, (VALUES ('Q', 'f'), ('W', 'g')) v(p, f))""",
    "match_registry_summary": "SELECT n_regionkey::VARCHAR AS key, count(*) AS total, count(*) FILTER (n_nationkey % 3 <> 1) AS matched, count(*) FILTER (n_nationkey % 3 = 1) AS no_match FROM nation GROUP BY 1",
    "src_http_guard_rows": """SELECT c_custkey, CASE WHEN ok THEN 200 ELSE 403 END::INT AS status, CASE WHEN ok THEN 'ok' END AS body
FROM (SELECT c_custkey, c_custkey % 3 <> 0 AND c_custkey % 8 IN (0, 7) AS ok FROM customer)""",
    "edge_meta": """SELECT 'K' || n_nationkey AS query_key, 'd' || n_nationkey AS source_db, 't' AS source_table, 'a' AS source_column, 'f' AS target_db, 'g' AS target_table, 'x' AS target_column, 'column' AS edge_type, 'success' AS status FROM nation
UNION ALL SELECT 'L' || n_nationkey, 'static', 'static_value', '7', 'dummy', 'dummy_table', 'y', 'static', 'success' FROM nation WHERE n_nationkey % 3 = 0""",
    "edge_odd": "SELECT p_partkey, p_partkey % 6 = 0 AS read FROM part",
    "src_upload": "SELECT n_nationkey::INT AS n_nationkey, n_name, NULL::VARCHAR AS error FROM nation",
    "src_sql_file": "SELECT true AS keyed, 'SELECT a FROM d.t' || n_nationkey AS sql FROM nation",
    "src_inline": "SELECT r_regionkey::INT AS r_regionkey, r_name, CASE WHEN r_regionkey = 0 THEN 'AFRICA' END AS wanted FROM region WHERE r_regionkey < 2",
    "src_log_lines": """SELECT c_mktsegment AS segment, 0::BIGINT AS line_no, c_mktsegment AS line FROM customer GROUP BY c_mktsegment
UNION ALL SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey), c_custkey::VARCHAR FROM customer""",
    "lin_trace_odd": """SELECT s_suppkey AS query_no, a AS "databaseName", b AS "tableName", c AS "columnName", o AS "aliasName", r AS remarks, 'success' AS status FROM supplier JOIN
(VALUES (0, '', '', 'a', 'o', 'invalid_table_alias'), (1, '', 's', 'q', 'o', 'via_subquery:s|subquery_output_column_not_found'), (2, '', '', 'a', 'o', 'table_name_ambiguous'), (3, 'd', 't', 'a', 'o', 'via_subquery:s'),
(4, 'd', 't', 'a', 'b', 'via_subquery:s'), (4, 'd', 't', 'c', 'h', 'via_subquery:s'), (4, 'd', 't', 'g', 'h', 'via_subquery:s'), (5, 'd', 't', '*', '*', 'via_subquery:c'), (5, 'e', 'u', 'i', 'i', 'via_subquery:c')) v(k, a, b, c, o, r) ON s_suppkey % 6 = k""",
    "lin_star_dive": """SELECT s_suppkey AS query_no, l AS layer_order, 's' AS "tableAliasName", c AS "columnName", a AS "aliasName", CASE l WHEN 2 THEN 'Inner Query Alias Layer' ELSE 'Subquery Layer' END AS remarks FROM supplier JOIN
(VALUES (0, 2, '*', ''), (0, 3, 'a', 'a'), (0, 3, 'c', 'c'), (1, 2, 'cust', 'x'), (1, 3, 'cust_name', 'x')) v(k, l, c, a) ON s_suppkey % 2 = k""",
}


def feeder() -> str:
    """The feeder's columns written out."""
    yes = lambda test, name: f"CASE WHEN {test} THEN 'Y' ELSE 'N' END AS {name}"
    columns = [
        "'rec_' || l_orderkey || '_' || l_linenumber AS record_id", "'LINES' AS source_system", "7::INT AS batch",
        "CASE l_returnflag WHEN 'R' THEN 'MASKING' WHEN 'A' THEN 'NON_MASKING' ELSE 'OPEN' END AS reporting_type", "CASE l_linestatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' END AS status",
        "l_linenumber = 1 AS is_first", "upper(l_linestatus) AS mode", "substr(l_shipdate::VARCHAR, 1, 10) AS ship_day", "l_extendedprice::DOUBLE AS amount", "upper(l_linestatus || '/' || l_returnflag || 'x') AS label",
        *[f"substr(l_partkey::VARCHAR, {k}, 1) AS part_{k}" for k in range(1, 6)], *[yes(f"l_returnflag = '{m}'", f"flag_{m.lower()}") for m in "RAN"],
        *[yes(f"l_linenumber = {k}", f"line_{k}") for k in range(1, 8)], *[f"'c{k}' AS constant_{k}" for k in range(1, 9)], *[f"'{k}:' || l_suppkey AS key_{k}" for k in range(1, 8)],
        *[f"l_{c} AS raw_{c}" for c in ("orderkey", "linenumber", "partkey", "suppkey", "returnflag", "linestatus")],
    ]
    return "SELECT " + ", ".join(columns) + " FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_linenumber IN (1, 2, 3, 5) AND l_suppkey IS NOT NULL"


ORACLES |= {
    "recon_feeder": feeder(),
    "src_http_pages": """SELECT c_custkey, 'https://a.example.org/' || c_custkey AS url, CASE WHEN c_custkey % 10 = 7 THEN 404 ELSE 200 END::INT AS status,
  CASE WHEN c_custkey % 10 <> 7 THEN c_custkey::VARCHAR END AS n, CASE WHEN c_custkey % 10 = 7 THEN 'none' END AS error FROM customer""",
    "snk_ordered": "SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1 AS order_no FROM customer",
}


def by_shape(columns: list[str], rows: list[tuple], shapes: int, text: str = "FROM supplier") -> str:
    """Rows (shape, values...) for the suppliers whose number has that remainder; ? stands for the number."""
    values = ", ".join(f"({r[0]}, " + ", ".join(map(quoted, r[1:])) + ")" for r in rows)
    names = [f"c{i}" for i in range(len(columns))]
    shown = ", ".join(f"replace({n}, '?', s_suppkey::VARCHAR) AS \"{c}\"" for n, c in zip(names, columns, strict=True))
    return f"SELECT s_suppkey AS query_no, {shown} {text} JOIN (VALUES {values}) v(k, {', '.join(names)}) ON s_suppkey % {shapes} = k"


FULL, BLANK, AMBIGUOUS, CALL = "column_selected_with_database", "database_not_specified_in_query", "table_name_ambiguous", "derived_expression|function_expression"
ISLANDS = [
    (0, "d?", "t", "x1", FULL), (0, "unknown", "unknown", "COL_ONE", AMBIGUOUS), (0, "e", "u", "y", FULL), (0, "d?", "t", "i", FULL), (0, "e", "u", "i", FULL),
    (1, "unknown", "z", "q", AMBIGUOUS), (1, "d?", "t", "VALUE_A", FULL), (4, "s", "t", "c", FULL), (4, "unknown", "q", "v", AMBIGUOUS), (4, "unknown", "unknown", "AMOUNT", AMBIGUOUS),
    (5, "d?", "t", "p.q", FULL), (5, "d?", "t", "LEFT_SIDE", FULL),
]
PLACES = ["databaseName", "tableName", "columnName", "remark"]
ORACLES |= {
    "lin3_refs_bare": by_shape(PLACES, [r for r in ISLANDS if r[3].isupper()], 7),
    "lin3_fallback": by_shape([*PLACES, "status"], [(*r, "recovered") for r in ISLANDS] + [(2, "N/A", "N/A", "N/A", "empty query", "placeholder"), (3, "ERROR", "ERROR", "ERROR", "tech_failure", "failed")], 7),
    "lin_no_input_ctx": by_shape(
        ["databaseName", "tableName", "tableAliasName", "columnName", "aliasName", "remarks"],
        [
            (0, "d?", "t", "x", "now()", "n", CALL), (0, "d?", "t", "x", "a", "", FULL), (1, "d?", "t", "s", "n", "", FULL), (1, "d?", "t", "", "date_format(now(), 'yyyy')", "n", CALL),
            (2, "d", "t", "x", "?", "k", "derived_expression"), (2, "d", "t", "x", "'v'", "w", "derived_expression"), (3, "", "", "q", "n", "", BLANK), (3, "", "__DERIVED__", "q", "uuid()", "n", CALL),
            (3, "d", "t", "x", "a", "", FULL), (4, "e?", "u", "main", "now()", "n", CALL),
        ], 5),
}
