"""Statement templates per lineage rule, with the rows that each must give, worked out by hand.

``{k}`` stands for a number, so that a table of numbers makes a corpus of any
size.  A row is (database, table, table alias, column, alias, remarks joined by |).
"""

from __future__ import annotations

DB, NO = "column_selected_with_database", "database_not_specified_in_query"
DER, FUN, CASE = "derived_expression", "function_expression", "case_expression"
W, G, H, ON = "where_clause_column", "group_by_column", "having_clause_column", "join_on_clause_column"
ALL, BAD, AMB, DT = "all_columns_selected", "invalid_table_alias", "table_name_ambiguous", "table_name_derived"
FIRST = ("d{k}", "t", "")

TEMPLATES: dict[str, tuple[str, list[tuple[str, str, str, str, str, str]]]] = {
    "lin_parse": ("SELECT (", [("", "", "", "", "", "tech_failure")]),
    "lin_direct": ("SELECT a, b AS x FROM d{k}.t", [(*FIRST, "a", "", DB), (*FIRST, "b", "x", DB)]),
    "lin_direct_no_db": ("SELECT Colum FROM Tab{k} T1", [("", "tab{k}", "t1", "colum", "", NO)]),
    "lin_alias_blank": ("SELECT t.a FROM d{k}.t t", [(*FIRST, "a", "", DB)]),
    "lin_scope_global": ("SELECT x.a, y.b FROM d{k}.t x, e.u y", [("d{k}", "t", "x", "a", "", DB), ("e", "u", "y", "b", "", DB)]),
    "lin_scope_local": (
        "SELECT a FROM d{k}.t UNION ALL SELECT b FROM e.u", [(*FIRST, "a", "", DB), ("e", "u", "", "b", "", DB)]),
    "lin_invalid_alias": ("SELECT z.a FROM d{k}.t x, e.u y", [("", "", "z", "a", "", BAD)]),
    "lin_ambiguous": ("SELECT a FROM d{k}.t x, e.u y", [("", "", "", "a", "", AMB)]),
    "lin_star": ("SELECT * FROM d{k}.t", [(*FIRST, "*", "", ALL)]),
    "lin_qstar": ("SELECT x.* FROM d{k}.t x", [("d{k}", "t", "x", "*", "", f"{ALL}|{DB}")]),
    "lin_derived": ("SELECT nvl(a, b) AS c FROM d{k}.t", [(*FIRST, "a", "c", DER), (*FIRST, "b", "c", DER)]),
    "lin_case": (
        "SELECT CASE WHEN a > 1 THEN b ELSE 0 END AS c FROM d{k}.t",
        [(*FIRST, "a", "c", f"{CASE}|{DER}|table name Derived"), (*FIRST, "b", "c", f"{CASE}|{DER}|table name Derived")]),
    "lin_func_only": ("SELECT now() AS n, 5 AS five, count(*) AS c FROM d{k}.t", [("", "", "", "now()", "n", f"{DER}|{FUN}"), ("", "", "", "count(*)", "c", f"{DER}|{FUN}")]),
    "lin_where": ("SELECT a FROM d{k}.t WHERE b = 1 AND c IS NOT NULL", [(*FIRST, "a", "", DB), (*FIRST, "b", "", W), (*FIRST, "c", "", W)]),
    "lin_group": ("SELECT a, sum(b) AS s FROM d{k}.t GROUP BY a", [(*FIRST, "a", "", DB), (*FIRST, "b", "s", DER), (*FIRST, "a", "", G)]),
    "lin_having": (
        "SELECT a FROM d{k}.t GROUP BY a HAVING max(b) > 3", [(*FIRST, "a", "", DB), (*FIRST, "a", "", G), (*FIRST, "b", "", H)]),
    "lin_clause_resolve": ("SELECT x.a FROM d{k}.t x, e.u y WHERE z.c = 1", [("d{k}", "t", "x", "a", "", DB), ("", "", "z", "c", "", f"{BAD}|{W}")]),
    "lin_join_on": (
        "SELECT x.a FROM d{k}.t x JOIN e.u y ON x.i = y.j",
        [("d{k}", "t", "x", "a", "", DB), ("d{k}", "t", "x", "i", "", f"{ON}|join_type:INNER"), ("e", "u", "y", "j", "", f"{ON}|join_type:INNER")]),
    "lin_join_eq": (
        "SELECT x.a FROM d{k}.t x JOIN e.u y ON x.i = y.i AND x.v > 3",
        [("d{k}", "t", "x", "a", "", DB), ("d{k}", "t", "x", "i", "", f"{ON}|join_type:INNER"), ("e", "u", "y", "i", "", f"{ON}|join_type:INNER"),
         ("d{k}", "t", "x", "v", "", f"{ON}|join_type:INNER")]),
    "lin_join_type": (
        "SELECT x.a FROM d{k}.t x LEFT OUTER JOIN e.u y ON x.i = y.j FULL JOIN f.v z ON z.m = x.n",
        [("d{k}", "t", "x", "a", "", DB), ("d{k}", "t", "x", "i", "", f"{ON}|join_type:LEFT"), ("e", "u", "y", "j", "", f"{ON}|join_type:LEFT"),
         ("f", "v", "z", "m", "", f"{ON}|join_type:FULL"), ("d{k}", "t", "x", "n", "", f"{ON}|join_type:FULL")]),
    "lin_join_sub_where": (
        "SELECT x.a FROM d{k}.t x JOIN (SELECT i FROM e.u WHERE r = 1) y ON x.i = y.i",
        [("d{k}", "t", "x", "a", "", DB), ("d{k}", "t", "x", "i", "", f"{ON}|join_type:INNER"), ("e", "u", "y", "i", "", f"{ON}|join_type:INNER"),
         ("", "u", "y", "r", "", "join_subquery_where_column|join_type:INNER"), ("e", "u", "", "i", "", DB)]),
    "lin_base_table": ("SELECT s.a FROM (SELECT a FROM d{k}.t) s", [("d{k}", "t", "s", "a", "", DB), (*FIRST, "a", "", DB)]),
    "lin_dataset": ("SELECT * FROM (SELECT a FROM d{k}.t) s", [("d{k}", "t", "s", "*", "", f"{ALL}|{DT}"), ("d{k}", "t", "s", "*", "", ALL), (*FIRST, "a", "", DB)]),
    "lin_cte_chain": (
        "WITH c1 AS (SELECT a FROM d{k}.t), c2 AS (SELECT a FROM c1) SELECT a FROM c2",
        [(*FIRST, "a", "", DB), ("d{k}", "t", "c1", "a", "", DB), ("d{k}", "t", "c2", "a", "", DB)]),
    "lin_union": (
        "WITH c AS (SELECT a FROM d{k}.t) SELECT a FROM c UNION SELECT b FROM e.u",
        [(*FIRST, "a", "", DB), ("d{k}", "t", "c", "a", "", DB), ("e", "u", "", "b", "", DB)]),
    "lin_set_ops": ("SELECT a FROM d{k}.t INTERSECT SELECT b FROM d{k}.t EXCEPT SELECT c FROM d{k}.t", [(*FIRST, "a", "", DB), (*FIRST, "b", "", DB), (*FIRST, "c", "", DB)]),
    "lin_nested": (
        "SELECT a FROM d{k}.t WHERE b IN (SELECT c FROM d{k}.t WHERE e = 1)",
        [(*FIRST, "a", "", DB), (*FIRST, "b", "", W), (*FIRST, "c", "", W), (*FIRST, "e", "", W), (*FIRST, "c", "", DB)]),
    "lin_window": (
        "SELECT sum(v) OVER (PARTITION BY p ORDER BY o DESC) AS s FROM d{k}.t", [(*FIRST, "v", "s", DER), (*FIRST, "p", "s", DER), (*FIRST, "o", "s", DER)]),
    "lin_dml": ("UPDATE d{k}.t SET a = b WHERE c = 1", [(*FIRST, "a", "", "update_set_column"), (*FIRST, "b", "", "update_set_column"), (*FIRST, "c", "", W)]),
    "lin_insert": ("INSERT INTO f.g SELECT a FROM d{k}.t", [(*FIRST, "a", "", DB)]),
    "lin_double_alias": ("SELECT q.a FROM d{k}.t q r WHERE q.b = 2", [("d{k}", "t", "q", "a", "", DB), ("d{k}", "t", "q", "b", "", W)]),
    "lin_quoted_alias": ("SELECT a AS 'k:id' FROM d{k}.t", [(*FIRST, "a", "k:id", DB)]),
    "lin_order_by": ("SELECT a FROM d{k}.t ORDER BY b LIMIT 5", [(*FIRST, "a", "", DB)]),
}
