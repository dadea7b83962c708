"""Queries over the driver's tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.python import SplitColumns, SplitStatements, decode_lenient_udf, percent_udf, ratio_udf
from .operators import dq, extract, logs, match, metadata, nosql, recon
from .plans import edges, layers, lineage, recover
from .plans.corpus import TEMPLATES
from .shared import new_folder
from .sources import files, http, http_pages, ordered, sinks
from .streaming import blocks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all tasks: for work per row that the bytes of a table don't tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


# -- data quality


@query
def dq_null_counts(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    return dq.null_counts(docs.join(labels, "doc_id", "left").select("doc_id", "quality", "toxic"))


@query
def dq_duplicates(spark, d):
    return dq.duplicates(table(spark, d, "documents").select("text", "lang"))


@query
def dq_range(spark, d):
    return dq.out_of_range(table(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(1)).alias("p_size")), "p_size", 5, 45)


@query
def dq_pattern(spark, d):
    return dq.pattern_violations(table(spark, d, "part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#11")).alias("p_brand")), "p_brand", "Brand#[1-3]")


@query
def dq_domain(spark, d):
    return dq.domain_violations(table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus")), "o_orderstatus", ["O"])


@query
def dq_run_checks(spark, d):
    rules = {"columns": {"p_size": {"min": 5, "max": 45}, "p_brand": {"pattern": "Brand#[1-3]"}, "p_type": {"allowed": ["ECONOMY"]}, "age": {"min": 1}}}
    found = dq.run_checks(table(spark, d, "part"), rules)
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n") for name, df in sorted(found.items())]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# -- reconciliation


def _positions(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_custkey").cast("string").alias("uitid"), F.pmod("o_orderkey", F.lit(4)).cast("int").alias("version"), F.col("o_orderpriority").alias("break_type"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit("_202501010")).alias("tsr_msg_id"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("break_status"),
    )


def _submissions(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    sent = o.select(
        F.col("o_orderkey").cast("string").alias("reghub_id"), F.col("o_custkey").cast("string").alias("keys_uitid"), F.pmod(F.col("o_orderkey") + F.col("o_custkey"), F.lit(4)).cast("int").alias("version"),
        F.element_at(F.array(*map(F.lit, ["ACK", "NACK", "NON_REPORTABLE"])), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int")).alias("state_status"), F.col("o_orderdate").alias("sent"),
    )
    return recon.load_rank(sent, ["keys_uitid"], [F.desc("sent"), F.desc(F.col("reghub_id").cast("long"))], "reg_ranking")


@query
def recon_classify(spark, d):
    return recon.classify(_positions(spark, d), _submissions(spark, d))


@query
def recon_extract(spark, d):
    o = recon.extract(table(spark, d, "orders"), {"o_orderstatus": ["O", "P"]})
    return o.select(
        F.concat(F.lit("rhoo_"), F.col("o_orderkey").cast("string"), F.nvl("o_orderpriority", F.lit(""))).alias("id"),
        F.when(F.col("o_orderstatus") == "O", "MASKING").when(F.col("o_orderstatus") == "P", "NON_MASKING").alias("reporting_type"), F.col("o_totalprice").alias("amount"),
    )


#: A feeder over order lines as data, with columns in the shapes that feeders have.
FEEDER = extract.Extract(
    rules=[
        extract.Rule("record_id", parts=["=rec_", "l_orderkey", "=_", "l_linenumber"]), extract.Rule("source_system", value="LINES"), extract.Rule("batch", value=7, kind="int"),
        extract.Rule("reporting_type", arms=[("l_returnflag", "R", "MASKING"), ("l_returnflag", "A", "NON_MASKING")], default="OPEN"),
        extract.Rule("status", arms=[("l_linestatus", "O", "open"), ("l_linestatus", "F", "closed")]), extract.Rule("is_first", arms=[("l_linenumber", 1, True)], default=False),
        extract.Rule("mode", column="l_linestatus", upper=True, default="NONE"), extract.Rule("ship_day", column="l_shipdate", cut=(1, 10)), extract.Rule("amount", column="l_extendedprice", kind="double"),
        extract.Rule("label", parts=["l_linestatus", "=/", "l_returnflag", "=x"], upper=True),
        *[extract.Rule(f"part_{k}", column="l_partkey", kind="string", cut=(k, 1)) for k in range(1, 6)], *[extract.Rule(f"flag_{m.lower()}", arms=[("l_returnflag", m, "Y")], default="N") for m in "RAN"],
        *[extract.Rule(f"line_{k}", arms=[("l_linenumber", k, "Y")], default="N") for k in range(1, 8)], *[extract.Rule(f"constant_{k}", value=f"c{k}") for k in range(1, 9)],
        *[extract.Rule(f"key_{k}", parts=[f"={k}:", "l_suppkey"]) for k in range(1, 8)], *[extract.Rule(f"raw_{c}", column=f"l_{c}") for c in ("orderkey", "linenumber", "partkey", "suppkey", "returnflag", "linestatus")],
    ],
    among={"l_returnflag": ["R", "A"], "l_linenumber": [1, 2, 3, 5]}, present=["l_suppkey"],
)


@query
def recon_feeder(spark, d):
    return extract.run_extract(table(spark, d, "lineitem"), FEEDER)


@query
def recon_latest(spark, d):
    return recon.latest(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], [F.desc("ts"), F.desc("event_id")])


@query
def recon_load_rank(spark, d):
    return recon.load_rank(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate")])


@query
def recon_running_sum(spark, d):
    e = table(spark, d, "events")
    return recon.running_sum(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "click", 1).otherwise(0), "running").select("event_id", F.col("running").cast("long").alias("running"))


@query
def recon_rank(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    w = Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"))
    return o.select("o_orderkey", F.rank().over(w).alias("price_rank"), F.count(F.lit(1)).over(Window.partitionBy("o_orderstatus")).alias("n_status"))


@query
def recon_rank_spread(spark, d):
    """As recon_rank, with three statuses that hold all rows, by counts and chunks instead of windows over them."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", (-F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    ranked = recon.rank_of(o, ["o_orderstatus"], "cents", "price_rank", chunk=100_000)
    return recon.total_of(ranked, ["o_orderstatus"], F.count(F.lit(1)), "n_status").select("o_orderkey", "price_rank", "n_status")


# -- metadata


def _payloads(spark, d) -> DataFrame:
    """One catalogue record per part, its queries in base64, as JSON text."""
    p = spread(table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_name"))
    sql = T.b64_encode(F.concat(F.lit("SELECT a FROM db.t"), F.col("p_partkey").cast("string")))
    record = F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("regulation"),
        F.struct(F.col("p_type").alias("classname"), F.array(F.struct(F.col("p_name").alias("view_name"), sql.alias("sql_query"))).alias("create_query")).alias("value"),
    )
    single = F.to_json(record)
    wrapped = F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.concat(F.lit('{"metadataList":['), single, F.lit("]}"))).when(F.pmod("p_partkey", F.lit(3)) == 1, F.concat(F.lit("["), single, F.lit("]"))).otherwise(single)
    return p.select("p_partkey", wrapped.alias("payload"))


def _flat(spark, d) -> DataFrame:
    return metadata.flatten(metadata.records(_payloads(spark, d)))


@query
def meta_flatten(spark, d):
    return _flat(spark, d).select("name", "regulation", "classname", "kind", "view_name", "sql")


@query
def meta_filter(spark, d):
    return metadata.filter_records(_flat(spark, d), regulation="Brand#11", classname=None).select("name", "regulation", "classname")


@query
def meta_filter_view(spark, d):
    flat = _flat(spark, d).withColumn("classname", F.when(F.col("regulation") == "Brand#12", "").otherwise(F.col("classname")))
    return metadata.filter_records(flat, lenient=True, classname=["ECONOMY ANODIZED STEEL", "PROMO", "SMALL"]).select("name", "classname")


@query
def meta_class_by_reg(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("regulation"), F.col("p_type").alias("classname"))
    return metadata.class_by_regulation(p, "Brand#11", ["p_partkey"])


@query
def meta_json_walk(spark, d):
    nested = _payloads(spark, d).select(F.concat(F.lit('{"outer":{"inner":['), "payload", F.lit("]}}")).alias("payload"))
    return metadata.walk(nested).select("name", "classname", "view_name", "sql_query")


@query
def meta_json_walk_deep(spark, d):
    """Queries under as many lists and objects as the part's size says, named by the nearest object around them that has a name."""
    p = spread(table(spark, d, "part").select("p_partkey", "p_size"))
    k = F.col("p_partkey").cast("string")
    inner = F.concat(F.lit('{"name":"'), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("own"), k)).otherwise(""), F.lit('","view_name":"v'), k, F.lit('","sql_query":null,"note":7}'))
    outer = F.concat(F.lit('{"classname":"c'), k, F.lit('","name":"far","x":{"name":"near'), k, F.lit('","list":[1,'), F.repeat(F.lit('[{"a":'), F.col("p_size")), inner, F.repeat(F.lit("}]"), F.col("p_size")), F.lit("]}}"))
    return metadata.walk(p.select(F.when(F.col("p_partkey") % 10 == 9, F.concat(F.lit("["), outer)).otherwise(outer).alias("payload")))


def _branches(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("u"), "props", "ts")
    middle = F.pmod("event_id", F.lit(2))
    made = e.select("event_id", "u", "props", middle.alias("half"))
    return tuple(metadata.snapshot(made.where(F.col("half") == h), "u", "props", ["event_id"]) for h in (1, 0))


@query
def meta_diff(spark, d):
    return metadata.diff(*_branches(spark, d))


@query
def meta_count(spark, d):
    return metadata.counts(table(spark, d, "nation").select(F.col("n_name").alias("name"))).select("total_records", F.array_join("names", ",").alias("names"))


@query
def meta_registry_upsert(spark, d):
    p = table(spark, d, "part")
    rows = p.select(metadata.registry_id(F.col("p_brand"), F.col("p_name"), F.col("p_type")).alias("id"), "p_partkey", F.lit("new").alias("status")).dropDuplicates(["id"]).drop("p_partkey")
    registry = recon.latest(p.select(metadata.registry_id(F.col("p_brand"), F.col("p_name"), F.col("p_type")).alias("id"), F.when(F.col("p_size") > 25, "approved").otherwise("rejected").alias("status"), "p_size", "p_partkey"), ["id"], ["p_partkey"])
    return metadata.upsert(registry.where("p_size <= 40").select("id", "status"), rows)


@query
def lin_na_filter(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") < 10, "N/A").otherwise("db").alias("a"), F.when(F.col("p_size") < 20, "N/A").otherwise("t").alias("b"))
    return metadata.na_filter(p, ["a", "b"])


# -- functions

#: Impala expressions and the Spark ones that stand for them, worked out by hand; {k} is a number.
CALL_CASES = [
    ("DATEADD(day, abs({k}), greatest(d, e))", "DATE_ADD(greatest(d, e), abs({k}))"),
    ("DATESUB(f(a, b), {k})", "DATE_SUB(f(a, b), {k})"),
    ("appx_median(g(x, {k}))", "percentile_approx(g(x, {k}), 0.5)"),
    ("group_concat(DISTINCT h(a, b), ';')", "concat_ws(';', collect_set(h(a, b)))"),
    ("group_concat(a || ',' || {k})", "concat_ws(',', collect_list(a || ',' || {k}))"),
    ("group_concat(a, '(')", "concat_ws('(', collect_list(a))"),
    ("PERCENTILE_CONT(0.{k}) WITHIN GROUP (ORDER BY abs(p)) OVER ()", "PERCENTILE(abs(p), 0.{k})"),
    ("ndv(len(isnull(a, 'now()')))", "approx_count_distinct(length(nvl(a, 'now()')))"),
    ("getdate() + INTERVAL {k} MONTHS", "CURRENT_TIMESTAMP + INTERVAL {k} MONTH"),
    ("TIMESTAMP '2024-01-01 00:00:00' /*+ hint */", "TIMESTAMP('2024-01-01 00:00:00') "),
    ("current_time() /* isnull( */", "CURRENT_TIMESTAMP /* isnull( */"),
    ("lengthy(a, {k})", "lengthy(a, {k})"),
]


def _names(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_brand", F.regexp_replace(F.concat_ws("_", "p_name", "p_brand", F.lit("ID")), "[^A-Za-z0-9_ ]", "").alias("s"))


@query
def fn_norm(spark, d):
    return _names(spark, d).select("p_partkey", T.norm(F.col("s")).alias("norm"))


@query
def fn_tokens(spark, d):
    return _names(spark, d).select("p_partkey", F.array_join(F.array_sort(T.token_array(F.col("s"))), ",").alias("tokens"))


@query
def fn_overlap(spark, d):
    return _names(spark, d).select("p_partkey", T.overlap(F.col("s"), F.concat(F.lit("brand_key_"), F.col("p_brand"))).alias("meets"))


@query
def fn_ratio(spark, d):
    pairs = _names(spark, d).select("p_partkey", T.norm(F.col("s")).alias("a"), T.norm(F.col("p_brand")).alias("b"))
    scored = pairs.select("a", "b").distinct().withColumn("ratio", ratio_udf("a", "b"))
    return pairs.join(scored, ["a", "b"]).select("p_partkey", "ratio", percent_udf("ratio").alias("percent"))


@query
def fn_ratio_sized(spark, d):
    """Of a name and a longer one that holds it, so that the ratio follows from the lengths."""
    n = table(spark, d, "part").select("p_partkey", T.norm(F.col("p_name")).alias("a"), T.norm(F.concat_ws("_", "p_brand", "p_name", "p_type")).alias("b"))
    scored = n.select("a", "b").distinct().withColumn("ratio", ratio_udf("a", "b"))
    return n.join(scored, ["a", "b"]).select("p_partkey", "ratio", percent_udf("ratio").alias("percent"))


@query
def fn_b64(spark, d):
    c = table(spark, d, "customer")
    coded = F.translate(F.regexp_replace(T.b64_encode(F.col("c_name")), "=+$", ""), "+/", "-_")
    return c.select("c_custkey", T.b64_decode(coded).alias("plain"), T.b64_or_raw(F.concat(F.lit("select *, "), F.col("c_name"))).alias("raw"), T.b64_strict(T.b64_encode(F.substring("c_name", 1, 3))).alias("short"), T.b64_encode(F.col("c_mktsegment")).alias("coded"))


@query
def fn_b64_lenient(spark, d):
    return table(spark, d, "customer").select("c_custkey", decode_lenient_udf(T.b64_encode(F.col("c_name"))).alias("plain"))


def _sql_texts(spark, d) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("SELECT ndv(a), len(b) -- note "), k, F.lit("\nFROM t /* x\ny */ WHERE d = '#START_DATE#' AND now() > DATE '2024-01-01';  SELECT isnull(c, ';') FROM u OFFSET 5 ROWS"))
    return table(spark, d, "part").select("p_partkey", text.alias("sql"))


@query
def fn_clean_sql(spark, d):
    return _sql_texts(spark, d).select("p_partkey", T.clean_sql(F.col("sql")).alias("clean"))


@query
def fn_params(spark, d):
    return _sql_texts(spark, d).select("p_partkey", T.fill_parameters(F.col("sql"), {"#START_DATE#": "20240101"}).alias("filled"))


@query
def fn_split_stmts(spark, d):
    return _sql_texts(spark, d).lateralJoin(SplitStatements(F.col("sql").outer())).select("p_partkey", "ordinal", F.regexp_replace("statement", r"\s+", " ").alias("statement"))


@query
def fn_split_cols(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("a, f(b, c) AS x, 'q,r' || "), F.col("p_partkey").cast("string")).alias("c"))
    return p.lateralJoin(SplitColumns(F.col("c").outer())).select("p_partkey", "ordinal", "item")


@query
def fn_tsr_strip(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.strip_suffix(F.concat(F.col("o_orderkey").cast("string"), F.lit("_202501010"))).alias("id"))


def _dotted(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    pieces = F.when(k % 3 == 0, F.concat_ws(".", F.lit("a"), F.lit("b"), "p_brand")).when(k % 3 == 1, F.concat_ws(".", F.lit("a"), "p_brand")).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", pieces.alias("s"))


@query
def fn_parse_table(spark, d):
    return _dotted(spark, d).select("p_partkey", T.table_parts(F.col("s")).alias("t")).select("p_partkey", "t.db", "t.schema", "t.table")


@query
def fn_parse_entity(spark, d):
    return _dotted(spark, d).select("p_partkey", T.entity_parts(F.col("s")).alias("t")).select("p_partkey", "t.db", "t.table", "t.column")


@query
def fn_remark_rule(spark, d):
    p = table(spark, d, "part")
    kind = F.element_at(F.array(*map(F.lit, ["map", "window", "derived", "constant", "column"])), (F.col("p_size") % 5 + 1).cast("int"))
    return p.select("p_partkey", T.remark_rule(F.when(F.col("p_size") > 25, "db").otherwise(""), F.lit("t"), F.lit(1), kind).alias("remark"))


@query
def dialect_rewrite(spark, d):
    return _sql_texts(spark, d).select("p_partkey", T.to_spark_sql(F.col("sql")).alias("spark_sql"))


@query
def dialect_calls(spark, d):
    """Every rule of the rewrite once, around nested calls, quotes and comments."""
    k = F.col("p_partkey").cast("string")
    texts = [f"SELECT {a} AS c FROM t" for a, _ in CALL_CASES]
    sql = F.replace(F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % len(texts) + 1).cast("int")), F.lit("{k}"), k)
    return table(spark, d, "part").select("p_partkey", T.to_spark_sql(sql).alias("spark_sql"))


@query
def dialect_detect(spark, d):
    p = table(spark, d, "part")
    sql = F.element_at(F.array(*map(F.lit, ["select ndv(a) from t", "select collect_list(a) from t", "select a from t", "refresh table t; select len(a), now() from t"])), (F.col("p_size") % 4 + 1).cast("int"))
    return p.select("p_partkey", T.dialect(sql).alias("dialect"))


@query
def prj_route(spark, d):
    p = table(spark, d, "part")
    sql = F.element_at(F.array(*map(F.lit, ['{"find": 1}', "[1]", "select map(a, b) from t", "select a from t"])), (F.col("p_size") % 4 + 1).cast("int"))
    return p.select("p_partkey", T.query_type(sql).alias("query_type"), T.engine(sql).alias("engine"), T.safe_sql(F.concat(sql, F.when(F.col("p_size") > 40, "; drop table t").otherwise(""))).alias("safe"))


#: Texts with their kind, their engine and whether they are safe to run.
ROUTE_CASES = [
    ('{"find": "orders", "filter": {"a": 1}}', "mongo", "sql", True), ('  {"query": {"bool": {"must": []}}} ', "mongo", "elastic", True), ('[{"match": 1}]', "elastic", "sql", True),
    ("select Map('a', 1) as m from t", "map", "sql", True), ("select create_map (a, b) from t", "map", "sql", True), ("select mapped(a) from t", "sql", "sql", True),
    ("db.t.find({a: {$gt: 1}})", "sql", "mongo", True), ("db.t.aggregate([])", "sql", "mongo", True), ('{"$lookup": {"from": "t"}}', "mongo", "mongo", True),
    ("select * from elastic_index", "sql", "elastic", True), ('select "query" from t', "sql", "sql", True), ('select "term", "range" from t', "sql", "elastic", True),
    ("DROP TABLE t", "sql", "sql", False), ("select a from t; truncate table t", "sql", "sql", False), ("select dropped, granted from t", "sql", "sql", True), ("", "sql", "sql", True),
]


@query
def lin3_detect(spark, d):
    """Every branch of the three detections."""
    p = table(spark, d, "part")
    text = F.element_at(F.array(*[F.lit(t) for t, *_ in ROUTE_CASES]), (F.col("p_partkey") % len(ROUTE_CASES) + 1).cast("int"))
    return p.select("p_partkey", T.query_type(text).alias("query_type"), T.engine(text).alias("engine"), T.safe_sql(text).alias("safe"))


# -- matching


def _match_inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    n, p = table(spark, d, "nation"), table(spark, d, "part")
    fields = n.select(F.col("n_nationkey").alias("field_no"), F.concat_ws("_", F.lit("brand"), F.element_at(F.array(*map(F.lit, ["name", "type", "key", "size", "zone"])), F.col("n_nationkey") % 5 + 1), "n_name").alias("mapperColumn"), F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("mapperFactField"))
    extra = n.where("n_nationkey % 5 = 2").select((F.col("n_nationkey") + 100).alias("field_no"), F.col("n_name").alias("mapperColumn"), F.lit("g").alias("mapperFactField"))
    word = F.element_at(F.array(*map(F.lit, ["brand_name", "brand_type", "*", "part_size", "brandname"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = p.select(
        F.col("p_partkey").alias("row_no"), F.when(F.col("p_partkey") % 7 == 0, "gfolyreg_work_x").when(F.col("p_partkey") % 11 == 0, "").otherwise("db").alias("db"), F.lit("part").alias("table"),
        word.alias("column"), F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("_", word, (F.col("p_partkey") % 25).cast("string"))).otherwise("").alias("alias"),
    )
    return fields.unionByName(extra), rows


@query
def match_gate(spark, d):
    fields, rows = _match_inputs(spark, d)
    return match.gate(fields, match.usable(rows)).select("field_no", "row_no")


@query
def match_key(spark, d):
    fields, rows = _match_inputs(spark, d)
    fields = fields.withColumn("key", F.concat(F.lit("k"), (F.col("field_no") % 2).cast("string")))
    rows = rows.withColumn("key", F.concat(F.lit("k"), (F.col("row_no") % 3).cast("string")))
    return match.match_columns(fields, rows, regulation="REG").groupBy("key", "field_no").agg(F.count_if(F.col("matchType") == "no_match").alias("n_none"))


@query
def match_columns(spark, d):
    fields, rows = _match_inputs(spark, d)
    return match.match_columns(fields, rows, "k1", "REG")


@query
def match_exact(spark, d):
    fields, rows = _match_inputs(spark, d)
    named = rows.withColumn("alias", F.when(F.col("row_no") % 2 == 0, F.upper("column")).otherwise(""))
    fields = fields.withColumn("mapperColumn", F.element_at(F.array(*map(F.lit, ["Brand_Name", "PART SIZE", "zzz"])), (F.col("field_no") % 3 + 1).cast("int")))
    return match.match_columns(fields, named, "k1", "REG").where("matchType = 'exact'").select("field_no", "mapperColumn", "columnName", "columnAliasName", "matchPercentage", "matchType")


@query
def match_nomatch(spark, d):
    fields, rows = _match_inputs(spark, d)
    return match.match_columns(fields, rows, "k1", "REG").where("matchType = 'no_match'").select("field_no", "mapperColumn", "matchPercentage", "matchType")


@query
def match_summary(spark, d):
    fields, rows = _match_inputs(spark, d)
    return match.summary(match.match_columns(fields, rows, "k1", "REG"))


@query
def match_key_summary(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("key"), F.element_at(F.array(*map(F.lit, ["exact", "fuzzy", "weak", "no_match"])), (F.col("p_size") % 4 + 1).cast("int")).alias("matchType"))
    return match.key_summary(p)


@query
def match_topn(spark, d):
    fields, rows = _match_inputs(spark, d)
    return match.best_matches(fields, match.usable(rows), 3).select("field_no", "row_no", "rank")


def _sized_inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    """Names that share one word and nothing else, so that their ratio follows from lengths: words and letters against words and digits."""
    n, p = table(spark, d, "nation"), table(spark, d, "part")
    k = F.col("p_partkey")
    word = F.element_at(F.array(*map(F.lit, ["brand", "size", "zone"])), F.col("n_nationkey") % 3 + 1)
    fields = n.select(F.col("n_nationkey").alias("field_no"), F.concat_ws("_", word, F.repeat(_letters(F.col("n_nationkey")), F.col("n_nationkey") % 4 * 4 + 1)).alias("mapperColumn"), F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("mapperFactField"))
    rows = p.select(
        k.alias("row_no"), F.when(k % 7 == 0, "staging_area_x").when(k % 11 == 0, "").otherwise("db").alias("db"), F.lit("part").alias("table"),
        F.concat_ws("_", F.when(k % 3 == 0, "size").otherwise("brand"), (k % 100).cast("string")).alias("column"), F.when(k % 2 == 0, F.concat(F.lit("size_"), k.cast("string"))).otherwise("").alias("alias"),
    )
    return fields, rows


@query
def match_columns_sized(spark, d):
    fields, rows = _sized_inputs(spark, d)
    return match.match_columns(fields, rows, "k1", "REG", staging="staging_area")


@query
def match_summary_sized(spark, d):
    fields, rows = _sized_inputs(spark, d)
    return match.summary(match.match_columns(fields, rows, "k1", "REG", staging="staging_area"))


@query
def match_topn_sized(spark, d):
    fields, rows = _sized_inputs(spark, d)
    return match.best_matches(fields, match.usable(rows, "staging_area"), 3).select("field_no", "row_no", "compared", "percent", "rank")


@query
def match_flatten(spark, d):
    e = table(spark, d, "events")
    item = F.struct(F.lit("db").alias("a1"), F.col("event_type").alias("a2"), F.lit("").alias("a3"), F.col("event_id").cast("string").alias("a4"), F.lit("al").alias("a5"), F.lit("f.sql").alias("a6"), F.lit("v").alias("a7"))
    keys = F.struct(F.lit("b").alias("currBranch"), F.lit("app").alias("olympusApplication"))
    payload = F.to_json(F.struct(F.lit(1).alias("totalRecords"), F.array(F.struct(F.array(item, item).alias("windata"), keys.alias("winkeys"))).alias("factContainers")))
    return match.flatten_facts(e.select(payload.alias("payload"))).select("row_no", "db", "table", "column", "alias", "file", "view", "application")


@query
def match_mapper(spark, d):
    n = table(spark, d, "nation")
    cols = F.array(F.struct(F.col("n_name").alias("column_name"), F.lit("f").alias("field"), F.lit("string").alias("column_type")), F.struct(F.lit("x").alias("column_name"), F.lit("g").alias("field"), F.lit("int").alias("column_type")))
    return match.mapper_fields(n.select(F.to_json(F.struct(F.lit("m").alias("name"), F.struct(cols.alias("table_columns")).alias("value"))).alias("payload")))


def _letters(c) -> Column:
    """A number spelled with letters, so that names have one token each."""
    return F.translate(c.cast("string"), "0123456789", "ABCDEFGHIJ")


@query
def match_registry(spark, d):
    """One mapper and one fact payload per nation, keyed by region; even nations' first field has its row."""
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("key"), F.col("n_nationkey").alias("payload_no"), F.concat(F.lit("Q"), _letters(F.col("n_nationkey"))).alias("q"), F.concat(F.lit("W"), _letters(F.col("n_nationkey"))).alias("w"))
    of = lambda name, field: F.struct(F.col(name).alias("column_name"), F.lit(field).alias("field"), F.lit("string").alias("column_type"))
    mapper = F.to_json(F.struct(F.lit("m").alias("name"), F.struct(F.array(of("q", "f"), of("w", "g")).alias("table_columns")).alias("value")))
    item = lambda name: F.struct(F.lit("db").alias("a1"), F.lit("t").alias("a2"), F.lit("").alias("a3"), name.alias("a4"), F.lit("").alias("a5"))
    row = F.when(F.col("payload_no") % 2 == 0, F.lower("q")).otherwise(F.lit("other_price"))
    fact = F.to_json(F.struct(F.lit(1).alias("totalRecords"), F.array(F.struct(F.array(item(F.lit("total_amount")), item(row)).alias("windata"))).alias("factContainers")))
    found = match.match_registry(n.select("key", "payload_no", mapper.alias("payload")), n.select("key", "payload_no", fact.alias("payload")), regulation="REG")
    return found.select("key", "mapperColumn", "mapperFactField", "columnName", "matchPercentage", "matchType")


@query
def match_registry_summary(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("key"), F.col("n_nationkey").alias("payload_no"), F.concat(F.lit("Q"), _letters(F.col("n_nationkey"))).alias("q"))
    mapper = F.to_json(F.struct(F.lit("m").alias("name"), F.struct(F.array(F.struct(F.col("q").alias("column_name"), F.lit("f").alias("field"), F.lit("string").alias("column_type"))).alias("table_columns")).alias("value")))
    item = F.struct(F.lit("db").alias("a1"), F.lit("t").alias("a2"), F.lit("").alias("a3"), F.col("q").alias("a4"), F.lit("").alias("a5"))
    fact = F.to_json(F.struct(F.lit(1).alias("totalRecords"), F.array(F.struct(F.array(item).alias("windata"))).alias("factContainers")))
    known = n.where("payload_no % 3 <> 1")
    return match.key_summary(match.match_registry(n.select("key", "payload_no", mapper.alias("payload")), known.select("key", "payload_no", fact.alias("payload"))))


# -- sources and sinks


@query
def src_http_guard(spark, d):
    urls = ["https://a.example.org/x", "http://a.example.org/x", "https://localhost/", "https://10.0.0.1/", "https://other.net/", "https://sub.a.example.org/"]

    def verdict(u: str) -> str:
        try:
            http.check_url(u, ["a.example.org"])
        except http.UnsafeUrl:
            return "blocked"
        return "allowed"

    return spark.createDataFrame([(u, verdict(u)) for u in urls], "url string, verdict string")


@query
def src_http_guard_rows(spark, d):
    """Each refused url is a row of its own, never sent."""
    host = F.element_at(F.array(*map(F.lit, ["a.example.org", "db.local", "x.internal", "y.localhost", "172.16.0.1", "169.254.169.254", "[::1]", "b.example.org."])), (F.col("c_custkey") % 8 + 1).cast("int"))
    scheme = F.when(F.col("c_custkey") % 3 == 0, "http://").otherwise("https://")
    asked = table(spark, d, "customer").select("c_custkey", F.concat(scheme, host, F.lit("/"), F.col("c_custkey").cast("string")).alias("url"))
    got = http.fetch_rows(asked.select("url", F.lit("GET").alias("method"), F.lit(None).cast("string").alias("payload")), send=lambda *a: (200, "ok"))
    return got.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("c_custkey"), "status", "body")


@query
def src_csv(spark, d):
    path = new_folder(spark, "csv")
    sinks.write_csv(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), path)
    return files.read_csv(spark, path, "p_partkey long, p_name string, p_size int")


@query
def src_json_dir(spark, d):
    path = new_folder(spark, "json")
    n = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") == 3, "{bad").otherwise(F.to_json(F.struct("n_name"))).alias("value"))
    n.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_json_texts(spark, path, "*.txt").select(F.get_json_object("payload", "$.n_name").alias("name"), F.col("error").isNotNull().alias("bad"))


@query
def src_upload(spark, d):
    """One .json file per nation."""
    path = f"{new_folder(spark, 'upload')}.json"
    table(spark, d, "nation").select("n_nationkey", "n_name").write.option("maxRecordsPerFile", 1).json(path)
    got = files.read_uploaded_json(spark, path)
    return got.select(F.get_json_object("payload", "$.n_nationkey").cast("int").alias("n_nationkey"), F.get_json_object("payload", "$.n_name").alias("n_name"), "error")


@query
def src_sql_file(spark, d):
    """One statement per file; the second path does not exist and is skipped."""
    path = new_folder(spark, "sql")
    statement = F.concat(F.lit("SELECT a\nFROM d.t"), F.col("n_nationkey").cast("string"))
    table(spark, d, "nation").select(statement.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return files.read_sql_files(spark, [path, f"{path}-none"]).select(F.col("query_key").rlike("^PART-[0-9A-F-]+-C[0-9]+$").alias("keyed"), F.rtrim(F.replace("sql", F.lit("\n"), F.lit(" "))).alias("sql"))


@query
def src_inline(spark, d):
    given = files.inline(spark, [(0, "AFRICA"), (1, None), (9, "")], "r_regionkey int, wanted string")
    return table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name").join(given, "r_regionkey")


@query
def src_log_lines(spark, d):
    """Numbers and lines of one log file per customer segment."""
    path = new_folder(spark, "log")
    c = table(spark, d, "customer").select("c_mktsegment", F.col("c_custkey").alias("k"))
    one = c.groupBy("c_mktsegment").agg(F.array_sort(F.collect_list("k")).alias("ks")).select(F.concat_ws("\n", "c_mktsegment", F.array_join("ks", "\n")).alias("value"))
    one.write.option("maxRecordsPerFile", 1).text(path)
    read = files.read_log(spark, path)
    name = read.where("line_no = 0").select("file", F.col("line").alias("segment"))
    return read.join(name, "file").select("segment", "line_no", "line")


@query
def src_log(spark, d):
    path = new_folder(spark, "log")
    table(spark, d, "region").select(F.concat_ws("\n", F.concat(F.lit("ERROR "), "r_name"), F.lit(" at x"), F.lit("")).alias("value")).repartition(3, "value").write.text(path)
    return files.read_log(spark, path).where("line <> ''").groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query
def src_sql_dict(spark, d):
    return files.sql_dictionary(spark, {"A": "select 1", "B": "select 2"}, {"A": {"view_name": "va", "regulation": "r"}})


@query
def src_yaml(spark, d):
    path = new_folder(spark, "yaml")
    spark.createDataFrame([("columns:\n  p_size: {min: 5, max: 45}\n",)], "value string").coalesce(1).write.text(path)
    rules = files.read_rules(spark, path)
    return dq.run_checks(table(spark, d, "part"), rules)["range:p_size"].select("p_partkey", "p_size")


@query
def src_url_build(spark, d):
    return table(spark, d, "nation").select("n_nationkey", http.metadata_url(F.lit("https://h/"), F.col("n_name"), F.concat(F.lit("m"), F.col("n_nationkey").cast("string"))).alias("url"))


@query
def src_payload_build(spark, d):
    n = table(spark, d, "nation")
    files = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("f.sql"))).otherwise(F.array().cast("array<string>"))
    return n.select("n_nationkey", http.payload_filter(F.lit("b"), F.lit("w"), F.col("n_name"), files).alias("body"))


@query
def src_payload_filter(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("branch"), F.lit("w").alias("window_type"), F.lit("app").alias("application"), F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string")).alias("file"))
    return http.apply_payload_filter(e, "click", "w", "app", ["f0", "f1"])


@query
def src_http(spark, d):
    asked = table(spark, d, "nation").select(F.concat(F.lit("https://h/"), "n_name").alias("url"), F.lit("GET").alias("method"), F.lit(None).cast("string").alias("payload"))

    def send(url, method, body, headers, timeout):
        return (200, '{"u": "' + url[-1:] + '"}') if url[-1] in "AEIOU" else (404, "none")

    return http.fetch_rows(asked, send=send)


@query
def src_http_pages(spark, d):
    """A page per customer through the data source; the transport answers without a network."""
    spark.dataSource.register(http_pages.HttpPages)
    c = table(spark, d, "customer")
    low, high = c.agg(F.min("c_custkey"), F.max("c_custkey")).first()
    pages = spark.read.format("http_pages").option("url", "https://a.example.org/{n}").option("first", low).option("last", high).option("per_partition", 1000).option("transport", "tracewell.sources.http_pages:echo").load()
    return c.join(pages, F.col("c_custkey") == F.col("request_no")).select("c_custkey", "url", "status", F.get_json_object("body", "$.n").alias("n"), "error")


@query
def snk_ordered(spark, d):
    """Customers sorted by name and key, with the places that a reader finds; no row is out of place."""
    path = new_folder(spark, "ordered")
    by = ["c_mktsegment", "c_custkey"]
    ordered.write_ordered(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), path, by)
    read = ordered.read_ordered(spark, path)
    return read.join(ordered.misplaced(read, by).select("order_no"), "order_no", "left_anti").select("c_custkey", "c_mktsegment", "order_no")


@query
def snk_json(spark, d):
    return sinks.envelope(table(spark, d, "region").select("r_regionkey", "r_name")).select("success", "message", "total_records", "record")


# -- logs and no-SQL payloads


def _whole_log_lines(spark, d) -> DataFrame:
    """The document lines in full, some behind a marker, with a blank line after each sixth of seven."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p", "t"))
    line = F.when(F.col("p") % 7 == 1, F.concat(F.lit("ERROR at "), "t")).when(F.col("p") % 7 == 3, F.concat(F.lit("Caused by: x"), F.col("p").cast("string"), F.lit(" "), "t")).otherwise(F.col("t"))
    lines = F.when(F.col("p") % 7 == 5, F.array(line, F.lit(""))).otherwise(F.array(line))
    return docs.select(F.col("doc_id").alias("file"), "p", F.posexplode(lines).alias("k", "line")).select("file", (F.col("p").cast("long") * 2 + F.col("k")).alias("line_no"), "line")


@query
def log_blocks_whole(spark, d):
    return logs.error_blocks(_whole_log_lines(spark, d)).select("file", "block_id", "line_no")


@query
def log_root_whole(spark, d):
    return logs.root_causes(logs.error_blocks(_whole_log_lines(spark, d))).select("file", "block_id", "root_cause")


@query
def log_count_whole(spark, d):
    return logs.block_count(logs.error_blocks(_whole_log_lines(spark, d)))


def _one_log(spark, d) -> DataFrame:
    """All document lines as one log file, numbered with gaps between documents."""
    lines = _whole_log_lines(spark, d)
    return lines.select(F.lit("all").alias("file"), (F.col("file") * 1_000_000 + F.col("line_no")).alias("line_no"), "line")


@query
def log_one_file(spark, d):
    """Blocks of one log as long as the corpus, running on from document to document."""
    return logs.error_blocks(_one_log(spark, d)).select("block_id", "line_no")


@query
def log_one_file_root(spark, d):
    causes = logs.root_causes(logs.error_blocks(_one_log(spark, d)))
    return causes.select("block_id", "root_cause", "trace")


@query
def log_stream(spark, d):
    """Blocks of logs whose lines come in three batches, the last with the ends of all files."""
    arrived, found, checkpoint = (new_folder(spark, n) for n in ("log-lines", "log-blocks", "log-state"))
    lines = _whole_log_lines(spark, d)
    ends = lines.groupBy("file").agg((F.max("line_no") + 1).alias("line_no")).withColumn("line", F.lit(None).cast("string"))
    for low, high in ((0, 20), (20, 60), (60, None)):
        part = lines.where((F.col("line_no") >= low) & (F.lit(high is None) | (F.col("line_no") < F.lit(high))))
        (part if high else part.unionByName(ends)).write.mode("append").parquet(arrived)
        blocks.append_blocks(spark.readStream.schema(lines.schema).parquet(arrived), found, checkpoint)
    return spark.read.parquet(found)


@query
def nosql_mongo(spark, d):
    n = table(spark, d, "nation")
    op = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit('{"op":"find","collection":"'), "n_name", F.lit('","projection":{"a":1,"b":"$c"}}'))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit('{"op":"find","collection":"'), "n_name", F.lit('"}'))).otherwise(
        F.concat(F.lit('{"op":"aggregate","collection":"'), "n_name", F.lit('","pipeline":[{"$project":{"x":1}},{"$lookup":{"from":"o","as":"z"}}]}')))
    return nosql.mongo_lineage(n.select("n_nationkey", op.alias("op")), "op", "n_nationkey")


@query
def nosql_elastic(spark, d):
    n = table(spark, d, "nation")
    q = F.concat(F.lit('{"query":{"bool":{"must":[{"match":{"f'), F.col("n_nationkey").cast("string"), F.lit('":"v"}},{"bool":{"should":[{"range":{"g":{"gte":1}}},{"exists":{"field":"h"}}]}}],"filter":{"term":{"t":1}}}}}'))
    return nosql.elastic_lineage(n.select("n_nationkey", q.alias("q")), "q", "n_nationkey").drop("remark")


#: Clauses of Elastic queries, and the fields that each names with the kind and the remark.
CLAUSES = [
    ('{"match_phrase":{"m":"v"}}', [("m", "match_phrase", "Mongo query")]),
    ('{"range":{"r":{"lt":9,"gte":1},"s":{"boost":2}}}', [("r", "range", "range:gte=1,lt=9"), ("s", "range", "Mongo query")]),
    ('{"prefix":{"p":"v"}}', [("p", "prefix", "Mongo query")]),
    ('{"wildcard":{"w":"v*"},"other":1}', [("w", "wildcard", "Mongo query")]),
    ('{"term":"plain"}', [("plain", "term", "Mongo query")]),
    ('{"exists":{"name":"e"}}', [("e", "exists", "Mongo query")]),
    ('{"u":{"value":1},"w":{"a":1,"value":2}}', [("u", "unknown", "Mongo query")]),
    ('5', []),
]


@query
def nosql_elastic_kinds(spark, d):
    """Every kind of clause in every part of a bool, bools nested as deep as the part's size says, clauses in lists and alone."""
    p = spread(table(spark, d, "part").select("p_partkey", "p_size"))
    clause = F.element_at(F.array(*[F.lit(c) for c, _ in CLAUSES]), (F.col("p_partkey") % len(CLAUSES) + 1).cast("int"))
    part = F.element_at(F.array(*map(F.lit, nosql.BOOL_PARTS)), (F.col("p_size") % 4 + 1).cast("int"))
    deep = F.concat(F.repeat(F.concat(F.lit('{"bool":{"'), part, F.lit('":[')), F.col("p_size")), clause, F.repeat(F.lit("]}}"), F.col("p_size")))
    q = F.concat(F.lit('{"bool":{"must_not":{"term":{"last":1}},"must":['), deep, F.lit(',{"range":{"second":{"from":"a","to":"b"}}}]}}'))
    return nosql.elastic_lineage(p.select("p_partkey", q.alias("q")), "q", "p_partkey")


# -- lineage


def corpus(spark: SparkSession, d: str, sql: str, name: str = "supplier", key: str = "s_suppkey") -> DataFrame:
    text = F.replace(F.lit(sql), F.lit("{k}"), F.col(key).cast("string"))
    return table(spark, d, name).select(F.col(key).alias("query_no"), text.alias("sql"), F.lit("REG").alias("regulation"), F.lit("KEY").alias("metadatakey"), F.lit("V").alias("view_name"))


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("query_no", "databaseName", "tableName", "tableAliasName", "columnName", "aliasName", F.array_join(F.array_sort("remarks"), "|").alias("remarks"))


def _lineage_query(sql: str) -> Query:
    return lambda spark, d: shown(lineage.deduplicate(lineage.extract_lineage(corpus(spark, d, sql), keep=("query_no",))))


for _name, (_sql, _rows) in TEMPLATES.items():
    QUERIES[_name] = _lineage_query(_sql)


def all_templates(spark: SparkSession, d: str) -> DataFrame:
    """Every template for every part; the parts are dealt to all tasks before they are multiplied."""
    made = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(s).alias("s")) for n, (s, _) in TEMPLATES.items()]))
    return spread(table(spark, d, "part").select("p_partkey")).select("p_partkey", made.alias("x")).select(
        F.concat_ws("-", "x.rule", F.col("p_partkey").cast("string")).alias("query_no"), F.replace(F.col("x.s"), F.lit("{k}"), F.col("p_partkey").cast("string")).alias("sql"),
        F.lit("REG").alias("regulation"), F.lit("KEY").alias("metadatakey"), F.lit("V").alias("view_name"),
    )


@query
def lin_corpus(spark, d):
    rows = lineage.deduplicate(lineage.extract_lineage(all_templates(spark, d), keep=("query_no",), spread=False))
    return rows.groupBy("databaseName", "tableName").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("columnName").alias("n_columns"))


@query
def lin_summary(spark, d):
    return lineage.summary(lineage.deduplicate(lineage.extract_lineage(all_templates(spark, d), keep=("query_no",), spread=False)))


@query
def lin_counts(spark, d):
    """Rows per rule over the whole corpus of templates."""
    rows = lineage.deduplicate(lineage.extract_lineage(all_templates(spark, d), keep=("query_no",), spread=False))
    return rows.groupBy(F.regexp_extract("query_no", "^(.*)-", 1).alias("rule")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("databaseName") == "").alias("n_no_database"))


@query
def lin_titled(spark, d):
    rows = lineage.deduplicate(lineage.extract_lineage(corpus(spark, d, TEMPLATES["lin_direct"][0])))
    return lineage.titled(rows).drop("Remarks", "Regulation", "Metadatakey", "View Name")


@query
def lin_meta(spark, d):
    flat = _flat(spark, d).select(F.col("name").alias("metadatakey"), "regulation", "view_name", "sql")
    return lineage.deduplicate(lineage.extract_lineage(flat)).select("databaseName", "tableName", "columnName", "metadatakey", "regulation", "viewName")


@query
def lin_dedup(spark, d):
    rows = lineage.extract_lineage(corpus(spark, d, TEMPLATES["lin_join_eq"][0]), keep=("query_no",))
    return lineage.deduplicate(rows).groupBy("query_no").agg(F.count(F.lit(1)).alias("n_rows")).join(rows.groupBy("query_no").agg(F.count(F.lit(1)).alias("n_emitted")), "query_no")


@query
def lin_route(spark, d):
    sql = F.element_at(F.array(*map(F.lit, ['{"find": 1}', "[1]", "select map(a, b) from t", "select a from t"])), (F.col("s_suppkey") % 4 + 1).cast("int"))
    q = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_no"), sql.alias("sql"), F.lit("").alias("regulation"), F.lit("").alias("metadatakey"), F.lit("").alias("view_name"))
    return shown(lineage.deduplicate(lineage.extract_lineage(q, keep=("query_no",), route=True)))


@query
def lin_trace(spark, d):
    sql = "WITH c AS (SELECT a AS b FROM d{k}.t) SELECT s.z AS out FROM (SELECT b AS z FROM c) s"
    return layers.traced_lineage(corpus(spark, d, sql), keep="query_no").select("query_no", "databaseName", "tableName", "columnName", "aliasName", F.array_join("remarks", "|").alias("remarks"))


@query
def lin_trace_odd(spark, d):
    """Columns that lead nowhere or to several places, and stars."""
    texts = [
        "SELECT z.a AS o FROM d.t x", "SELECT s.q AS o FROM (SELECT a AS b FROM d.t) s", "SELECT a AS o FROM d.t x, e.u y", "SELECT s.a AS o FROM (SELECT * FROM d.t) s",
        "SELECT s.* FROM (SELECT a AS b, f(c, x.g) AS h FROM d.t x) s", "WITH c AS (SELECT x.*, y.i FROM d.t x JOIN e.u y ON x.k = y.k) SELECT * FROM c",
    ]
    sql = F.element_at(F.array(*map(F.lit, texts)), (F.col("s_suppkey") % len(texts) + 1).cast("int"))
    found = layers.traced_lineage(table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_no"), sql.alias("sql")), keep="query_no")
    return found.select("query_no", "databaseName", "tableName", "columnName", "aliasName", F.array_join("remarks", "|").alias("remarks"), "status")


def _shapes(spark, d, texts: list[str]) -> DataFrame:
    """Supplier number k has text number k modulo their count, with its number for {k}."""
    k = F.col("s_suppkey")
    sql = F.replace(F.element_at(F.array(*map(F.lit, texts)), (k % len(texts) + 1).cast("int")), F.lit("{k}"), k.cast("string"))
    return table(spark, d, "supplier").select(k.alias("query_no"), sql.alias("sql"), F.lit("").alias("regulation"), F.lit("").alias("metadatakey"), F.lit("").alias("view_name"))


@query
def lin_no_input_ctx(spark, d):
    """Literals and functions without columns belong to the table of their block."""
    texts = [
        "SELECT now() AS n, a FROM d{k}.t x", "SELECT s.n FROM (SELECT date_format(now(), 'yyyy') AS n FROM d{k}.t) s", "SELECT {k} AS k, 'v' AS w FROM d.t x, e.u y",
        "SELECT q.n FROM (SELECT uuid() AS n FROM (SELECT x.a FROM d.t x, e.u y) r) q", "SELECT now() AS n FROM d.t x, e{k}.u main",
    ]
    return shown(lineage.deduplicate(lineage.extract_lineage(_shapes(spark, d, texts), keep=("query_no",), context=True, prefer="main")))


#: Texts that cannot be read.
BROKEN = [
    "SELECT a.x1, COL_ONE, lower(b.y) FROM d{k}.t a JOIN e.u AS b ON a.i = b.i WHERE ((", "SELEC z.q, VALUE_A, 'NOT_THIS' FROM d{k}.t x", "", "((((", "SELECT s.t.c, q.v, MAX(AMOUNT FROM WHERE",
    "SELECT t.p.q FROM d{k}.t WHERE LEFT_SIDE = (SELECT", "SELECT fine FROM d.t",
]


@query
def lin3_refs_bare(spark, d):
    """Upper-case names without a qualifier, in texts that cannot be read."""
    found = recover.recovered_lineage(_shapes(spark, d, BROKEN), keep="query_no")
    return found.where(F.col("columnName").rlike("^[A-Z][A-Z0-9_]{2,}$") & (F.col("status") == "recovered")).select("query_no", "databaseName", "tableName", "columnName", "remark")


@query
def lin3_fallback(spark, d):
    """All rows of texts that cannot be read, with their marks."""
    return recover.recovered_lineage(_shapes(spark, d, BROKEN), keep="query_no").drop("ordinal")


@query
def lin_star_dive(spark, d):
    """A star over a subquery has a row for each of its outputs; names that differ are matched by their parts."""
    texts = ["SELECT s.* FROM (SELECT a, b AS c FROM d.t) s", "SELECT s.cust AS x FROM (SELECT cust_name FROM d.t) s"]
    sql = F.element_at(F.array(*map(F.lit, texts)), (F.col("s_suppkey") % 2 + 1).cast("int"))
    found = layers.layered_lineage(table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_no"), sql.alias("sql")), keep="query_no")
    return found.where("layer_order > 1").select("query_no", "layer_order", "tableAliasName", "columnName", "aliasName", "remarks")


@query
def lin_map_pairs(spark, d):
    return layers.map_pairs(corpus(spark, d, "SELECT map('k{k}', a, 'l', nvl(t.b, c)) AS m FROM d.t"), keep="query_no").select("query_no", "qualifier", "columnName", "aliasName")


@query
def lin_tables_cols(spark, d):
    return layers.tables_and_columns(corpus(spark, d, "SELECT x.a, b FROM d{k}.t x JOIN e.u y ON x.i = y.j"), keep="query_no").select("query_no", "kind", "qualifier", "name")


@query
def lin3_layers(spark, d):
    return layers.layered_lineage(corpus(spark, d, "SELECT s.col_a AS x FROM (SELECT col_a FROM d{k}.t) s"), keep="query_no", in_order=True).select("query_no", "layer_order", "databaseName", "tableName", "tableAliasName", "columnName", "aliasName", "remarks")


@query
def lin3_joins(spark, d):
    return layers.joins(corpus(spark, d, "SELECT x.a FROM d{k}.t x LEFT JOIN e.u y ON x.i = y.j"), keep="query_no").select("query_no", "join_type", "databaseName", "tableName", "condition")


@query
def lin3_status(spark, d):
    return layers.only_failures(layers.layered_lineage(corpus(spark, d, "SELEC a FROM"), keep="query_no")).select("query_no", "status")


@query
def edge_many(spark, d):
    found = edges.edge_lineage(corpus(spark, d, "INSERT INTO f.g SELECT a AS x, 5 + b AS y FROM d{k}.t; SELECT 'v' || c AS z FROM e.u"), keep=("query_no",))
    return found.select("query_no", "source_db", "source_table", "source_column", "target_db", "target_table", "target_column", "edge_type", "status")


@query
def edge_status(spark, d):
    sql = F.element_at(F.array(*map(F.lit, ["", "{}", "select map(a, b) from t", "select from", "select 1"])), (F.col("p_size") % 5 + 1).cast("int"))
    return edges.edge_lineage(table(spark, d, "part").select("p_partkey", sql.alias("sql")), keep=("p_partkey",)).select("p_partkey", "status", "ambiguous")


#: Items of a select list, the statement around them, and the static values that they put into column k.
LITERALS = [
    ("'word'", ["word"]), ("null", ["null"]), ("true", ["true"]), ("-12.5", ["-12.5"]), ("0x1f", ["0x1f"]), ("date '2024-01-31'", ["DATE_2024-01-31"]),
    ("timestamp '2024-01-31 10:20:30'", ["TIMESTAMP_2024-01-31_10-20-30"]), ("interval '3' day", ["INTERVAL_3_DAY"]), ("interval 2 months", ["INTERVAL_2_MONTHS"]),
    ("array[1, 2, 3]", ["ARRAY_1_2_3"]), ("array('p', 'q')", ["ARRAY_p_q"]), ("case when 1 = 2 then 'x' when 3 < 4 then -5 else date '2024-02-01' end", ["x", "-5", "DATE_2024-02-01"]),
    ("case 1 when 2 then case when 3 = 4 then 'deep' end else null end", ["deep", "null"]),
]
#: Statements whose column k has no known table, one with a known table, and what the edge says.
PLACES = [
    ("select a as k from d1.t, d2.u", "N/A", True), ("select a as k from unknown", "N/A", True), ("select a as k from d1.t", "t", False),
    ("select t.a as k from d1.t t join d2.u u on t.i = u.i", "t", False),
]


@query
def edge_literals(spark, d):
    sql = F.element_at(F.array(*[F.lit(x) for x, _ in LITERALS]), (F.col("p_partkey") % len(LITERALS) + 1).cast("int"))
    made = table(spark, d, "part").select("p_partkey", F.concat(F.lit("insert into w.z select "), sql, F.lit(" as k, "), F.col("p_size"), F.lit(" as n from d.t")).alias("sql"))
    return edges.edge_lineage(made, keep=("p_partkey",)).select("p_partkey", "ordinal", "source_db", "source_table", "source_column", "target_table", "target_column", "edge_type")


@query
def edge_ambiguous(spark, d):
    sql = F.element_at(F.array(*[F.lit(x) for x, *_ in PLACES]), (F.col("p_partkey") % len(PLACES) + 1).cast("int"))
    return edges.edge_lineage(table(spark, d, "part").select("p_partkey", sql.alias("sql")), keep=("p_partkey",)).select("p_partkey", "source_table", "status", "ambiguous")


@query
def edge_meta(spark, d):
    """From catalogue payloads to edges: the reader's queries go straight into the edge walker."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey").cast("string")
    first = F.concat(F.lit('{"key":"K'), k, F.lit('","sql":"INSERT INTO f.g SELECT a AS x FROM d'), k, F.lit('.t"}'))
    other = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit(',{"key":"L'), k, F.lit('","query":"SELECT 7 AS y FROM e.u"}'))).otherwise("")
    payload = F.concat(F.lit('{"name":"n","value":{"create_query":['), first, other, F.lit("]}}"))
    found = edges.edge_lineage(edges.payload_queries(n.select(payload.alias("payload"))), keep=("query_key",))
    return found.select("query_key", "source_db", "source_table", "source_column", "target_db", "target_table", "target_column", "edge_type", "status")


@query
def edge_odd(spark, d):
    """Texts that no reader expects give a status row and stop nothing."""
    sql = F.element_at(F.array(*map(F.lit, ["UPDATE d1.t SET a = view WHERE c = 1", "SELECT ((((", "CREATE VIEW", "SELECT a FROM", "';--", "INSERT OVERWRITE TABLE"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return edges.edge_lineage(table(spark, d, "part").select("p_partkey", sql.alias("sql")), keep=("p_partkey",)).groupBy("p_partkey").agg((F.max("status") == "success").alias("read"))


@query
def edge_extract(spark, d):
    n = table(spark, d, "nation")
    body = F.when(F.col("n_nationkey") % 2 == 0, F.lit('[{"query":"select 1"},{"key":"K","sql":"select 2"}]')).otherwise('{"sql_query":"select 3"}')
    return edges.payload_queries(n.select(F.concat(F.lit('{"name":"'), "n_name", F.lit('","value":{"create_query":'), body, F.lit("}}")).alias("payload")))
