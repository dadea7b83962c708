"""Schemas and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# The tags a lineage row may carry.
ALL_COLUMNS = "all_columns_selected"
WITH_DB = "column_selected_with_database"
NO_DB = "database_not_specified_in_query"
AMBIGUOUS = "table_name_ambiguous"
DERIVED = "derived_expression"
CASE = "case_expression"
DERIVED_NAME = "table name Derived"
WHERE = "where_clause_column"
GROUP_BY = "group_by_column"
HAVING = "having_clause_column"
JOIN_ON = "join_on_clause_column"
JOIN_TYPE = "join_type"
JOIN_SUBQUERY_WHERE = "join_subquery_where_column"
FUNCTION = "function_expression"
INVALID_ALIAS = "invalid_table_alias"
DERIVED_TABLE = "table_name_derived"
FAILURE = "tech_failure"
UPDATE_SET = "update_set_column"
IGNORED_ELASTIC = "ignored_elastic_query"
IGNORED_MONGO = "ignored_mongo_query"
MAP_SKIPPED = "Spark complex SQL -MAP function"

LINEAGE_FIELDS = ["databaseName", "tableName", "tableAliasName", "columnName", "aliasName", "regulation", "metadatakey", "viewName"]
LINEAGE = T.StructType(
    [T.StructField(n, T.StringType(), False) for n in LINEAGE_FIELDS] + [T.StructField("remarks", T.ArrayType(T.StringType(), False), False)]
)
MATCH_FIELDS = ["regulation", "key", "mapperColumn", "mapperFactField", "dbName", "tableName", "columnName", "columnAliasName", "matchedOn", "matchPercentage", "matchType"]
#: Column titles of the older row format, in order.
TITLES = {
    "databaseName": "Database Name", "tableName": "Table Name", "tableAliasName": "Table Alias Name", "columnName": "Column Name",
    "aliasName": "Alias Name", "regulation": "Regulation", "metadatakey": "Metadatakey", "viewName": "View Name", "remarks": "Remarks",
}
