"""Functions that Spark has no built-in for, Arrow-batched or as UDTFs."""

from __future__ import annotations

import base64
import binascii
import difflib
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf


def row_of(*names: str) -> T.StructType:
    """A row type without a session: ``name`` is text, ``name:int`` a number."""
    fields = [n.partition(":") for n in names]
    return T.StructType([T.StructField(n, T.IntegerType() if kind == "int" else T.StringType()) for n, _, kind in fields])


def ratio(a: str, b: str) -> float:
    """Ratcliff/Obershelp similarity in percent, ``a`` as the first argument."""
    return difflib.SequenceMatcher(None, a, b).ratio() * 100.0


@pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Over distinct pairs: callers deduplicate before."""
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


@pandas_udf(T.StringType())
def percent_udf(score: pd.Series) -> pd.Series:
    """One decimal, rounded half to even on the binary value."""
    return score.map(lambda x: f"{x:.1f}%")


def decode_lenient(text: str | None) -> str:
    """Base64 with characters outside the alphabet ignored; the raw text when that fails; empty for null."""
    if not text:
        return ""
    padded = text + "=" * (-len(text) % 4)
    for decode in (base64.b64decode, base64.urlsafe_b64decode):
        try:
            return decode(padded).decode("utf-8", "replace")
        except (binascii.Error, ValueError):
            continue
    return text


@pandas_udf(T.StringType())
def decode_lenient_udf(c: pd.Series) -> pd.Series:
    return c.map(decode_lenient)


def statements(sql: str) -> list[str]:
    """Statements split at ; outside quotes, comments removed, lower-cased."""
    sql = re.sub(r"/\*.*?\*/", "", re.sub(r"--[^\n]*", "", sql), flags=re.S)
    pieces = re.findall(r"(?:'(?:\\.|[^'\\])*'?|\"(?:\\.|[^\"\\])*\"?|[^;'\"])+", sql)
    return [p.strip().lower() for p in pieces if p.strip()]


def split_columns(clause: str) -> list[str]:
    """Split at commas outside quotes and parentheses."""
    out, depth, quote, begin = [], 0, "", 0
    for i, ch in enumerate(clause):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "," and not depth:
            out.append(clause[begin:i].strip())
            begin = i + 1
    return [p for p in [*out, clause[begin:].strip()] if p]


@udtf(returnType=row_of("ordinal:int", "statement"))
class SplitStatements:
    def eval(self, sql: str):
        yield from enumerate(statements(sql or ""))


@udtf(returnType=row_of("ordinal:int", "item"))
class SplitColumns:
    def eval(self, clause: str):
        yield from enumerate(split_columns(clause or ""))


def distinct_ratio(pairs, left: str, right: str, out: str):
    """Join ``out`` = ratio of the two columns, computed once per distinct pair."""
    scored = pairs.select(left, right).distinct().withColumn(out, ratio_udf(F.col(left), F.col(right)))
    return pairs.join(scored, [left, right])
