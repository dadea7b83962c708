"""Impala text as Spark SQL: calls are found by nesting, not by pattern, so quotes, comments and inner calls stay whole."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Fixed values: (function, number of arguments) -> what stands for the call; {n} is its n-th argument.
CALLS = {
    ("dateadd", 3): "DATE_ADD({2}, {1})",
    ("datesub", 2): "DATE_SUB({0}, {1})",
    ("now", 0): "CURRENT_TIMESTAMP",
    ("getdate", 0): "CURRENT_TIMESTAMP",
    ("current_time", 0): "CURRENT_TIMESTAMP",
    ("appx_median", 1): "percentile_approx({0}, 0.5)",
    ("group_concat", 1): "concat_ws(',', collect_list({0}))",
    ("group_concat", 2): "concat_ws({1}, collect_list({0}))",
}
#: Functions that only have another name.
NAMES = {"isnull": "nvl", "len": "length", "ndv": "approx_count_distinct"}
#: Units of intervals that lose their last letter.
PLURALS = ["YEARS", "MONTHS", "DAYS"]
LEXEME = re.compile(r"'(?:[^']|'')*'?|\"[^\"]*\"?|`[^`]*`?|--[^\n]*|/\*.*?(?:\*/|\Z)|\w+|\s+|.", re.S)


class Rewriter:
    """Reads lexemes from left to right and gives the rewritten text."""

    def __init__(self, sql: str):
        self.t, self.i = LEXEME.findall(sql), 0

    def peek(self, *words: str) -> int:
        """The place after ``words`` (any number for 0), white space skipped; -1 when they don't come next."""
        k = self.i
        for w in words:
            while k < len(self.t) and self.t[k].isspace():
                k += 1
            if k == len(self.t) or not (self.t[k].isdigit() if w == "0" else self.t[k].upper() == w):
                return -1
            k += 1
        return k

    def until(self, closed: bool) -> tuple[list[str], bool]:
        """Texts between commas, up to the closing parenthesis (``closed``) or the end, and whether that was found."""
        parts = [""]
        while self.i < len(self.t):
            x = self.t[self.i]
            if closed and x == ")":
                self.i += 1
                return parts, True
            if closed and x == ",":
                self.i += 1
                parts.append("")
            else:
                parts[-1] += self.item()
        return parts, not closed

    def item(self) -> str:
        begin, word = self.i, self.t[self.i]
        self.i += 1
        if word == "(":
            return self.closed("(", *self.until(True))
        if word.startswith("/*") and word[2:].lstrip().startswith("+"):
            return ""
        if not (word[0].isalpha() or word[0] == "_"):
            return word
        upper = word.upper()
        k = self.peek("(")
        if k > 0:
            space = "".join(self.t[self.i : k - 1])
            self.i = k
            qualified = begin > 0 and self.t[begin - 1] == "."
            return self.closed(f"{word}{space}(", *self.until(True)) if qualified else self.call(word, space, *self.until(True))
        if upper in ("DATE", "TIMESTAMP"):
            k = self.i
            while k < len(self.t) and self.t[k].isspace():
                k += 1
            if self.i < k < len(self.t) and self.t[k].startswith("'"):
                self.i = k + 1
                return f"{word}({self.t[k]})"
        if upper == "INTERVAL":
            for plural in PLURALS:
                if (k := self.peek("0", plural)) > 0:
                    number, unit = self.t[self.peek("0") - 1], self.t[k - 1]
                    self.i = k
                    return f"INTERVAL {number} {unit[:-1]}"
        if upper == "OFFSET":
            for rows in ("ROWS", "ROW"):
                if (k := self.peek("0", rows)) > 0:
                    number = self.t[self.peek("0") - 1]
                    self.i = k
                    return f"OFFSET {number}"
        return word

    @staticmethod
    def closed(head: str, parts: list[str], done: bool) -> str:
        return head + ",".join(parts) + ")" * done

    def call(self, name: str, space: str, parts: list[str], done: bool) -> str:
        if not done:
            return self.closed(f"{name}{space}(", parts, done)
        args, low = [p.strip() for p in parts], name.lower()
        args = [] if args == [""] else args
        if (k := self.peek("WITHIN", "GROUP", "(", "ORDER", "BY")) > 0:
            self.i = k
            order = ",".join(self.until(True)[0]).strip()
            if low in ("percentile_cont", "percentile_disc") and (way := re.search(r"\s+(ASC|DESC)$", order, re.I)):
                # The call takes no direction: from the other end it is the rest of the fraction.
                order = order[: way.start()]
                args = [f"1 - {a}" for a in args] if way[1].upper() == "DESC" else args
            over = self.peek("OVER", "(", ")")
            if low in ("percentile_cont", "percentile_disc") and over > 0:
                self.i, name = over, "PERCENTILE"
            return f"{name}({', '.join([order, *args])})"
        made = CALLS.get((low, len(args)))
        if made is None:
            return self.closed(f"{NAMES.get(low, name)}{space}(", parts, done)
        if low == "group_concat" and args[0][:8].upper() == "DISTINCT" and args[0][8:9].isspace():
            made, args[0] = made.replace("collect_list", "collect_set"), args[0][8:].strip()
        return made.format(*args)


def rewrite(sql: str) -> str:
    """Spark SQL for Impala text; ADD_MONTHS and MONTHS_BETWEEN stay, as Spark has them; hints go.

    A call whose parenthesis is never closed keeps its name and its text, and so
    does a text nested too deeply to be read.  Qualified names are no functions.
    DATEADD and DATESUB become day arithmetic whatever their unit, as in the
    dialect this follows.
    """
    try:
        return "".join(Rewriter(sql).until(False)[0])
    except RecursionError:
        return sql


@pandas_udf(T.StringType())
def rewrite_udf(sql: pd.Series) -> pd.Series:
    return sql.map(lambda s: None if s is None else rewrite(s))
