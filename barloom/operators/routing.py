"""Declarative routing of events: rules joined to events."""

from __future__ import annotations

import re
from fnmatch import translate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANKS = {"critical": 0, "high": 1, "medium": 2, "low": 3, "low_async": 3}
_OPS = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}
_CONDITION = re.compile(r"\s*(\w+)\s*(>=|<=|==|>|<)\s*(-?\d+)\s*")


def rules(spark: SparkSession, rows: list[tuple[str, str, str, str, str, str]]) -> DataFrame:
    """Rules from (event, pattern, condition, target, action, priority).

    A condition is ``name op whole number``; any other never holds. An unknown priority comes last.
    """
    out = []
    for i, (event, pattern, condition, target, action, priority) in enumerate(rows):
        m = _CONDITION.fullmatch(condition)
        name, op, value = (m[1], m[2], int(m[3])) if m else ("", None, None) if condition else (None, None, None)
        regex = translate(pattern).replace("(?s:", "(?s)(?:").removesuffix("\\z").removesuffix("\\Z") + "$" if pattern else None
        out.append((i, event, pattern or None, regex, name, op, value, target, action, RANKS.get(priority, 99)))
    return spark.createDataFrame(out, "rule long, event_type string, pattern string, regex string, name string, op string, value long, target string, action string, rank int")


def routed(events: DataFrame, table: DataFrame, key: str, path: str = "path", otherwise: str = "tool_name", note: str = "annotation") -> DataFrame:
    """(key, rule, target, action, place): the rules each event meets, the most urgent first, rules of a rank in their order.

    A pattern is looked for in ``note`` of annotation events, and is a file pattern for
    ``path`` of all others, or for ``otherwise`` where the path is empty; columns that events
    lack count as empty. The table of rules is written by hand and small; it is broadcast.
    """

    def column(name: str, kind: str = "string") -> Column:
        return F.col(name).cast(kind) if name in events.columns else F.lit(None).cast(kind)

    met = events.join(F.broadcast(table.withColumnRenamed("value", "__value").withColumnRenamed("name", "__name")), "event_type")
    subject = F.coalesce(F.nullif(column(path), F.lit("")), column(otherwise))
    fits = F.when(F.col("event_type") == "annotation", F.contains(F.coalesce(column(note), F.lit("")), F.col("pattern"))).otherwise(F.regexp_like(subject, F.col("regex")))
    names = sorted(r["name"] for r in table.where("name <> ''").select("name").distinct().collect())
    holds = F.col("__name").isNull()
    for n in names:
        own = column(n, "long")
        test = F.lit(False)
        for op, compare in _OPS.items():
            test = F.when(F.col("op") == op, compare(own, F.col("__value"))).otherwise(test)
        holds = holds | ((F.col("__name") == n) & F.coalesce(test, F.lit(False)))
    out = met.where((F.col("pattern").isNull() | F.coalesce(fits, F.lit(False))) & holds).select(key, "rule", "target", "action", "rank")
    place = F.row_number().over(Window.partitionBy(key).orderBy("rank", "rule"))
    return out.withColumn("place", place.cast("long")).drop("rank")
