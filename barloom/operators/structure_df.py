"""Structure rules that are plain window expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.layers import Settings, layers


def fractals(merged: DataFrame) -> DataFrame:
    """Tops and bottoms of merged bars by their neighbours: stream_id, m_idx, kind, price."""
    w = Window.partitionBy("stream_id").orderBy("idx")
    m = merged.select("stream_id", F.col("idx").alias("m_idx"), "high", "low", *[f(c).over(w).alias(n) for f, c, n in ((F.lag, "high", "ph"), (F.lag, "low", "pl"), (F.lead, "high", "nh"), (F.lead, "low", "nl"))])
    top = (F.col("high") > F.col("ph")) & (F.col("high") > F.col("nh")) & (F.col("low") > F.col("pl")) & (F.col("low") > F.col("nl"))
    bottom = (F.col("low") < F.col("pl")) & (F.col("low") < F.col("nl")) & (F.col("high") < F.col("ph")) & (F.col("high") < F.col("nh"))
    kind = F.when(top, "top").when(bottom, "bottom")
    return m.withColumn("kind", kind).where("kind is not null").select("stream_id", "m_idx", "kind", F.when(F.col("kind") == "top", F.col("high")).otherwise(F.col("low")).alias("price"))


def alternating(found: DataFrame) -> DataFrame:
    """Of fractals of a kind in a row only the most extreme, of equals the first."""
    w = Window.partitionBy("stream_id").orderBy("m_idx")
    runs = found.withColumn("__new", (F.lag("kind").over(w) != F.col("kind")).cast("int"))
    runs = runs.withColumn("__run", F.sum(F.coalesce("__new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    extreme = F.when(F.col("kind") == "top", -F.col("price")).otherwise(F.col("price"))
    best = Window.partitionBy("stream_id", "__run").orderBy(extreme, "m_idx")
    return runs.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n", "__run", "__new")


def counts(bars: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """How many entries each layer of each stream has; one pass over the bars."""
    names = ("fractals", "strokes", "segments", "zhongshus", "moves", "centers", "trends")
    return layers(bars, names, settings).groupBy("stream_id", "layer", "level").agg(F.count("*").alias("n"))


def search(catalog: DataFrame, text: str, columns: list[str], limit: int | None = None) -> DataFrame:
    """Rows whose columns, joined and in upper case, hold ``text``; by symbol, the first ``limit`` if given."""
    found = catalog.where(F.contains(F.upper(F.concat_ws(" ", *columns)), F.lit(text.strip().upper())))
    return found.orderBy("symbol").limit(limit) if limit else found


def merged_search(cached: DataFrame, catalog: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Matches among cached names first, then catalog ones; each symbol once."""
    both = [search(df, text, columns).withColumn("__rank", F.lit(i)) for i, df in enumerate((cached, catalog))]
    best = Window.partitionBy("symbol").orderBy("__rank")
    return reduce(DataFrame.unionByName, both).withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n", "__rank")
