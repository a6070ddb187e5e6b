"""Capital flows between four asset classes, and the pairs they are read from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.indicators import macd
from barloom.operators.bars import PRICES
from barloom.operators.layers import Settings, layer

VERTICES = ("EQUITY", "REAL_ESTATE", "COMMODITY", "CASH")
A_TO_B, B_TO_A, EQUILIBRIUM = "A_TO_B", "B_TO_A", "EQUILIBRIUM"

#: Defaults of pair validation.
MIN_OVERLAP, MIN_BARS, CV, STROKE, DYNAMICS = 5, 30, 0.01, 0.005, 0.0001


def matrix(spark: SparkSession, representatives: dict[str, str] | None = None) -> DataFrame:
    """The six edges of the complete graph of the classes: vertex_a, vertex_b, description, and an instrument that stands for each end.

    An unknown class in ``representatives`` raises ValueError.
    """
    chosen = representatives or {}
    if unknown := set(chosen) - set(VERTICES):
        raise ValueError(f"unknown classes: {', '.join(sorted(unknown))}")
    rows = [(a, b, f"{a} against {b}", chosen.get(a), chosen.get(b)) for i, a in enumerate(VERTICES) for b in VERTICES[i + 1 :]]
    return spark.createDataFrame(rows, "vertex_a string, vertex_b string, description string, instrument_a string, instrument_b string")


def stroke_flows(strokes: DataFrame) -> DataFrame:
    """Flow of each stroke of a ratio A/B: up, capital moves from B to A, down from A to B.

    magnitude is |p1 - p0| / |p0|; a stroke that starts at 0 raises.
    """
    up = F.col("direction") == "up"
    size = F.when(F.col("p0") == 0, F.raise_error(F.lit("stroke starts at price 0"))).otherwise(F.abs(F.col("p1") - F.col("p0")) / F.abs("p0"))
    return strokes.withColumns(
        {"flow": F.when(up, B_TO_A).otherwise(A_TO_B), "from_side": F.when(up, "B").otherwise("A"), "to_side": F.when(up, "A").otherwise("B"), "magnitude": size}
    )


def _sign(direction: Column) -> Column:
    """+1 when capital reaches vertex_a."""
    return F.when(direction == B_TO_A, 1).when(direction == A_TO_B, -1).when(direction == EQUILIBRIUM, 0).otherwise(F.raise_error(F.concat(F.lit("unknown direction "), direction)))


def _strength(net: Column) -> Column:
    return F.when(F.abs(net) >= 3, "strong").when(F.abs(net) == 2, "weak").otherwise("none")


def vertex_flows(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Net flow of each vertex for every group of ``keys``: six different edges a group, or it raises.

    edges: keys, vertex_a, vertex_b, direction. Returns keys, vertex, net, strength (3 of
    three edges is strong, 2 weak) and role (sink, source, neutral).
    """
    ends = F.array(
        F.struct(F.col("vertex_a").alias("vertex"), _sign(F.col("direction")).alias("s")), F.struct(F.col("vertex_b").alias("vertex"), (-_sign(F.col("direction"))).alias("s"))
    )
    edge = F.concat_ws("|", F.least("vertex_a", "vertex_b"), F.greatest("vertex_a", "vertex_b"))
    loop = F.when(F.col("vertex_a") == F.col("vertex_b"), F.raise_error(F.lit("edge from a vertex to itself"))).otherwise(edge)
    each = edges.select(*keys, F.explode(ends).alias("x"), loop.alias("edge")).select(*keys, "x.*", "edge")
    # a vertex of the complete graph has three edges; any gap or repeat shows at one of them
    seen = each.groupBy(*keys, "vertex").agg(F.sum("s").cast("long").alias("net"), F.count("*").alias("n"), F.size(F.collect_set("edge")).alias("d"))
    checked = F.when((F.col("n") != 3) | (F.col("d") != 3), F.raise_error(F.lit("needs six different edges"))).otherwise(F.col("net"))
    return seen.select(*keys, "vertex", checked.alias("net")).select(
        "*", _strength(F.col("net")).alias("strength"), F.when(F.col("net") > 0, "sink").when(F.col("net") < 0, "source").otherwise("neutral").alias("role")
    )


def resonance(states: DataFrame) -> DataFrame:
    """The state of every vertex with its strength: 3 of three edges is strong, 2 weak, less none. Adds ``resonates``, whether two or more agree."""
    return states.withColumn("resonates", F.col("strength") != "none")


def imbalance(states: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose net flows do not cancel: no rows if all is well."""
    return states.groupBy(*keys).agg(F.sum("net").alias("total")).where("total <> 0")


def flow_timeline(events: DataFrame, order: list[str], graphs: tuple[str, ...] = ()) -> DataFrame:
    """After every edge event, the net flow of all four vertices: graphs, order columns, vertex, net, strength.

    Each edge keeps its last direction; an edge given the other way round is turned. Events
    of unknown edges change nothing but still have their rows. The events of a graph are one
    sequence; ``graphs`` are the columns that tell graphs apart, which are ordered apart.
    """
    turn = F.col("vertex_a") > F.col("vertex_b")
    sign = F.when(F.col("direction") == EQUILIBRIUM, F.lit(0)).otherwise(F.when(turn, -_sign(F.col("direction"))).otherwise(_sign(F.col("direction"))))
    e = events.select(*graphs, *order, F.least("vertex_a", "vertex_b").alias("a"), F.greatest("vertex_a", "vertex_b").alias("b"), sign.alias("s"))
    upto = Window.partitionBy(*graphs).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = sorted(VERTICES)
    edges = [(x, y) for i, x in enumerate(known) for y in known[i + 1 :]]
    state = e.select(*graphs, *order, *[F.coalesce(F.last(F.when((F.col("a") == x) & (F.col("b") == y), F.col("s")), ignorenulls=True).over(upto), F.lit(0)).alias(f"{x}__{y}") for x, y in edges])
    nets = [F.struct(F.lit(v).alias("vertex"), sum((F.col(f"{x}__{y}") * (1 if x == v else -1) for x, y in edges if v in (x, y)), F.lit(0)).cast("long").alias("net")) for v in VERTICES]
    return state.select(*graphs, *order, F.explode(F.array(*nets)).alias("v")).select(*graphs, *order, "v.*").withColumn("strength", _strength(F.col("net")))


def cash_signal(edges: DataFrame, keys: list[str]) -> DataFrame:
    """What a net flow of cash means, by how the edges between the other classes point.

    Six edges a group, as in vertex_flows. Returns keys, cash_net, variance (population, of the
    directions of the three edges without cash as +1, -1 and 0 as they are given; 0 when cash
    is flat), signal and confidence: neutral when cash is flat; a shift of the measure when the
    edges agree; a genuine flow when their variance is over half its largest (8/9); else mixed.
    """
    states = vertex_flows(edges, keys)
    cash = states.where("vertex = 'CASH'").select(*keys, F.col("net").alias("cash_net"))
    asset = edges.where("vertex_a <> 'CASH' and vertex_b <> 'CASH'").groupBy(*keys).agg(F.var_pop(-_sign(F.col("direction"))).alias("v"))
    share = F.least(F.col("v") / F.lit(8.0 / 9.0), F.lit(1.0))
    flat, alike = F.col("cash_net") == 0, F.col("v") == 0
    return cash.join(asset, keys).select(
        *keys, "cash_net", F.when(flat, 0.0).otherwise(F.col("v")).alias("variance"),
        F.when(flat, "neutral").when(alike, "metric_shift").when(share > 0.5, "genuine_flow").otherwise("mixed").alias("signal"),
        F.when(flat | alike, 1.0).when(share > 0.5, share).otherwise(0.5).alias("confidence"),
    )


def pair_ratios(paired: DataFrame) -> DataFrame:
    """Ratio bars of every pair of bars.pairs: stream_id is the pair."""
    return paired.select(F.col("pair_id").alias("stream_id"), "ts", *[F.try_divide(F.col(c), F.col(f"b_{c}")).alias(c) for c in PRICES], *[c for c in ("volume",) if c in paired.columns])


def validate_pairs(
    paired: DataFrame, zero: DataFrame | None = None, min_overlap: int = MIN_OVERLAP, cv: float = CV, stroke: float = STROKE, dynamics: float = DYNAMICS, settings: Settings = Settings(raw_gaps=False)
) -> DataFrame:
    """One row a pair: whether its ratio moves enough to be worth reading.

    In order: a price of 0 in b, too few common bars, a ratio that hardly varies, strokes that
    are too small, a MACD that is too flat. Ratios under MIN_BARS bars pass after the second
    test, ratios without strokes after the third. Only pairs that are still open run the
    later, dearer tests. ``zero``: streams with a zero open or close anywhere, if known;
    otherwise zeros are looked for among the common bars.

    (pair_id, valid, reason, n_bars, cv, n_strokes, stroke_mean, macd_norm)
    """
    closes = F.try_divide(F.col("close"), F.col("b_close"))
    nought = (F.col("b_close") == 0) | (F.col("b_open") == 0)
    base = paired.groupBy("pair_id").agg(
        F.count("*").alias("n_bars"), F.max(F.when(nought, 1).otherwise(0)).alias("nought"), F.avg(closes).alias("mean"), F.stddev_pop(closes).alias("std"), F.first("b").alias("b")
    )
    if zero is not None:
        base = base.join(zero.select(F.col("stream_id").alias("b"), F.lit(1).alias("z")), "b", "left").withColumn("nought", F.greatest("nought", F.coalesce("z", F.lit(0)))).drop("z")
    base = base.withColumn("cv", F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).otherwise(F.lit(0.0)))
    early = F.when(F.col("nought") == 1, "zero price in b").when(F.col("n_bars") < min_overlap, "insufficient overlap").when(F.col("cv") < cv, "degenerate ratio")
    base = base.withColumn("early", early).withColumn("open", F.col("early").isNull() & (F.col("n_bars") >= MIN_BARS))
    ratios = pair_ratios(paired.join(base.where("open").select("pair_id"), "pair_id", "left_semi"))
    strokes = layer(ratios, "strokes", settings).groupBy("stream_id").agg(
        F.count("*").alias("n_strokes"), F.coalesce(F.avg(F.abs(F.try_divide("p1", "p0") - 1)), F.lit(0.0)).alias("stroke_mean")
    )
    hist = macd(ratios).groupBy("stream_id").agg(F.avg(F.abs("hist")).alias("h"))
    both = base.join(strokes.withColumnRenamed("stream_id", "pair_id"), "pair_id", "left").join(hist.withColumnRenamed("stream_id", "pair_id"), "pair_id", "left")
    both = both.withColumn("n_strokes", F.when(F.col("open"), F.coalesce("n_strokes", F.lit(0)))).withColumn("macd_norm", F.try_divide(F.col("h"), F.col("mean")))
    late = F.when(F.col("open") & (F.col("n_strokes") > 0), F.when(F.col("stroke_mean") < stroke, "structure degenerate").when(F.col("macd_norm") < dynamics, "dynamics degenerate"))
    reason = F.coalesce("early", late)
    return both.select(
        "pair_id", reason.isNull().alias("valid"), reason.alias("reason"), "n_bars", F.when(F.col("early").isNull() | (F.col("early") == "degenerate ratio"), F.col("cv")).alias("cv"),
        "n_strokes", F.when(F.col("n_strokes") > 0, F.col("stroke_mean")).alias("stroke_mean"), F.when(F.coalesce(F.col("n_strokes") > 0, F.lit(False)) & (F.col("stroke_mean") >= stroke), F.col("macd_norm")).alias("macd_norm"),
    )


def zero_streams(bars: DataFrame) -> DataFrame:
    """Streams that open or close at 0 anywhere: nothing can be divided by them."""
    return bars.where("open = 0 or close = 0").select("stream_id").distinct()


def ratio_structure(paired: DataFrame, zero: DataFrame | None = None, settings: Settings = Settings(raw_gaps=False)) -> DataFrame:
    """Validation and, for valid pairs, the number of strokes and segments of the ratio; invalid ones carry their reason."""
    checked = validate_pairs(paired, zero, settings=settings)
    ratios = pair_ratios(paired.join(checked.where("valid").select("pair_id"), "pair_id", "left_semi"))
    segments = layer(ratios, "segments", settings).groupBy(F.col("stream_id").alias("pair_id")).agg(F.count("*").alias("n_segments"))
    return checked.join(segments, "pair_id", "left").select("pair_id", "valid", F.col("reason").alias("error"), "n_bars", "n_strokes", F.when(F.col("valid"), F.coalesce("n_segments", F.lit(0))).alias("n_segments"))


def edge_directions(bars: DataFrame, of_class: dict[str, str], graphs: tuple[str, ...] = ()) -> DataFrame:
    """Direction of each of the six edges at each time all classes have bars: how the ratio of closes moved since the time before.

    ``of_class`` names the stream that stands for each class; ``graphs`` are columns of bars
    that tell graphs apart. (graphs, ts, vertex_a, vertex_b, direction)
    """
    names = [(a, b) for i, a in enumerate(VERTICES) for b in VERTICES[i + 1 :]]
    wide = bars.groupBy(*graphs, "ts").agg(*[F.max(F.when(F.col("stream_id") == of_class[v], F.col("close"))).alias(v) for v in VERTICES]).dropna()
    before = Window.partitionBy(*graphs).orderBy("ts")
    wide = wide.select(*graphs, "ts", *VERTICES, *[F.lag(v).over(before).alias(f"p_{v}") for v in VERTICES]).dropna()

    def direction(a: str, b: str) -> Column:
        # closes are whole and positive: a/b rose if a * previous b > previous a * b
        now, then = F.col(a) * F.col(f"p_{b}"), F.col(f"p_{a}") * F.col(b)
        return F.when(now > then, B_TO_A).when(now < then, A_TO_B).otherwise(EQUILIBRIUM)

    edges = F.array(*[F.struct(F.lit(a).alias("vertex_a"), F.lit(b).alias("vertex_b"), direction(a, b).alias("direction")) for a, b in names])
    return wide.select(*graphs, "ts", F.explode(edges).alias("e")).select(*graphs, "ts", "e.*")


__all__ = [
    "VERTICES", "cash_signal", "edge_directions", "flow_timeline", "imbalance", "matrix", "pair_ratios", "ratio_structure", "resonance", "stroke_flows", "validate_pairs", "vertex_flows", "zero_streams",
]
