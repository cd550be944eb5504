"""K-means on any number of rows of a stream, as rounds of sums over Spark.

Random draws are NumPy's, from a fixed seed and the number of rows, and name rows by their rank in order of seg_id. So
labels are those of the same method on one machine, up to ties and the rounding of sums. A stream's centers are one row
of a small table, which each round writes anew; streams whose labels no longer change rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spliceflow.helpers import cut, discard, in_line, percentiles, running_sum

POINT = "array<double>"
#: Rounds that are planned as one job.
AT_ONCE = 4


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, d: acc + d)


def _nearest(v: Column, centers: Column) -> Column:
    """The position of the nearest center, from 0; the first among equals."""
    best = F.array_min(F.transform(centers, lambda c, i: F.struct(_distance(v, c).alias("d"), i.alias("i"))))
    return best["i"]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _legacy_draws(n: pd.Series, k: pd.Series) -> pd.Series:
    """A row's rank, then shares of a total: what k-means++ draws for k of n rows."""

    def draw(n: int, k: int) -> list[float]:
        rng = np.random.RandomState(42)
        return [float(rng.randint(n)), *rng.random_sample(k - 1).tolist()]

    return pd.Series([draw(int(a), int(b)) for a, b in zip(n, k, strict=True)])


def _draws(seed: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def drawn(n: pd.Series, k: pd.Series, more: pd.Series) -> pd.Series:
        """Ranks of k different rows, then of `more` rows for clusters that come out empty."""

        def draw(n: int, k: int, more: int) -> list[int]:
            rng = np.random.default_rng(seed)
            return [*rng.choice(n, min(k, n), replace=False).tolist(), *(int(rng.integers(0, n)) for _ in range(more))]

        return pd.Series([draw(int(a), int(b), int(c)) for a, b, c in zip(n, k, more, strict=True)])

    return drawn


def _at_ranks(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """stream_id, points: the rows' v at ranks(stream_id, ranks: array), in the array's order."""
    each = ranks.select("stream_id", F.posexplode("ranks").alias("pos", "idx"))
    found = each.join(rows.select("stream_id", "idx", "v"), ["stream_id", "idx"])
    return found.groupBy("stream_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("points"))


def seeded(rows: DataFrame, streams: DataFrame) -> DataFrame:
    """stream_id, c: centers by k-means++. rows: stream_id, idx, v; streams: stream_id, n, k.

    The first is a random row; each next one is drawn with weights by the squared distance to the nearest center, that is,
    the first row at which the running sum of weights exceeds a random share of the total. Where all weights are 0, there
    are no more centers.
    """
    streams = cut(streams.select("stream_id", "k", _legacy_draws("n", "k").alias("draws")))
    first = _at_ranks(rows, streams.select("stream_id", F.array(F.get("draws", F.lit(0)).cast("long")).alias("ranks")))
    found = cut(streams.join(first, "stream_id").select("stream_id", "k", "draws", F.col("points").alias("c")))
    most = streams.agg(F.max("k")).first()[0] or 0
    for i in range(1, most):
        weight = F.array_min(F.transform("c", lambda c: _distance(F.col("v"), c)))
        going = rows.join(found.where((F.col("k") > i) & (F.size("c") == i)).select("stream_id", "c", F.get("draws", F.lit(i)).alias("u")), "stream_id")
        going = cut(going.select("stream_id", "idx", "u", weight.alias("w")))
        total = going.groupBy("stream_id").agg(F.sum("w").alias("total")).where("total > 0")
        hit = running_sum(going, F.col("w"), "upto").join(total, "stream_id").where("upto > u * total and w > 0")
        chosen = hit.groupBy("stream_id").agg(F.array(F.min("idx")).alias("ranks"))
        points = _at_ranks(rows, chosen)
        found = cut(found.join(points, "stream_id", "left").select("stream_id", "k", "draws", F.when(F.col("points").isNull(), F.col("c")).otherwise(F.concat("c", "points")).alias("c")))
    return found.select("stream_id", "c")


def _round(rows: DataFrame, state: DataFrame, size: int, points: DataFrame | None) -> DataFrame:
    """state (stream_id, c: centers, used: those of the round before, drawn, rests) after one more round."""
    pairs = rows.join(state.where("not rests").select("stream_id", "c", "used"), "stream_id")
    label = _nearest(F.col("v"), F.col("c"))
    before = F.coalesce(_nearest(F.col("v"), F.col("used")), F.lit(0))
    each = pairs.select("stream_id", "v", label.alias("label"), (label != before).cast("long").alias("moved"))
    sums = each.groupBy("stream_id", "label").agg(F.sum("moved").alias("moved"), *[F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(size)])
    mean = F.struct("label", F.array(*[f"m{i}" for i in range(size)]).alias("m"))
    found = sums.groupBy("stream_id").agg(F.sum("moved").alias("moved"), F.collect_list(mean).alias("means"))
    nxt = state.join(found, "stream_id", "left")
    nxt = nxt.withColumn("empty", F.filter(F.sequence(F.lit(0), F.size("c") - 1), lambda i: ~F.exists("means", lambda m: m["label"] == i)))
    old = lambda c, i: c
    if points is not None:
        nxt = nxt.join(points, "stream_id", "left")
        old = lambda c, i: F.when(F.array_contains(F.col("empty"), i), F.get("points", (F.col("drawn") + F.array_position(F.col("empty"), i) - 1).cast("int"))).otherwise(c)
    moved = F.transform("c", lambda c, i: F.coalesce(F.get(F.filter("means", lambda m: m["label"] == i), F.lit(0))["m"], old(c, i)))
    goes = ~F.col("rests") & (F.col("moved") > 0)
    return nxt.select(
        "stream_id", F.when(goes, moved).otherwise(F.col("c")).alias("c"), F.when(F.col("rests"), F.col("used")).otherwise(F.col("c")).alias("used"),
        F.when(goes, F.col("drawn") + F.size("empty")).otherwise(F.col("drawn")).cast("int").alias("drawn"), (~F.coalesce(goes, F.lit(False))).alias("rests"),
    )


def lloyd(rows: DataFrame, centers: DataFrame, rounds: int, size: int, reserve=None) -> DataFrame:
    """rows with label, the position of the nearest center after at most `rounds` rounds. centers: stream_id, c.

    rows: stream_id, v (of `size` values), written already. Labels start as 0; a stream rests once a round changes none.
    A cluster that comes out empty keeps its center, or, with reserve, takes the next of the stream's random rows:
    reserve(m) gives stream_id, points with m of them for each stream.
    """
    state = cut(centers.select("stream_id", "c", F.lit(None).cast(f"array<{POINT}>").alias("used"), F.lit(0).alias("drawn"), F.lit(False).alias("rests")))
    held, points = 0, None
    for turn in range(0, rounds, AT_ONCE):
        if reserve is not None:
            need = state.where("not rests").agg(F.max(F.col("drawn") + AT_ONCE * F.size("c"))).first()[0] or 0
            if need > held:
                held = 2 * need
                points = cut(reserve(held))
        last, state = state, state
        for _ in range(turn, min(turn + AT_ONCE, rounds)):
            state = _round(rows, state, size, points)
        state = cut(state)
        discard(last)
        if state.where("not rests").isEmpty():
            break
    return rows.join(state.select("stream_id", "used"), "stream_id").withColumn("label", _nearest(F.col("v"), F.col("used"))).drop("used")


def by_mean(labelled: DataFrame, value: str) -> DataFrame:
    """Labels that occur are renumbered from 0 by the mean of value; the lower label first among equals."""
    means = labelled.groupBy("stream_id", "label").agg(F.avg(value).alias("__m"))
    order = F.row_number().over(Window.partitionBy("stream_id").orderBy("__m", "label")) - 1
    return labelled.join(means.select("stream_id", "label", order.cast("int").alias("__new")), ["stream_id", "label"]).drop("label").withColumnRenamed("__new", "label")


def labelled_pp(segs: DataFrame, names: list[str], clusters: int | None = None) -> DataFrame:
    """segs with label: k-means++ on min-max scaled columns (first: centroid, fourth: zero crossings), labels by mean centroid.

    Seeded with 42 in the legacy generator. As many clusters as rows or more give one label per row, in order of seg_id;
    rows that are all equal give one label.
    """
    given = segs.withColumns({f"__{i}": F.col(c).cast("double") for i, c in enumerate(names)})
    given = cut(in_line(given, "seg_id"))
    span = [F.max(f"__{i}") - F.min(f"__{i}") for i in range(len(names))]
    wide = (span[0] > 3000) | ((span[3] > 0.1) if len(names) > 3 else F.lit(False))
    k = F.when(wide, 3).otherwise(2) if clusters is None else F.lit(clusters)
    streams = cut(given.groupBy("stream_id").agg(F.count("*").alias("n"), k.alias("k"), F.array(*[F.min(f"__{i}") for i in range(len(names))]).alias("lo"), F.array(*span).alias("span")))
    one = lambda i: F.when(F.get("span", F.lit(i)) > 0, (F.col(f"__{i}") - F.get("lo", F.lit(i))) / F.get("span", F.lit(i))).otherwise(F.col(f"__{i}"))
    many = streams.where("k < n")
    rows = cut(given.join(many, "stream_id").select("stream_id", "idx", F.array(*[one(i) for i in range(len(names))]).alias("v")))
    found = lloyd(rows, seeded(rows, many.select("stream_id", "n", "k")), 100, len(names)).select("stream_id", "idx", F.col("label").cast("int").alias("label"))
    found = cut(found)
    out = given.drop(*[f"__{i}" for i in range(1, len(names))])
    many = by_mean(out.join(found, ["stream_id", "idx"]), "__0").drop("__0", "idx")
    few = out.join(streams.where("k >= n").select("stream_id"), "stream_id", "left_semi").withColumn("label", F.col("idx").cast("int")).drop("__0", "idx")
    return many.unionByName(few).select(*segs.columns, "label")


def labelled_levels(segs: DataFrame, columns: tuple[str, str], clusters: int | None = None, seed: int = 7, rounds: int = 60) -> DataFrame:
    """segs with label: k-means on (centroid in Hz, level in dB) in units of median absolute deviations, from random rows.

    Clusters that come out empty start anew from random rows. Labels are not merged or ordered yet.
    """
    given = cut(in_line(segs.withColumns({f"__{i}": F.col(c).cast("double") for i, c in enumerate(columns)}), "seg_id"))

    def bounds(rows: DataFrame, wanted: dict[str, float]) -> DataFrame:
        long = rows.select("stream_id", F.posexplode(F.array("__0", "__1")).alias("name", "v"))
        found = percentiles(long, "v", wanted, ["stream_id", "name"])
        return found.groupBy("stream_id").agg(*[F.max(F.when(F.col("name") == i, F.col(w))).alias(f"{w}{i}") for w in wanted for i in range(2)])

    mid = bounds(given, {"mid": 0.5, "low": 0.1, "high": 0.9})
    apart = given.join(mid, "stream_id")
    dev = bounds(apart.select("stream_id", *[F.abs(F.col(f"__{i}") - F.col(f"mid{i}")).alias(f"__{i}") for i in range(2)]), {"mad": 0.5})
    scaled = F.array(*[(F.col(f"__{i}") - F.col(f"mid{i}")) / (1.4826 * F.col(f"mad{i}") + 1e-9) for i in range(2)])
    rows = cut(apart.join(dev, "stream_id").select("stream_id", "idx", scaled.alias("v")))
    k = F.when(F.col("high0") - F.col("low0") > 1500, 3).otherwise(2) if clusters is None else F.lit(clusters)
    streams = cut(given.groupBy("stream_id").agg(F.count("*").alias("n")).join(mid, "stream_id").select("stream_id", "n", k.alias("k")))
    draws = _draws(seed)
    ranks = lambda more: streams.select("stream_id", F.least("k", "n").alias("kept"), draws("n", "k", F.lit(more)).alias("r"))
    start = _at_ranks(rows, ranks(0).select("stream_id", F.col("r").alias("ranks"))).withColumnRenamed("points", "c")
    reserve = lambda m: _at_ranks(rows, ranks(m).select("stream_id", F.slice("r", F.col("kept").cast("int") + 1, F.lit(m)).alias("ranks")))
    found = cut(lloyd(rows, start, rounds, 2, reserve).select("stream_id", "idx", F.col("label").cast("int").alias("label")))
    return given.join(found, ["stream_id", "idx"]).select(*segs.columns, "label")
