"""Building blocks for ordered data: chunks with halos, runs, exact percentiles, interval joins.

A signal may be one stream of any length, so no helper needs a whole stream in one task: rows are dealt by (stream_id,
chunk of idx). Windows of limited reach get the neighbours' edge rows; running states are carried over chunk by chunk
through one row for each chunk.
"""

from __future__ import annotations

import functools
import operator
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a stream that one task orders at a time.
CHUNK = 65_536


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table in the folder that driver and executors share (spark.checkpoint.dir).

    Used where a result is read several times: plans stay short, sizes are known, and a lost executor costs no lineage.
    """
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "/tmp/spliceflow-checkpoints"
    path = f"{top.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the table that cut() made, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if not folder.rsplit("/", 1)[-1].startswith("cut-"):
            raise ValueError(f"not a table of cut(): {folder}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def in_order(df: DataFrame, position: str, start: Callable[[], Any], schema: str) -> DataFrame:
    """Rows of each stream one after the other, through an object that start() makes for the stream.

    For definitions that are sequential: each stream goes to one task, in batches and by what the object holds, so memory
    doesn't grow with a stream. stream_id is df's first column. The object has next(row) and end(), which give lists of
    tuples of the schema's columns.
    """
    names = [f.name for f in df.schema]
    fields = [f.strip().split(" ") for f in schema.split(",")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, types[t]) for v, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, stream = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or row[0] != stream:
                    out += [] if held is None else held.end()
                    held, stream = start(), row[0]
                out += held.next(dict(zip(names, row, strict=True)))
            if out:
                yield packed(out)
        if held is not None and (out := list(held.end())):
            yield packed(out)

    return df.repartition("stream_id").sortWithinPartitions("stream_id", position).mapInArrow(run, schema)


def with_index(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "idx") -> DataFrame:
    """Number rows from 0 by `order` within keys. bucket: a coarse value that grows with the order, such as
    the minute; few enough rows of a key share one to be ordered in one task.

    Rows are numbered within (keys, bucket); what lies in earlier buckets is added from a table of counts.
    """
    df = df.withColumn("__bucket", bucket)
    counts = df.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order))
    return df.join(counts, [*keys, "__bucket"]).withColumn(name, (F.col("__before") + own - 1).cast("long")).drop("__bucket", "__before")


def in_line(df: DataFrame, position: str, *then: str) -> DataFrame:
    """Number rows as idx from 0 by position (a sample or a time; then by other columns), in parallel within a stream."""
    return with_index(cut(df), ["stream_id"], [position, *then], F.floor(F.col(position) / CHUNK))


def near(df: DataFrame, before: int, after: int, columns: dict[str, object], chunk: int = CHUNK) -> DataFrame:
    """Add columns that look at most `before` rows back and `after` rows on, in order of idx within stream_id.

    columns: name -> function(window) -> Column; window is ordered, for lag, lead and row frames. idx must have no holes.
    """
    own = F.floor(F.col("idx") / chunk)
    at = F.col("idx") - own * chunk
    # a row also stands in the next chunk as what lies before it, and in the previous one as what follows
    places = [own] + [F.when(at >= chunk - before, own + 1)] * (before > 0) + [F.when((at < after) & (own > 0), own - 1)] * (after > 0)
    dealt = df.withColumn("__own", own).withColumn("__chunk", F.explode(F.filter(F.array(*places), lambda x: x.isNotNull())))
    w = Window.partitionBy("stream_id", "__chunk").orderBy("idx")
    out = dealt.withColumns({name: f(w) for name, f in columns.items()})
    return out.where("__own = __chunk").drop("__own", "__chunk")


def last_before(df: DataFrame, value: Column, name: str, inclusive: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Add the last non-null value before this row (inclusive: up to it), in order of idx within stream_id.

    Within chunks it is a window; from one chunk to the next, the last value of each chunk is carried over.
    """
    df = df.withColumns({"__chunk": F.floor(F.col("idx") / chunk), "__value": value})
    known = F.when(F.col("__value").isNotNull(), F.col("idx"))
    chunks = df.groupBy("stream_id", "__chunk").agg(F.max_by("__value", known).alias("__last"))
    earlier = Window.partitionBy("stream_id").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("stream_id", "__chunk", F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
    w = Window.partitionBy("stream_id", "__chunk").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = df.join(chunks, ["stream_id", "__chunk"]).withColumn(name, F.coalesce(F.last("__value", ignorenulls=True).over(w), "__carried"))
    return out.drop("__chunk", "__value", "__carried")


def _running(df: DataFrame, value: Column, name: str, total: Callable[[str], Column], both: Callable[[Column, Column], Column], chunk: int) -> DataFrame:
    df = df.withColumns({"__chunk": F.floor(F.col("idx") / chunk), "__value": value})
    totals = df.groupBy("stream_id", "__chunk").agg(total("__value").alias("__total"))
    earlier = Window.partitionBy("stream_id").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("stream_id", "__chunk", total("__total").over(earlier).alias("__carried"))
    w = Window.partitionBy("stream_id", "__chunk").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(totals, ["stream_id", "__chunk"]).withColumn(name, both(total("__value").over(w), F.col("__carried")))
    return out.drop("__chunk", "__value", "__carried")


def running_sum(df: DataFrame, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """Add the sum of value over the rows up to this one, in order of idx within stream_id."""
    return _running(df, value, name, F.sum, lambda a, b: a + F.coalesce(b, F.lit(0)), chunk)


def running_max(df: DataFrame, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """Add the greatest value of the rows up to this one, in order of idx within stream_id."""
    return _running(df, value, name, F.max, F.greatest, chunk)


def runs(df: DataFrame, name: str = "run") -> DataFrame:
    """Number gap-free runs of idx within stream_id by their first idx. df: rows that passed a filter; idx has holes."""
    marked = last_before(cut(df), F.col("idx"), "__prev")
    new = F.col("__prev").isNull() | (F.col("idx") > F.col("__prev") + 1)
    return last_before(marked, F.when(new, F.col("idx")), name, inclusive=True).drop("__prev")


def percentiles(df: DataFrame, value: str, wanted: dict[str, float], keys: list[str] | None = None, at_place: bool = False) -> DataFrame:
    """Exact percentiles by linear interpolation: one row per key, one column for each name -> share (0 to 1).

    A mergeable sketch says between which two values each wanted rank lies, about a thousandth of a key's rows apart
    whatever the distribution; the rows below are counted, and only those between are looked at by value. Equal values
    count as one. Should a rank lie outside (the sketch promises that none does), the key is looked at more widely.
    at_place: no interpolation, but the value at place floor(share * rows), counted from 0.
    """
    keys = ["stream_id"] if keys is None else keys
    df = cut(df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v is not null and not isnan(__v)"))
    names, shares = list(wanted), list(wanted.values())
    found, left = None, None
    for width in (0.0004, 0.02, 1.0):
        # a bracket's ends are values; beyond the first and the last rank they are the least and the greatest one
        rows = df if left is None else df.join(left, keys, "left_semi")
        at = [max(p - width, 0.0) for p in shares] + [min(p + width, 1.0) for p in shares]
        sketch = rows.groupBy(*keys).agg(F.percentile_approx("__v", at, 20_000).alias("q"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count("*").alias("__n"))
        low = lambda i: F.col("lo") if at[i] <= 0 else F.get("q", F.lit(i))  # noqa: B023, E731
        high = lambda i: F.col("hi") if at[i + len(shares)] >= 1 else F.get("q", F.lit(i + len(shares)))  # noqa: B023, E731
        brackets = F.array(*[F.struct(F.lit(i).alias("i"), low(i).alias("a"), high(i).alias("b")) for i in range(len(names))])
        bounds = cut(sketch.select(*keys, "__n", brackets.alias("__brackets")))
        # each row tells each bracket that it lies below it, or shows its value; the others say nothing
        said = F.transform("__brackets", lambda x: F.when(F.col("__v") < x["a"], F.struct(x["i"].alias("i"), F.lit(None).cast("double").alias("v"))).when(F.col("__v") <= x["b"], F.struct(x["i"].alias("i"), F.col("__v").alias("v"))))
        told = rows.join(bounds.select(*keys, "__brackets"), keys).select(*keys, F.explode(F.filter(said, lambda x: x.isNotNull())).alias("s"))
        told = told.groupBy(*keys, F.col("s.i").alias("__i"), F.col("s.v").alias("__v")).agg(F.count("*").alias("__m"))
        # null values, all that lies below, come first
        upto = Window.partitionBy(*keys, "__i").orderBy(F.asc_nulls_first("__v")).rowsBetween(Window.unboundedPreceding, 0)
        told = told.withColumn("__upto", F.sum("__m").over(upto)).where("__v is not null")
        share = F.get(F.array(*[F.lit(float(p)) for p in shares]), F.col("__i"))
        rank = F.least(F.floor(F.col("__n") * share), F.col("__n") - 1).cast("double") if at_place else (F.col("__n") - 1) * share
        told = told.join(bounds.select(*keys, "__n"), keys).withColumn("__at", rank)
        under = F.col("__upto") - F.col("__m")
        holds = lambda r: (r >= under) & (r < F.col("__upto"))  # noqa: B023, E731
        part = F.col("__at") - F.floor("__at")
        weight = F.when(holds(F.floor("__at")), 1 - part).otherwise(0.0) + F.when(holds(F.ceil("__at")) & (part > 0), part).otherwise(0.0)
        mine = lambda i, c: F.sum(F.when(F.col("__i") == i, c))
        sums = told.withColumn("__w", weight).where("__w > 0").groupBy(*keys).agg(*[mine(i, F.col("__v") * F.col("__w")).alias(n) for i, n in enumerate(names)], *[mine(i, F.col("__w")).alias(f"__w{i}") for i in range(len(names))])
        whole = functools.reduce(operator.and_, (F.coalesce(F.abs(F.col(f"__w{i}") - 1) < 1e-9, F.lit(False)) for i in range(len(names))))
        out = cut(bounds.select(*keys).join(sums, keys, "left").withColumn("__whole", whole))
        good = out.where("__whole").select(*keys, *names)
        found = good if found is None else found.unionByName(good)
        left = out.where("not __whole").select(*keys)
        if left.isEmpty():
            break
    return found


def interval_join(points: DataFrame, spans: DataFrame, width: int, how: str = "inner") -> DataFrame:
    """points (stream_id, idx) with the spans (stream_id, i0, i1: half open) that hold them.

    Spans are listed under each block of `width` idx that they touch, so this is an equi-join with a check.
    """
    blocks = F.explode(F.sequence(F.floor(F.col("i0") / width), F.floor((F.col("i1") - 1) / width)))
    spans = spans.where("i1 > i0").withColumn("__block", blocks).withColumnRenamed("stream_id", "__stream")
    points = points.withColumn("__at", F.floor(F.col("idx") / width))
    on = (F.col("stream_id") == F.col("__stream")) & (F.col("__at") == F.col("__block")) & (F.col("idx") >= F.col("i0")) & (F.col("idx") < F.col("i1"))
    return points.join(spans, on, how).drop("__at", "__block", "__stream")
