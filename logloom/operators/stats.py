"""Grouped counters: totals, successes, rates and top-N by stage and dimensions, and checks of sink ratios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compare import filter_expression, record


@dataclass(frozen=True)
class Request:
    """What to count: a stage name, dimension columns, a success condition, a target (all, ignore or one rule), top-N."""

    name: str
    stage: str = "pick"
    collect: tuple[str, ...] = ()
    target: str = "all"
    top: int | None = None


def counters(df: DataFrame, request: Request, success: Column | None = None, at: str | None = None, rule: str = "rule", window: str | None = None) -> DataFrame:
    """stage, name, target, dimensions, total, success, suc_rate, and beg_time, end_time and speed where ``at`` names a time.

    A missing dimension shows as ``*``. ``suc_rate`` is a percentage, 0 without rows. ``speed`` is
    total / (milliseconds + 1) * 1000 / 10000. ``window`` groups by tumbling windows of that length too.
    """
    if request.target == "ignore":
        df = df.limit(0)
    elif request.target != "all":
        df = df.where(F.col(rule) == request.target)
    good = F.coalesce(success, F.lit(False)) if success is not None else F.lit(True)
    dims = [(F.coalesce(F.col(f"`{d}`").cast("string"), F.lit("*")) if d in df.columns else F.lit("*")).alias(d) for d in request.collect]
    keys = [*dims, *([F.window(at, window).alias("slice")] if window and at else [])]
    sums = [F.count(F.lit(1)).alias("total"), F.sum(F.when(good, 1).otherwise(0)).cast("long").alias("success")]
    if at:
        sums += [F.min(at).alias("beg_time"), F.max(at).alias("end_time")]
    out = df.groupBy(*keys).agg(*sums) if keys else df.agg(*sums).where("total > 0")
    head = [F.lit(request.stage).alias("stage"), F.lit(request.name).alias("name"), F.lit(request.target).alias("target")]
    names = [*request.collect, *(["slice"] if window and at else [])]
    rate = F.when(F.col("total") == 0, 0.0).otherwise(F.col("success") * 100.0 / F.col("total")).alias("suc_rate")
    tail = []
    if at:
        ms = F.timestamp_diff("MILLISECOND", F.col("beg_time"), F.col("end_time"))
        tail = ["beg_time", "end_time", (F.col("total") / (ms + 1) * 1000 / 10000).alias("speed")]
    out = out.select(*head, *names, "total", F.coalesce("success", F.lit(0)).cast("long").alias("success"), rate, *tail)
    return top_n(out, request.top, request.collect) if request.top else out


def top_n(df: DataFrame, most: int, dims: Sequence[str] = ()) -> DataFrame:
    """The 2 x ``most`` largest totals, exact; ties by dimensions."""
    return df.orderBy(F.desc("total"), *dims).limit(2 * most)


def merge(parts: Sequence[DataFrame], dims: Sequence[str]) -> DataFrame:
    """Adds up counters of several reports by their keys."""
    keys = ["stage", "name", "target", *dims]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    out = both.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("success").alias("success"))
    return out.withColumn("suc_rate", F.when(F.col("total") == 0, 0.0).otherwise(F.col("success") * 100.0 / F.col("total")))


def alert(df: DataFrame, condition: str, severity: str, prompt: str) -> DataFrame:
    """Counter rows that meet a filter expression, with severity and prompt."""
    return df.where(filter_expression(condition, record(df))).withColumns({"severity": F.lit(severity), "prompt": F.lit(prompt)})


@dataclass(frozen=True)
class Expect:
    """What share of all rows a sink should get: ``ratio`` within ``tol``, or between ``least`` and ``most``."""

    ratio: float | None = None
    tol: float = 0.0
    least: float | None = None
    most: float | None = None


def check_ratios(counts: DataFrame, expects: Mapping[str, Expect], min_samples: int = 0, others_most: float | None = None, sum_tol: float | None = None) -> DataFrame:
    """sink, rows, ratio, ok, reason for each sink of (sink, rows), from the counts and their sum.

    Fewer rows than ``min_samples`` in all: nothing fails. Sinks without an expectation share ``others_most``;
    ``sum_tol`` bounds how far the ratios' sum may be from 1, with the row named ``*``.
    """
    spark = counts.sparkSession
    given = spark.createDataFrame([(k, e.ratio, e.tol, e.least, e.most) for k, e in expects.items()] or [(None,) * 5], "sink string, want double, tol double, least double, most double").where("sink IS NOT NULL")
    total = counts.agg(F.sum("rows")).first()[0] or 0
    joined = counts.join(given, "sink", "full_outer").withColumn("_all", F.lit(total))
    share = F.when(F.col("_all") > 0, F.coalesce("rows", F.lit(0)) / F.col("_all")).otherwise(0.0)
    off = (F.when(F.col("_all") < min_samples, F.lit(None)).when(F.col("want").isNotNull() & (F.abs(F.col("ratio") - F.col("want")) > F.col("tol") + 1e-12), "ratio")
           .when(F.col("least").isNotNull() & (F.col("ratio") < F.col("least")), "below least").when(F.col("most").isNotNull() & (F.col("ratio") > F.col("most")), "above most"))
    if others_most is not None:
        known = F.col("want").isNotNull() | F.col("least").isNotNull() | F.col("most").isNotNull()
        off = F.coalesce(off, F.when((F.col("_all") >= min_samples) & ~known & (F.col("ratio") > others_most), "others"))
    out = joined.withColumn("ratio", share).withColumn("reason", off)
    out = out.select("sink", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "ratio", F.col("reason").isNull().alias("ok"), "reason")
    if sum_tol is not None:
        named = out.where(F.col("sink").isin(list(expects)))
        whole = named.agg(F.sum("rows").alias("rows"), F.coalesce(F.sum("ratio"), F.lit(0.0)).alias("ratio"))
        good = F.abs(F.col("ratio") - 1) <= sum_tol + 1e-12
        out = out.unionByName(whole.select(F.lit("*").alias("sink"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "ratio", good.alias("ok"), F.when(~good, "sum").alias("reason")))
    return out
