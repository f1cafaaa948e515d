"""Exact order statistics by distributed selection: bracket the wanted ranks, count, keep the bracket, until it is small."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SMALL = 8192  # values of a bracket that are sorted in one task
CUTS = 64  # parts of a bracket in a round


def _within(values: DataFrame, brackets: list[dict]) -> DataFrame:
    """id, v of the values that lie in each bracket; brackets are a few a key, as many as ranks were asked for."""
    spark, kind = values.sparkSession, values.schema
    rows = [(b["id"], b["key"], b["low"], b["high"]) for b in brackets]
    small = spark.createDataFrame(rows, f"id int, key {kind['key'].dataType.simpleString()}, low {kind['v'].dataType.simpleString()}, high {kind['v'].dataType.simpleString()}")
    inside = values["key"].eqNullSafe(small["key"]) & (values["v"] >= small["low"]) & (values["v"] <= small["high"])
    return values.join(F.broadcast(small), inside).select("id", "v")


def ranked_values(values: DataFrame, wanted: Mapping[object, Sequence[int]], facts: Mapping[object, tuple]) -> dict:
    """(key, rank): value, for 0-based ranks in order of values(key, v), v not null, of any type that has an order.

    ``facts`` gives (count, smallest, largest) of each key. A round cuts every bracket at approximate quantiles, counts
    its parts and keeps the one with the rank; a part of equal values is known at once. Only counts come to the driver.
    """
    out, live = {}, []
    for key, ranks in wanted.items():
        n, low, high = facts[key]
        for rank in sorted(set(ranks)):
            if not 0 <= rank < n:
                raise ValueError(f"there is no rank {rank} among {n} values")
            live.append({"id": len(live), "key": key, "rank": rank, "asked": rank, "n": n, "low": low, "high": high})
    small = []
    while live:
        for b in [b for b in live if b["low"] == b["high"]]:
            out[b["key"], b["asked"]] = b["low"]
        live = [b for b in live if b["low"] != b["high"]]
        small += [b for b in live if b["n"] <= SMALL]
        live = [b for b in live if b["n"] > SMALL]
        if not live:
            break
        cuts = {r.id: r.cuts for r in _within(values, live).groupBy("id").agg(F.percentile_approx("v", [i / CUTS for i in range(1, CUTS)], 10_000).alias("cuts")).collect()}
        table = values.sparkSession.createDataFrame([(i, c) for i, c in cuts.items()], f"id int, cuts array<{values.schema['v'].dataType.simpleString()}>")
        # a cut is a part of its own, so that frequent values can't keep a bracket from shrinking
        part = F.size(F.filter("cuts", lambda c: c < F.col("v"))) + F.size(F.filter("cuts", lambda c: c <= F.col("v")))
        parts = _within(values, live).join(F.broadcast(table), "id").groupBy("id", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        found: dict = {}
        for r in parts.orderBy("id", "part").collect():  # at most 127 rows a bracket
            found.setdefault(r.id, []).append(r)
        for b in live:
            for r in found[b["id"]]:
                if b["rank"] < r.n:
                    b.update(n=r.n, low=r.low, high=r.high)
                    break
                b["rank"] -= r.n
    if small:
        at = F.coalesce(F.sum("n").over(Window.partitionBy("id").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranks = values.sparkSession.createDataFrame([(b["id"], b["rank"]) for b in small], "id int, rank long")
        placed = _within(values, small).groupBy("id", "v").agg(F.count("*").alias("n")).withColumn("at", at).join(F.broadcast(ranks), "id")
        by_id = {b["id"]: b for b in small}
        for r in placed.filter("at <= rank AND rank < at + n").collect():
            out[by_id[r.id]["key"], by_id[r.id]["asked"]] = r.v
    return out
