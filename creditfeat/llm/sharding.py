"""Sharding along a Hilbert curve, in DataFrame operations only.

Every metadata dimension is quantised at its quantiles, the cells are walked along a Hilbert curve,
and the walk is cut into runs of equal row counts. Rows that are near in all dimensions come to lie
in the same files, so a filter on any of them skips most files by their minima and maxima.

A row's place in the whole order is found without one global sort: rows of each (cell, hash bucket)
are counted, the counts are summed in two levels (buckets of a cell, cells), and only rows of one
bucket are numbered together. A cell that holds a third of all rows has as many buckets as others.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditfeat.llm.common import stage
from creditfeat.operators.ordering import running_totals


@dataclass(frozen=True)
class Curve:
    """``bits``: bits of each dimension, so 2 ** (bits * dimensions) cells; ``buckets``: hash
    buckets that the rows of a cell are numbered in; ``accuracy``: of the quantile summary."""

    bits: int = 4
    buckets: int = 1024
    accuracy: int = 10_000


def with_place(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the number of rows whose text in ``column`` isn't greater: a number of the texts' order, however
    alike they begin, at which quantiles can be cut. Null comes first, as 0."""
    counts = stage(df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")), "values")
    places = running_totals(counts, column, ["_n"]).select(F.col(column).alias("_value"), F.col("cum__n").alias(name))
    joined = df.join(places, F.col(column) == F.col("_value"), "left").drop("_value")
    return joined.withColumn(name, F.coalesce(F.col(name).cast("bigint"), F.lit(0).cast("bigint")))


def hilbert_index(cells: Column, bits: int, dimensions: int) -> Column:
    """Index on the curve of a cell given as an array of ``dimensions`` coordinates (Skilling's
    transform: undo the excess work from the highest bit down, Gray encode, interleave)."""
    places = F.sequence(F.lit(0), F.lit(dimensions - 1))
    levels = F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)) if bits > 1 else F.array().cast("array<int>")
    one = F.lit(1).cast("bigint")

    def per_level(x: Column, level: Column) -> Column:
        q = F.call_function("shiftleft", one, level)
        p = q - 1

        def per_place(x: Column, i: Column) -> Column:
            here = F.get(x, i)
            first = F.get(x, F.lit(0))
            swap = first.bitwiseXOR(here).bitwiseAND(p)
            flipped = F.transform(x, lambda v, k: F.when(k == 0, v.bitwiseXOR(p)).otherwise(v))
            swapped = F.transform(
                x, lambda v, k: F.when((k == 0) | (k == i), v.bitwiseXOR(swap)).otherwise(v)
            )
            return F.when(here.bitwiseAND(q) != 0, flipped).otherwise(swapped)

        return F.aggregate(places, x, per_place)

    turned = F.aggregate(levels, cells, per_level)

    def gray(x: Column) -> Column:
        chained = F.aggregate(
            x,
            F.array().cast("array<bigint>"),
            lambda done, v: F.concat(
                done, F.array(v.bitwiseXOR(F.coalesce(F.get(done, F.size(done) - 1), F.lit(0).cast("bigint"))))
            ),
        )

        def finish(c: Column) -> Column:
            last = F.get(c, F.lit(dimensions - 1))
            flip = F.aggregate(
                levels,
                F.lit(0).cast("bigint"),
                lambda t, level: F.when(
                    last.bitwiseAND(F.call_function("shiftleft", one, level)) != 0,
                    t.bitwiseXOR(F.call_function("shiftleft", one, level) - 1),
                ).otherwise(t),
            )
            return F.transform(F.array(flip), lambda t: F.transform(c, lambda v: v.bitwiseXOR(t)))[0]

        return F.transform(F.array(chained), finish)[0]

    def interleave(x: Column) -> Column:
        all_levels = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
        return F.aggregate(
            all_levels,
            F.lit(0).cast("bigint"),
            lambda acc, level: F.aggregate(
                x,
                acc,
                lambda a, v: a * 2 + F.call_function("shiftright", v, level).bitwiseAND(one),
            ),
        )

    coded = F.transform(F.array(turned), gray)[0]
    return F.transform(F.array(coded), interleave)[0]


def _cuts(df: DataFrame, dimensions: list[str], curve: Curve) -> list[list[int]]:
    """Inner quantiles of each dimension: at most 2 ** bits - 1 numbers, brought to the driver."""
    steps = 1 << curve.bits
    shares = [i / steps for i in range(1, steps)]
    found = df.agg(
        *[F.percentile_approx(d, shares, curve.accuracy).alias(d) for d in dimensions]
    ).first()
    return [sorted(set(found[d] or [])) for d in dimensions]


def _cell(value: Column, cuts: list[int]) -> Column:
    """How many of the cuts don't exceed ``value``."""
    known = F.array(*[F.lit(c).cast("bigint") for c in cuts]).cast("array<bigint>")
    return F.size(F.filter(known, lambda c: c <= value)).cast("bigint")


def hilbert_ranks(
    df: DataFrame, dimensions: list[str], key: str, curve: Curve = Curve(), whole: Sequence[str] = ()
) -> DataFrame:
    """Adds ``curve_index``, ``rank`` (gapless from 0 over the whole table, along the curve) and
    ``n_rows``. ``dimensions``: bigint columns; ``key``: with all columns but ``whole``, orders rows of a
    cell. Rows that are equal in them get places of their own in any order."""
    # All columns together, so that rows which share a key don't share a bucket.
    spread = [key, *[c for c in df.columns if c != key and c not in whole]]
    cut = _cuts(df, dimensions, curve)
    cells = F.array(*[_cell(F.col(d), c) for d, c in zip(dimensions, cut, strict=True)])
    placed = df.withColumn("curve_index", hilbert_index(cells, curve.bits, len(dimensions))).withColumn(
        "_bucket", F.pmod(F.xxhash64(*spread), F.lit(curve.buckets))
    )
    placed = stage(placed, "placed")
    counts = placed.groupBy("curve_index", "_bucket").agg(F.count("*").alias("_n"))
    per_cell = counts.groupBy("curve_index").agg(F.sum("_n").alias("_cell"))
    up_to = Window.orderBy("curve_index").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("curve_index").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    # At most 2 ** (bits * dimensions) rows, whatever the size of the table.
    before_cell = per_cell.select(
        "curve_index",
        F.coalesce(F.sum("_cell").over(up_to), F.lit(0)).alias("_before_cell"),
        F.sum("_cell").over(everything).alias("n_rows"),
    )
    inside = (
        Window.partitionBy("curve_index")
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(before_cell, "curve_index")
        .select("curve_index", "_bucket", (F.col("_before") + F.col("_before_cell")).alias("_start"), "n_rows")
    )
    own = Window.partitionBy("curve_index", "_bucket").orderBy(
        *[F.col(c).asc_nulls_first() for c in spread]
    )
    return (
        placed.withColumn("_place", F.row_number().over(own) - 1)
        .join(before, ["curve_index", "_bucket"])
        .withColumn("rank", F.col("_start") + F.col("_place"))
        .drop("_bucket", "_place", "_start")
    )


def shard_assignment(docs: DataFrame, shards: int = 16, curve: Curve = Curve()) -> DataFrame:
    """doc_id, size, text_crc32, curve_index, ``shard`` and ``slot`` for every row of ``docs``.

    Dimensions are source, language and size. Shards hold runs of the curve with counts at most one
    apart; slots are gapless from 0 along the curve. Null ids, texts, sources and languages are
    values like others and come first; repeated rows get slots of their own. Fewer rows than shards
    leave shards empty, an empty table gives an empty result. Further columns are ignored.
    """
    placed = _assigned(docs, [], shards, curve)
    return placed.select("doc_id", "size", "text_crc32", "curve_index", "shard", "slot")


def _assigned(docs: DataFrame, whole: list[str], shards: int, curve: Curve) -> DataFrame:
    """The assignment, with the columns ``whole`` carried along as ``_row``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    carried = [F.struct(*[F.col(f"`{c}`") for c in whole]).alias("_row")] if whole else []
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.col("source").cast("string").alias("_s"),
        F.col("lang").cast("string").alias("_l"),
        *carried,
    )
    rows = with_place(with_place(rows, "_s", "_source"), "_l", "_lang").drop("_s", "_l")
    ranked = hilbert_ranks(rows, ["_source", "_lang", "size"], "doc_id", curve, ["_row"])
    shard = F.expr(f"(rank * {shards}) div n_rows")
    first = F.expr(f"(shard * n_rows + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("rank") - first)


def write_shards(docs: DataFrame, path: str, shards: int = 16, run_rows: int = 100_000, curve: Curve = Curve()) -> None:
    """Write ``docs`` to ``path``, a folder for each shard, cut into files of at most ``run_rows``
    rows that follow the curve. Every row is written once, with its columns as they are: rows without an id
    and rows that repeat one have places of their own. A column ``shard`` of ``docs`` gives way to the shard."""
    columns = [c for c in docs.columns if c != "shard"]
    placed = _assigned(docs, columns, shards, curve).select("shard", "slot", "_row.*")
    (
        placed.withColumn("_run", F.expr(f"slot div {run_rows}"))
        .repartition("shard", "_run")
        .sortWithinPartitions("shard", "slot")
        .select("shard", *columns)
        .write.partitionBy("shard")
        .option("maxRecordsPerFile", run_rows)
        .parquet(path)
    )
