"""Suffix ranks of very long symbol sequences by the difference-cover algorithm, every step a distributed sort or join.

A sequence is a table (pos, sym): runs of neighbouring positions are strings, a gap ends a string.  Positions that are not a
multiple of three are the sample.  Their triples are sorted and named by rank; where names repeat, the algorithm recurses on the
string of names, in which a third of the positions is left.  The other suffixes are ordered by (symbol, rank of the next
suffix), and both orders are merged by counting: how many suffixes of the other order stand before each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import keep



def _numbered(keys: list[str], carried: list[str], compare: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k = np.stack([batch.column(c).to_numpy() for c in compare])
            new = np.ones(n, bool)
            new[1:] = (k[:, 1:] != k[:, :-1]).any(axis=0)
            new[0] = last is None or (k[:, 0] != last).any()
            last = k[:, -1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), *(batch.column(c) for c in keys), pa.array(np.full(n, part, np.int32)),
                 pa.array(np.arange(row, row + n)), pa.array(new)], [*carried, *keys, "part", "row", "new"])
            row += n
    return run


def ordered(df: DataFrame, keys: list[str], unique: str, carried: tuple[str, ...] = (), compare: list[str] | None = None) -> DataFrame:
    """``df`` globally sorted by long ``keys`` and then ``unique``: adds the row number ``at`` and ``name``, which counts the
    changes of ``compare`` (the keys, if none are given) from row to row.

    Equal keys may fill several partitions; a summary of one row per partition carries names across.
    """
    carried = list(dict.fromkeys([unique, *carried]))
    compare = compare or keys
    names = [k for k in dict.fromkeys([*keys, *compare]) if k not in carried]
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carried] + [f"`{c}` long" for c in names]
    sort = df.select(*carried, *names).repartitionByRange(*keys, unique).sortWithinPartitions(*keys, unique)
    rows = keep(sort.mapInArrow(_numbered(names, carried, compare), ", ".join([*fields, "part int", "row long", "new boolean"])), "sorted")
    edge = F.struct(*compare)
    parts = rows.groupBy("part").agg(
        F.count("*").alias("n"), F.count_if("new").alias("distinct"), F.min_by(edge, "row").alias("first"), F.max_by(edge, "row").alias("last"))
    order = Window.orderBy("part")  # one row per partition of the sort
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("joins", (F.lag("last").over(order) == F.col("first")).cast("long"))
    parts = parts.select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        (F.coalesce(F.sum("distinct").over(before), F.lit(0)) - F.sum(F.coalesce("joins", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("names_before"))
    named = rows.join(F.broadcast(parts), "part")
    # Within a partition, names count the changes so far; the running count is cheap because rows are already in order there.
    running = F.sum(F.col("new").cast("long")).over(Window.partitionBy("part").orderBy("row"))
    return named.select(*carried, *names, (F.col("rows_before") + F.col("row")).alias("at"), (F.col("names_before") + running - 1).alias("name"))


def _next(df: DataFrame, ranks: DataFrame, step: int, name: str) -> DataFrame:
    """``name``: the rank of the suffix ``step`` later; after the end of a string, a negative number by position."""
    later = ranks.select((F.col("pos") - step).alias("pos"), F.col("rank").alias(name))
    return df.join(later, "pos", "left").withColumn(name, F.coalesce(name, -F.col("pos") - 2))


def suffix_ranks(symbols: DataFrame, depth: int | None = None) -> DataFrame:
    """(pos, rank): the place of each suffix of (pos, s0[, s1, s2]) in the order of suffixes.

    ``s0`` are longs of any sign; ``s1`` and ``s2`` are the next two symbols where the caller has them at hand, else they are
    joined here, null after the end of a string.  With ``depth``, only the first ``depth`` symbols decide: suffixes that differ
    in them have ranks in the right order, others may share a rank, and recursion ends as soon as names span that many symbols.  Without, equal suffixes of
    different strings are ordered by position.
    """
    if "s1" not in symbols.columns:
        for k in (1, 2):
            symbols = symbols.join(symbols.select((F.col("pos") - k).alias("pos"), F.col("s0").alias(f"s{k}")), "pos", "left")
    # 0: after the end; the end of each string is a symbol of its own.
    triples = symbols.select(
        "pos", "s0", F.coalesce(F.when(F.col("s1").isNull(), 0), F.lit(1)).cast("long").alias("f1"), F.coalesce("s1", F.col("pos") + 1).alias("s1"),
        F.coalesce(F.when(F.col("s2").isNull(), 0), F.lit(1)).cast("long").alias("f2"), F.coalesce("s2", F.col("pos") + 2).alias("s2"))
    triples = keep(triples, "triples")
    sample = triples.where("pmod(pos, 3) <> 0")
    names = keep(ordered(sample, ["s0", "f1", "s1", "f2", "s2"], "pos").select("pos", "at", "name"), "names")
    n, distinct = names.agg(F.count("*"), F.max("name")).first()
    if not n:
        return triples.select("pos", F.lit(0).cast("long").alias("rank")) if triples.isEmpty() else ordered(triples, ["s0"], "pos").select("pos", F.col("at").alias("rank"))
    if distinct + 1 == n or (depth is not None and depth <= 3):
        ranks = names.select("pos", F.col("at").alias("rank"))
    else:
        # Neighbours in the string of names are three positions apart; its two halves are kept far from each other.
        limits = names.agg(F.min("pos"), F.max("pos")).first()
        low, span = limits[0] // 3, limits[1] // 3 - limits[0] // 3 + 4
        place = F.floor(F.col("pos") / 3).cast("long") - low + F.when(F.pmod("pos", F.lit(3)) == 2, span + (-span) % 3).otherwise(0)
        inner = names.select(place.alias("pos"), F.col("name").alias("s0"))
        found = suffix_ranks(inner, None if depth is None else -(-depth // 3))
        ranks = keep(names.select("pos", place.alias("place")).join(found.withColumnRenamed("pos", "place"), "place").select("pos", "rank"), "ranks")
    rest = triples.where("pmod(pos, 3) = 0")
    one = triples.where("pmod(pos, 3) = 1").select("pos", "s0", F.lit(1).cast("long").alias("kind"))
    two = triples.where("pmod(pos, 3) = 2")
    zero = rest.select("pos", "s0", F.lit(0).cast("long").alias("kind"))
    # Against suffixes one past a multiple of three: (symbol, rank of the next suffix), both in the sample.
    first = ordered(_next(zero.union(one), ranks, 1, "r1"), ["s0", "r1"], "pos", ("kind",))
    # Against those two past: two symbols, then the rank of the suffix after them.
    pair = ["pos", "s0", "f1", "s1"]
    both = rest.select(*pair, F.lit(0).cast("long").alias("kind")).union(two.select(*pair, F.lit(2).cast("long").alias("kind")))
    second = ordered(_next(both, ranks, 2, "r2"), ["s0", "f1", "s1", "r2"], "pos", ("kind",))
    first, second = keep(_counted(first), "first"), keep(_counted(second), "second")
    sampled = ranks.join(
        first.where("kind = 1").select("pos", "others").union(second.where("kind = 2").select("pos", "others")), "pos").select("pos", (F.col("rank") + F.col("others")).alias("rank"))
    others = first.where("kind = 0").select("pos", F.col("others").alias("a"), F.col("own").alias("own")).join(
        second.where("kind = 0").select("pos", F.col("others").alias("b")), "pos").select("pos", (F.col("own") + F.col("a") + F.col("b")).alias("rank"))
    return sampled.union(others)


def _counted(df: DataFrame) -> DataFrame:
    """For rows in global order ``at``: how many rows of kind 0 (``own`` for kind 0) and of the other kind stand before."""
    size = 1 << 16
    blocks = df.groupBy(F.floor(F.col("at") / size).alias("block")).agg(F.count_if(F.col("kind") == 0).alias("zeros"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per 65,536
    blocks = blocks.select("block", F.coalesce(F.sum("zeros").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    zeros = F.coalesce(F.sum((F.col("kind") == 0).cast("long")).over(inside), F.lit(0))
    rows = df.withColumn("block", F.floor(F.col("at") / size)).join(blocks, "block").withColumn("zeros", F.col("earlier") + zeros)
    own = F.col("zeros")
    return rows.select("pos", "kind", F.when(F.col("kind") == 0, F.col("at") - own).otherwise(own).alias("others"), own.alias("own"))
