"""Operator 5: mixing sources to target weights by capped water-filling.

Each source gets a share of the mix in proportion to its weight, but at most ``max_epochs`` times its own
size; what a clamped source can't take goes to the others in proportion, until none is above its cap.
Whole repetitions of a source take all its documents; the rest of its target is met by the documents that
come first in a seeded order and fit; a few more passes over those that still fit, and a last document where going over
the target a little is nearer than staying below, bring the rest near zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import checked_broadcast, shared_dir, tidy, written
from tallyloom.llm.textbytes import text_slices, word_bounds

#: Parts of the seeded order per source, each in as many again; only the one in which a source's share ends is sorted.
BUCKETS = 1024


def word_counts(docs: DataFrame, keep: dict[str, Column], text_col: str = "text", name: str = "size") -> DataFrame:
    """``keep``'s columns and the number of words (runs of other than ASCII white space) in the whole text."""
    df = docs.select(*[c.alias(k) for k, c in keep.items()], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    names = [*keep, name]

    def count(batches):
        for batch in batches:
            counts = [np.diff(np.searchsorted(word_bounds(data, offsets)[0], offsets)) for data, offsets in text_slices(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(counts) if counts else [], pa.int64())], names=names)

    return df.mapInArrow(tidy(count), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]) + f", `{name}` bigint")


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """``sources`` (size, weight, ...) with ``target``: weighted shares of ``total``, none above ``max_epochs`` x size.

    The state of the iteration is one number, the share of a source of weight 1 that isn't clamped; each
    round is one aggregate over the table of sources, which never leaves the executors.
    """
    cap = F.col("size") * F.lit(float(max_epochs))
    level, clamped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= cap
        held = F.sum(F.when(full, cap).otherwise(0.0))
        n, taken, weight = sources.agg(F.count(F.when(full, 1)), held, F.sum(F.when(~full, F.col("weight").cast("double")).otherwise(0.0))).first()
        if n == clamped or not weight:
            break
        clamped, level = n, max(level, (total - taken) / weight)
    share = F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(share >= cap, cap).otherwise(share) if weight else cap)


def _ended(parts: DataFrame, plan: DataFrame, name: str) -> DataFrame:
    """``plan`` (s, need) with the last part that begins before its source's need is met, and the need that is left there."""
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.select("source", "part", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("before"))
    needs = plan.select(F.col("s").alias("ns"), F.col("need").alias("n"))
    ends = sums.join(needs, F.col("source").eqNullSafe(F.col("ns"))).filter("before < n").groupBy("source").agg(F.max("part").alias(name), F.max("before").alias("before"))
    return plan.join(ends, F.col("s").eqNullSafe(F.col("source")), "left").withColumn(name, F.coalesce(name, F.lit(-1))).withColumn("need", F.col("need") - F.coalesce("before", F.lit(0))).drop("source", "before")


def _pass(marked: DataFrame, needs: DataFrame, scratch: str) -> DataFrame:
    """``marked`` with ``extra`` 1 for the rows not yet taken that come first in the seeded order and fit the need.

    Rows larger than what their source still needs are passed over.  The order is cut by sums of its parts and
    of the parts of one part; only the rows of the part in which the need ends are sorted, a millionth of a source.
    """
    first = needs.withColumn("whole_need", F.col("need"))
    open_ = (F.col("extra") == 0) & (F.col("size") > 0) & (F.col("size") <= F.col("whole_need"))

    def met(plan: DataFrame) -> DataFrame:
        return marked.join(plan, F.col("source").eqNullSafe(F.col("s")))

    parts = met(checked_broadcast(first)).filter(open_).groupBy("source", F.col("b1").alias("part")).agg(F.sum("size").alias("size"))
    plan = checked_broadcast(written(_ended(parts, first, "last1"), f"{scratch}-1"))
    inner = met(plan).filter(open_ & (F.col("b1") == F.col("last1"))).groupBy("source", F.col("b2").alias("part")).agg(F.sum("size").alias("size"))
    plan = checked_broadcast(written(_ended(inner, plan, "last2"), f"{scratch}-2"))
    joined = met(plan).drop("s")
    at_end = open_ & (F.col("b1") == F.col("last1")) & (F.col("b2") == F.col("last2"))
    seeded = Window.partitionBy("source").orderBy("u", "id", "row").rowsBetween(Window.unboundedPreceding, 0)
    edge = joined.filter(at_end).withColumn("upto", F.sum("size").over(seeded)).withColumn("extra", (F.col("upto") <= F.col("need")).cast("long")).drop("upto")
    ahead = open_ & (F.struct("b1", "b2") < F.struct("last1", "last2"))
    sure = joined.filter(~at_end).withColumn("extra", F.when(ahead, 1).otherwise(F.col("extra")).cast("long"))
    return sure.unionByName(edge).select(*marked.columns)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=(1, 2, 3), share: float = 1.0, max_epochs: float = 3.0, seed: int = 5, buckets: int = BUCKETS, passes: int = 4) -> DataFrame:
    """id, source, size, source_size, target, copies, taken for each row of ``docs``.

    ``weights`` repeats over the sources in code-point order, null last.  The mix has ``share`` of the words
    of all documents.  copies is how often the mix takes the row, taken the words: copies x size.  A source's
    taken words differ from its target by at most half of a document that stopped the last of ``passes`` passes
    over those that fit; each pass begins with what the one before left.  No row is taken more than
    ``max_epochs`` (rounded up) times.

    A null text has size 0, a null source is a source.  Repeated ids are rows of their own.  A source
    of size 0 has target 0 and is not taken.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = shared_dir(spark)
    keep = {"id": F.col(id_col), "source": F.col(source_col)}
    rows = written(word_counts(docs, keep, text_col).withColumn("row", F.monotonically_increasing_id()), f"{scratch}/sizes")
    u = F.xxhash64(F.col("id"), F.lit(seed))
    b1, b2 = F.pmod(u, F.lit(buckets)).cast("int"), F.pmod(F.shiftrightunsigned(u, 32), F.lit(buckets)).cast("int")
    rows = rows.withColumn("u", u).withColumn("b1", b1).withColumn("b2", b2)

    parts = written(rows.groupBy("source", F.col("b1").alias("part")).agg(F.sum("size").alias("size")), f"{scratch}/parts")
    # One row per source: their number is bounded by how many sources there are, not by documents.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = parts.groupBy("source").agg(F.sum("size").alias("size"))
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    sources = written(sources, f"{scratch}/sources")
    total = (sources.agg(F.sum("size")).first()[0] or 0) * share
    filled = water_fill(sources, float(total), max_epochs)
    epochs = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    filled = filled.withColumn("whole", F.floor(epochs + 1e-12)).withColumn("need", F.col("target") - F.col("whole") * F.col("size"))
    plan = checked_broadcast(written(filled.select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target", "whole", "need"), f"{scratch}/plan"))
    marked = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s", "need").withColumn("extra", F.lit(0).cast("long"))
    needs = plan.select("s", "need")
    for n in range(passes):
        marked = written(_pass(marked, needs, f"{scratch}/{n}"), f"{scratch}/marked{n}")
        short = F.first("target") - F.first("whole") * F.first("source_size") - F.sum(F.col("extra") * F.col("size"))
        needs = written(marked.groupBy(F.col("source").alias("s")).agg(short.alias("need")), f"{scratch}/needs{n}")
    # Where one more document goes over the target by less than what is missing, the smallest such is taken.
    gaps = checked_broadcast(needs.withColumnRenamed("need", "gap"))
    over = marked.join(gaps, F.col("source").eqNullSafe(F.col("s"))).filter("extra = 0 and size > gap and size < 2 * gap")
    last = over.groupBy("source").agg(F.min(F.struct("size", "u", "row")).alias("b")).select(F.col("b.row").alias("row"), F.lit(1).alias("more"))
    marked = marked.join(checked_broadcast(written(last, f"{scratch}/last")), "row", "left").withColumn("extra", F.col("extra") + F.coalesce("more", F.lit(0)))

    copies = F.when(F.col("source_size") > 0, F.col("whole") + F.col("extra")).otherwise(0)
    out = marked.withColumn("copies", copies.cast("long"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
