"""Mixing sources to target weights by hash thresholds, in DataFrame functions only.

A source's target is met with whole passes over its documents plus one partial pass: the documents whose
hash lies below the source's threshold. The threshold comes from nested histograms. Words are summed by
(source, top 12 bits of the hash); in the bucket where the budget ends, and only there, they are summed by
the next 12 bits, and again; the few rows of the last bucket are taken one by one. No source is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
BITS, LEVEL_BITS, LEVELS = 60, 12, 3
#: The table of sources is broadcast if it has at most as many rows.
BROADCAST_SOURCES = 10_000


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of the id, or without one of the text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares by weight, held at cap times the size.

    What capped sources leave is shared again by weight. In ascending order of cap to weight, a source is
    capped if the level that holds when all before it are capped still exceeds its cap; the level of the
    first that isn't capped is that of all others. One row for each source is all that this sorts.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1)
    s = sources.withColumn("w", w.cast("double"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left", share * F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    s = s.withColumn("level", F.col("left") / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("most", (cap * F.col("source_size")).cast("double")).withColumn("capped", F.col("level") * F.col("w") > F.col("most"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(every)["level"]
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(F.least("most", level * F.col("w"))).alias("target"))


def mix(documents: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted), copies, and the columns ``keep``.

    Rows are taken by the hash of their doc_id, so reruns agree. A null text has no words; a null source is a
    source of its own, the last; rows without an id are taken by the hash of their text. Rows of one hash (repeated
    ids, or texts without an id) are told apart one by one. A document at the threshold is taken if more than half of it fits, so a source ends within half a document
    of its target. Very long texts are counted by a regular expression, in constant memory; an empty table
    gives an empty one. Other columns are not read.
    """
    rows = documents.select("doc_id", "source", *keep, size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("h"))
    rows = materialize(rows, "sizes")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap, weights)
    plan = plan.withColumn("passes", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0)).cast("long"))
    plan = materialize(plan.withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size")), "plan", 1)

    edge = plan.select(F.col("source").alias("s"), "budget", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("prefix"))
    shift = BITS
    for _ in range(LEVELS):
        inside = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift) == F.col("prefix"))
        shift -= LEVEL_BITS
        bins = rows.join(edge, inside).groupBy("s", "budget", "base", F.shiftright("h", shift).alias("bin")).agg(F.sum("size").alias("words"))
        upto = F.col("base") + F.sum("words").over(Window.partitionBy("s").orderBy("bin"))
        edge = bins.withColumn("upto", upto).where("upto > budget")
        edge = edge.groupBy("s", "budget").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("base"))).alias("e"))
        edge = materialize(edge.select("s", "budget", F.col("e.base").alias("base"), F.col("e.bin").alias("prefix")), "edge", 1)

    known = plan.join(edge.drop("budget"), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "passes", "budget", "base", "prefix")
    known = F.broadcast(known) if plan.count() <= BROADCAST_SOURCES else known
    out = rows.join(known, F.col("source").eqNullSafe(F.col("s"))).withColumn("side", F.shiftright("h", shift) - F.col("prefix"))
    clear = out.where("side is null or side <> 0").withColumn("extra", F.when(F.col("side") < 0, 1).otherwise(0))
    order = Window.partitionBy("s").orderBy("h", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.col("base") + F.coalesce(F.sum("size").over(order), F.lit(0))
    last = out.where("side = 0").withColumn("extra", F.when(spent + F.col("size") / 2 <= F.col("budget"), 1).otherwise(0))
    out = clear.unionByName(last).withColumn("copies", F.col("passes") + F.col("extra"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *keep)


def mixed(documents: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``documents`` as often as the mix takes them, with all their columns, whatever these are called."""
    rows = documents.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("document"))
    out = mix(rows, share, cap, weights, ("document",)).where("copies > 0")
    return out.select("document", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("document.*")


ORACLE = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         cast('0x' || substr(md5(coalesce(doc_id::varchar, text, '')), 1, 15) as bigint) as h
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         [5e0, 2e0, 1e0][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w
  from d group by source),
l as (
  select *, (1.5e0 * sum(source_size) over () - 2e0 * coalesce(sum(source_size) over prev, 0))
            / (sum(w) over () - coalesce(sum(w) over prev, 0)) as level
  from s window prev as (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding)),
t as (
  select source, source_size, case when level * w > 2e0 * source_size then 2e0 * source_size
         else least(2e0 * source_size, w * first_value(level) over (order by level * w > 2e0 * source_size, source_size / w, source nulls last)) end as target
  from l),
p as (select *, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint as passes from t)
select doc_id, size, source_size, target,
       size * (passes + case when coalesce(sum(size) over (partition by d.source order by h, size, doc_id
         rows between unbounded preceding and 1 preceding), 0) + size / 2e0 <= target - passes * source_size then 1 else 0 end)::bigint as taken
from d join p on d.source is not distinct from p.source
"""
