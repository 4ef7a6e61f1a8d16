"""Mixing sources to target weights by hash-threshold histograms.

Built-in column functions only. Sizes are summed by source and hash bucket; a window over the histogram finds
the bucket in which the running sum passes the source's budget; only that bucket is read again at the next finer
resolution; the thresholds then select documents by a filter, without a sort of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.storage import Workspace, join_small, read_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
#: Three levels of 12 bits each: a threshold is a 36-bit number.
LEVEL_BITS = 12
LEVELS = 3


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixing_hash(doc_id: Column, text: Column) -> Column:
    """36 bits that depend on id and text alone, so reruns agree and equal rows are treated alike."""
    key = F.concat_ws("|", doc_id.cast("string"), text)
    return F.conv(F.substring(F.md5(key), 1, LEVEL_BITS * LEVELS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Each source's size and target: source, source_size, target.

    Sources in code point order (null last) get the weights in turn and share the sum of all sizes by weight. A
    target stops at max_repeat times its source's size, and what is over is shared again among the others. That
    fixed point is a water level: with sources sorted by bound / weight, the capped ones come first, and the level
    is what the capped ones leave, divided by the weights of the rest. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int")).cast("double"))
    per = per.withColumn("bound", F.col("source_size") * F.lit(float(max_repeat)))
    by_ratio = Window.orderBy(F.col("bound") / F.col("weight"), F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("bound").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - before) / rest
    per = per.withColumn("level", level)
    open_here = F.when(F.col("level") <= F.col("bound") / F.col("weight"), F.col("level"))
    first_open = F.first(open_here, ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    share = F.coalesce(first_open, F.lit(float("inf"))) * F.col("weight")
    return per.select("source", "source_size", F.least("bound", share).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """docs with __sift_size, __sift_source_size, __sift_target and __sift_times: how often the mix takes the document.

    Every document of a source is taken floor(target / source size) times, and once more if its hash lies under the
    source's threshold, at most max_repeat times in all. Null or blank texts have size 0, texts of any length are
    counted whole; null is a source of its own. Rows that are equal in id and text are taken alike. An empty table
    gives an empty one. Other columns stay; names that start with "__sift_" are reserved.
    """
    work = Workspace(docs.sparkSession, "mixing")
    keyed = docs.withColumn("__sift_size", word_count(F.col("text")))
    rows = keyed.withColumn("__sift_hash", mixing_hash(F.col("doc_id"), F.col("text")))
    sizes = rows.select("source", F.col("__sift_size").alias("size"), F.col("__sift_hash").alias("mix_hash"))
    limits = thresholds(work, work.table(sizes, "sizes"), weights, max_repeat)
    limits = limits.select([F.col(c).alias(f"__sift_{c}") for c in limits.columns])
    taken = join_small(rows, limits, rows["source"].eqNullSafe(limits["__sift_source"]))
    extra = (F.col("__sift_hash") < F.col("__sift_threshold")).cast("int")
    taken = taken.withColumn("__sift_times", F.col("__sift_repeats") + extra)
    return taken.drop("__sift_hash", "__sift_threshold", "__sift_repeats", "__sift_source")


def mixed_rows(docs: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """docs as the mix takes them: each row as often as its __sift_times says. Columns stay as they are."""
    taken = mix(docs, weights, max_repeat)
    repeated = taken.filter("__sift_times > 0").withColumn("__sift_turn", F.explode(F.sequence(F.lit(1), "__sift_times")))
    return repeated.select(*docs.columns)


def thresholds(work: Workspace, sizes: DataFrame, weights: tuple, max_repeat: int) -> DataFrame:
    """source, source_size, target, repeats, threshold: one row per source."""
    targets = source_targets(sizes, weights, max_repeat)
    repeats = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeat)))
    limits = targets.withColumn("repeats", F.coalesce(repeats, F.lit(0)).cast("int"))
    limits = limits.withColumn("need", F.col("target") - F.col("repeats") * F.col("source_size"))
    limits = work.table(limits.withColumn("prefix", F.lit(0).cast("long")), "limits0")
    for level in range(LEVELS):
        limits = work.table(_refine(work, sizes, limits, level), f"limits{level + 1}")
    return limits.select("source", "source_size", "target", "repeats", F.col("prefix").alias("threshold"))


def _refine(work: Workspace, sizes: DataFrame, limits: DataFrame, level: int) -> DataFrame:
    """Add LEVEL_BITS bits to each source's prefix: histogram of the bucket that the prefix names, then a window over it."""
    below = LEVEL_BITS * (LEVELS - 1 - level)
    bucket = F.shiftright("mix_hash", below)
    if level == 0:
        inside = sizes
    else:
        right = limits.filter("need > 0").select(F.col("source").alias("limit_source"), F.col("prefix").alias("limit_prefix"))
        same = sizes["source"].eqNullSafe(right["limit_source"]) & (
            F.shiftright(sizes["mix_hash"], below + LEVEL_BITS) == right["limit_prefix"]
        )
        inside = join_small(sizes, right, same, "left_semi")
    hist = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("tokens"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("upto", F.sum("tokens").over(running))
    right = limits.select(F.col("source").alias("limit_source"), "need")
    hist = join_small(hist, right, hist["source"].eqNullSafe(right["limit_source"])).drop("limit_source")
    passed = hist.filter("upto >= need and need > 0")
    edge = passed.groupBy("source").agg(F.min(F.struct("bucket", "upto", "tokens")).alias("edge"))
    edge = work.table(edge.select(F.col("source").alias("edge_source"), "edge"), f"edge{level}")  # one row per source
    joined = join_small(limits, edge, limits["source"].eqNullSafe(edge["edge_source"]), "left")
    before = F.col("edge.upto") - F.col("edge.tokens")
    if level < LEVELS - 1:
        prefix, need = F.col("edge.bucket"), F.col("need") - before
    else:
        nearer = (F.col("edge.upto") - F.col("need")) <= (F.col("need") - before)
        prefix, need = F.col("edge.bucket") + nearer.cast("long"), F.lit(0.0)
    return joined.select(
        "source", "source_size", "target", "repeats",
        F.when(F.col("edge").isNotNull(), need).otherwise(F.lit(0.0)).alias("need"),
        F.coalesce(prefix, F.lit(0)).cast("long").alias("prefix"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    mixed = mix(read_table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", F.col("__sift_size").alias("size"), F.col("__sift_source_size").alias("source_size"),
        F.col("__sift_target").alias("target"), (F.col("__sift_size") * F.col("__sift_times")).cast("long").alias("taken"),
    )


OP10_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(concat_ws('|', doc_id::varchar, text)), 1, 9))::bigint as h
  from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as weight, source_size * 3.0::double as bound from s0),
s2 as (select *, ((sum(source_size) over ())::double
         - coalesce(sum(bound) over (order by bound / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by bound / weight, source nulls last rows between current row and unbounded following) as level from s1),
s3 as (select *, (select arg_min(level, bound / weight) from s2 where level <= bound / weight) as share from s2),
s as (select source, source_size, least(bound, coalesce(share * weight, bound)) as target,
        case when source_size > 0 then least(floor(least(bound, coalesce(share * weight, bound)) / source_size), 3) else 0 end::int as repeats from s3),
c as (select source, h, sum(sum(size)) over (partition by source order by h) as upto, sum(size) as tokens from d group by source, h),
e as (select s.source, min({'h': c.h, 'upto': c.upto, 'tokens': c.tokens}) as edge
      from c join s on c.source is not distinct from s.source
      where s.target - s.repeats * s.source_size > 0 and c.upto >= s.target - s.repeats * s.source_size group by s.source),
t as (select s.*, case when edge is null then 0
        when edge.upto - (target - repeats * source_size) <= (target - repeats * source_size) - (edge.upto - edge.tokens) then edge.h + 1 else edge.h end as threshold
      from s left join e on s.source is not distinct from e.source)
select d.doc_id, d.size, t.source_size, t.target, (d.size * (t.repeats + (d.h < t.threshold)::int))::bigint as taken
from d join t on d.source is not distinct from t.source
"""
