"""Chat formatting with cumulative-snapshot collapse.

Built-in column functions only. A logged conversation that is a prefix of a longer one is a snapshot of it. Each
turn gets a hash of (position, role, text); the rolling hash of a prefix is the xor of its turns' hashes, kept in
two independent 64-bit lanes. Xor lets the running value be computed by blocks of turns, so no conversation has to
fit in one task. An anti-join of whole-conversation hashes against all proper prefix hashes keeps the maximal ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.storage import Workspace, read_table

#: Turn numbers are dealt to blocks of this width; positions and hashes are carried from block to block.
BLOCK = 64
#: Turns in one rendered part.
PART_TURNS = 64
_SEED = 0x5F17

TEMPLATE = "<|{role}|>\n{text}\n<|end|>\n"


def _turn_hash(seed: int) -> Column:
    # Presence flags keep a null apart from an empty string.
    return F.xxhash64(F.lit(seed), "pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def _carry(rows: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """Join to each row what the earlier blocks of its conversation add up to.

    aggregates: name -> aggregate over a block; an integral sum or a bit_xor. A hot conversation is spread over its
    blocks; the window runs over one row per block.
    """
    blocks = rows.groupBy("conv_id", "block").agg(*[a.alias(f"own_{k}") for k, a in aggregates.items()])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    merge = {"n": F.sum, "h1": F.bit_xor, "h2": F.bit_xor}
    carried = [F.coalesce(merge[k](f"own_{k}").over(earlier), F.lit(0)).cast("long").alias(f"past_{k}") for k in aggregates]
    right = blocks.select(F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"), *carried)
    same = rows["conv_id"].eqNullSafe(right["b_conv"]) & (rows["block"] == right["b_block"])
    return rows.join(right, same).drop("b_conv", "b_block")


def rolling_prefixes(turns: DataFrame) -> DataFrame:
    """Turns with pos (from 1) and the prefix hash h1, h2 up to and with that turn.

    Turns are ordered by turn, role, text (null first), so repeated turn numbers have a defined order. A null
    conv_id is one conversation like any other.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    rows = rows.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK).cast("long"))
    in_block = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    upto = in_block.rowsBetween(Window.unboundedPreceding, 0)
    rows = _carry(rows, {"n": F.count(F.lit(1))})
    rows = rows.withColumn("pos", F.row_number().over(in_block) + F.col("past_n")).drop("past_n")
    rows = rows.withColumn("t1", _turn_hash(_SEED)).withColumn("t2", _turn_hash(_SEED + 1))
    rows = _carry(rows, {"h1": F.bit_xor("t1"), "h2": F.bit_xor("t2")})
    for lane in ("1", "2"):
        rolled = F.bit_xor(f"t{lane}").over(upto).bitwiseXOR(F.col(f"past_h{lane}"))
        rows = rows.withColumn(f"h{lane}", rolled)
    return rows.select("conv_id", "turn", "role", "text", "pos", "h1", "h2")


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal of the conversations to keep.

    Dropped: conversations that are a proper prefix of another one. Of equal conversations the smallest conv_id
    stays (null counts as smallest) and n_equal tells how many there were.
    """
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("end"))
    ends = last.select("conv_id", "end.*")
    groups = ends.groupBy("pos", "h1", "h2").agg(
        F.min("conv_id").alias("least"), F.max(F.col("conv_id").isNull()).alias("has_null"), F.count(F.lit(1)).alias("n_equal")
    )
    groups = groups.withColumn("conv_id", F.when(~F.col("has_null"), F.col("least")))
    proper = prefixes.join(
        ends.select(F.col("conv_id").alias("e_conv"), F.col("pos").alias("e_pos")),
        prefixes["conv_id"].eqNullSafe(F.col("e_conv")) & (F.col("pos") < F.col("e_pos")),
        "left_semi",
    )
    proper = proper.select("pos", "h1", "h2").distinct()
    kept = groups.join(proper, ["pos", "h1", "h2"], "left_anti")
    return kept.select("conv_id", F.col("pos").alias("n_turns"), "n_equal")


def render(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part (from 0), turns, rendered: the conversation's text in the template, part_turns turns to a row.

    A null role renders as "unknown", a null text as the empty string.
    """
    head, rest = TEMPLATE.split("{role}")
    middle, tail = rest.split("{text}")
    line = F.concat(F.lit(head), F.coalesce("role", F.lit("unknown")), F.lit(middle), F.coalesce("text", F.lit("")), F.lit(tail))
    parts = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / part_turns).cast("long").alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines")
    )
    return parts.select("conv_id", "part", F.size("lines").cast("long").alias("turns"), F.array_join("lines.line", "").alias("rendered"))


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """Rendered parts of the maximal conversations: conv_id, n_turns, n_equal, part, turns, rendered.

    Nulls in any column count as values of their own (see `rolling_prefixes`, `render`); rows that repeat are turns of
    their own. Long texts are rendered whole. The turns of one conversation are dealt to blocks by turn number; those within
    a block, among them all with one number or none, are ordered in one task. Other columns are not read; an
    empty table gives an empty one.
    """
    work = Workspace(conversations.sparkSession, "chat")
    prefixes = work.table(rolling_prefixes(conversations), "prefixes")
    kept = work.table(maximal_conversations(prefixes), "kept")
    right = kept.withColumnRenamed("conv_id", "k_conv")
    turns = prefixes.join(right, prefixes["conv_id"].eqNullSafe(right["k_conv"]), "left_semi")
    parts = render(turns)
    return parts.join(right, parts["conv_id"].eqNullSafe(right["k_conv"])).select(
        "conv_id", "n_turns", "n_equal", "part", "turns", "rendered"
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered maximal conversations of the conversations table."""
    return collapse_and_render(read_table(spark, sf_dir, "conversations"))


OP3_SQL = r"""
with t as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as pos
           from conversations),
h as (select *, string_agg(md5(concat_ws('|', role is null, role, text is null, text)), '') over
        (partition by conv_id order by pos rows between unbounded preceding and current row) as prefix,
        count(*) over (partition by conv_id) as n from t),
e as (select prefix, n, min(conv_id) as conv_id, count(*) as n_equal from h where pos = n group by prefix, n),
k as (select * from e where not exists (select 1 from h where h.pos < h.n and h.pos = e.n and h.prefix = e.prefix))
select h.conv_id, k.n as n_turns, k.n_equal, (h.pos - 1) // 64 as part, count(*) as turns,
       string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' order by h.pos) as rendered
from h join k using (conv_id) group by h.conv_id, k.n, k.n_equal, (h.pos - 1) // 64
"""
