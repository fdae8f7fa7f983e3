"""Chat formatting: conversations logged again and again as they grow are reduced to the maximal ones, which are rendered.

Each turn has two 64-bit hashes of its place, role and text; the running exclusive-or over a conversation's turns is the rolling hash of each of its
prefixes. An anti-join drops every conversation whose whole hash is that of a proper prefix of another one; of equal ones the smallest conv_id stays.
DataFrame and SQL functions only. The turns are sorted by range once and written; a conversation may span many ranges, in each of which places and running
hashes start from what the ranges before it add up to. After that only hashes are dealt, and the texts of the conversations that stay.

Cases. Null conv_id: its turns are one conversation of their own, the null one. Turns are ordered by turn, role, text (nulls first) and numbered anew,
so gaps and repeated turn numbers do no harm; rows repeated in full count as turns. Null role or text differs from an empty one when compared, and is
rendered as empty. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import shuffle_partitions, written


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text, range, seq (which orders all turns, without gaps in a range) and two hashes t1, t2 of role and text; a written table."""
    spread = "_even"  # turns that are equal in all may lie in any order
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).withColumn(spread, F.rand(5))
    keys = [*(F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")), F.col(spread)]
    own = [F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    ranged = rows.repartitionByRange(shuffle_partitions(conversations.sparkSession), *keys).sortWithinPartitions(*keys)
    return written(ranged.select("conv_id", "role", "text", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("seq"), F.xxhash64(F.lit(17), *own).alias("t1"), F.xxhash64(F.lit(1_000_003), *own).alias("t2")))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), n_turns and the prefix hashes h1, h2 up to that turn, of ordered() turns."""
    pieces = Window.partitionBy("conv_id").orderBy("range")  # a row for each range that a conversation spans
    before = pieces.rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col("conv_id").alias("of_conv"), F.col("range").alias("of_range")]
    same = F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("range") == F.col("of_range"))
    sizes = turns.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    sizes = sizes.select(*named, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("past"), F.sum("n").over(Window.partitionBy("conv_id")).alias("n_turns"))
    placed = turns.join(sizes, same).select("conv_id", "range", (F.col("seq") - F.col("first") + F.col("past") + 1).alias("place"), "n_turns", "t1", "t2")
    placed = written(placed.select("conv_id", "range", "place", "n_turns", F.xxhash64("place", "t1").alias("o1"), F.xxhash64(F.lit(3), "place", "t2").alias("o2")))
    sums = placed.groupBy("conv_id", "range").agg(F.bit_xor("o1").alias("x1"), F.bit_xor("o2").alias("x2"))
    sums = sums.select(*named, *[F.coalesce(F.bit_xor(f"x{k}").over(before), F.lit(0)).alias(f"x{k}") for k in (1, 2)])
    run = Window.partitionBy("conv_id", "range").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("conv_id", "range", "place", "n_turns", *[F.bit_xor(f"o{k}").over(run).alias(f"l{k}") for k in (1, 2)])
    return written(local.join(sums, same).select("conv_id", "place", "n_turns", *[F.col(f"l{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"h{k}") for k in (1, 2)]))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are a prefix of no longer one and of no equal one with a smaller conv_id. turns: ordered()."""
    steps = prefixes(turns)
    key = ["place", "h1", "h2"]
    first = steps.where("place = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    longer = steps.where("place < n_turns").select(*key).distinct()
    return first.join(longer, key, "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"))


def rendered(conversations: DataFrame, form: str = "<|{role}|>\n{text}<|end|>\n") -> DataFrame:
    """conv_id, n_turns and chat: the turns of each maximal conversation in order, each in the form."""
    turns = ordered(conversations)
    kept = maximal(turns).withColumnRenamed("conv_id", "kept_id")
    before, between, after = form.replace("{role}", "\0").replace("{text}", "\0").split("\0")
    turn = F.concat(F.lit(before), F.coalesce("role", F.lit("")), F.lit(between), F.coalesce("text", F.lit("")), F.lit(after))
    lines = turns.select("conv_id", "seq", turn.alias("line"))
    own = lines.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    chat = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda s: s["line"]), "")
    return own.groupBy("conv_id", "n_turns").agg(chat.alias("chat"))
