"""Chat formatting from reply trees.

Messages of a conversation form trees. A column ``parent_turn`` names the message replied to; where the
table has none, a message replies to the latest earlier message of another role, so that several messages
of one role in a row are alternative replies. Iterative self-joins over ids find every message's way to its
root: round k joins each message with the one 2^k above it, which gives the one 2^(k+1) above and the score
and length of the path between, so rounds are logarithmic in the depth and no path is held as an array. Each
round is written to the shared folder. Branches are ranked by score within a conversation
(the sum of the messages' ``score``, or else of the characters of the assistant's messages; ties: the longer
path, then the smaller leaf turn), and the paths of the best ``branches`` are walked back through the same rounds
and formatted as one conversation each.

Defined cases: messages with a null conversation or turn have no place and are left out; a null role is
``unknown``, a null text empty, a null score 0; of several messages with the same conversation and turn the
least by role and text counts; a message whose parent isn't there is a root; messages on a cycle are reached
from no root and left out; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, narrow

BRANCHES = 3
#: turns of a conversation that one window holds at most
BLOCK = 4096


def messages(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, score, parent: one row for each message that has a place."""
    extra = [c for c in ("parent_turn", "score") if c in table.columns]
    rows = narrow(table, "conv_id", "turn", "role", "text", *extra).where("conv_id is not null and turn is not null")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), *extra)
    first = F.min(F.struct("role", "text", *extra)).alias("m")
    rows = rows.groupBy("conv_id", "turn").agg(first).select("conv_id", "turn", "m.*")
    if "score" in extra:
        rows = rows.withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0)))
    else:
        rows = rows.withColumn("score", F.when(F.col("role") == "assistant", F.char_length("text")).otherwise(0).cast("long"))
    return rows.withColumnRenamed("parent_turn", "parent") if "parent_turn" in extra else with_parents(rows)


def with_parents(rows: DataFrame) -> DataFrame:
    """parent: the latest earlier turn of another role.

    Turns are taken in blocks, so no window holds a whole conversation. A message before the first change of
    role in its block looks to the blocks before: to the last message there, or if that has its own role, to the
    last before it that hasn't.
    """
    at = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    w = W.partitionBy("conv_id", "block").orderBy("turn")
    turned = F.when(F.lag("role").over(w) != F.col("role"), F.lag("turn").over(w))
    at = at.withColumn("at", turned).withColumn("near", F.last("at", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    ends = at.groupBy("conv_id", "block").agg(F.max(F.struct("turn", "role", "near")).alias("e"))
    over = W.partitionBy("conv_id").orderBy("block")
    changed = F.coalesce("e.near", F.when(F.lag("e.role").over(over) != F.col("e.role"), F.lag("e.turn").over(over)))
    known = ends.withColumn("changed", changed).withColumn("other", F.last("changed", ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, W.currentRow)))
    back = known.select("conv_id", "block", *[F.lag(c).over(over).alias(n) for c, n in (("e.turn", "last_turn"), ("e.role", "last_role"), ("other", "other_turn"))])
    far = F.when(F.col("last_role") == F.col("role"), F.col("other_turn")).otherwise(F.col("last_turn"))
    return at.join(back, ["conv_id", "block"]).select(*rows.columns, F.coalesce("near", far).alias("parent"))


def climbs(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(conv_id, turn, up) for each power of two, ``up`` being the message so many levels above; and conv_id,
    turn, score and n_messages of every root-to-leaf path, under its leaf."""
    edges = cut(nodes.select("conv_id", "turn", "parent", "score"), "edges")
    there = edges.select("conv_id", F.col("turn").alias("parent"), F.lit(True).alias("found"))
    up = F.when(F.col("found"), F.col("parent"))
    state = cut(edges.join(there, ["conv_id", "parent"], "left").select("conv_id", "turn", up.alias("up"), "score", F.lit(1).cast("long").alias("n_messages")), "stretches")
    jumps, left = [], None
    # a message whose way has ended stays as it is; those that never end hang on a cycle
    while (now := state.where("up is not null").count()) not in (0, left):
        jumps.append(state.where("up is not null").select("conv_id", "turn", "up"))
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"), F.col("n_messages").alias("longer"))
        longer = state.where("up is not null").join(above, ["conv_id", "up"]).select("conv_id", "turn", F.col("next").alias("up"), (F.col("more") + F.col("score")).alias("score"), (F.col("longer") + F.col("n_messages")).alias("n_messages"))
        state, left = cut(state.where("up is null").unionByName(longer), "stretches"), now
    parents = edges.select("conv_id", F.col("parent").alias("turn")).distinct()
    return jumps, state.where("up is null").drop("up").join(parents, ["conv_id", "turn"], "left_anti")


def walked(best: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """The chosen leaves (conv_id, leaf_turn, rank) with every message ``turn`` of their paths and its height
    over the leaf: from the longest climb down, each message reached so far gets the one so far above it."""
    way = best.withColumn("turn", F.col("leaf_turn")).withColumn("height", F.lit(0).cast("long"))
    for k in reversed(range(len(jumps))):
        more = way.join(jumps[k], ["conv_id", "turn"]).withColumn("turn", F.col("up")).withColumn("height", F.col("height") + (1 << k))
        way = cut(way.unionByName(more.drop("up")), "ways")
    return way


def format_conversations(table: DataFrame, branches: int = BRANCHES) -> DataFrame:
    """conv_id, rank, leaf_turn, score, n_messages, text: the best branches of each conversation."""
    nodes = cut(messages(table), "messages")
    jumps, whole = climbs(nodes)
    w = W.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("n_messages"), "turn")
    best = cut(whole.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= branches).withColumnRenamed("turn", "leaf_turn"), "best")
    said = walked(best, jumps).join(nodes.select("conv_id", "turn", "role", "text"), ["conv_id", "turn"])
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n"))
    whole = said.groupBy("conv_id", "rank", "leaf_turn", "score", "n_messages").agg(F.array_sort(F.collect_list(F.struct((-F.col("height")).alias("k"), line.alias("line")))).alias("lines"))
    return whole.select("conv_id", F.col("rank").cast("long").alias("rank"), "leaf_turn", "score", "n_messages", F.array_join("lines.line", "").alias("text"))
