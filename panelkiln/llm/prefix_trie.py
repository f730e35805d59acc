"""Prefix trie of conversations by recursive halving (van Emde Boas recursion).

Sequences are cut at half depth. The distinct first halves under one root are named by their smallest conversation and
stay, once each, as sequences of the upper trie; the second halves go on as sequences of the lower forest, each under the
name of its first half. Both are cut again at half their depth, all tries of a size in one Spark job, so that the deepest
conversation of D turns takes log2(D) rounds and not D. A row of a round (an item) is a part of one conversation: its
root, its conversation, the depth before it and its number of turns. A part of 2^(k-1) + 1 to 2^k turns waits for round k;
a conversation that ends just at a cut takes part in its naming. In the last round parts have one turn: those with equal
root and turn are a node.

Equality of first halves is that of a name of 128 bits: the exclusive or of two 64-bit hashes of (turn, place) over the
block's turns, computed for all aligned blocks of 1, 2, 4, ... turns in one aggregate. A turn itself is named by its SHA-256.

Totals are grafted upwards by the same cuts. The smallest conversation through a node owns it. Once the nodes and
their own amounts are known, each conversation has sums of what it owns by aligned block, and a cut hands what lies below
it, the sums of the second halves of all its parts and what was grafted on these before, to the part that stays in the upper trie.

No row holds more than one turn, so that one conversation with a third of all turns, or as many copies of
one, spread over all tasks: groups meet as sums, and joins on a conversation have its one row on the other side. Turns get
their places in distributed order (range partitions, then offsets). The digests of ids are the one thing that follows an
order: ids are joined to byte blocks in range partitions, and only blocks meet.

Turns follow the column turn (nulls first), ties role and text; null roles and texts count as empty; repeated rows are
turns of their own. Rows without conv_id are no conversation. An empty table has no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkiln.llm.sparkops import cut, map_batches, table

MOST_SHARED, GROUP = 4, 20
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of joined ids in one block.
BLOCK_BYTES = 1 << 18


def _log2(turns: Column) -> Column:
    """The largest k with 2^k <= turns, 0 for none."""
    return F.greatest(F.length(F.bin(turns)) - 1, F.lit(0))


def _level(turns: Column) -> Column:
    """The smallest k with turns <= 2^k."""
    return F.when(turns <= 1, 0).otherwise(F.length(F.bin(turns - 1)))


def _round(lo: Column, turns: Column, deepest: int) -> Column:
    """The round of a conversation's last part: its level, or the next one if it can end at the cut of an aligned block there."""
    level = _level(turns)
    ends = (F.pow(F.lit(2.0), level).cast("long") == turns) & (lo % F.pow(F.lit(2.0), level + 1).cast("long") == 0)
    return F.least(level + ends.cast("int"), F.lit(deepest))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 0), x and y (a turn's 128-bit name), words. Text is shuffled once."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    order = (F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    named = [F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(c) for at, c in ((1, "x"), (16, "y"))]
    words = F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")
    # Within a sorted range the running id counts rows; its upper bits are the range.
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", F.monotonically_increasing_id().alias("at"), *named, words))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that a conversation reaches
    starts = parts.select("conv", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(starts, ["conv", "part"]).select("conv", (F.col("at") + F.col("shift")).alias("pos"), "x", "y", "words")


def rebuilt(turns: DataFrame, most: int = MOST_SHARED, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, n) and turns (conv, pos, x, y, words, n): each begins with the first h turns of its group's
    first conversation, h = crc32(conv) % most, and goes on with its own turns after its first h."""
    turns = cut(turns)
    own = turns.groupBy("conv").agg(F.count("*").alias("own"))
    heads = turns.where((F.col("pos") < most - 1) & (F.col("conv") % group == 0))
    heads = heads.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y", "words"))).alias("head"))  # at most `most` - 1
    shared = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = own.select("conv", "own", shared.cast("int").alias("h"), (F.col("conv") - F.col("conv") % group).alias("base")).join(heads, "base", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h")))
    convs = convs.withColumn("n", F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = cut(convs.select("conv", "h", "head", F.col("n").cast("long").alias("n")))
    begin = convs.select("conv", F.explode("head").alias("t"), "n").select("conv", "t.pos", "t.x", "t.y", "t.words", "n")
    rest = turns.join(convs.select("conv", "h", F.size("head").alias("k"), "n"), "conv").where("pos >= h")
    rest = rest.select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "x", "y", "words", "n")
    return convs.select("conv", "n"), begin.unionByName(rest)


def _by_block(rows: DataFrame, levels: Column, *sums: Column) -> DataFrame:
    """Aggregates over the aligned blocks of 2^k turns, k = 0 .. levels, of (conv, pos) rows: conv, k, block."""
    spread = rows.withColumn("k", F.explode(F.sequence(F.lit(0), levels)))
    return spread.groupBy("conv", "k", F.expr("shiftright(pos, k)").alias("block")).agg(*sums)


def _of_level(tables: list[DataFrame], k: int) -> DataFrame:
    found = tables[0].where(F.col("level") == k)
    for t in tables[1:]:
        found = found.unionByName(t.where(F.col("level") == k))
    return found


def trie(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends of `rebuilt` conversations.

    nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens of every node below the root;
    ends: conv, conv_id and depth of the node at which it ends, for conversations with turns.
    """
    top = convs.agg(F.max("n").alias("n"), F.min("conv").alias("root"))
    deepest, root = top.select(_level(F.col("n")), "root").head()
    if deepest is None:
        deepest, root = 0, None
    mixed = (F.bit_xor(F.xxhash64("x", "y", "pos")).alias("x"), F.bit_xor(F.xxhash64("pos", "y", "x", F.lit(7))).alias("y"))
    names = cut(_by_block(turns, _log2(F.col("n")), *mixed, F.sum("words").alias("words"))).withColumnRenamed("conv", "of")

    # Names, from the longest parts to those of one turn.
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    whole = convs.where("n > 0").select(F.lit(root).cast("long").alias("root"), "conv", zero.alias("lo"), "n", one.alias("count"), F.lit(True).alias("own_end"), _log2(F.col("n")).alias("top"))
    items = [whole.withColumn("level", _round(F.col("lo"), F.col("n"), deepest))]
    cuts: dict[int, DataFrame] = {}
    for k in range(deepest, 0, -1):
        half = 1 << (k - 1)
        first = names.where(F.col("k") == k - 1).select("of", "block", "x", "y")
        now = _of_level(items, k)
        now = now.join(first, (now.conv == first.of) & (F.shiftright(now.lo, k - 1) == first.block)).drop("of", "block", "level")
        now = cut(now.withColumn("longer", F.col("n") > half))
        upper = now.groupBy("root", "lo", "x", "y").agg(F.min("conv").alias("name"), F.sum(F.when(F.col("longer"), F.col("count")).otherwise(0)).alias("all"), F.min_by("top", "conv").alias("name_top"), F.max_by("longer", -F.col("conv")).alias("name_longer"), F.min_by("count", "conv").alias("name_count"))
        upper = cut(upper)
        cuts[k] = cut(now.join(upper.drop("all", "name_top", "name_longer", "name_count"), ["root", "lo", "x", "y"]))
        ended = ~F.col("name_longer")
        items.append(upper.select("root", F.col("name").alias("conv"), "lo", F.lit(half).cast("long").alias("n"), F.when(ended, F.col("all") + F.col("name_count")).otherwise(F.col("all")).alias("count"), ended.alias("own_end"), F.col("name_top").alias("top"), F.lit(k - 1).alias("level")))
        items.append(cuts[k].where("NOT longer AND conv <> name").select("root", "conv", "lo", "n", "count", "own_end", "top", F.lit(k - 1).alias("level")))
        cuts[k] = cuts[k].where("longer")
        lo, rest = F.col("lo") + half, F.col("n") - half
        items.append(cuts[k].select(F.col("name").alias("root"), "conv", lo.alias("lo"), rest.alias("n"), "count", "own_end", "top", _round(lo, rest, k - 1).alias("level")))
    single = names.where("k = 0").select("of", F.col("block").alias("pos"), "x", "y", "words")
    last = _of_level(items, 0)
    last = cut(last.join(single, (last.conv == single.of) & (last.lo == single.pos)).drop("of", "pos"))
    met = cut(last.groupBy("root", "lo", "x", "y").agg(F.min("conv").alias("name"), F.sum("count").alias("n_convs"), F.max("words").alias("words"), F.min_by("top", "conv").alias("top")))
    children = met.groupBy(F.col("root").alias("name"), (F.col("lo") - 1).alias("lo")).agg(F.count("*").alias("n_children"))
    nodes = met.join(children, ["name", "lo"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = cut(nodes.select("root", "lo", "x", "y", "name", "top", "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")))

    # Totals: what lies below a cut is handed to the part that stays above it.
    owned = nodes.select(F.col("name").alias("conv"), F.col("lo").alias("pos"), "top", "leaf", "saved")
    owned = cut(_by_block(owned, F.col("top"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))).withColumnRenamed("conv", "of")
    kind = "level int, conv long, lo long, leaf_below long, saved_below long"
    grafted = [convs.sparkSession.createDataFrame([], kind)]
    for k in range(deepest, 0, -1):
        half = 1 << (k - 1)
        second = owned.where(F.col("k") == k - 1).select("of", "block", "leaf", "saved")
        parts = cuts[k].select("name", "conv", "lo", "n").join(_of_level(grafted, k).drop("level"), ["conv", "lo"], "left")
        parts = parts.join(second, (parts.conv == second.of) & (F.shiftright(parts.lo, k - 1) + 1 == second.block), "left")
        parts = cut(parts.select("name", "conv", "lo", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("leaf", "saved", "leaf_below", "saved_below"))))
        grafted.append(parts.groupBy(F.lit(k - 1).alias("level"), F.col("name").alias("conv"), "lo").agg(*(F.sum(F.col(c) + F.col(f"{c}_below")).alias(f"{c}_below") for c in ("leaf", "saved"))))
        down = parts.where("leaf_below <> 0 OR saved_below <> 0")
        lo, rest = F.col("lo") + half, F.col("n") - half
        grafted.append(down.select(_round(lo, rest, k - 1).alias("level"), "conv", lo.alias("lo"), "leaf_below", "saved_below"))
    below = last.select("root", "lo", "x", "y", "conv").join(_of_level(grafted, 0).drop("level"), ["conv", "lo"])
    below = below.groupBy("root", "lo", "x", "y").agg(F.sum("leaf_below").alias("leaf_below"), F.sum("saved_below").alias("saved_below"))
    done = nodes.join(below, ["root", "lo", "x", "y"], "left")
    total = [(F.col(c) + F.coalesce(f"{c}_below", F.lit(0))).alias(n) for c, n in (("leaf", "n_leaves"), ("saved", "saved_tokens"))]
    ends = last.where("own_end").join(nodes.select("root", "lo", "x", "y", "name"), ["root", "lo", "x", "y"])
    return (
        done.select(F.col("name").alias("conv_id"), (F.col("lo") + 1).alias("depth"), F.col("root").alias("parent_conv_id"), "n_convs", "n_children", *total),
        ends.select("conv", F.col("name").alias("conv_id"), (F.col("lo") + 1).alias("depth")),
    )


def _joined_batches(block_bytes: int):
    """Sorted rows (conv_id, depth, conv) to comma-joined ids, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        node, first, ids, size = None, None, [], 0
        for batch in batches:
            for a, d, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (a, d) != node or size >= block_bytes:
                    if ids:
                        rows.append((*node, first, ",".join(ids).encode()))
                    node, first, ids, size = (a, d), c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if rows:
                yield _blocks(rows)
                rows = []
        if ids:
            yield _blocks([(*node, first, ",".join(ids).encode())])

    return run


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "depth", "first", "ids"])


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks to one SHA-256 for each node; a block is held at a time."""
    node, running = None, None
    for batch in batches:
        found = []
        for a, d, block in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (a, d) == node:
                running.update(b",")
            else:
                if running is not None:
                    found.append((*node, running.hexdigest()))
                node, running = (a, d), hashlib.sha256()
            running.update(block)
        yield _digests(found)
    if running is not None:
        yield _digests([(*node, running.hexdigest())])


def _digests(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv_id", "depth", "ends_sha256"])


def end_digests(ends: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """conv_id, depth and the SHA-256 of the ascending ids that end at the node."""
    order = ("conv_id", "depth", "conv")
    rows = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = map_batches(rows, _joined_batches(block_bytes), "conv_id long, depth long, first long, ids binary")
    whole = blocks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return map_batches(whole, _digest_batches, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, most: int = MOST_SHARED, group: int = GROUP) -> DataFrame:
    """All nodes of the trie of rebuilt `conversations` (conv_id, turn, role, text), from the root (depth 0)."""
    convs, turns = rebuilt(ordered_turns(conversations), most, group)
    convs = cut(convs)
    nodes, ends = trie(convs, cut(turns))
    nodes = cut(nodes)
    whole = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    firsts = nodes.where("depth = 1").agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    root = whole.crossJoin(F.broadcast(firsts))  # one row on each side
    root = root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    turnless = convs.where("n = 0").crossJoin(F.broadcast(whole.select("conv_id"))).select("conv", "conv_id", F.lit(0).cast("long").alias("depth"))  # one row on the right
    found = end_digests(ends.unionByName(turnless))
    out = root.unionByName(nodes).join(found, ["conv_id", "depth"], "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
