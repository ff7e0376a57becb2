"""Prefix trie of conversations by Spark SQL ROLLUP.

The turns of a conversation stand in BLOCK positional columns t1, t2, ...; longer conversations go on in
further rows of the same columns, keyed by the node that the turns before the block lead to. One
ROLLUP over the columns then groups by every prefix of a block at once, ``grouping_id`` tells its
length, and the groups of all blocks are the nodes of the trie.

A turn's id at its place is two 56-bit integers of a SHA-256 of (place, role, text). A node's name is the
sum of its turns' ids modulo 2^56 (two of n nodes share it with odds of n * n / 2^113), so the names
that key the blocks come from sums over blocks and no level waits for the one above.

What a node needs of its subtree is a sum over its members. Every node belongs to its smallest
member; a conversation owns the nodes of its path from some depth on. The first ROLLUP finds the
owners. In the second, a node's children are members that own their next node, leaves are members that
own a childless node, and saved tokens are bytes of turns that members don't own: each member but
the owner adds a turn's bytes once. All are partial aggregates, whatever a prefix's share of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.ordered import row_index, running_sums
from ..core.sizing import join_stats
from .common import kept, text_of

BLOCK = 8
MAX_SHARED = 8
# Conversations of more turns are numbered and summed in blocks of rows instead of one window.
LONG = 50_000
# Ids of one piece of a list of conversations, whose ids are distinct.
PIECE_IDS = 1024
_MASK = (1 << 56) - 1


def _lanes(digest: Column) -> tuple[Column, Column]:
    """Two 56-bit integers of a hexadecimal digest."""
    lane = lambda i: F.conv(F.substring(digest, i, 14), 16, 10).cast("long")
    return lane(1), lane(15)


def ordered_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, turn_id, n_bytes): turns in their order, from 1, with a SHA-256 for role and text.

    Null turn numbers come first; turns of equal number come in the order of a hash of role and text.
    Null role or text is empty. Rows without a conversation id are left out.
    """
    body = F.concat(F.length(text_of(role)).cast("string"), F.lit(":"), text_of(role), text_of(text))
    rows = df.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.sha2(body, 256).alias("turn_id"), F.octet_length(text_of(text)).cast("long").alias("n_bytes"))
    rows = rows.filter("conv is not null").withColumn("tie", _lanes(F.col("turn_id"))[0])
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"))
    order = ["turn", "tie"]
    plain = lambda part: part.withColumn("pos", F.row_number().over(Window.partitionBy("conv").orderBy(*order)).cast("long"))
    in_blocks = lambda part: row_index(part, ["conv"], order, "pos")
    return _by_length(rows, sizes.filter(F.col("n") > LONG).select("conv"), plain, in_blocks).drop("tie", "turn")


def _by_length(rows: DataFrame, long: DataFrame, plain: Callable, in_blocks: Callable) -> DataFrame:
    """One function for conversations of moderate length and another for the long ones."""
    long = kept(long)
    if long.isEmpty():
        return plain(rows)
    a, b = (f(join_stats(rows, long, ["conv"], how)) for f, how in ((plain, "left_anti"), (in_blocks, "left_semi")))
    return a.unionByName(b)


def rebuilt(turns: DataFrame, group: int = 5, head: int = MAX_SHARED + 1) -> DataFrame:
    """Turns of conversations rebuilt on the head of their group's first one: conv, len, pos, turn_id, n_bytes.

    Conversation c takes the first h turns of c - c % ``group`` (the remainder has the sign of c), h being
    crc32(c) % ``head``, then its own turns after its first h. One row without a place stands for each conversation itself.
    """
    sizes = kept(turns.groupBy("conv").agg(F.count("*").alias("n")))
    c = F.col("conv")
    members = sizes.select("conv", "n", (c - c % group).alias("base"), (F.crc32(c.cast("string").cast("binary")) % head).alias("h"))
    bases = sizes.select(c.alias("base"), F.col("n").alias("base_n"))
    members = members.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))
    members = kept(members.select("conv", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    own = turns.join(members, "conv").filter("pos > h").select("conv", "len", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "turn_id", "n_bytes")
    heads = turns.filter(F.col("pos") < head).withColumnRenamed("conv", "base")
    shared = heads.join(members, "base").filter("pos <= h").select("conv", "len", "pos", "turn_id", "n_bytes")
    self_ = members.select("conv", "len", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("turn_id"), F.lit(None).cast("long").alias("n_bytes"))
    return own.union(shared).union(self_)


def _slots(block: int) -> list[str]:
    return [f"t{i + 1}" for i in range(block)]


def _total(field: str, block: int, upto: int | None = None) -> Column:
    return sum((F.coalesce(F.col(t)[field], F.lit(0).cast("long")) for t in _slots(block)[:upto]), F.lit(0).cast("long"))


def in_columns(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, len, blk, a, b, n, t1, ...): ``block`` turns a row; a, b name the node before the block, n its path's bytes."""
    lanes = _lanes(F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("turn_id")), 256))
    at = F.coalesce(F.col("pos") - 1, F.lit(0))
    slot = F.when(F.col("pos").isNotNull(), at % block)
    turn = F.struct(lanes[0].alias("a"), lanes[1].alias("b"), F.col("n_bytes").alias("n"))
    placed = turns.select("conv", "len", F.floor(at / block).alias("blk"), slot.alias("slot"), turn.alias("t"))
    rows = kept(placed.groupBy("conv", "len", "blk").agg(*[F.max(F.when(F.col("slot") == i, F.col("t"))).alias(t) for i, t in enumerate(_slots(block))]))
    zero = F.lit(0).cast("long")
    first = rows.filter(F.col("len") <= block).select("*", zero.alias("a"), zero.alias("b"), zero.alias("n"))
    further = rows.filter(F.col("len") > block)
    sums = {x: _total(x, block).cast("decimal(20,0)") for x in "abn"}

    def before(part: DataFrame, running: Mapping[str, Column]) -> DataFrame:
        left = {x: (F.coalesce(c, F.lit(0).cast("decimal(20,0)")) - sums[x]) for x, c in running.items()}
        return part.select("conv", "len", "blk", *_slots(block), *[(left[x] % F.lit(_MASK + 1) if x != "n" else left[x]).cast("long").alias(x) for x in "abn"])

    def plain(part: DataFrame) -> DataFrame:
        w = Window.partitionBy("conv").orderBy("blk").rowsBetween(Window.unboundedPreceding, 0)
        return before(part.select("*", *[F.sum(c).over(w).alias(f"run_{x}") for x, c in sums.items()]), {x: F.col(f"run_{x}") for x in "abn"})

    def in_blocks(part: DataFrame) -> DataFrame:
        return before(running_sums(part, ["conv"], ["blk"], {f"run_{x}": c for x, c in sums.items()}), {x: F.col(f"run_{x}") for x in "abn"})

    long = further.filter(F.col("len") > LONG).select("conv").distinct()
    return first.unionByName(_by_length(further, long, plain, in_blocks))


def _rolled(blocks: DataFrame, aggregates: Mapping[str, str], block: int) -> DataFrame:
    """Every prefix of every block, ``level`` turns long, with SQL aggregates over its members."""
    slots = ", ".join(_slots(block))
    made = ", ".join(f"{sql} AS {name}" for name, sql in aggregates.items())
    rolled = blocks.sparkSession.sql(f"SELECT blk, a, b, {slots}, {block} - bit_count(grouping_id()) AS level, {made} FROM {{blocks}} GROUP BY blk, a, b, ROLLUP({slots})", blocks=blocks)
    last = F.element_at(F.array(*_slots(block)), F.greatest(F.col("level"), F.lit(1)).cast("int"))
    # A level without its turn stands for conversations that ended before; level 0 is the node of the block before.
    found = rolled.withColumn("last", last).filter(((F.col("level") > 0) & F.col("last").isNotNull()) | ((F.col("level") == 0) & (F.col("blk") == 0)))
    name = lambda x: ((F.col(x) + _total(x, block)).bitwiseAND(_MASK))
    out = found.select("*", (F.col("blk") * block + F.col("level")).alias("depth"), name("a").alias("name_a"), name("b").alias("name_b"))
    return out.drop("a", "b")


def _lists(finals: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids of the conversations that end at a node, comma-joined.

    Ids are distinct, so a piece of PIECE_IDS consecutive ones is bounded; the pieces of a node are hashed in a stream.
    """
    node = ["depth", "name_a", "name_b"]
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = finals.groupBy(*node, F.floor(F.col("conv") / PIECE_IDS).alias("piece")).agg(ids.alias("ids"))

    def hashed(batches):
        key, state = None, None
        for b in batches:
            out = {n: [] for n in (*node, "ends")}
            for *at, ids_ in zip(*[b.column(n).to_pylist() for n in (*node, "ids")]):
                if at == key:
                    state.update(b"," + ids_.encode())
                    continue
                if key is not None:
                    for n, v in zip(out, (*key, state.hexdigest())):
                        out[n].append(v)
                key, state = at, hashlib.sha256(ids_.encode())
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.string() if n == "ends" else pa.int64()) for n, v in out.items()})
        if key is not None:
            yield pa.RecordBatch.from_pydict({n: pa.array([v], pa.string() if n == "ends" else pa.int64()) for n, v in zip((*node, "ends"), (*key, state.hexdigest()))})

    return pieces.repartition(*node).sortWithinPartitions(*node, "piece").mapInArrow(hashed, "depth long, name_a long, name_b long, ends string")


def trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Nodes of the trie of rebuilt conversations (``rebuilt``), one row each, the root (depth 0) included.

    conv_id (the smallest member), depth, parent_conv_id (the parent's conv_id, null for the root), n_convs, n_children,
    n_leaves (childless nodes of the subtree), saved_tokens ((n_convs - 1) times the bytes of the last text, summed
    over the subtree), ends_sha256. Without conversations there are no nodes.
    """
    blocks = kept(in_columns(turns, block))
    owned = _rolled(blocks, {"conv": "min(conv)", "longest": "max(len)"}, block)
    owners = owned.groupBy("conv").agg(F.count(F.when(F.col("depth") > 0, 1)).alias("owned"), F.max((F.col("longest") == F.col("depth")).cast("int")).alias("leaf"))
    lengths = blocks.filter("blk = 0").select("conv", "len")
    starts = lengths.join(owners, "conv", "left").select("conv", (F.col("len") + 1 - F.coalesce("owned", F.lit(0))).alias("start"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf"))
    rows = kept(blocks.join(starts, "conv"))
    place = lambda i: F.col("blk") * block + i
    # Bytes of turns that belong to other conversations' nodes, in this block and from it on.
    others = {f"x{i + 1}": F.when(place(i + 1) < F.col("start"), F.coalesce(F.col(t)["n"], F.lit(0).cast("long"))).otherwise(0) for i, t in enumerate(_slots(block))}
    rows = rows.select("*", *[c.alias(n) for n, c in others.items()])
    here = sum((F.col(n) for n in others), F.lit(0).cast("long"))
    # The block with the last such turn knows how many there are.
    ends_here = (place(0) < F.col("start") - 1) & (F.col("start") - 1 <= place(block))
    totals = rows.filter(ends_here & (F.col("len") > block)).select("conv", (F.col("n") + here).alias("total"))
    rows = rows.join(totals, "conv", "left").withColumn("rest", F.when(place(1) < F.col("start"), F.coalesce(F.col("total"), here) - F.col("n")).otherwise(0))
    owns = {f"o{i}": f"sum(CASE WHEN start <= blk * {block} + {i} AND blk * {block} + {i} <= len THEN 1 ELSE 0 END)" for i in range(1, block + 2)}
    sums = {n: f"sum({n})" for n in others} | {"rest": "sum(rest)", "n_leaves": "sum(leaf)", "conv_id": "min(conv)", "n_convs": "count(*)"}
    nodes = _rolled(rows, owns | sums, block)
    children = F.element_at(F.array(*owns), (F.col("level") + 1).cast("int"))
    above = F.aggregate(F.slice(F.array(*others), F.lit(1), F.greatest(F.col("level") - 1, F.lit(0)).cast("int")), F.lit(0).cast("long"), lambda s, x: s + x)
    up = lambda x: F.when(F.col("depth") > 0, (F.col(f"name_{x}") - F.col("last")[x]).bitwiseAND(_MASK))
    nodes = kept(nodes.select("conv_id", "depth", "n_convs", children.alias("n_children"), "n_leaves", (F.col("rest") - above).alias("saved_tokens"), "name_a", "name_b", up("a").alias("up_a"), up("b").alias("up_b")))
    final = blocks.filter(F.col("blk") == F.floor(F.greatest(F.col("len") - 1, F.lit(0)) / block))
    final = final.select("conv", F.col("len").alias("depth"), *[(F.col(x) + _total(x, block)).bitwiseAND(_MASK).alias(f"name_{x}") for x in "ab"])
    parents = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("name_a").alias("up_a"), F.col("name_b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    told = nodes.join(parents, ["depth", "up_a", "up_b"], "left").join(_lists(final), ["depth", "name_a", "name_b"], "left")
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
