"""The prefix trie of conversations, by digests of blocks of turns.

Conversations are cut into blocks of ``BLOCK`` turns. A block's digest goes into the digest of all blocks up to it, and conversations are
grouped by that: what they share is found block by block, with counts and least ids added up before anything is shuffled. Where all who
share the blocks so far go on with the same block, its turns have the same members, and no turn is compared. Only where siblings part are
the distinct blocks (not the conversations) opened, and their turns grouped by digests of the turns up to each.

No level waits for another. The least member of a node is the least member of all nodes below it that it reaches, so every conversation
owns the end of its path and shares the rest with lesser ones; sums over a subtree are sums over its members: the words of the part that
a member shares, and whether it owns a leaf. Digests are 128 bits of XXH64; the one of several blocks is an exclusive or over (number,
block), so that the blocks of one endless conversation are dealt to many tasks like any other rows.

Turns are ordered by number, null first; equal numbers by the digest of role and text. A null role or text is empty. Rows without a
conversation id belong to none and are left out. Repeated rows are turns of their own. An empty table has no trie, not even a root.
Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyclock.functions.timeunits import floor_div
from keyclock.llm.shared import WORD, written
from keyclock.operators.scan import Fold, running

BLOCK = 4
SLICE = 4096  # turns of a conversation, or ids of a node, that one task takes at a time
HEAD = 3  # the most turns that a rebuilt conversation takes from another
_KEY = ["k1", "k2"]


def numbered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 1), digest ``d`` and ``words`` of every turn. The texts are read once, and go no further."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.struct(F.xxhash64(r, t).alias("a"), F.xxhash64(F.lit("again"), r, t).alias("b"))
    turns = conversations.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), digest.alias("d"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("words"))
    turns = written(turns.where(F.col("conv").isNotNull()))
    order = [F.col("turn").asc_nulls_first(), F.col("d")]
    return running(turns, ["conv"], order, floor_div("turn", SLICE), [Fold("pos", "sum", F.lit(1).cast("long"))]).drop("turn")


def rebuilt_turns(turns: DataFrame, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """All conversations (``conv``), and their turns (conv, pos, d, words) where each begins with the first h turns of the one whose id is
    the next lower multiple of ``every``, h being the CRC-32 of its own id modulo four, and goes on with its own after its first h."""
    turns = written(turns)
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % (HEAD + 1)
    heads = written(turns.where(F.col("pos") <= HEAD).groupBy("conv").agg(F.collect_list(F.struct("pos", "d", "words")).alias("head")))
    wanted = heads.select("conv", (F.col("conv") - F.col("conv") % every).alias("base"), taken.alias("h"))
    begun = wanted.join(heads.select(F.col("conv").alias("base"), "head"), "base").select("conv", "h", F.inline("head")).where("pos <= h").drop("h")
    rest = turns.where(F.col("pos") > taken).select("conv", "pos", "d", "words")
    count = [Fold("place", "sum", F.lit(1).cast("long"))]
    both = running(begun.unionByName(rest), ["conv"], [F.col("pos")], floor_div("pos", SLICE), count)
    return heads.select("conv"), both.select("conv", F.col("place").alias("pos"), "d", "words")


def _digest(*parts: Column) -> list[Column]:
    return [F.xxhash64(*parts), F.xxhash64(F.lit("again"), *parts)]


def conversation_blocks(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation and block: ``d`` and ``w`` (digests and words of its turns), ``p1``, ``p2`` (the digest of all blocks before
    it), ``x1``, ``x2`` (with it), ``before`` (words before it)."""
    cut = turns.groupBy("conv", floor_div(F.col("pos") - 1, block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "d", "words"))).alias("t"))
    one, two = _digest(F.col("block"), F.col("t.d"))
    cut = cut.select("conv", "block", F.col("t.d").alias("d"), F.col("t.words").alias("w"), one.alias("b1"), two.alias("b2"))
    folds = [Fold("x1", "xor", F.col("b1")), Fold("x2", "xor", F.col("b2")), Fold("upto", "sum", _total(F.col("w")))]
    cut = running(cut, ["conv"], [F.col("block")], floor_div("block", SLICE), folds)
    return cut.select("conv", "block", "d", "w", *[F.col(f"x{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"p{i}") for i in (1, 2)], "x1", "x2", (F.col("upto") - _total(F.col("w"))).alias("before"))


def _total(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + x)


def _node_key(place: Column, block: int, name: str) -> Column:
    """The key of the node that the first ``place`` turns of a block row lead to."""
    i = int(name[-1])
    inside = _digest(F.col("p1"), F.col("p2"), F.col("block"), place, F.slice("d", 1, place))[i - 1]
    return F.when(place == 0, F.col(f"p{i}")).when(place == block, F.col(f"x{i}")).otherwise(inside)


def _opened(blocks: DataFrame, block: int, *columns: str) -> DataFrame:
    """One row per turn of every block row: depth, key and parent's key, words before the turn, words from it to the block's end."""

    def node(i: Column) -> Column:
        i = i.cast("int")
        keys = [_node_key(i, block, k).alias(k) for k in _KEY] + [_node_key(i - 1, block, k).alias(f"parent_{k}") for k in _KEY]
        ahead = _total(F.slice("w", F.lit(1), i - 1))
        return F.struct((F.col("block") * block + i).alias("depth"), *keys, (F.col("before") + ahead).alias("ahead"), (_total(F.col("w")) - ahead).alias("rest"))

    return blocks.select(*columns, F.inline(F.transform(F.sequence(F.lit(1), F.size("d")), node)))


def id_digests(ends: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``ends_sha256``: SHA-256 of the ids (``conv``) of each key, ascending, joined by commas.

    Ids are joined in runs by many tasks; a key's runs then pass through one hash in order, one at a time."""
    runs = ends.groupBy(*_KEY, floor_div("conv", SLICE).alias("run")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        key, state = None, None
        for batch in batches:
            out = []
            for k1, k2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if key == (k1, k2):
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip((*_KEY, "ends_sha256"), r)) for r in out], schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([{"k1": key[0], "k2": key[1], "ends_sha256": state.hexdigest()}], schema)

    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    return runs.repartition(*_KEY).sortWithinPartitions(*_KEY, "run").mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv, pos from 1, d, words): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. ``convs`` (conv) has the conversations without turns, too."""
    rows = written(conversation_blocks(turns, block))
    shared = ["block", "p1", "p2", "x1", "x2"]
    distinct = written(rows.groupBy(*shared).agg(F.count("*").alias("n"), F.min("conv").alias("least"), F.first("d").alias("d"), F.first("w").alias("w"), F.first("before").alias("before")))
    # blocks without siblings: all who come so far go on alike
    family = distinct.where("block > 0").groupBy("block", "p1", "p2").agg((F.count("*") == 1).alias("alone"))
    marked = distinct.where("block > 0").join(family, ["block", "p1", "p2"]).unionByName(distinct.where("block = 0").withColumn("alone", F.lit(False)))
    marked = written(marked)

    # nodes with their least members, to learn what each conversation owns
    node, parent = ["depth", *_KEY], [f"parent_{k}" for k in _KEY]
    straight = _opened(marked.where("alone"), block, "least").select(*node, *parent, "least", "ahead")
    parted = _opened(marked.where("not alone"), block, "least").groupBy(*node, *parent).agg(F.min("least").alias("least"), F.min("ahead").alias("ahead"))
    nodes = written(straight.unionByName(parted))
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), *[F.col(p).alias(k) for p, k in zip(parent, _KEY)]).agg(F.count("*").alias("n_children"))
    children = written(children)
    owned = nodes.groupBy(F.col("least").alias("conv")).agg(F.min("ahead").alias("shared"))
    leaves = nodes.join(children, node, "left_anti").select(F.col("least").alias("conv"), F.lit(1).cast("long").alias("leaf"))
    last = F.struct("before", "w", *[_node_key(F.size("d"), block, k).alias(k) for k in _KEY])
    members = rows.groupBy("conv").agg(F.max_by(last, "block").alias("last")).join(owned, "conv", "left").join(leaves, "conv", "left")
    # a conversation that owns no node shares all its words
    members = members.select("conv", F.coalesce("shared", F.col("last.before") + _total(F.col("last.w"))).alias("shared"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"), "last.k1", "last.k2")
    members = written(members)

    # what the members of a block share after it, and the leaves they own
    after = F.greatest(F.lit(0).cast("long"), F.col("shared") - F.col("before") - _total(F.col("w")))
    sums = rows.join(members.select("conv", "shared", "leaf"), "conv").groupBy(*shared).agg(F.sum(after).alias("after"), F.sum("leaf").alias("leaves"), F.min_by("shared", "conv").alias("least_shares"))
    full = _opened(marked.join(sums, shared), block, "alone", "n", "least", "leaves", "after", "least_shares")
    # all but the least share the rest of the block; the least shares what it does not own
    saved = F.col("after") + (F.col("n") - 1) * F.col("rest") + F.greatest(F.lit(0).cast("long"), F.col("least_shares") - F.col("ahead"))
    full = full.withColumn("saved", saved)
    straight = full.where("alone").select(*node, *parent, "least", "n", "leaves", "saved")
    parted = full.where("not alone").groupBy(*node, *parent).agg(F.min("least").alias("least"), *[F.sum(c).alias(c) for c in ("n", "leaves", "saved")])
    nodes = written(straight.unionByName(parted))

    # the root, whose key no block has
    zero = F.lit(0).cast("long")
    everyone = convs.join(members, "conv", "left")
    root = everyone.agg(F.min("conv").alias("least"), F.count("*").alias("n"), F.sum(F.coalesce("leaf", zero)).alias("leaves"), F.sum(F.coalesce("shared", zero)).alias("saved")).where("n > 0")
    root = written(root.withColumn("leaves", F.greatest("leaves", F.lit(1).cast("long"))))
    top = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("above"), "least", "n", "leaves", "saved")
    # what lies under the root would all meet in one task of a join by keys; the root is one row
    first = nodes.where("depth = 1").join(F.broadcast(root.select(F.lit(1).cast("long").alias("depth"), F.col("least").alias("above"))), "depth")
    names = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(p) for p, k in zip(parent, _KEY)], F.col("least").alias("above"))
    below = nodes.where("depth > 1").join(names, ["depth", *parent])
    columns = [*node, "above", "least", "n", "leaves", "saved"]
    found = first.select(*columns).unionByName(below.select(*columns)).unionByName(top)
    ends = members.select(*_KEY, "conv").unionByName(convs.join(members, "conv", "left_anti").select(zero.alias("k1"), zero.alias("k2"), "conv"))
    found = found.join(children, node, "left").join(id_digests(ends), _KEY, "left")
    return found.select(
        F.col("least").alias("conv_id"),
        "depth",
        F.col("above").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.coalesce("n_children", zero).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of conversations that share their beginnings with others, as :func:`rebuilt_turns` has them."""
    return trie(*rebuilt_turns(numbered_turns(conversations)), block)
