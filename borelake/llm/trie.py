"""The prefix trie of conversations by ROLLUP over columns of turns.

A turn's id is a digest of its role and text with the text's length. The first
``width`` turns of each conversation stand in columns; one ROLLUP over them
groups all prefixes at once, grouping_id tells how long each is. Conversations
that go on stand in the next block of columns, keyed by the node that the block
before ended in. A second ROLLUP, over nodes, from the last block to the first,
sums leaves and savings of subtrees; a block's totals are added to the node that
it hangs from.

A conversation that is alone in a block's first node has nothing to group: what
is left of it is a chain, and its nodes are written down as such. So there are
as many rounds as blocks that conversations share, not as the longest has.

Turns are numbered over sorted ranges, and a conversation is a row a block, so
a conversation with very many turns is many tasks. The ids of those that end in
a node are joined into pieces over sorted ranges, and the pieces hashed one
after the other; no list of a node's members is ever held.

Defined results: null roles and texts are empty; turns of equal number follow
each other by their id, null numbers come first; repeated rows are turns of
their own; rows without conv_id belong to no conversation and are left out; no
conversations give no nodes; further columns are ignored, and their names don't
matter. Texts are told apart by 128 bits of SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borelake.llm.buckets import returned
from borelake.operators.ranks import numbered
from borelake.shared import stored

#: Turns of a block; the ROLLUP makes a row more for each conversation before rows are put together.
WIDTH = 16
#: Characters of a turn's id: 32 of the digest, 10 of the length.
_ID = 42


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, number (from 1) and id of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    ids = conversations.select("conv_id", "turn", F.concat(digest, F.lpad(F.char_length(text).cast("string"), 10, "0")).alias("id"))
    rows = ids.filter("conv_id is not null").withColumn("_row", F.monotonically_increasing_id())
    return numbered(rows, ["conv_id"], ["turn", "id", "_row"]).select("conv_id", "number", "id")


def rebuilt(own: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Turns of conversations whose first turns are those of another: with h = crc32(conv_id) % ``most``, the first h of conversation c - c % ``group``, then all but the first h of c. A conversation without turns is a row without number and id."""
    convs = own.groupBy("conv_id").agg(F.max("number").alias("_own"))
    convs = convs.withColumns({"_h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most, "_from": F.col("conv_id") - F.col("conv_id") % group})
    heads = own.filter((F.col("conv_id") % group == 0) & (F.col("number") < most)).groupBy(F.col("conv_id").alias("_from")).agg(F.sort_array(F.collect_list(F.struct("number", "id"))).alias("_head"))
    convs = convs.join(heads, "_from", "left")
    head = F.filter(F.coalesce("_head", F.array().cast("array<struct<number:bigint,id:string>>")), lambda x: x.number <= F.col("_h"))
    convs = stored(convs.select("conv_id", "_h", head.alias("_head"), F.size(head).cast("long").alias("_heads")), "heads")
    first = convs.select("conv_id", F.explode_outer("_head").alias("_turn")).select("conv_id", "_turn.number", "_turn.id")
    rest = own.join(convs.drop("_head"), "conv_id").filter("number > _h").select("conv_id", (F.col("number") - F.col("_h") + F.col("_heads")).alias("number"), "id")
    return first.unionByName(rest)


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    """A row for each conversation and block of turns: t0, t1, ..., and the number of turns in _turns."""
    at = F.col("number") - 1
    block = F.coalesce(F.floor(at / width), F.lit(0)).cast("int")
    made = rows.groupBy("conv_id", block.alias("block")).agg(*[F.max(F.when(at % width == k, F.col("id"))).alias(f"t{k}") for k in range(width)], F.coalesce(F.max("number"), F.lit(0)).alias("_last"))
    ends = made.groupBy("conv_id").agg(F.max("_last").alias("_turns"))
    return stored(made.drop("_last").join(ends, "conv_id"), "blocks")


def _key(k: int, path: Column) -> Column:
    """The node that ``path`` leads to in block k from node prior; '' is the root."""
    named = F.md5(F.concat_ws("|", F.lit(str(k)), "prior", path).cast("binary"))
    return F.when(path == "", F.col("prior")).otherwise(named)


def _prefixes(rows: DataFrame, width: int, *sums: Column) -> DataFrame:
    """ROLLUP over the columns of turns, from each first node: prior, t0, ..., path, _deep (turns in the block) and ``sums``."""
    cols = [f"t{k}" for k in range(width)]
    rolled = rows.rollup("prior", *cols).agg(F.grouping_id().alias("_gid"), *sums)
    rolled = rolled.withColumns({"path": F.concat_ws("", *cols), "_deep": width - F.bit_count("_gid")}).drop("_gid")
    return rolled.filter((F.col("_deep") >= 0) & (F.length("path") == _ID * F.col("_deep")))


def _joined(rows: DataFrame) -> DataFrame:
    """key and ends_sha256: the hash of each key's conv_ids, ascending, with commas between."""
    pieces = "key string, first long, ids binary"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            begins = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).astype(np.int32)
            ids = batch.column("conv_id")
            text = pc.binary_join(pa.ListArray.from_arrays(begins, ids.cast(pa.string())), ",")
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(begins[:-1])), ids.take(pa.array(begins[:-1])), text.cast(pa.binary())], ["key", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, found = [], []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k == key:
                    state.update(b"," + ids)
                    continue
                if state is not None:
                    keys.append(key)
                    found.append(state.hexdigest())
                key, state = k, hashlib.sha256(ids)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], ["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    sorted_ = rows.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    return sorted_.mapInArrow(returned(gather), pieces).repartition("key").sortWithinPartitions("key", "first").mapInArrow(returned(hashed), "key string, ends_sha256 string")


def trie(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """The nodes of the prefix trie of ``rows`` (conv_id, number from 1, id; without number and id: a conversation without turns).

    A node is named by conv_id, its smallest member, and depth. turn_id is that of its last turn.
    """
    blocks = _blocks(rows, width)
    active = blocks.filter("block = 0").withColumn("prior", F.lit(""))
    rounds, ends, tails, k = [], [], [], 0
    while True:
        deep = F.col("_turns") > (k + 1) * width
        nodes = _prefixes(active, width, F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("_turns").alias("_deepest"))
        rounds.append(stored(nodes.filter(F.lit(k == 0) | (F.col("_deep") > 0)), "nodes"))
        here = active.select("conv_id", "_turns", _key(k, F.concat_ws("", *[f"t{j}" for j in range(width)])).alias("key"))
        ends.append(here.filter(~deep).select("key", "conv_id"))
        k += 1
        going = stored(here.filter(deep).select("conv_id", F.col("key").alias("prior")), "going")
        if going.isEmpty():
            break
        alone = stored(going.groupBy("prior").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("_n")), "alone").filter("_n = 1").select("conv_id", "prior")
        tails.append(blocks.filter(F.col("block") >= k).join(alone, "conv_id").select("conv_id", "block", "_turns", "prior", F.lit(k).alias("_k"), *[f"t{j}" for j in range(width)]))
        active = stored(blocks.filter(F.col("block") == k).join(going.join(alone, "conv_id", "left_anti"), "conv_id"), "active")
        if active.isEmpty():
            break

    # subtrees, from the last block of turns to the first
    chains = [t.filter(F.col("block") == F.col("_k")).select("prior", F.lit(1).cast("long").alias("_leaves"), F.lit(0).cast("long").alias("_saved")) for t in tails]
    made, below = [], None
    for k in reversed(range(len(rounds))):
        last = F.substring("path", -10, 10).try_cast("long")
        own = rounds[k].withColumns({"_leaf": (F.col("_deepest") == F.col("_deep") + k * width).cast("long"), "_save": (F.col("n_convs") - 1) * F.coalesce(last, F.lit(0))})
        hung = [*([below] if below is not None else []), *([chains[k]] if k < len(chains) else [])]
        if hung:
            more = reduce(DataFrame.unionByName, hung).withColumnRenamed("prior", "_below")
            own = own.join(more, _key(k, F.col("path")) == F.col("_below"), "left")
            own = own.withColumns({"_leaf": F.col("_leaf") + F.coalesce("_leaves", F.lit(0)), "_save": F.col("_save") + F.coalesce("_saved", F.lit(0))})
        sums = _prefixes(own, width, F.min("conv_id").alias("conv_id"), F.max("n_convs").alias("n_convs"), F.sum("_leaf").alias("n_leaves"), F.sum("_save").alias("saved_tokens"))
        sums = sums.withColumns({"key": _key(k, F.col("path")), "depth": F.col("_deep").cast("long") + k * width})
        parent = F.expr(f"substring(path, 1, length(path) - {_ID})")
        sums = sums.withColumns({"parent": F.when(F.col("depth") > 0, _key(k, parent)), "turn_id": F.when(F.col("_deep") > 0, F.substring("path", -_ID, _ID))})
        sums = stored(sums.select("key", "parent", "turn_id", "depth", "conv_id", "n_convs", "n_leaves", "saved_tokens", "_deep"), "subtrees")
        below = sums.filter("_deep = 0").select(F.col("key").alias("prior"), F.col("n_leaves").alias("_leaves"), F.col("saved_tokens").alias("_saved"))
        made.append(sums.filter(F.lit(k == 0) | (F.col("_deep") > 0)).drop("_deep"))
    shared = reduce(DataFrame.unionByName, made)
    begun = [t.filter(F.col("block") == F.col("_k")).select(F.col("prior").alias("parent")) for t in tails]
    kids = reduce(DataFrame.unionByName, [shared.select("parent"), *begun]).filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    hashes = _joined(reduce(DataFrame.unionByName, ends))
    nodes = shared.join(kids, "key", "left").join(hashes, "key", "left")
    names = shared.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(names, "parent", "left")
    nodes = nodes.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))})
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_id"]
    return reduce(DataFrame.unionByName, [nodes.select(*out), *[_chain(t, names, width).select(*out) for t in tails]])


def _chain(tail: DataFrame, names: DataFrame, width: int) -> DataFrame:
    """The nodes of conversations that share nothing further; the first hangs from the node of the block before, as ``names`` has it."""
    first = F.col("block") == F.col("_k")
    hung = tail.filter(first).join(names.withColumnsRenamed({"parent": "prior", "parent_conv_id": "_hung"}), "prior")
    tail = hung.unionByName(tail.filter(~first).withColumn("_hung", F.col("conv_id")))
    ids = F.array(*[f"t{k}" for k in range(width)])
    at = tail.select("conv_id", "block", "_turns", "_hung", "_k", F.posexplode(ids).alias("_at", "turn_id")).filter("turn_id is not null")
    depth = (F.col("block") * width + F.col("_at") + 1).cast("long")
    ended = depth == F.col("_turns")
    end = F.sha2(F.when(ended, F.col("conv_id").cast("string")).otherwise(F.lit("")), 256)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return at.select("conv_id", depth.alias("depth"), F.when(first & (F.col("_at") == 0), F.col("_hung")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(ended, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), end.alias("ends_sha256"), "turn_id")


def prefix_trie(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """The trie of conversations as they are."""
    return trie(stored(turns(conversations), "turns"), width)


def op12_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    own = turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return trie(rebuilt(stored(own, "turns"))).drop("turn_id")


QUERIES = {"op12_trie": op12_trie}
SQL = {
    "op12_trie": """
WITH named AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), ordered AS (
    SELECT conv_id, role, text, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(length(role)::VARCHAR || ':' || role || text), 1, 32), length(text)) AS number
    FROM named
), own AS (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY number) AS turns FROM ordered GROUP BY conv_id
), hashed AS (
    SELECT *, xor(list_reduce(
        list_prepend(4294967295::UBIGINT, list_transform(str_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384::UBIGINT))
    ), 4294967295::UBIGINT) % 6 AS h FROM own
), made AS (
    SELECT a.conv_id, coalesce(b.turns[1:a.h], []) || a.turns[a.h + 1:] AS turns
    FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100
), prefixes AS (
    SELECT conv_id, len(turns) AS n, d AS depth, turns[1:d] AS path FROM made, unnest(range(0, len(turns) + 1)) AS t(d)
), nodes AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = depth AS leaf,
        coalesce((count(*) - 1) * length(path[depth].text), 0) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
    FROM prefixes GROUP BY path, depth
), sums AS (
    SELECT a.path, a.depth, count(*) FILTER (b.depth = a.depth + 1) AS n_children, count(*) FILTER (b.leaf) AS n_leaves, sum(b.saved) AS saved_tokens
    FROM nodes a JOIN nodes b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path GROUP BY a.path, a.depth
)
SELECT a.conv_id, a.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, a.n_convs, s.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, a.ends_sha256
FROM nodes a JOIN sums s ON s.depth = a.depth AND s.path = a.path
LEFT JOIN nodes p ON p.depth = a.depth - 1 AND p.path = a.path[1:a.depth - 1]
"""
}
