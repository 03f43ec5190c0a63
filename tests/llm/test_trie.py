import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borelake.llm import trie

SCHEMA = T.StructType([T.StructField(c, t) for c, t in (("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("id", T.StringType()))])


def order(turn, role, text):
    return (turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], len(text))


def brute(rows, rebuild=True):
    """The nodes from all prefixes of all conversations."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts, key=lambda x: order(*x))] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:]) if rebuild else tuple(ts)
    members = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    out = set()
    for path, who in members.items():
        under = [p for p in members if p[: len(path)] == path]
        kids = sum(len(p) == len(path) + 1 for p in under)
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in under) for p in under)
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p)
        ends = ",".join(map(str, sorted(c for c in who if made[c] == path)))
        out.add((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    assert len(out) == len(members)
    return out


def rows_of(df):
    got = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(got) == len(set(got))
    return set(got)


def conversations():
    rows = [(None, 1, "user", "nobody's", "x")]
    for c in range(100, 130):
        rows += [(c, k, ("user", "assistant")[k % 2], f"text {k if k < c % 7 else c % 3} é\U0001f600", "clash") for k in range(c % 11)]
    for c in (200, 204, 205, 206, 233):  # shared far beyond a block, one of them longer
        rows += [(c, k, "user", f"long {k}", None) for k in range(23 + 3 * (c == 205))]
    for c in (-7, 300, 301):
        rows += [(c, 1, None, None, None), (c, None, "user", "no number", None), (c, 1, "user", "", None), (c, 1, "user", "", None), (c, 1, "user", "tie", None)]
    rows += [(401, 1, "user", "goes if h > 0", None), (402, 1, "user", "too", None), (403, 1, "user", "too", None)]
    return rows


@pytest.mark.parametrize("width", [3, 16])
def test_all_nodes(spark, width):
    rows = conversations()
    own = trie.turns(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(trie.trie(trie.rebuilt(own), width)) == brute(rows)


def test_plain_conversations(spark):
    rows = conversations()
    found = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), width=4)
    assert rows_of(found) == brute(rows, rebuild=False)
    assert found.filter("turn_id is null").count() == 1


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.trie(trie.rebuilt(trie.turns(empty))).count() == 0


def test_one_conversation_of_many_turns_and_many_alike(spark):
    long = spark.range(20_000).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), (F.col("id") % 10).cast("string").alias("text"))
    alike = spark.range(30_000).select((F.col("id") + 1000).alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), F.lit("hello").alias("text"))
    found = {(r.conv_id, r.depth): r for r in trie.prefix_trie(long.unionByName(alike)).collect()}
    assert len(found) == 1 + 20_000 + 1
    root, hello, last = found[7, 0], found[1000, 1], found[7, 20_000]
    assert (root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (30_001, 2, 2, 5 * 29_999)
    assert hello.ends_sha256 == hashlib.sha256(",".join(str(k + 1000) for k in range(30_000)).encode()).hexdigest()
    assert (last.n_children, last.parent_conv_id, last.ends_sha256) == (0, 7, hashlib.sha256(b"7").hexdigest())
