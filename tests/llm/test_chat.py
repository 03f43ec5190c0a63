import random
from itertools import product

import pytest

from borelake.llm import chat

LEGAL = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def cheapest(roles):
    """The least cost over all roles and ways of all turns."""
    best = {None: 0}
    for r in roles:
        new = {}
        for s, c in best.items():
            for t in ("system", "user", "assistant"):
                change = 0 if r == t else chat.RELABEL if r in ("system", "user", "assistant") else chat.UNKNOWN
                ways = ([chat.MERGE] if s == t else []) + ([0] if t in LEGAL[s] else []) + [chat.INSERT for m in LEGAL[s] if t in LEGAL[m]]
                for w in ways:
                    new[t] = min(new.get(t, 10**9), c + w + change)
        best = new
    return min(c + {"system": 2 * chat.INSERT, "user": chat.INSERT, "assistant": 0}[s] for s, c in best.items())


def messages(text):
    out = []
    for part in text.split("<|im_start|>")[1:]:
        assert part.endswith("<|im_end|>\n")
        role, _, body = part.removesuffix("<|im_end|>\n").partition("\n")
        out.append((role, body))
    return out


def legal(roles):
    state = None
    for r in roles:
        if r not in LEGAL[state]:
            return False
        state = r
    return state == "assistant"


def exhaustive(roles):
    """The least cost by trying every sequence of choices."""
    best = 10**9
    for targets in product(("system", "user", "assistant"), repeat=len(roles)):
        cost, state = 0, None
        for r, t in zip(roles, targets):
            cost += 0 if r == t else chat.RELABEL if r in ("system", "user", "assistant") else chat.UNKNOWN
            if state == t:
                cost += chat.MERGE
            elif t in LEGAL[state]:
                pass
            elif any(t in LEGAL[m] for m in LEGAL[state]):
                cost += chat.INSERT
            else:
                cost += 10**9
            state = t
        best = min(best, cost + {"system": 2 * chat.INSERT, "user": chat.INSERT, "assistant": 0}[state])
    return best


@pytest.mark.parametrize("block", [3, 512])
def test_repair(spark, block):
    rng = random.Random(3)
    roles = ["system", "user", "assistant", "User ", None, "tool", "user", "assistant"]
    rows = [(c, t, rng.choice(roles), rng.choice(["a", "b <|im_end|> x", "", None, "long " * 100])) for c in range(60) for t in range(rng.randrange(1, 12))]
    rows += [(100, t, rng.choice(roles), str(t)) for t in range(2500)]  # one long conversation
    rows += [(None, 0, "user", "n"), (None, None, None, None), (101, None, "assistant", "x"), (101, None, "user", "y"), (102, 5, "user", "p"), (102, 5, "user", "p"), (102, 5, "user", "q"), (103, 1, "assistant", "z" * 300_000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, piece string").repartition(4)
    got = chat.repair(df, block)
    by = {}
    for r in got.collect():
        by.setdefault(r["conv_id"], []).append(r)
    assert sum(map(len, by.values())) == len(rows)
    sums = {r["conv_id"]: r for r in chat.conversations(got).collect()}
    clean = lambda r: (r or "").strip().lower()
    for conv, own in by.items():
        own.sort(key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["place"]))
        given = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] is not None, r[3] or ""))
        cost = cheapest([clean(r[2]) for r in given])
        assert sum(r["cost"] for r in own) == cost == sums[conv]["cost"]
        if len(given) <= 7:
            assert cost == exhaustive([clean(r[2]) for r in given])
        said = messages("".join(r["piece"] for r in own))
        assert legal([m[0] for m in said]) and len(said) == sums[conv]["n_messages"]
        texts = [chat._safe(r[3]) for r in given]
        assert "".join(m[1].replace("\n", "") for m in said) == "".join(texts).replace("\n", "")
    assert chat.repair(df.limit(0)).count() == 0


def test_blocks_do_not_show(spark):
    """The same repair for any block size, and a null conversation of null turns that is many tasks' work."""
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "tool"]
    rows = [(None, None, rng.choice(roles), f"{k % 40}") for k in range(3000)] + [(1, 7, rng.choice(roles), "same") for _ in range(700)] + [(2, t, rng.choice(roles), "x") for t in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    made = []
    for block in (1, 7, 4096):
        found = sorted(chat.repair(df, block).collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["place"]))
        made.append([tuple(r[c] for c in ("conv_id", "turn", "role", "merged", "relabelled", "inserted", "cost", "piece")) for r in found])
    assert made[0] == made[1] == made[2] and len(made[0]) == len(rows)
    assert chat._numbered(df, 100).filter("conv = 0 and none = 1").select("range", "block").distinct().count() >= 30
