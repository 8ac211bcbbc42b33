"""The trie of conversations against brute force, with every part made small enough to be cut."""

import hashlib
import random
import re
import zlib

import pytest

from tidemark.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = turns.get(base, [])[:h] + mine[h:]
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def totals(p):
        leaves, saved = (0, 0) if p in children else (1, 0)
        if p:
            saved += (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1]))
        for q in children.get(p, []):
            a, b = totals(q)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), *totals(p),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def tables():
    rng = random.Random(4)
    turn = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["a", "b c", "d\t e  f", "", None]))
    mixed = [(rng.randint(-40, 90), rng.choice([None, 0, 1, 2, 3, 4, 5]), *turn()) for _ in range(500)]
    mixed += [(None, 1, "user", "lost"), (7, 9, "user", "word " * 30000), (7, 9, "user", "word " * 30000)]
    hot = [(c, t, "user", f"same {t}") for c in range(200, 280) for t in range(5)]
    fan = [(c, t, "user", f"first {t}" if t < 4 else f"own {c}") for c in range(400, 460) for t in range(6)]
    long = [(1000, t, "user", f"t{t}") for t in range(90)] + [(1001 + k, t, "user", f"t{t}") for k in range(6) for t in range(10 * k)]
    return {"mixed": mixed, "hot": hot, "fan": fan, "long": long, "all": mixed + hot + fan + long, "none": []}


@pytest.mark.parametrize("name", list(tables()))
def test_trie_equals_brute_force(spark, name):
    rows = tables()[name]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    small = dict(shard_turns=12, piece=4, queued=3, block_bits=2, chunk_bits=2)
    for name in ("x", "depth", "row", "length", "heavy", "band", "p", "leaves"):
        df = df.selectExpr("*", f"'q' AS {name}")
    got = prefix_trie.trie(df, **small)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_whole_in_one_shard(spark):
    rows = tables()["all"]
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_queue_gives_rows_back_in_order_through_its_file():
    rng = random.Random(1)
    queue = prefix_trie.SpillingQueue(4)
    queue.READ = 3
    waiting = [(-rng.randint(0, 9), rng.randint(0, 3), 0, k, k) for k in range(500)]
    for row in waiting:
        queue.push(row)
    assert queue.file is not None and len(queue.near) <= 4
    got = [row for key in sorted({r[:3] for r in waiting}) for row in sorted(queue.due(key))]
    assert got == sorted(waiting)
    assert not queue.near and not queue.runs
