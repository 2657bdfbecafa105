import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from gustline.llm import prefix_trie

COLUMNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    given, members, kids, totals, out = defaultdict(list), defaultdict(list), defaultdict(list), {}, []
    for c, turn, role, text in rows:
        if c is not None:
            given[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [turn[2:] for turn in sorted(turns)] for c, turns in given.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
        for depth in range(len(whole[c]) + 1):
            members[tuple(whole[c][:depth])].append(c)
    for key in sorted(members, key=len, reverse=True):
        if key:
            kids[key[:-1]].append(key)
        saved = (len(members[key]) - 1) * (len(key[-1][1]) if key else 0)
        below = [totals[k] for k in kids[key]]
        totals[key] = (len(below), sum(x[1] for x in below) or 1, saved + sum(x[2] for x in below))
    for key, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(whole[c]) == len(key))
        parent = min(members[key[:-1]]) if key else None
        out.append((min(of), len(key), parent, len(of), *totals[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    assert sorted(map(tuple, prefix_trie.prefix_trie(df).collect()), key=repr) == brute(rows)


def talks(seed, n):
    rng = random.Random(seed)
    texts = ["", "hi", "hello there", "é🎉", "a,b", "yes", "no"]
    rows = []
    for c in [*range(n), *range(250, 250 + n), -7, -100, -105, 900]:
        for turn in range(rng.choice([1, 2, 3, 4, 8, 12])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(texts) * rng.choice([1, 1, 3])))
    return rows


ODD = [
    (None, 1, "user", "no id"), (5, None, None, None), (5, None, "user", "null turn"), (5, 1, "user", "tie"), (5, 1, "user", "tie"),
    (5, 1, "assistant", "tie"), (0, 3, "user", "x" * 100_000), (0, 3, "user", None), (0, 1, "system", "s"), (150, 1, "user", "base is missing"),
    (151, 1, "u", "gone"), (152, 1, "u", "gone"), (199, 0, "u", "a"), (199, 1, "u", "b"), (-150, 0, "u", "a"),
]


def test_against_brute_force(spark):
    check(spark, talks(1, 120))
    check(spark, ODD)
    check(spark, [])
    check(spark, [(None, 1, "user", "x")])


@pytest.mark.parametrize("breadth,levels,block,queue,piece", [(2, 2, 2, 1, 1), (3, 5, 3, 7, 2), (64, 4, 1, 500, 3)])
def test_many_parts_small_queues_and_pieces(spark, monkeypatch, breadth, levels, block, queue, piece):
    for name, value in (("BREADTH", breadth), ("LEVELS", levels), ("BLOCK", block), ("QUEUE_MESSAGES", queue), ("IDS_PER_PIECE", piece)):
        monkeypatch.setattr(prefix_trie, name, value)
    monkeypatch.setattr(prefix_trie, "BROADCAST_NODES", 0)
    check(spark, talks(2, 60))


def test_one_long_conversation_and_many_copies(spark):
    rows = [(0, i, "user", f"turn {i}") for i in range(1500)] + [(c, i, "user", f"turn {i}") for c in range(1, 300) for i in range(3)]
    check(spark, rows)


def test_other_columns(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in talks(3, 20)], f"{COLUMNS}, depth int, ka string")
    assert prefix_trie.prefix_trie(df).count() == len(brute(talks(3, 20)))


def test_queue_gives_messages_in_order_and_spills():
    rng = random.Random(4)
    queue = prefix_trie.MessageQueue(limit=10)
    messages = [(rng.randint(0, 40), rng.randint(0, 5), 0, i, 0) for i in range(3000)]
    for message in messages:
        queue.push(message)
    assert queue.spilled > 2000 and len(queue.heap) <= 10
    for time in sorted({m[:3] for m in messages}):
        assert sorted(m[3] for m in queue.pop_at(time)) == sorted(m[3] for m in messages if m[:3] == time)
        assert list(queue.pop_at(time)) == []
    queue.close()
