import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from cases import sha

from lakekit.llm import conversation_trie, queries

TURNS = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """The contract's nodes from plain lists."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, tie), (role, text)))
    turns = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        path = (*turns.get(base, [])[:h], *turns[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(of) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, of in members.items():
        up = min(members[node[:-1]]) if node else None
        out.append((min(of), len(node), up, len(of), children[node], leaves[node], saved[node], sha(",".join(map(str, sorted(ends.get(node, [])))))))
    return sorted(out, key=str)


def got(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def hard_rows(seed=1):
    """Shared first turns, equal conversations, null and repeated fields and rows, ties, negative and far ids, one long one."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(-12, 160), 5000, 9999, 2**40, 2**40 + 3]:
        rows += [(c, None if t == 0 and c % 7 == 0 else t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "é€", "long " * 9])) for t in range(rng.randint(1, 6))]
    rows += [(c, t, "user", f"step {t}") for c in range(200, 260) for t in range(9 + c % 3)]
    rows += [(300, t, "user", "word") for t in range(300)] + [(301, t, "user", "word") for t in range(280)]
    rows += [rows[3], (None, 1, "user", "x"), (400, 1, "a", "b"), (400, 1, "b", "a"), (400, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most_paths", [conversation_trie.PATHS, 20, 1, 0])
def test_query_on_hard_rows(spark, root, monkeypatch, most_paths):
    """The same nodes with no shared upper nodes, some, and as many as there can be."""
    whole = conversation_trie.nodes
    monkeypatch.setattr(conversation_trie, "nodes", lambda s: whole(s, most_paths))
    monkeypatch.setattr(conversation_trie, "PATHS", max(2, most_paths // 4))
    monkeypatch.setattr(conversation_trie, "BLOCK", 3)
    rows = hard_rows()
    if most_paths < 20:
        rows = [r for r in rows if r[0] not in (300, 301)]
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    df.selectExpr("*", "1 as path", "2 as shard", "3 as above", "4 as node", "5 as n").write.parquet(f"{root}/conversations.parquet")
    assert got(queries.op12_double_arrays(spark, root)) == brute(rows)


def test_empty_and_turnless(spark, root):
    spark.createDataFrame([], TURNS).write.parquet(f"{root}/a/conversations.parquet")
    assert got(queries.op12_double_arrays(spark, f"{root}/a")) == []
    alone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(alone, 0, "user", "gone"), (None, 0, "user", "of none")]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{root}/b/conversations.parquet")
    assert got(queries.op12_double_arrays(spark, f"{root}/b")) == brute(rows) == [(alone, 0, None, 1, 0, 1, 0, sha(str(alone)))]


def test_double_array_finds_what_was_packed_and_nothing_else():
    rng = random.Random(7)
    packed = {tuple(rng.randint(1, 300) for _ in range(rng.randint(0, 6))) for _ in range(3000)}
    trie = conversation_trie.DoubleArray([list(s) for s in packed])
    prefixes = {s[:d] for s in packed for d in range(1, len(s) + 1)}
    slots = {}
    for s in packed:
        way = trie.walk(list(s))
        assert len(way) == len(s)
        for d, slot in enumerate(way, 1):
            assert slots.setdefault(slot, s[:d]) == s[:d]
    assert len(slots) == len(prefixes) == (trie.check[1:] >= 0).sum()
    for _ in range(3000):
        s = [rng.randint(1, 301) for _ in range(4)]
        known = max((d for d in range(5) if tuple(s[:d]) in prefixes or d == 0))
        assert len(trie.walk(s)) == known
