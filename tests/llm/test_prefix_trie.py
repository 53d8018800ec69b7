"""Prefix trie of conversations against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from tests.llm.conftest import rows_of
from veleta.llm.prefix_trie import grow_forest, prefix_trie

SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def element_key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append(((turn is not None, turn or 0, element_key(role, text)), role, text))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - int(abs(c) % 5 * (1 if c > 0 else -1)), [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def subtree(node):
        own_saved = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        parts = [subtree(k) for k in children.get(node, [])]
        return sum(p[0] for p in parts) or 1, own_saved + sum(p[1] for p in parts)

    out = []
    for node, own_members in members.items():
        leaves, saved = subtree(node)
        ends = ",".join(str(c) for c in sorted(c for c in own_members if len(rebuilt[c]) == len(node)))
        out.append((min(own_members), len(node), min(members[node[:-1]]) if node else None, len(own_members), len(children.get(node, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randrange(4 * n), rng.randrange(4 * n), -rng.randrange(30)])
        length = rng.choice([0, 1, 2, 3, 5, 12])
        rows += [(c, t, rng.choice(["user", "user", None]), rng.choice(["a", "b", "é" * 3, "a", None, ""])) for t in range(length)]
    rows += [(5 * n + 5 * i, t, "user", f"same {t}") for i in range(n // 3) for t in range(4)]  # a third are copies
    rows += [(7, None, "user", "early"), (7, None, "user", "early"), (7, 3, None, None), (7, 3, "x", "tie"), (None, 0, "user", "nobody")]
    rows += [(9 * n + 1, t, "user", "long" * 50) for t in range(300)]
    return rows


@pytest.mark.parametrize("block_paths,fan_in", [(50_000, 64), (9, 2), (2, 3)])
def test_equals_plain_prefixes(spark, block_paths, fan_in):
    rows = conversations(block_paths, 90)
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert rows_of(prefix_trie(table, block_paths, fan_in), *NAMES) == brute(rows)


def test_empty_and_turnless_and_clashing(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(3, 0, "user", "hi")]  # its head is one that is absent
    assert rows_of(prefix_trie(spark.createDataFrame(rows, SCHEMA)), *NAMES) == brute(rows)
    clash = spark.createDataFrame([(*r, "z", 1, 2) for r in conversations(1, 20)], SCHEMA + ", path STRING, depth LONG, node LONG")
    assert rows_of(prefix_trie(clash), *NAMES) == brute(conversations(1, 20))


def test_open_spines_are_handed_on():
    one, two, three = "0" * 32 + "00000001", "1" * 32 + "00000002", "2" * 32 + "00000003"
    entries = [(one + one, 1, 4, 0, 0, 0), (two + one, 2, 5, 0, 0, 0), (two + two, 1, 6, 0, 0, 0), (three, 1, 7, 0, 0, 0)]
    rows = grow_forest(entries, 1, False, False)
    closed = {r[4]: (r[2], r[3], r[5]) for r in rows if r[1]}
    assert closed == {two + one: (1, [1], 2), two + two: (1, [0], 1), two: (0, [5], 3)}
    assert {r[4]: r[7] for r in rows if not r[1]} == {one + one: 0, three: 0, "": 1}
