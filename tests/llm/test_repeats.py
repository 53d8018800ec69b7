import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA, rows_of
from veleta.llm import near_dedup as N
from veleta.llm import suffix_dedup as S
from veleta.llm.components import components


def removed(rows, length=50):
    """doc_id, bytes, removed bytes, runs and digest of the rest, one string at a time."""
    ordered = sorted(((i if i is not None else S.LAST, (t or "").encode()) for i, t in rows), key=lambda r: r[0])
    first: dict[bytes, int] = {}
    for i, data in ordered:
        for j in range(len(data) - length + 1):
            first.setdefault(data[j : j + length], i)
    out = []
    for i, data in ordered:
        gone = np.zeros(len(data) + 1, dtype=np.int8)
        for j in range(len(data) - length + 1):
            if first[data[j : j + length]] < i:
                gone[j : j + length] = 1
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((None if i == S.LAST else i, len(data), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


NAMES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def as_df(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(4)


def edge_texts():
    rng = random.Random(11)
    text = "".join(rng.choice("abcdefgh \n") for _ in range(3000))
    rows = [(5, text), (9, text[:49]), (10, text[:50]), (11, text[100:151]), (12, "x" * 400), (13, "x" * 300), (13, "x" * 60), (14, "x" * 49)]
    rows += [(20, text[200:300] + "-" + text[290:420]), (21, text[1000:1060] + "é" * 40 + text[1030:1100]), (2, text[1040:1110]), (30, None), (31, "")]
    rows += [(None, text), (None, "y" * 100), (40, "\0" * 120), (41, "\0" * 80 + "q"), (42, "ab" * 100), (43, "ab" * 70 + "c")]
    rows += [(50 + i, text[2000:2100] + f" tail {i} " + "".join(rng.choice("abc") for _ in range(90))) for i in range(30)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"batch_bytes": 600, "bucket_bytes": 2000}, {"batch_bytes": 600, "bucket_bytes": 500, "hot_batches": 2}])
def test_repeats_against_brute_force(spark, settings, monkeypatch):
    rows = edge_texts()
    usual = S.remove_repeats
    monkeypatch.setattr(S, "remove_repeats", lambda d: usual(d, **settings))
    assert rows_of(S.repeats_digest(as_df(spark, rows)), *NAMES) == removed(rows)


def test_repeats_of_the_corpus(clashing, corpus):
    rows = [(r[0], r[1]) for r in corpus]
    assert rows_of(S.repeats_digest(clashing), *NAMES) == removed(rows)


def test_spans_and_kept_bytes(spark):
    rows = [(1, "k" * 10 + "passage " * 8 + "end"), (2, "z" * 5 + "passage " * 8 + "rest")]
    out = {r.doc_id: r for r in S.remove_repeats(as_df(spark, rows)).collect()}
    assert out[1].spans == [] and bytes(out[1].kept).decode() == rows[0][1]
    assert out[2].spans == [5, 69] and bytes(out[2].kept).decode() == "zzzzzrest"


def test_no_documents(empty):
    assert S.repeats_digest(empty).count() == 0 and N.near_copies(empty).count() == 0


def test_smaller_places():
    values = np.random.default_rng(2).integers(0, 30, 500)
    want = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(500)]
    assert S.previous_smaller(values).tolist() == want


# --- near copies --------------------------------------------------------------------------------
def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
    for c in "\n\r\x0b\x0c":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return set(zip(w, w[1:], w[2:], w[3:], w[4:]))


def grouped(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_id = {}
    for x, (i, _) in enumerate(rows):
        if i is not None and i in by_id:
            parent[root(x)] = root(by_id[i])
        by_id.setdefault(i, x)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[root(x)].append(i)
    out = []
    for x, (i, _) in enumerate(rows):
        group = min(least[root(x)], default=None)
        out.append((i, len(sets[x]), group, group is None or i == group))
    return sorted(out, key=repr)


GROUP = ("doc_id", "n_shingles", "component_id", "kept")


def test_near_copies_against_brute_force(clashing, corpus):
    assert rows_of(N.near_copies(clashing), *GROUP) == grouped([(r[0], r[1]) for r in corpus])


def test_chains_and_borders(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows = [(900, " ".join(words))]
    for step in range(12):  # each is near to the one before it only
        at = 20 + 30 * step
        words[at : at + 3] = [f"c{step}a", f"c{step}b", f"c{step}c"]
        rows.append((100 + step, " ".join(words)))
    for n in (5, 6, 7, 8, 11, 30, 37):  # one word more: at the limit for some sizes
        own = [f"v{n}x{i}" for i in range(n)]
        rows += [(300 + n, " ".join(own)), (400 + n, " ".join([*own, "more"])), (500 + n, " ".join(own).upper())]
    template = [rng.choice(["the", "of", "and", f"t{i}"]) for i in range(200)]
    for i in range(60):  # a template with edits: some pairs are near, some are not
        own = list(template)
        for _ in range(rng.choice([1, 2, 4, 8])):
            own[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(own)))
    rows += [(1, "one"), (2, "one"), (3, "ONE two"), (4, "one two"), (5, ""), (6, None), (7, "one"), (7, "something else now"), (None, "nobody knows this text at all")]
    assert rows_of(N.near_copies(as_df(spark, rows)), *GROUP) == grouped(rows)


def test_blocks_find_what_one_block_finds(spark, monkeypatch):
    rng = random.Random(4)
    template = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(80):
        own = list(template)
        for _ in range(5):
            own[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(N, "BLOCK", 7)
    assert rows_of(N.near_copies(as_df(spark, rows)), *GROUP) == grouped(rows)


def test_estimate_is_close():
    rng = np.random.default_rng(8)
    for shared, own in ((850, 75), (400, 300), (60, 5), (0, 500)):
        errors = []
        for _ in range(40):
            both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) for n in (shared, own, own))
            sa, sb = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
            match = (N.signature(sa) == N.signature(sb)).sum()
            errors.append(N.estimated(np.array([match]), np.array([len(sa)]), np.array([len(sb)]))[0] - shared / (shared + 2 * own))
        assert abs(np.mean(errors)) < 0.03


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1080)] + [(2000, 3000 + i) for i in range(50)]
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a LONG, b LONG")).collect()}
    assert got == {x: root(x) for x in parent if any(x in link and link[0] != link[1] for link in links)}
    assert Counter(got.values())[1000] == 81
