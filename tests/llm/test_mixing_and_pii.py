import hashlib
import re
from collections import defaultdict

import pytest

from tests.llm.conftest import SCHEMA, rows_of
from veleta.llm import mixing, pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, weights):
    """Targets by repeated resharing."""
    total, target, full = sum(sizes), [0.0] * len(sizes), set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        rest = total - sum(3 * sizes[i] for i in full)
        for i in open_:
            target[i] = rest * weights[i] / sum(weights[j] for j in open_)
        over = [i for i in open_ if target[i] >= 3 * sizes[i]]
        if not over:
            return target
        for i in over:
            full.add(i)
            target[i] = 3.0 * sizes[i]
        if len(full) == len(sizes):
            return target


def check_mix(rows, out):
    names = sorted({r[3] for r in rows if r[3] is not None}) + ([None] if any(r[3] is None for r in rows) else [])
    sizes = {n: sum(len(WORD.findall(r[1] or "")) for r in rows if r[3] == n) for n in names}
    want = dict(zip(names, filled(list(sizes.values()), [i % 3 + 1 for i in range(len(names))])))
    assert len(out) == len(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for n in names:
        assert abs(taken[n] - want[n]) <= 2 * largest[n]
    assert sum(taken.values()) <= sum(sizes.values())


def test_mix_of_the_corpus(clashing, corpus):
    out = mixing.mix(clashing).collect()
    check_mix(corpus, out)
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(clashing.repartition(7)).collect()))


@pytest.mark.parametrize("bin_rows", [20, 50_000])
def test_mix_with_a_large_source_and_limits(spark, monkeypatch, bin_rows):
    monkeypatch.setattr(mixing, "BIN_ROWS", bin_rows)
    rows = [(i, "w " * (1 + i % 9), "en", "big" if i % 3 else f"small{i % 12}", 0) for i in range(900)]
    rows += [(2000, "w " * 5, "en", "zz", 0), (2001, "", "en", "none at all", 0), (2002, "w", "en", None, 0), (None, "w w", "en", "big", 0)]
    check_mix(rows, mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect())


def test_mix_edges(spark, empty):
    assert mixing.mix(empty).count() == 0
    out = mixing.mix(spark.createDataFrame([(1, None, None, "a", 0), (2, " ", None, None, 0)], SCHEMA)).collect()
    assert [(r.size, r.taken) for r in out] == [(0, 0), (0, 0)]
    one = mixing.mix(spark.createDataFrame([(1, "a b", None, "s", 0), (1, "a b", None, "s", 0)], SCHEMA)).collect()
    assert [r.taken for r in one] == [2, 2]


# --- personal data ---------------------------------------------------------------------------------
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(d[::-1]):
        x = int(c) * (1 + i % 2)
        total += x // 10 + x % 10
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True, "ip": lambda: all(len(p) < 9 and int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((kind, *m.span()))
    return out


TEXTS = [
    "a@b.c", "x a.b+c@d-e.f.g, y@z @q.r a@b@c.d", "a@b.c@d.e f@g.h-i@j.k", "@a.b a@.b a@b", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.3.255", "4111 1111 1111 1111",
    "4111-1111-1111-1112 4111111111111111", "0000000000000", "+49 (30) 1234-5678 +1 2 +123456789012345678", "é 😀 me@home.org 😀 10.0.0.1", "", None, "5" * 5000,
    "mail me@here.org+49 30 123456789", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "a%b_c@x.y..z", "9" * 5000 + ".1.1.1", "@" * 50, "a@" * 30 + "b.c",
]


def check_base(rows, out):
    want = []
    for doc_id, text in rows:
        found = base(text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        want.append((doc_id, *(sum(f[0] == k for f in found) for k in PATTERNS), hashlib.sha256(listed.encode()).hexdigest()))
    assert rows_of(out, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)


def test_base_against_plain_patterns(spark):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[0]), (1, TEXTS[1])]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    out = pii.find_pii(df)
    check_base(rows, out)
    for r in out.collect():
        if r.doc_id is not None:
            assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in base(TEXTS[r.doc_id]))


def test_base_of_the_corpus(clashing, corpus, empty):
    check_base([(r[0], r[1]) for r in corpus], pii.find_pii(clashing))
    assert pii.find_pii(empty).count() == 0


def test_contexts_find_other_identifiers(spark):
    rows = [(i, f"some words here and then please write to user{i}@mail.example.org for more of it") for i in range(40)]
    rows += [(100 + i, f"other words again, please write to agent-{7000 + i}-x for the rest") for i in range(5)]
    rows += [(200 + i, f"the serial number was {90000 + i} in that list") for i in range(30)]
    rows += [(300, "call tel:0049301234567 now")] + [(301 + i, f"call tel:+49 30 12345{100 + i} now") for i in range(20)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    texts = dict(rows)
    out = {r.doc_id: r.spans for r in pii.find_pii(df).collect()}
    for i in range(100, 105):
        kind, a, b = out[i].split(":")
        assert kind == "email" and texts[i][int(a) : int(b)] == f"agent-{7000 + i - 100}-x"
    assert all(out[i] == "" for i in range(200, 230))
    kind, a, b = out[300].split(":")
    assert kind == "phone" and texts[300][int(a) : int(b)] == "0049301234567"
    check_base(rows, pii.find_pii(df))


def test_masking(spark):
    rows = [(1, "to me@x.org or 10.0.0.1."), (2, "nothing"), (3, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 7) for i, t in rows], SCHEMA)
    out = pii.mask_pii(df)
    assert out.columns == df.columns and out.schema == df.schema
    assert rows_of(out, "doc_id", "text", "n_chars") == [(1, "to [EMAIL] or [IP].", 19), (2, "nothing", 7), (3, None, None)]
