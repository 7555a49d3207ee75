import random

import numpy as np
import pytest

from ledgerloom.llm import spans as S

BASES = S.random_bases()
SCHEMA = "key string, probe boolean, rec bigint, owner bigint, text string"


def _brute(rows, n):
    """Pairs and shared characters by comparing all windows of n characters."""
    at = {}
    for k, _, _, o, t in rows:
        for i in range(len(t or "") - n + 1):
            at.setdefault(t[i : i + n], set()).add((k, o))
    kinds = {k: p for k, p, *_ in rows}
    pairs, shared = set(), {}
    for k, _, _, o, t in rows:
        cover = np.zeros(len(t or ""), bool)
        for i in range(len(t or "") - n + 1):
            others = {x for x, y in at[t[i : i + n]] if y != o}
            if others:
                cover[i : i + n] = True
            pairs |= {(min(k, x), max(k, x)) for x in others if not (kinds[k] and kinds[x])}
        if cover.any():
            shared[k] = int(cover.sum())
    return pairs, shared


def _words(rng, n):
    return " ".join(rng.choice(["the", "door", "of", "Søren", "opened", "at", "07:49.", "and", "slip", "KB-87452", "aus", "\n"]) + str(rng.randrange(99)) for _ in range(n))


def _rows(seed):
    rng = random.Random(seed)
    rows = [[f"k{i:02d}", i % 5 == 4, i, i % 7, _words(rng, rng.randrange(5, 120))] for i in range(30)]
    for _ in range(25):  # copies of all lengths around the limit, at any offset, some cut inside words
        a, b = rng.sample(range(30), 2)
        n = rng.choice([150, 178, 179, 180, 181, 200, 300])
        t = rows[a][4]
        i = rng.randrange(max(1, len(t) - n))
        x = rng.randrange(len(rows[b][4]) + 1)
        rows[b][4] = rows[b][4][:x] + t[i : i + n] + rows[b][4][x:]
    rows += [["p1", False, 40, 8, "ab" * 300], ["p2", False, 41, 9, "x" + "ab" * 100], ["z1", False, 42, 8, "a" * 500], ["z2", False, 43, 9, "b" + "a" * 180], ["z3", False, 44, 10, "a" * 179], ["c1", False, 45, 8, "字" * 90 + "漢字仮名" * 40], ["c2", False, 46, 9, "仮名漢字" * 50], ["n", False, 47, 3, ""]]
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("seed", range(4))
def test_pairs_and_coverage_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "PAIR_BLOCK", 2)
    monkeypatch.setattr(S, "BATCH_CHARS", 2_000)
    rows = _rows(seed)
    df = spark.createDataFrame(rows + rows[:3], SCHEMA).repartition(3)
    pairs, shared = _brute(rows, 180)
    assert {tuple(r) for r in S.shared_pairs(df).collect()} == pairs
    got = {r.key: r.shared_chars for r in S.shared_coverage(df).collect()}
    assert got == shared


def test_hot_copy_and_empty(spark):
    rng = random.Random(1)
    block = _words(rng, 60)
    rows = [(f"h{i:02d}", False, i, i, _words(rng, 20) + block[:200] + _words(rng, 10)) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert S.shared_pairs(df).count() == 40 * 39 // 2
    assert S.shared_pairs(df.limit(0)).count() == 0 and S.shared_coverage(df.limit(0)).count() == 0


def test_shuffle_instead_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_RECORDS", 0)
    rows = _rows(2)
    assert {tuple(r) for r in S.shared_pairs(spark.createDataFrame(rows, SCHEMA)).collect()} == _brute(rows, 180)[0]


def test_project_records(spark):
    t = "x" * 200
    snaps = spark.createDataFrame([("s1", "o1", t), ("s2", "o2", t), ("s2", "o2", t), ("s3", "o3", None)], "snapshot_id string, source_id string, content string")
    ev = spark.createDataFrame([("e1", "S1 ", t), ("e2", "gone", t), ("e3", "s1", "short"), ("e4", None, t), ("e1", "s1", t)], "evidence_id string, snapshot_id string, quote string")
    r = S.project_records(snaps, ev)
    assert {x.key for x in r.collect()} == {"s1", "s2", "e1"}
    assert {tuple(x) for x in S.shared_pairs(r).collect()} == {("s1", "s2"), ("e1", "s2")}


def test_kept_kmers_are_the_same_in_any_surroundings():
    rng = random.Random(3)
    powers: dict = {}
    shared = _words(rng, 40)[:180]
    marks = []
    for _ in range(20):
        text = _words(rng, 9) + shared + _words(rng, 9)
        at = text.index(shared)
        _, h, pos, size = S.kept_kmers([text], 180, powers, BASES)
        marks.append({int(x) for x, p, n in zip(h, pos, size) if p >= at and p + n <= at + 180})
    assert all(m & marks[0] for m in marks)


def test_very_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "BATCH_CHARS", 700)
    rng = random.Random(8)
    a, b = _words(rng, 900), _words(rng, 700)
    rows = [("a", False, 1, 1, a), ("b", False, 2, 2, b[:2000] + a[600:790] + b[2000:] + a[3000:3179])]
    assert len(a) > 5_000
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in S.shared_pairs(df).collect()} == _brute(rows, 180)[0] == {("a", "b")}
    assert {r.key: r.shared_chars for r in S.shared_coverage(df).collect()} == _brute(rows, 180)[1]


def _template_rows(seed):
    """Texts of one template: the same words, with digits that differ at the same places now and then."""
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdefgh") + ("" if rng.random() < 0.8 else " ") for _ in range(6_000))
    rows = []
    for i in range(4):
        own = random.Random(seed * 10 + i)
        text = list(base)
        at = 100
        while at < len(text):
            text[at] = own.choice("0123456789")
            at += _step(seed, at)
        rows.append((f"t{i}", False, i, i, "".join(text)))
    return rows


def _step(seed, at):
    return random.Random(seed * 100_003 + at).choice([80, 120, 170, 181, 185, 200, 260])


@pytest.mark.parametrize("seed", range(3))
def test_templates_with_fields_of_equal_length(spark, seed):
    rows = _template_rows(seed)
    pairs, shared = _brute(rows, 180)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in S.shared_pairs(df).collect()} == pairs
    assert {r.key: r.shared_chars for r in S.shared_coverage(df).collect()} == shared


def test_kept_kmers_cover_a_record_and_are_found_inside_long_tokens():
    rng = random.Random(4)
    powers: dict = {}
    for _ in range(300):
        shared = "".join(rng.choice("abcdefgh") + rng.choice(["", "", "", "", "", "", " "]) for _ in range(180))[:180]
        marks = []
        for _ in range(2):
            head = rng.choice(["", " "]) + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40)))
            _, h, pos, size = S.kept_kmers([head + shared + "ab" * 40], 180, powers, BASES)
            assert (pos[1:] <= pos[:-1] + size[:-1]).all()
            marks.append({int(x) for x, p, n in zip(h, pos, size) if p >= len(head) and p + n <= len(head) + 180})
        assert marks[0] & marks[1]


def _alike():
    """Two texts that any polynomial hash modulo 2**64 with an odd base takes for equal: (x**4 - 1)**18 apart."""
    from math import comb

    one = [0x20000] * 180
    two = list(one)
    for i in range(19):
        two[40 + 4 * i] += (-1) ** i * comb(18, i)
    return "".join(map(chr, one)), "".join(map(chr, two))


def test_texts_made_to_collide_do_not(spark):
    import numpy as np

    a, b = _alike()
    up = [pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(180)]
    assert sum(ord(c) * u for c, u in zip(a, up)) % (1 << 64) == sum(ord(c) * u for c, u in zip(b, up)) % (1 << 64)
    x, y = (S._run_hashes(t, np.array([0]), 180, {}, BASES) for t in (a, b))
    assert x[0] != y[0] and x[1] != y[1]
    head = "the same words before and after it, again and again and once more, until it ends. "
    rows = [("a", False, 1, 1, head + a + head), ("b", False, 2, 2, head + b + head)]
    assert S.shared_pairs(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_hash_against_whole_numbers():
    import numpy as np

    text, base = "some words, größer 😀 " * 40, BASES[0]
    r = S._Roller(S._codes([text]), base, {})
    for a, b in ((0, 5), (3, 200), (100, 700)):
        want = sum((ord(c) + 1) * pow(base, i, S.PRIME) for i, c in enumerate(text[a:b])) % S.PRIME
        assert int(r.hash(np.array([a]), np.array([b]))[0]) == want


def test_numbers_of_records_are_not_shared(spark, monkeypatch):
    from ledgerloom.runtime import Scratch

    real = S.F.xxhash64
    # a hash of few values at first, so that clashes have to be mended
    monkeypatch.setattr(S.F, "xxhash64", lambda seed, *c: S.F.when(seed < 3, S.F.pmod(real(seed, *c), S.F.lit(7))).otherwise(real(seed, *c)))
    rows = spark.createDataFrame([(f"k{i % 40}", i % 2 == 0) for i in range(80)], "key string, probe boolean")
    got = S.numbered(rows, rows, Scratch(spark)).distinct().collect()
    assert len(got) == len({r.rec for r in got}) == len({(r.key, r.probe) for r in got})


def test_groups_stand_for_their_pairs(spark):
    a, b = "common words that stand in many of the records, word for word, " * 4, "another passage that is shared by some of them and no others at all, " * 4
    rows = [(f"k{i}", False, i, i // 2, (a if i % 3 else "") + f" own text {i} " + (b if i % 2 else "")) for i in range(12)] + [("q1", True, 100, 50, a), ("q2", True, 101, 51, a), ("q3", True, 102, 52, "only quotes have this sentence, and both have it alike " * 5), ("q4", True, 103, 53, "only quotes have this sentence, and both have it alike " * 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    g = S.shared_groups(df).collect()
    members = {}
    for r in g:
        members.setdefault(r.group, []).append(r)
    assert all(len(m) == m[0].n and len({x.owner for x in m}) > 1 for m in members.values()) and len({frozenset(x.key for x in m) for m in members.values()}) == len(members)
    pairs = {tuple(sorted((x.key, y.key))) for m in members.values() for x in m for y in m if x.owner != y.owner and not (x.probe and y.probe)}
    assert pairs == {tuple(r) for r in S.shared_pairs(df).collect()} and not {"q3", "q4"} & {r.key for r in g}
