"""The general problems against brute force, and their edge cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import hierarchy as H, intervals as I, orphans as O, snapshot_diff as D


def _brute_tree(parent):
    parent = {k: (v if v in parent else None) for k, v in parent.items()}
    out = {}
    for n in parent:
        path, at, x = [], {}, n
        while x is not None and x not in at:
            at[x] = len(path)
            path.append(x)
            x = parent[x]
        if x is None:
            out[n] = (path[-1], len(path) - 1, path[::-1])
        else:
            ring = path[at[x] :]
            out[n] = (min(ring), -1 if n in ring else -2, None)
    return out


def _tree_rows(rng, n):
    ids = [f"n{i:04d}" for i in range(n)]
    parent = {}
    for i, x in enumerate(ids):
        r = rng.random()
        parent[x] = None if r < 0.1 or i == 0 else "gone" if r < 0.15 else ids[rng.randrange(i)] if r < 0.7 else ids[max(0, i - 1)]
    for ring in ([3, 4, 5], [10], [20, 21]):
        for a, b in zip(ring, ring[1:] + ring[:1]):
            parent[ids[a]] = ids[b]
    return parent


@pytest.mark.parametrize("n,block", [(60, 7), (300, 50_000)])
def test_hierarchy_against_brute_force(spark, monkeypatch, n, block):
    monkeypatch.setattr(H, "SIBLING_BLOCK", block)
    monkeypatch.setattr(H, "NUMBER_BLOCK", 50)
    monkeypatch.setattr(H, "INTERVAL", block)
    parent = _tree_rows(random.Random(n), n)
    rows = [(k, None if v is None else f" {v.upper()}\t", 1, "x") for k, v in parent.items()] + [("n0001", parent["n0001"], 2, "y"), (None, "n0001", 3, "z")]
    df = spark.createDataFrame(rows, "id string, parent string, depth int, root_id string")
    want = _brute_tree(parent)
    tree = H.hierarchy(df, "id", "parent")
    got = {r.id: r for r in tree.collect()}
    assert {k: (r.root_id, r.depth) for k, r in got.items()} == {k: v[:2] for k, v in want.items()}
    kids = {k: {m for m, v in want.items() if v[2] and k in v[2][:-1]} for k in want}
    for k, r in got.items():
        if r.depth >= 0:
            assert r.n_descendants == len(kids[k])
            inside = {m for m, s in got.items() if s.root_id == r.root_id and s.depth >= 0 and r.entry < s.entry and s.exit < r.exit}
            assert inside == kids[k]
    paths = H.paths(df, "id", "parent")
    assert {r.id: r.path for r in paths.collect()} == {k: v[2] for k, v in want.items()}
    pairs = H.descendants(tree)
    assert {(r[0], r[1]) for r in pairs.collect()} == {(k, m) for k, s in kids.items() for m in s}
    asked = H.descendants(tree, spark.createDataFrame([("n0000",)], "id string"))
    assert {r.descendant_id for r in asked.collect()} == kids["n0000"]


def test_hierarchy_empty_and_long_chain(spark):
    empty = spark.createDataFrame([], "id string, p string")
    assert H.hierarchy(empty, "id", "p").count() == 0 and H.paths(empty, "id", "p").count() == 0
    chain = spark.createDataFrame([(f"c{i:03d}", f"c{i - 1:03d}" if i else None) for i in range(200)], "id string, p string")
    assert H.hierarchy(chain, "id", "p").agg(F.max("depth"), F.sum("n_descendants")).first() == (199, 199 * 200 // 2)
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, p string")
    assert sorted(map(tuple, H.hierarchy(ring, "id", "p").select("id", "root_id", "depth").collect())) == [("a", "a", -1), ("b", "a", -1)]


def test_intervals_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(600):
        a = rng.choice([None, *range(0, 400_000, 7)]) if rng.random() < 0.1 else rng.randrange(400_000)
        b = None if rng.random() < 0.03 else (a or 0) + rng.randrange(-50, 9_000)
        rows.append((rng.choice(["hot", "hot", "b", None]), a, b, "extra"))
    df = spark.createDataFrame(rows + rows[:20], "k string, a bigint, b bigint, day string")
    inf = float("inf")
    want, want_periods = set(), 0
    for k in {r[0] for r in rows}:
        spans = sorted({(-inf if a is None else a, inf if b is None else b) for x, a, b, _ in rows if x == k and (a is None or b is None or a < b)})
        end = None
        for a, b in spans:
            if end is not None and a > end:
                want.add((k, end, a))
            if end is None or a > end:
                want_periods += 1
            end = b if end is None else max(end, b)
    assert {tuple(r) for r in I.gaps(df, ["k"], "a", "b").collect()} == want
    periods = I.periods(df, ["k"], "a", "b")
    assert periods.count() == want_periods
    assert periods.groupBy("k", "period_no").count().where("count > 1").count() == 0
    assert I.gaps(df.limit(0), ["k"], "a", "b").count() == 0


def test_touching_and_nested(spark):
    df = spark.createDataFrame([("x", 0, 10), ("x", 10, 20), ("x", 2, 5), ("x", 30, 31), ("x", 31, 31), ("x", 25, 20)], "k string, a bigint, b bigint")
    assert [tuple(r) for r in I.gaps(df, ["k"], "a", "b").collect()] == [("x", 20, 30)]
    assert sorted(map(tuple, I.periods(df, ["k"], "a", "b").select("period_from", "period_to").collect())) == [(0, 20), (30, 31)]


def test_orphans(spark, monkeypatch):
    monkeypatch.setattr(O, "HEAVY_SHARE", 4)
    snaps = spark.createDataFrame(
        [("s1", None, "2024-01-02"), ("s2", " S1 ", "2024-01-03"), ("s3", "gone", "2024-02-01T00:00:00Z"), ("s4", "old", "never"), ("s1", "", "2024-01-02T00:00:00Z")],
        "snapshot_id string, previous_snapshot_id string, created_at string",
    )
    claims = spark.createDataFrame([("c1", "2024-05-01")], "claim_id string, created_at string")
    ev = spark.createDataFrame([(f"e{i}", "C1", "s1", "2024-03-01") for i in range(6)] + [("e9", None, "OLD\n", "2024-06-01"), ("e9", None, "old", "2024-06-01T00:00:00Z"), (None, "c1", "s9", None)], "evidence_id string, claim_id string, snapshot_id string, created_at string")
    legacy = spark.createDataFrame([("source_snapshots", "old "), ("claim_proposals", "gone")], "original_table string, legacy_key string")
    tables = {"source_snapshots": snaps, "claim_proposals": claims, "evidence_refs": ev}
    got = {tuple(r) for r in O.orphan_references(tables, O.PROJECT_REFERENCES, O.PROJECT_TARGETS, legacy).collect()}
    want = {("evidence_refs.claim_id", f"e{i}", "late", "2024-03") for i in range(6)}
    want |= {("evidence_refs.snapshot_id", "e9", "deleted", "2024-06"), ("evidence_refs.snapshot_id", None, "missing", None)}
    want |= {("source_snapshots.previous_snapshot_id", "s3", "missing", "2024-02"), ("source_snapshots.previous_snapshot_id", "s4", "deleted", None)}
    assert got == want
    report = {tuple(r) for r in O.orphan_report(tables, O.PROJECT_REFERENCES, O.PROJECT_TARGETS, legacy).collect()}
    assert ("evidence_refs.claim_id", "2024-03", "late", 6) in report and len(report) == 5
    none = {k: v.limit(0) for k, v in tables.items()}
    assert O.orphan_references(none, O.PROJECT_REFERENCES, O.PROJECT_TARGETS, legacy.limit(0)).count() == 0


def _md(rows, order=("entry", "item", "count")):
    return "# R\n\n| " + " | ".join(order) + " |\n|" + "---|" * len(order) + "\n" + "".join("| " + " | ".join(str(r.get(c, "")) for c in order) + " |\n" for r in rows)


def test_register_changes(spark):
    a = [{"entry": f"K{i:03d}", "item": f"i{i}", "count": i} for i in range(200)]
    b = [dict(r) for r in a if r["entry"] not in ("K007", "K100")]
    b[50]["item"] = "other"
    b.append({"entry": "Z1", "item": "new", "count": None})
    b.append(dict(b[3]))
    random.Random(1).shuffle(b)
    snaps = [
        ("s1", "r", None, "text/markdown", _md(a)), ("s2", "r", "S1 ", "application/json", json.dumps({"entries": b})), ("s3", "r", "s2", "application/json", "{broken"),
        ("s4", "r", "s3", "application/json", json.dumps(a)), ("s5", "r", "s1", "text/markdown", _md(a[::-1], ("count", "entry", "item"))), ("s6", "x", "s1", "text/markdown", _md(b)),
        ("s7", "r", "nowhere", "text/markdown", _md(b)), ("s8", "r", "s7", "text/markdown", None), ("s2", "r", "s1", "application/json", json.dumps({"entries": b})),
    ]
    df = spark.createDataFrame([(*s, "extra") for s in snaps], "snapshot_id string, source_id string, previous_snapshot_id string, media_type string, content string, id string")
    got = {tuple(r) for r in D.register_changes(df, spark.createDataFrame([("r",), ("r",)], "source_id string")).collect()}
    s2 = {("s2", "K007", "removed"), ("s2", "K100", "removed"), ("s2", b_key := next(r["entry"] for r in b if r["item"] == "other"), "changed"), ("s2", "Z1", "added")}
    s8 = {("s8", r["entry"], "removed") for r in b}
    assert b_key and got == s2 | s8
    assert D.register_changes(df.limit(0), spark.createDataFrame([("r",)], "source_id string")).count() == 0


def test_chunks_are_content_defined():
    rows = [{"entry": f"E{i:04d}", "item": "x", "holder": "", "place": "", "count": str(i), "note": ""} for i in range(500)]
    before = {d for d, _ in D.chunks_of(rows)}
    after = {d for d, _ in D.chunks_of(rows[:250] + [dict(rows[0], entry="E0250x")] + rows[250:])}
    assert len(before) > 10 and len(before - after) <= 2


def test_cells_and_numbers():
    assert D.table_entries("| entry | item |\n|:--|--:|\n| A | x \\| y |\n") == [{"entry": "A", "item": "x | y", "holder": "", "place": "", "count": "", "note": ""}]
    assert D.json_entries('[{"entry": "A", "count": 1.50, "note": null}]')[0]["count"] == "1.50"
    assert D.json_entries("[NaN]") is None and D.json_entries('"text"') == []


def test_shared_folder_is_needed_off_local_masters(spark, monkeypatch):
    from ledgerloom import runtime

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(ValueError):
        runtime.shared_root(Session())
    Session.conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: "file:///shared/")})()
    assert runtime.shared_root(Session()) == "file:///shared"


def test_orphans_of_a_hot_key_and_of_the_month_a_key_was_born(spark):
    refs = [(f"e{i}", "hot" if i % 3 else "gone", f"2024-0{1 + i % 3}-{10 + i % 15}T00:00:00Z") for i in range(3000)] + [("x", None, "2024-01-01"), ("y", " HOT ", "bad"), ("z", "nowhere", "2024-05-01")]
    t = {"r": spark.createDataFrame(refs, "rid string, ref string, created_at string"), "t": spark.createDataFrame([("hot", "2024-02-15")], "tid string, created_at string")}
    withdrawn = spark.createDataFrame([("t", "GONE ")], "original_table string, legacy_key string")
    own, targets = [O.Reference("r.ref", "r", "rid", "ref", "t")], [O.Target("t", "tid")]
    want = set()
    for rid, k, at in refs:
        k = (k or "").strip().lower()
        if k == "gone":
            want.add((rid, "deleted", at[:7]))
        elif k == "nowhere":
            want.add((rid, "missing", at[:7]))
        elif k == "hot" and at < "2024-02-15" and at != "bad":
            want.add((rid, "late", at[:7]))
    got = {tuple(r) for r in O.orphan_references(t, own, targets, withdrawn).select("row_key", "kind", "period").collect()}
    assert got == want
    from collections import Counter

    counted = Counter((p, k) for _, k, p in want)
    assert {(r.period, r.kind): r.n for r in O.orphan_report(t, own, targets, withdrawn).collect()} == dict(counted)


def test_slices_are_cut_by_bytes():
    import pyarrow as pa

    from ledgerloom.runtime import slices

    b = pa.RecordBatch.from_pydict({"t": ["aa", None, "", "b" * 50, "c", "dd"], "i": list(range(6))})
    got = [x.column("i").to_pylist() for x in slices(iter([b, b.slice(0, 0), b.slice(4)]), "t", 4)]
    assert got == [[0, 1, 2], [3], [4, 5], [4, 5]]
