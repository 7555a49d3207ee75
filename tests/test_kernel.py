"""Kernel operators on small literals and against plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import constraints as C, contradictions, evidence as E, impact as M, ledger as L, legacy as G, material, ordered, pack, replay, revisions as R
from ledgerloom.sources import ingest


@pytest.mark.parametrize("width", [3, 1000])
def test_previous_and_numbers(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice("ab") if rng.random() < 0.9 else None, i, rng.randrange(50)) for i in rng.sample(range(200), 80)]
    df = ordered.with_previous(spark.createDataFrame(rows, "k string, o bigint, v int"), ["k"], ["o"], {"before": "v"}, width, number="n")
    got = {r.o: (r.before, r.n) for r in df.collect()}
    for k in ("a", "b", None):
        prev, n = None, 0
        for _, o, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            n += 1
            assert got[o] == (prev, n)
            prev = v


def test_revisions(spark):
    rows = [("s", 1, "A"), ("s", 2, "A"), ("s", 3, "B"), ("s", 4, "A"), ("s", 5, None), ("s", 6, ""), ("t", 1, "A")]
    got = sorted(map(tuple, R.allocate(spark.createDataFrame(rows, "k string, o bigint, text string"), ["k"], "o", "o", "text", width=2).select("k", "id", "version", "previous_id").collect()))
    assert got == [("s", 1, 1, None), ("s", 3, 2, 1), ("s", 4, 3, 3), ("s", 5, 4, 4), ("t", 1, 1, None)]


def test_lineage(spark):
    rows = [("a1", "a", 1, None), ("a2", "a", 2, "A1 "), ("a4", "a", 4, "a2"), ("b1", "b", 1, "a1"), ("a2", "a", 2, "a1")]
    got = sorted(map(tuple, R.lineage_issues(spark.createDataFrame(rows, "snapshot_id string, source_id string, version bigint, previous_snapshot_id string")).collect()))
    assert got == [("SNAPSHOT_CHAIN_BROKEN", "a4"), ("SNAPSHOT_CHAIN_BROKEN", "b1"), ("SNAPSHOT_VERSION_GAP", "a4")]


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_evidence_codes(spark):
    claims = spark.createDataFrame([("c1", "w"), ("c2", "w"), ("c3", " ")], "claim_id string, continuity string")
    sources = spark.createDataFrame([("o1", "w"), ("o2", "v")], "source_id string, continuity string")
    snaps = spark.createDataFrame([("s1", "o1", "a\nb\nc", 3), ("s2", "o2", "a", 9), ("s3", "o9", None, None)], "snapshot_id string, source_id string, content string, line_count bigint")
    ev = [
        ("ok", "c1", "S1 ", 1, 2, "a\r\nb", "sha256:" + _sha("a\nb").upper()), ("noid", "c1", " ", 1, 1, None, None), ("null", "c1", "s1", None, 1, None, None), ("lost", "c1", "s0", 1, 1, None, None),
        ("empty", "c1", "s3", 1, 1, None, None), ("other", "c1", "s2", 1, 1, "z", "bad"), ("range", "c1", "s1", 3, 2, "x", None), ("beyond", "c1", "s1", 2, 4, "x", None), ("hash", "c3", "s1", 1, 1, None, _sha("b")),
    ]
    got = {tuple(r) for r in E.issues(claims, spark.createDataFrame(ev + ev[:1], "evidence_id string, claim_id string, snapshot_id string, start_line bigint, end_line bigint, quote string, content_hash string"), snaps, sources).collect()}
    assert got == {
        ("SNAPSHOT_ID_REQUIRED", "c1", "noid"), ("INVALID_LINE_RANGE", "c1", "null"), ("SNAPSHOT_NOT_FOUND", "c1", "lost"), ("SNAPSHOT_CONTENT_MISSING", "c1", "empty"),
        ("CONTINUITY_MISMATCH", "c1", "other"), ("SNAPSHOT_LINE_COUNT_MISMATCH", "c1", "other"), ("QUOTE_MISMATCH", "c1", "other"), ("INVALID_CONTENT_HASH", "c1", "other"),
        ("INVALID_LINE_RANGE", "c1", "range"), ("LINE_RANGE_OUT_OF_BOUNDS", "c1", "beyond"), ("CONTENT_HASH_MISMATCH", "c3", "hash"), ("CLAIM_CONTINUITY_MISSING", "c3", None), ("EVIDENCE_REQUIRED", "c2", None),
    }
    assert {c for c, _, _ in got} | {"SNAPSHOT_CONTINUITY_MISSING", "INVALID_QUOTE"} == set(E.CODES)


def test_contradictions_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(contradictions, "BLOCK", 3)
    rng = random.Random(4)
    rows = [(f"c{i:02d}", "p", "w", "s", "r", rng.choice("xyz"), "AUTHORIZED", f"2024-01-{1 + i % 28:02d}", f"2024-{1 + i % 12:02d}-01", f"2024-{1 + i % 12:02d}-20", "2024-01-01") for i in range(30)]
    rows.append(("d", "p", "w", None, "r", "x", "AUTHORIZED", "2024-01-01", None, None, "2024-01-01"))
    df = spark.createDataFrame(rows, "claim_id string, persona_id string, continuity string, subject string, predicate string, object_value string, status string, created_at string, valid_from string, valid_to string, updated_at string")
    want = {(a[0], b[0]) for a in rows[:30] for b in rows[:30] if a[5] != b[5] and (a[7], a[0]) < (b[7], b[0]) and a[8] < b[9] and b[8] < a[9]}
    got = [tuple(r) for r in contradictions.pairs(df).collect()]
    assert set(got) == want and len(got) == len(want)
    plan = contradictions.pairs(df)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("width", [2, 1000])
def test_replays(spark, width):
    rng = random.Random(width)
    log = [(rng.choice("ab"), i, rng.choice("PAD"), rng.choice("PAD"), float(i)) for i in range(120)]
    df = spark.createDataFrame(log, "k string, seq bigint, f string, t string, v double")
    got = {r.seq: (r.expected, r.broken) for r in replay.chain(df, "k", "seq", "f", "t", "P", width=width).collect()}
    decided = df.withColumn("d", F.when(F.col("t") == "A", F.col("v")).cast("string"))
    force = {r.seq: r.in_force for r in replay.state_in_force(decided, "k", "seq", "d", "none", width=width).collect()}
    folded = {r.k: (r.state, r.value) for r in replay.last_valid(df, "k", "seq", "f", "t", "v", "P").collect()}
    assert folded == {r.k: (r.state, r.value) for r in replay.last_valid(df, "k", "seq", "f", "t", "v", "P", width=3).collect()}
    for k in "ab":
        state, seen, valid, value = "P", "none", "P", None
        for _, seq, f, t, v in (r for r in log if r[0] == k):
            assert got[seq] == (state, f != state) and force[seq] == seen
            state = t
            if t == "A":
                seen = str(v)
            if f == valid:
                valid, value = t, v
        assert folded[k] == (valid, value)
        assert {r.k: r.state for r in replay.final_states(df, "k", "seq", "t").collect()}[k] == state


def test_reconcile_and_sets(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (3, "x"), (5, None)], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "x"), (5, None), (None, "q")], "id int, v string")
    assert {tuple(r) for r in replay.reconcile(a, b, "id", ["v"]).collect()} == {(2, "DIFFERENT"), (3, "DUPLICATE"), (4, "MISSING_LEFT")}
    assert {tuple(r) for r in replay.set_difference(a, b, "id", "v").collect()} == {(2, "x", "left"), (2, "y", "right"), (4, "x", "right")}


def _chain(n):
    out, before = [], L.GENESIS
    for i in range(1, n + 1):
        e = {"aggregate_id": "a", "aggregate_type": "claim", "created_at": "2024-01-01T00:00:00Z", "entry_id": f"e{i}", "event_type": "t", "payload_json": '{"q":"é\\""}', "previous_hash": before, "sequence": i}
        before = hashlib.sha256(json.dumps(e, separators=(",", ":"), sort_keys=True, ensure_ascii=False).encode()).hexdigest()
        out.append(e | {"entry_hash": before})
    return out


def test_ledger_chain(spark):
    schema = "sequence bigint, entry_id string, event_type string, aggregate_type string, aggregate_id string, payload_json string, previous_hash string, entry_hash string, created_at string"
    load = lambda rows: spark.createDataFrame([{**r} for r in rows], schema)
    rows = _chain(30)
    assert L.chain_issues(load(rows)).count() == 0
    bad = [dict(r) for r in rows if r["sequence"] != 12]
    bad[4]["payload_json"] = "{}"
    bad[20]["previous_hash"] = "0" * 64
    got = {tuple(r) for r in L.chain_issues(load(bad)).collect()}
    assert got == {(13, "SEQUENCE_GAP"), (5, "DIGEST_MISMATCH"), (22, "LINK_MISMATCH"), (22, "DIGEST_MISMATCH")}
    assert "SinglePartition" not in L.chain_issues(load(rows))._jdf.queryExecution().toString()
    assert L.bounds(load(rows)).first().entries == 30 and L.bounds(load([])).first().payload_bytes == 0
    assert [r.sequence for r in L.entries(load(rows), after=27).collect()] == [28, 29, 30]


def test_impact_against_search(spark):
    rng = random.Random(9)
    targets = {f"t{i}": [rng.choice("abc") for _ in range(rng.randrange(12))] for i in range(12)}
    ev = []
    for i in range(200):
        q = [rng.choice("abc") for _ in range(rng.randrange(1, 4))]
        at = rng.randrange(1, 8)
        ev.append((f"e{i}", rng.choice(list(targets)), at, at + len(q) - 1, "\r\n".join(q), None))
    ev += [("x1", "t1", 1, 1, None, None), ("x2", "t1", 0, 1, "a", None), ("x3", "t1", 1, 2, "a", None), ("x4", "t1", 1, 1, "a", "zz"), ("x5", "t1", 1, 1, "a", "0" * 64), ("x6", "t0", 1, 1, "", None)]
    df = spark.createDataFrame(ev, "evidence_id string, snapshot_id string, start_line bigint, end_line bigint, quote string, content_hash string")
    t = spark.createDataFrame([(k, "\n".join(v)) for k, v in targets.items()], "target_id string, content string")
    asked = M.anchors(df).withColumn("target_id", F.col("snapshot_id"))
    got = {r.evidence_id: (r.outcome, list(r.candidates)) for r in M.classify(asked, t).collect()}
    for e, s, a, b, q, _ in ev[:200]:
        lines, want = q.split("\r\n"), targets[s]
        found = [i + 1 for i in range(len(want) - len(lines) + 1) if want[i : i + len(lines)] == lines]
        outcome = "SAME_POSITION" if a in found else ["NO_EXACT_MATCH", "EXACT_MOVED_UNIQUE", "EXACT_MOVED_AMBIGUOUS"][min(2, len(found))]
        assert got[e] == (outcome, found)
    assert all(got[f"x{i}"][0] == "INVALID_EVIDENCE" for i in range(1, 6)) and got["x6"][0] in ("NO_EXACT_MATCH", "SAME_POSITION")
    errors = {r.evidence_id: r.error for r in M.anchors(df).where("error is not null").collect()}
    assert errors == {"x1": "QUOTE_REQUIRED", "x2": "INVALID_LINE_RANGE", "x3": "QUOTE_SPAN_MISMATCH", "x4": "INVALID_CONTENT_HASH", "x5": "CONTENT_HASH_MISMATCH"}


def test_canonical_json(spark):
    rows = [("a\"b\\c\n\x01é", 1e-05, 10000000.0, 3), (None, -0.0, 0.1, None), ("", 1.0, 1e22, 0)]
    df = spark.createDataFrame(rows, "s string, x double, y double, n bigint")
    got = [r[0] for r in df.select(material.canonical_json(df, ["s", "x", "y", "n"])).collect()]
    want = [json.dumps({"s": s, "x": x + 0.0 if x else 0.0, "y": y, "n": n}, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for s, x, y, n in rows]
    assert got == want
    assert [r.digest for r in material.row_digests(df, "n", ["s"]).collect()][1] == _sha('{"s":null}')
    twice = spark.createDataFrame([("o", "b"), ("o", "a"), ("o", "a")], "k string, m string")
    d = sorted(_sha(json.dumps({"m": m}, separators=(",", ":"))) for m in "aab")
    assert material.set_digests(twice, "k", ["m"]).first() == ("o", 3, _sha("\n".join(d)))


def test_pack_edges(spark):
    rows = [("a", "AUTHORIZED", "agent", "2024-01-01", "2024-02-01", None, None), ("b", "AUTHORIZED", "hidden", None, None, None, None), ("c", "AUTHORIZED", "agent", "2024-02-01", None, "2030-01-01", None), ("d", "PROPOSED", "agent", None, None, None, None)]
    df = spark.createDataFrame([(*r, "p", "2024-01-01") for r in rows], "claim_id string, status string, access_policy string, knowledge_from string, knowledge_to string, valid_from string, valid_to string, persona_id string, updated_at string")
    feb = 1_706_745_600
    assert [r.claim_id for r in pack.ordered(pack.visible(df, feb)).collect()] == ["c"]
    assert [r.claim_id for r in pack.visible(df, feb - 1).collect()] == ["a"]
    assert pack.visible(df, feb, feb).count() == 0 and pack.visible(df, feb, access=["hidden"]).count() == 0
    assert {(r.cutoff, r.claims) for r in pack.visible_counts(df, feb - 86_400, 86_400, 3).collect()} == {(feb - 86_400, 1), (feb, 1), (feb + 86_400, 1)}


def test_ingest(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\r\n".encode())
    (tmp_path / "b.MD").write_bytes(b"\xff\xfeh\x00i\x00")
    (tmp_path / "b.md").write_bytes(b"\xff\xfeh\x00i\x00")
    (tmp_path / "c.srt").write_bytes(b"\xc3(")
    (tmp_path / "d.pdf").write_bytes(b"no")
    got = {r.path.rsplit("/", 1)[1]: (r.media_type, r.content, r.problem) for r in ingest.read_texts(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("text/plain", "é\r\n", None) and got["b.md"] == ("text/markdown", "hi", None) and got["c.srt"] == ("application/x-subrip", None, "UNDECODABLE")
    assert "d.pdf" not in got
    texts = spark.createDataFrame([(1, "ok"), (2, "a‮b"), (3, "x" * 50), (4, "\n" * 9), (5, None)], "k int, t string")
    issues = {tuple(r) for r in ingest.text_issues(texts, "k", "t", max_bytes=40, max_lines=5, max_line_bytes=45).collect()}
    assert issues == {(2, "UNSAFE_CONTROL", 1), (3, "FILE_BYTES", None), (3, "LINE_BYTES", None), (4, "LINES", 9)}


def test_constraints_and_legacy(spark):
    df = spark.createDataFrame([("a", 1.5, "P"), ("b", None, "Q")], "k string, x double, p string")
    assert [tuple(r) for r in C.broken_rows(df, "k", [C.Rule("RANGE", "x > 1"), C.Rule("NULL", "x is null")]).collect()] == [("RANGE", "a"), ("NULL", "b")]
    bad = C.foreign_key_issues(df, "k", F.col("p"), spark.createDataFrame([("P",)], "id string"), F.col("id"), "FK")
    good, held = C.split_quarantine(df, "k", bad)
    assert [r.k for r in good.collect()] == ["a"] and [r.k for r in held.collect()] == ["b"]
    assert C.schema_fingerprint(df) == C.schema_fingerprint(df.select("p", "k", "x")) != C.schema_fingerprint(df.select("k"))
    old = spark.createDataFrame([("Not-Specified", "2"), (" ", "x"), (None, "-1"), ("who", None)], "s string, c string")
    got = old.select(G.mapped(F.col("s"), {"NOT_SPECIFIED": "n"}, "other", "blank"), G.unit_interval(F.col("c")), G.first_filled(F.col("s"), F.lit("z"))).collect()
    assert [tuple(r) for r in got] == [("n", 1.0, "Not-Specified"), ("blank", 1.0, "z"), ("blank", 0.0, "z"), ("other", 1.0, "who")]
    texts = spark.createDataFrame([("k", "w", 1, "A"), ("k", "w", 2, "A"), ("k", "w", 3, "B")], "k string, w string, o bigint, t string")
    once, again = (sorted(map(tuple, G.converted_snapshots(texts, "k", "w", "o", "o", "t").collect())) for _ in range(2))
    assert once == again and len(once) == 2 and [r[2] for r in sorted(once, key=lambda r: r[2])] == [1, 2]


def test_stream(spark, tmp_path):
    from ledgerloom.streaming.ledger_stream import chain_stream

    rows = [("a", 1, "g", "h1"), ("a", 2, "h1", "h2"), ("b", 1, "g", "k1"), ("a", 3, "bad", "h3")]
    schema = "aggregate_id string, sequence bigint, previous_hash string, entry_hash string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = chain_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("links").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from links").collect()] == [("a", 3, "LINK_MISMATCH")]


def test_cli(spark, tmp_path, capsys):
    from ledgerloom import cli

    assert cli.main(["list"]) == 0 and "p2_found" in capsys.readouterr().out
    assert cli.main(["run", "nothing", str(tmp_path)]) == 2
    (tmp_path / "a.md").write_text("a‮b\n")
    assert cli.main(["texts", str(tmp_path)]) == 3 and '"at": 1, "code": "UNSAFE_CONTROL"' in capsys.readouterr().out


def test_upsert_continues_chains(spark):
    schema = "k string, o bigint, text string"
    first = [("s", 1, "A"), ("s", 2, "B"), ("t", 1, "X"), (None, 1, "N")]
    later = [("s", 3, "B"), ("s", 4, "C"), ("s", 5, "C"), ("s", 6, "B"), ("u", 1, "U"), (None, 2, "M")]
    a = R.allocate(spark.createDataFrame(first, schema), ["k"], "o", "o", "text")
    newest = a.groupBy("k").agg(F.max_by(F.struct("id", "version", "content_hash"), "version").alias("x")).select("k", "x.*")
    b = R.upsert(newest, spark.createDataFrame(later, schema), ["k"], "o", "o", "text", width=2)
    whole = R.allocate(spark.createDataFrame(first + later, schema), ["k"], "o", "o", "text")
    key = lambda df: sorted((str(r.k), str(r.id), r.version, str(r.previous_id)) for r in df.collect())
    assert key(b) == [x for x in key(whole) if x not in key(a)]
    assert R.upsert(newest.limit(0), spark.createDataFrame(first, schema), ["k"], "o", "o", "text").count() == 4


def test_ledger_append(spark, monkeypatch):
    rows = [(i, f"e{i}", "t", "claim", "a", '{"é":"\\""}', None if i == 3 else "2024-01-01T00:00:00Z") for i in range(20)]
    batch = spark.createDataFrame(rows, "o int, entry_id string, event_type string, aggregate_type string, aggregate_id string, payload_json string, created_at string")
    one = L.linked(batch.where("o < 12"), "o", 0)
    last = one.orderBy(F.desc("sequence")).first()
    two = L.linked(batch.where("o >= 12"), "o", last.sequence, last.entry_hash)
    whole = one.unionByName(two)
    assert L.chain_issues(whole).count() == 0 and whole.agg(F.max("sequence")).first()[0] == 20
    monkeypatch.setattr(L, "MAX_BATCH", 5)
    with pytest.raises(ValueError):
        L.linked(batch, "o", 0)


def test_quotes_that_are_no_text(spark):
    s = spark.createDataFrame([("s1", "o", "a\nb", 2)], "snapshot_id string, source_id string, content string, line_count bigint")
    c = spark.createDataFrame([("c1", "k")], "claim_id string, continuity string")
    o = spark.createDataFrame([("o", "k")], "source_id string, continuity string")
    e = spark.createDataFrame([("e1", "c1", "s1", 1, 1)], "evidence_id string, claim_id string, snapshot_id string, start_line bigint, end_line bigint")
    e = e.selectExpr("*", "cast(unhex('61ff') as string) as quote", "cast(null as string) as content_hash")
    assert [(r.code, r.evidence_id) for r in E.issues(c, e, s, o).collect()] == [("INVALID_QUOTE", "e1")]
    assert M.anchors(e).select("error").first()[0] == "INVALID_UNICODE_QUOTE"


def test_too_many_places_fail(spark):
    q = M.anchors(spark.createDataFrame([("e", "s", 1, 1, "x", None), ("f", "s", 1, 1, "y", None)], "evidence_id string, snapshot_id string, start_line bigint, end_line bigint, quote string, content_hash string"))
    t = spark.createDataFrame([("t", "x\n" * 6 + "y\n" * 3)], "target_id string, content string")
    asked = q.withColumn("target_id", F.lit("t"))
    assert {r.evidence_id: r.n_candidates for r in M.classify(asked, t, max_candidates=6).collect()} == {"e": 6, "f": 3}
    with pytest.raises(Exception, match="CANDIDATE_LIMIT"):
        M.classify(asked, t, max_candidates=5).collect()


def test_ledger_linked_in_steps(spark):
    from ledgerloom.runtime import Scratch

    rows = spark.createDataFrame([(i, f"e{i}", "t", "user", "1", "{}", "2024") for i in range(10)], "i bigint, entry_id string, event_type string, aggregate_type string, aggregate_id string, payload_json string, created_at string")
    whole = L.appended(rows, "i", Scratch(spark))
    steps = L.appended(rows, "i", Scratch(spark), step=4)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, steps.collect())) and L.chain_issues(steps).count() == 0
    assert L.appended(rows.limit(0), "i", Scratch(spark)).count() == 0
    with pytest.raises(ValueError):
        L.appended(rows, "i", Scratch(spark), reserved=("t",))
