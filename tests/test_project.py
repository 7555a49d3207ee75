"""Reads, audit material, reports, strict JSON and the catalogue on small tables."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import audit as A, constraints as K, legacy as G, reads, replay as R, report as P
from ledgerloom.sources import catalog as C, ingest, strict_json as J


def _sha(x):
    return hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


SOURCES = "source_id string, source_key string, continuity string"
SNAPS = "snapshot_id string, source_id string, version bigint, content_hash string, content string, media_type string, origin_path string, previous_snapshot_id string, line_count bigint, created_at string"


def _snap(i, source, version, text, prev=None, lines=None, digest=None):
    n = len(text.splitlines()) if lines is None else lines
    return (i, source, version, digest or hashlib.sha256(text.encode()).hexdigest(), text, "text/plain", None, prev, n, "2024-01-01")


def test_lookups_fail_instead_of_guessing(spark):
    s = spark.createDataFrame([("a", "k", "x"), ("b", "k", "y"), ("b", "k", "y"), ("c", "m", "x")], SOURCES)
    assert reads.find_source(s, "c").source_key == "m" and reads.find_source(s, source_key="k", continuity="y").source_id == "b"
    with pytest.raises(reads.Ambiguous):
        reads.find_source(s, source_key="k")
    with pytest.raises(reads.NotFound):
        reads.find_source(s, "z")
    with pytest.raises(TypeError):
        reads.find_source(s)
    assert reads.at_most(s, 4).count() == 4
    with pytest.raises(reads.LimitExceeded):
        reads.at_most(s, 3)
    assert [r.source_id for r in reads.sources(s).collect()] == ["a", "b", "c"]


def test_lineage_and_bodies_are_bounded(spark):
    s = spark.createDataFrame([_snap(f"s{i}", "a", i, "x" * i) for i in (1, 2, 3, 4)] + [_snap("t", "b", 1, "y")], SNAPS)
    assert [r.version for r in reads.lineage(s, "a", 2, 4).collect()] == [2, 3, 4]
    with pytest.raises(reads.LimitExceeded):
        reads.lineage(s, "a", 1, 4, limit=3)
    assert {r.content for r in reads.bodies(s, "a", [1, 3], 3).collect()} == {"x", "xxx"}
    with pytest.raises(reads.LimitExceeded):
        reads.bodies(s, "a", [4], 3)


def test_evidence_of_claims_and_events(spark):
    cols = "string, snapshot_id string, start_line bigint, end_line bigint, start_char bigint, end_char bigint, quote string, content_hash string, created_at string"
    row = lambda i, o, s, n: (i, o, s, n, n, None, None, None, None, None)
    c = spark.createDataFrame([row("e1", "C1 ", "S1", 2), row("e1", "c1", "s1", 2), row("e2", "c2", "s1", 1), row("x", "c2", "s2", 1)], "evidence_id string, claim_id " + cols)
    e = spark.createDataFrame([row("e3", "v1", "s1", 3), row("x", "v1", "s9", 1)], "evidence_id string, event_id " + cols)
    assert [r.evidence_id for r in reads.evidence(c, e, snapshot_id=" S1").collect()] == ["e2", "e1", "e3"]
    assert [r.evidence_id for r in reads.evidence(c, e, event_id="v1").collect()] == ["e3", "x"]
    assert [r.evidence_id for r in reads.evidence(c, e, claim_id="C1").collect()] == ["e1"]
    assert reads.find_evidence(c, e, "e3").kind == "event"
    for wrong in (lambda: reads.evidence(c, e, claim_id="c1", event_id="v1"), lambda: reads.evidence(c, None, event_id="v1")):
        with pytest.raises(TypeError):
            wrong()
    with pytest.raises(reads.Ambiguous):
        reads.find_evidence(c, e, "x")


def test_events_at_a_cutoff(spark):
    cols = "event_id string, persona_id string, continuity string, valid_from string, valid_to string, knowledge_from string, knowledge_to string, access_policy string, created_at string"
    e = spark.createDataFrame([("b", "p", "k", None, None, None, None, "agent_accessible", "2024-03-01"), ("a", "p", "k", "2024-01-01", "2024-02-01", None, None, "hidden", "2024-01-01"), ("c", "q", "k", None, None, "2030-01-01", None, "human_only", "2024-01-01")], cols)
    ids = lambda **k: [r.event_id for r in reads.events(e, **k).collect()]
    assert ids() == ["a", "b", "c"] and ids(persona_id="p") == ["a", "b"] and ids(access=[]) == []
    assert ids(known_at=1_704_067_200) == ["a", "b"] and ids(valid_at=1_706_745_600) == ["b", "c"] and ids(access=["hidden"]) == ["a"]


def test_specs_decisions_and_legacy(spark):
    s = spark.createDataFrame([("a:1:2",), ("x:y:3:3",), ("a:2:1",), ("a:0:1",), ("a:1",), (None,)], "c string").select(reads.evidence_spec(F.col("c")).alias("x")).collect()
    assert [r.x and tuple(r.x) for r in s] == [("a", 1, 2), ("x:y", 3, 3), None, None, None, None]
    d = spark.createDataFrame([(2, "c", "z"), (1, "c", "y"), (3, "d", "x")], "row_seq bigint, claim_id string, decision_id string")
    assert [r.decision_id for r in reads.decisions(d, "c").collect()] == ["y", "z"]


def test_material_digests_are_those_of_the_json(spark):
    fields = A.CLAIM_FIELDS
    base = {f: f"{f} \"q\" \\ \x01é" for f in fields} | {"confidence": -0.0, "subject": None}
    c = spark.createDataFrame([tuple(base[f] for f in fields)], ", ".join(f"{f} {'double' if f == 'confidence' else 'string'}" for f in fields))
    want = base | {"status": "PROPOSED", "updated_at": base["created_at"], "confidence": 0.0}
    assert A.claim_material(c).first().aggregate_sha256 == _sha({"material_version": 2, "aggregate_type": "claim", "aggregate": want})
    names = [f if f != "details" else "details_json" for f in A.EVENT_FIELDS]
    e = spark.createDataFrame([tuple('{"a":[1,2]}' if n == "details_json" else n for n in names)], ", ".join(f"{n} string" for n in names))
    assert A.event_material(e).first().aggregate_sha256 == _sha({"material_version": 2, "aggregate_type": "narrative_event", "aggregate": {f: {"a": [1, 2]} if f == "details" else f for f in A.EVENT_FIELDS}})


def test_evidence_sets_and_checkpoints(spark):
    rows = [("e2", "c", "s", 1, 1, None, None, "q\n", None, "2024-02-01"), ("e1", "c", "s", 2, 3, 0, 4, None, "h", "2024-01-01"), ("e1", "c", "s", 2, 3, 0, 4, None, "h", "2024-01-01"), ("e9", None, "s", 1, 1, None, None, None, None, None)]
    names = "evidence_id claim_id snapshot_id start_line end_line start_char end_char quote content_hash created_at".split()
    e = spark.createDataFrame(rows, ", ".join(f"{n} {'bigint' if n[-4:] in ('line', 'char') else 'string'}" for n in names))
    bodies = [dict(zip(names, r)) | {"event_id": None} for r in rows if r[1]]
    digest = lambda some: _sha({"material_version": 2, "aggregate_type": "claim", "evidence": sorted(some, key=lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False))})
    got = A.evidence_set_material(e, "claim_id", "claim").collect()
    assert [(r.claim_id, r.n, r.evidence_set_sha256) for r in got] == [("c", 3, digest(bodies))]
    steps = sorted(A.evidence_checkpoints(e, "claim_id", "claim", ["created_at"]).collect(), key=lambda r: r.position)
    order = sorted(bodies, key=lambda x: (x["created_at"], x["evidence_id"]))
    assert [r.evidence_set_sha256 for r in steps] == [digest(order[: i + 1]) for i in range(3)] and [r.evidence_id for r in steps] == ["e1", "e1", "e2"]
    with pytest.raises(ValueError):
        A.evidence_set_material(e, "claim_id", "claim", max_bytes=10)
    assert A.evidence_set_material(e.limit(0), "claim_id", "claim").count() == 0


def test_digests_and_attestations_in_payloads(spark):
    h = "a" * 64
    good = {"aggregate_sha256": h, "evidence_set_sha256": h, "material_version": 2}
    cases = {"a": (good, None), "b": ({"x": 1}, None), "c": ({"material_version": 2}, "INCOMPLETE"), "d": (good | {"material_version": "2"}, "VERSION"), "e": (good | {"aggregate_sha256": "A" * 64}, "DIGEST"), "f": (good | {"material_version": True}, "VERSION")}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, (v, _) in cases.items()] + [("g", "{"), ("h", None)], "k string, p string")
    got = {r.k: r.x for r in df.select("k", A.material_digests(F.col("p")).alias("x")).collect()}
    assert got == {k: v for k, (_, v) in cases.items()} | {"g": "NOT_JSON", "h": "NOT_JSON"}
    one = spark.range(1).select(A.attestation(F.lit(h), F.lit(h), F.lit("claim_proposed"), F.lit("e1"), F.lit("V02")).alias("p"))
    why = lambda t, e, k: one.select(A.attestation_problem(F.col("p"), F.lit(t), F.lit(e), k).alias("x")).first().x
    assert why("claim_proposed", "e1", ["V02"]) is None and why("other", "e1", ["V02"]) == "EVENT_TYPE" and why("claim_proposed", "e2", ["V02"]) == "ENTRY" and why("claim_proposed", "e1", ["V9"]) == "SOURCE_KIND"
    assert df.where("k = 'a'").select(A.attestation_problem(F.col("p"), F.lit("t"), F.lit("e"), ["V02"]).alias("x")).first().x == "FIELDS"


def _impact_tables(spark):
    old, new = "one\ntwo\nthree\nfour\n", "zero\none\ntwo\nx\nthree\nthree\n"
    snaps = [_snap("s1", "a", 1, old), _snap("s2", "a", 2, new, "S1 "), _snap("t1", "b", 1, "p"), _snap("t2", "b", 2, "q", "other"), _snap("u1", "c", 1, "p", lines=7), _snap("u2", "c", 2, "q", "u1"), _snap("v1", "d", 1, "p"), _snap("v3", "d", 3, "q", "v1"), _snap("w1", "e", 1, "only")]
    ev = [("e1", "c1", "s1", 1, 2, None, None), ("e2", "c1", " S1", 3, 3, "three", None), ("e3", "c2", "s1", 4, 4, None, None), ("e4", "c2", "s1", 1, 1, "wrong", None), ("e5", "c2", "s1", 9, 9, None, None), ("e6", "c2", "s2", 1, 1, None, None), ("e7", "zz", "s1", 1, 1, None, None)]
    c = [("c1", "p", "AUTHORIZED"), ("c2", "q", "PROPOSED")]
    return (
        spark.createDataFrame(snaps, SNAPS),
        spark.createDataFrame(ev, "evidence_id string, claim_id string, snapshot_id string, start_line bigint, end_line bigint, quote string, content_hash string"),
        spark.createDataFrame(c, "claim_id string, persona_id string, status string"),
    )


def test_impact_between_revisions(spark):
    s, e, c = _impact_tables(spark)
    pairs = P.endpoints(s, P.version_pairs(s))
    assert {r.source_id: r.problem for r in pairs.collect()} == {"a": None, "b": "SNAPSHOT_LINEAGE_INVALID", "c": "SNAPSHOT_LINE_COUNT_MISMATCH", "d": "SNAPSHOT_LINEAGE_MISSING"}
    got = {r.evidence_id: (r.aggregate_id, r.outcome, r.candidates) for r in P.source_impact(c, e, s, pairs).collect()}
    assert got == {
        "e1": ("c1", "EXACT_MOVED_UNIQUE", [2]), "e2": ("c1", "EXACT_MOVED_AMBIGUOUS", [5, 6]), "e3": ("c2", "NO_EXACT_MATCH", []),
        "e4": ("c2", "INVALID_EVIDENCE", []), "e5": ("c2", "INVALID_EVIDENCE", []),
    }
    t = P.impact_totals(P.source_impact(c, e, s, pairs), max_affected=4).first()
    assert (t.affected, t.claims, t.candidates, t.same_position, t.invalid_evidence, t.limit) == (5, 2, 3, 0, 2, "AFFECTED_EVIDENCE_LIMIT_EXCEEDED")
    assert P.version_pairs(s, 1, 3).collect() == [("d", 1, 3)]
    assert P.source_impact(c, e, s.limit(0), P.endpoints(s.limit(0), P.version_pairs(s.limit(0)))).count() == 0


def test_totals_and_intervals(spark):
    none = spark.createDataFrame([], "code string, severity string")
    assert tuple(P.totals(none).first()) == (0, 0, True)
    assert tuple(P.totals(spark.createDataFrame([("a", "error"), ("b", "warning"), ("b", "warning")], "code string, severity string")).first()) == (1, 2, False)
    rows = [("a", None, None, "2024-02-01", "2024-01-01"), ("b", "bad", None, None, None), ("c", "2024-01-01", "2024-01-01", None, None), ("d", " ", "", "2024-01-01", "2024-01-02")]
    df = spark.createDataFrame(rows, "id string, valid_from string, valid_to string, knowledge_from string, knowledge_to string")
    assert {r.id for r in P.interval_issues(df, "id", "claim").collect()} == {"a", "b", "c"}


def test_pack_is_written_once(spark, tmp_path):
    snaps = spark.createDataFrame([_snap("s1", "a", 1, "one\ntwo")], SNAPS)
    sources = spark.createDataFrame([("a", "key", "k")], SOURCES)
    names = "claim_id persona_id continuity text subject predicate object_value valid_from valid_to knowledge_from knowledge_to access_policy status rationale updated_at created_at".split()
    claim = lambda i, access="agent_accessible", text="t": (i, "p", "k", text, "s", "r", "o", None, None, "2024-01-01", None, access, "AUTHORIZED", None, "2024", "2024", 0.5)
    claims = spark.createDataFrame([claim("c1"), claim("c2", "hidden"), claim("c3")], ", ".join(f"{n} string" for n in names) + ", confidence double")
    ev = spark.createDataFrame([("e2", "c1", "s1", 2, 2, None, None, "two", None), ("e1", "C1", "S1", 1, 1, None, None, None, None), ("e3", "c3", "s1", 1, 1, None, None, "other", None)], "evidence_id string, claim_id string, snapshot_id string, start_line bigint, end_line bigint, start_char bigint, end_char bigint, quote string, content_hash string")
    packed, diagnostics = P.memory_pack(claims, ev, snaps, sources, 1_735_689_600)
    row = packed.collect()
    assert [r.id for r in row] == ["c1"] and len(row[0].asDict()) == 26 and [x.source_span.start_line for x in row[0].provenance] == [1, 2] and row[0].source_snapshot_id == "s1" and row[0].status == "supported"
    assert [tuple(r) for r in diagnostics.collect()] == [("EVIDENCE_INVALID", "c3")]
    assert tuple(P.pack_statistics(packed, diagnostics).first()) == (1, 0, 1)
    P.write_pack(packed, str(tmp_path / "pack"))
    (line,) = [x.value for x in spark.read.text(str(tmp_path / "pack")).collect()]
    assert json.loads(line)["valid_until"] is None and json.loads(line)["provenance"][1]["quote"] == "two"
    with pytest.raises(Exception):
        P.write_pack(packed, str(tmp_path / "pack"))


def test_strict_json(spark):
    deep = "[" * 300 + "]" * 300
    cases = {"{}": None, "[1, 2.5e3, null]": None, '{"a":1,"a":2}': "DUPLICATE_JSON_KEY", '{"a":{"b":1,"b":1}}': "DUPLICATE_JSON_KEY", "NaN": "NONFINITE_JSON_NUMBER", "[-Infinity]": "NONFINITE_JSON_NUMBER", "{": "INVALID_JSON", "": "INVALID_JSON", deep: "JSON_NESTING_LIMIT", '"\\u001b[1m"': "UNSAFE_CONTROL", '{"\\u202e":1}': "UNSAFE_CONTROL", "[\x00]": "UNSAFE_CONTROL", '"\\ud800"': None}
    for text, want in cases.items():
        assert J.problem(text) == want, text
    assert J.problem(None) is None and J.problem("[1]", max_bytes=2) == "FILE_BYTES" and J.problem("[[1]]", max_depth=2) == "JSON_NESTING_LIMIT"
    df = spark.createDataFrame([("a", "{}"), ("b", "{"), ("c", None), ("d", "[1,2,3,4]")], "k string, t string")
    assert {(r.key, r.code) for r in J.json_issues(df, "k", "t", max_bytes=8).collect()} == {("b", "INVALID_JSON"), ("d", "FILE_BYTES")}


def test_catalogue(spark, tmp_path):
    full = {t: c.split() for t, c in C.COLUMNS.items()}
    assert C.layout({}) == "EMPTY" and C.layout(full) == "CURRENT"
    assert C.layout({t: c for t, c in full.items() if t not in ("narrative_events", "event_evidence_refs")}) == "READABLE"
    assert C.layout({"source_snapshots": ["a"] * 6, "claims": ["b"] * 17}) == "FIRST"
    assert C.layout({"sources": ["x"]}) == "PARTIAL" and C.layout({"zzz": ["x"]}) == "UNKNOWN"
    a = spark.createDataFrame([("x", 1), ("y", None), ("y", None)], "s string, n bigint")
    b = spark.createDataFrame([(None, "y"), (1, "x"), (None, "y")], "n bigint, s string")
    c = spark.createDataFrame([("x", 1), ("y", None)], "s string, n bigint")
    digest = lambda df: tuple(C.table_digests({"t": df}).first())
    assert digest(a) == digest(b) != digest(c) and digest(a.limit(0)) == ("t", 0, "0")
    C.verified_copy(a, str(tmp_path / "copy"))
    with pytest.raises(Exception):
        C.verified_copy(a, str(tmp_path / "copy"))
    a.write.parquet(str(tmp_path / "sources.parquet"))
    with pytest.raises(ValueError):
        C.open_tables(spark, str(tmp_path), ["sources"])
    assert C.open_tables(spark, str(tmp_path), ["sources"], {"sources": "s n"})["sources"].count() == 3


def test_texts_for_reports(spark):
    df = spark.createDataFrame([("ok",), ("/etc/x",), ("a\x1bb",), ("z" * 2000,), ("",), (None,)], "t string")
    got = df.select("t", C.metadata_problem(F.col("t")).alias("p"), C.shown(F.col("t")).alias("s"), C.redacted(F.col("t")).alias("r")).collect()
    assert [r.p for r in got] == [None, None, "REPORT_METADATA_CONTROL_CHARACTER", "REPORT_METADATA_BYTES_LIMIT_EXCEEDED", "REPORT_METADATA_INVALID", "REPORT_METADATA_INVALID"]
    assert [r.s for r in got] == ["ok", None, None, None, "", None]
    assert got[0].r.sha256 == hashlib.sha256(b"ok").hexdigest() and got[0].r.length == 2 and got[5].r is None
    f = spark.createDataFrame([("a", "é" * 3, None), ("b", "x", "yyyy")], "k string, text string, subject string")
    assert {tuple(r) for r in C.over_limits(f, "k", {"text": 5, "subject": 3}).collect()} == {("a", "text", 6), ("b", "subject", 4)}
    t = spark.createDataFrame([(" ", "s", "p", "o"), ("x", "s", "p", "o"), (None, "s", None, "o")], "t string, s string, p string, o string")
    assert [r[0] for r in t.select(C.proposal_text(*[F.col(c) for c in "tspo"])).collect()] == ["s p o", "x", "s o"]


def test_older_claims_with_gaps(spark):
    rows = [("a", "says", None, "s9", "2", None, "bad", "x"), ("a", "says", None, "s9", "2", None, "bad", "x"), ("b", "", "denied", "s1", None, "3", "-2", None), (None, "z", None, None, None, None, None, None), ("c", None, "odd", "gone", "1", "1", None, "none")]
    older = spark.createDataFrame(rows, "Id string, Statement string, STATUS string, source_id string, line_start string, line_end string, confidence string, access string").withColumn("text_extra", F.lit(1))
    snaps = spark.createDataFrame([("s1", "n1", 3), ("s9", "n9", 1)], "old_id string, snapshot_id string, line_count bigint")
    c, d, e = G.converted_claims(older, snaps, "2026-01-01T00:00:00Z")
    got = {r.claim_id: r for r in c.collect()}
    assert set(got) == {"a", "b", "c"}
    assert [(got[k].status, got[k].access_policy, got[k].confidence, got[k].text) for k in "abc"] == [("AUTHORIZED", "hidden", 1.0, "says"), ("REJECTED", "agent_accessible", 0.0, ""), ("DISPUTED", "hidden", 1.0, "")]
    assert d.count() == 3 and [(r.claim_id, r.snapshot_id, r.start_line, r.end_line) for r in e.collect()] == [("b", "n1", 1, 3)]
    c2, _, e2 = G.converted_claims(older.limit(0), snaps, "2026-01-01T00:00:00Z")
    assert c2.count() == e2.count() == 0
    v = spark.createDataFrame([("1", "{\"a\": 1}"), ("2", "text"), ("2", "text"), (None, "x"), ("3", None)], "id string, metadata string")
    assert {r.event_id: r.details_json for r in G.converted_events(v, "2026-01-01T00:00:00Z").collect()} == {"1": '{"a": 1}', "2": '{"legacy_value":"text"}', "3": "{}"}


def test_entries_to_append_are_numbered(spark):
    rows = spark.createDataFrame([("b", "2024-01-02"), ("a", "2024-01-02"), ("c", "2023-01-01"), ("d", None), ("e", "2020")], "k string, created_at string")
    have = spark.createDataFrame([("t", "x", "e"), ("other", "x", "b")], "event_type string, aggregate_type string, aggregate_id string")
    got = sorted(G.missing_entries(rows, "k", have, "t", "x", F.lit("{}")).collect(), key=lambda r: r.n)
    assert [(r.n, r.aggregate_id) for r in got] == [(0, "d"), (1, "c"), (2, "a"), (3, "b")]
    assert G.missing_entries(rows.limit(0), "k", have, "t", "x", F.lit("{}")).count() == 0


def test_orders_and_openings(spark):
    log = spark.createDataFrame([("a", 1, 5, "open"), ("a", 2, 4, "x"), ("a", 9, 6, "x"), ("b", 1, 1, "x"), ("b", 1, 2, "open"), ("c", 1, 1, "x"), ("d", 1, 1, "open"), ("d", 2, 2, "open"), (None, 1, 1, "open")], "k string, at bigint, seq bigint, kind string")
    for width in (2, 100):
        assert [(r.k, r.seq) for r in R.out_of_order(log, "k", "at", "seq", width).collect()] == [("a", 4)]
    assert {r.k: r.problem for r in R.not_first(log, "k", "seq", "kind", "open").collect()} == {"a": "OPENING_LATE", "b": "OPENING_LATE", "c": "OPENING_MISSING", "d": "OPENING_REPEATED"}
    assert R.not_first(log.limit(0), "k", "seq", "kind", "open").count() == 0


def test_scopes_payloads_and_single_rows(spark):
    p = spark.createDataFrame([("1", '{"text": "t", "status": "AUTHORIZED", "confidence": 0.5}'), ("2", "no"), ("3", None)], "k string, p string")
    got = {r.k: r for r in K.payload_rows(p, "k", "p", {"status": "PROPOSED"}).collect()}
    assert (got["1"].text, got["1"].confidence, got["1"].status) == ("t", 0.5, "PROPOSED") and got["2"].text is None and got["3"].status == "PROPOSED"
    assert {tuple(r) for r in K.outside(p, p.where("k <> '2'"), ["k"]).collect()} == {("2",)}
    assert {tuple(r) for r in K.over_ceilings({"p": p, "none": p.limit(0)}, 2, 2).collect()} == {("p", 3), ("", 3)}
    assert reads.find(p, "k", " 1 ").p.startswith("{")
    with pytest.raises(reads.NotFound):
        reads.find(p, "k", "9")
    shape = spark.createDataFrame([("a", "p", "c", "t", 0.5), ("b", " ", None, "", None), ("c", "p", "c", "t", 1.5)], "claim_id string, persona_id string, continuity string, text string, confidence double")
    assert {tuple(r) for r in K.broken_rows(shape, "claim_id", K.CLAIM_SHAPE).collect()} == {("PERSONA_REQUIRED", "b"), ("CONTINUITY_REQUIRED", "b"), ("TEXT_REQUIRED", "b"), ("CONFIDENCE_RANGE", "b"), ("CONFIDENCE_RANGE", "c")}
    t = ingest.texts_in_memory(spark, [("a.txt", "text/plain", "é"), ("b.txt", "text/plain", "")]).collect()
    assert [(r.n_bytes, r.content, r.problem) for r in t] == [(2, "é", None), (0, "", None)]
