"""The SQL that the queries of `project` are compared with."""

from __future__ import annotations

from ledgerloom.plans.oracle import _ANCHOR, _CLAIMS, _EVIDENCE_ISSUES, _KNOWN, _LEDGER_ROWS, _VALID, _VISIBLE, _blank, _digest, _entry, _epoch, _json_row, _key, _lines, SQL as KERNEL

_META = "(select snapshot_id, max(source_id) source_id, max(version) as version, max(content_hash) content_hash, max(media_type) media_type, max(previous_snapshot_id) previous_snapshot_id, max(line_count) line_count from source_snapshots where snapshot_id is not null group by 1)"
_OWNERS = "(select distinct source_id, source_key, continuity from sources)"
_EVENTS = f"""(select regexp_replace(claim_id, '^clm_', 'evt_') event_id, persona_id, continuity, coalesce(predicate, 'told') event_type, coalesce(subject, 'untitled') title, text summary,
  '{{"confidence_known":' || case when confidence is null then 'false' else 'true' end || '}}' details_json, valid_from, valid_to, knowledge_from, knowledge_to, access_policy, created_at from {_CLAIMS})"""
_EVENT_EVIDENCE = f"""(select 'ev' || substr(evidence_id, 4) evidence_id, regexp_replace({_key('claim_id')}, '^clm_', 'evt_') event_id, snapshot_id, start_line, end_line, start_char, end_char, quote, content_hash, created_at from evidence_refs)"""
_ONE_EACH = f"""(select evidence_id, min({_key('claim_id')}) claim_id, min(snapshot_id) snapshot_id, min(start_line) start_line, min(end_line) end_line, min(start_char) start_char, min(end_char) end_char, min(quote) quote, min(content_hash) content_hash, min(created_at) created_at, null event_id from evidence_refs group by 1)"""
_CLAIM_FIELDS = sorted("access_policy claim_id confidence continuity created_at knowledge_from knowledge_to object_value persona_id predicate proposal_model proposed_by rationale status subject text updated_at valid_from valid_to".split())
_EVIDENCE_FIELDS = sorted("claim_id content_hash created_at end_char end_line event_id evidence_id quote snapshot_id start_char start_line".split())


def _lower_escapes(c: str) -> str:
    """Control characters are written with lower-case hex digits."""
    for code in ("000b", "000e", "000f", "001a", "001b", "001c", "001d", "001e", "001f"):
        c = f"replace({c}, '\\u{code.upper()}', '\\u{code}')"
    return c


def _json(fields: list[str], numbers: tuple[str, ...] = ()) -> str:
    part = lambda f: f"cast({f} as varchar)" if f in numbers else _lower_escapes(f"cast(to_json({f}) as varchar)")
    return " || ',' || ".join(f"'\"{f}\":' || coalesce({part(f)}, 'null')" for f in fields)


_EVIDENCE_JSON = "'{' || " + _json(_EVIDENCE_FIELDS, ("end_char", "end_line", "start_char", "start_line")) + " || '}'"
_EVENT_ISSUES = _EVIDENCE_ISSUES.replace(f"with e as (select distinct on (evidence_id) *, {_key('claim_id')} ck, {_key('snapshot_id')} sk from evidence_refs)", f"with e as (select distinct on (evidence_id) *, event_id ck, {_key('snapshot_id')} sk from {_EVENT_EVIDENCE})").replace("c as (select distinct on (claim_id) lower(claim_id) ck, claim_id cid, continuity from claim_proposals)", f"c as (select lower(event_id) ck, event_id cid, continuity from {_EVENTS})")

_ENDS = f"""
mt as {_META},
vp as (select source_id, max(version) - 1 as a, max(version) as z from source_snapshots where source_id is not null and version is not null group by 1 having max(version) > 1),
st as (select mt.*, a, z from mt join vp using (source_id) where version between a and z),
bf as (select source_id, version + 1 as version, list(lower(snapshot_id)) was from st group by 1, 2),
ln2 as (select st.source_id, any_value(a) from_version, any_value(z) to_version, count(*) n, count(distinct st.version) vs, max(case when st.version > a and was is not null and not coalesce(list_contains(was, {_key('previous_snapshot_id')}), false) then 1 else 0 end) broken,
  max(case when st.version = a then snapshot_id end) from_id, max(case when st.version = z then snapshot_id end) to_id from st left join bf on bf.source_id = st.source_id and bf.version = st.version group by st.source_id),
ck as (select snapshot_id, min(case when content is null then 'SNAPSHOT_CONTENT_MISSING' when {_digest('content_hash')} is null then 'INVALID_CONTENT_HASH' when line_count is distinct from len({_lines('content')}) then 'SNAPSHOT_LINE_COUNT_MISMATCH' when {_digest('content_hash')} <> sha256(content) then 'SNAPSHOT_CONTENT_HASH_MISMATCH' else '' end) bad from source_snapshots group by 1),
pr2 as (select source_id, from_version, to_version, from_id, to_id, case when n <> 2 or vs <> 2 then 'SNAPSHOT_LINEAGE_MISSING' when broken = 1 then 'SNAPSHOT_LINEAGE_INVALID' when x.bad <> '' then x.bad when y.bad <> '' then y.bad end problem
  from ln2 left join ck x on x.snapshot_id = from_id left join ck y on y.snapshot_id = to_id)
"""
_BETWEEN = f"""with {_ENDS},
ev as ({_ANCHOR}),
ec as (select distinct on (evidence_id) evidence_id, {_key('claim_id')} ck from evidence_refs),
tx as (select snapshot_id, {_lines('max(content)')} tl from source_snapshots group by 1),
an as (select ev.*, ec.ck, source_id, from_id, to_id, case when a >= 1 and z >= a and z <= len(o.tl) then array_to_string(o.tl[a:z], chr(10)) end x, t.tl target from ev join pr2 on problem is null and ev.sk = lower(from_id) join ec using (evidence_id) join tx o on o.snapshot_id = from_id join tx t on t.snapshot_id = to_id),
cl as (select lower(claim_id) ck, claim_id, persona_id, status from {_CLAIMS}),
er as (select *, case when x is null or (q is not null and q <> x) or (h is not null and dg is distinct from sha256(x)) then true else false end bad, z - a + 1 w from an),
cd as (select er.evidence_id, list_filter(range(1, len(target) + 1), lambda i: not bad and i + w - 1 <= len(target) and array_to_string(target[i : i + w - 1], chr(10)) = x) c from er),
rp as (select source_id, from_id, to_id, 'claim' aggregate_type, claim_id aggregate_id, evidence_id, persona_id, status governance_status, a start_line, z end_line,
  case when bad then 'INVALID_EVIDENCE' when list_contains(c, a) then 'SAME_POSITION' when len(c) = 1 then 'EXACT_MOVED_UNIQUE' when len(c) > 1 then 'EXACT_MOVED_AMBIGUOUS' else 'NO_EXACT_MATCH' end outcome, len(c) n_candidates, array_to_string(c, ',') candidates from er join cd using (evidence_id) join cl using (ck))
"""
_OUTCOMES = ("SAME_POSITION", "EXACT_MOVED_UNIQUE", "EXACT_MOVED_AMBIGUOUS", "NO_EXACT_MATCH", "INVALID_EVIDENCE")
_WRONG = lambda lo, hi: f"(not {_blank(lo)} and {_epoch(lo)} is null) or (not {_blank(hi)} and {_epoch(hi)} is null) or coalesce({_epoch(lo)} >= {_epoch(hi)}, false)"
_BAD_INTERVAL = f"({_WRONG('valid_from', 'valid_to')} or {_WRONG('knowledge_from', 'knowledge_to')})"
_CHAIN_BROKEN = f"""(select 1 from lg left join (select "sequence" + 1 nx, entry_hash eh from lg) b on lg."sequence" = b.nx where ("sequence" > 1 and eh is null) or sha256({_entry('previous_hash')}) <> entry_hash)"""
_FINDINGS = _LEDGER_ROWS + f""", pi as ({KERNEL['project_issues']}), ei as ({_EVENT_ISSUES}select distinct code, claim_id from iss), fi as (
select code, severity, kind, id from pi union all select 'INVALID_TEMPORAL_INTERVAL', 'error', 'claim', claim_id from {_CLAIMS} where {_BAD_INTERVAL} union all select 'INVALID_TEMPORAL_INTERVAL', 'error', 'event', event_id from {_EVENTS} where {_BAD_INTERVAL}
union all select code, 'error', 'event', claim_id from ei union all select distinct 'SOURCE_CONTINUITY_MISMATCH', 'error', 'snapshot', snapshot_id from source_snapshots where source_id is not null and source_id not in (select source_id from sources)
union all select 'EVENT_LEDGER_INVALID', 'error', 'ledger', null where exists {_CHAIN_BROKEN})
"""
_SOUND = f"v as ({_VISIBLE}), w as (select * from v where {_KNOWN} and {_VALID}), bad as (select distinct claim_id from ({_EVIDENCE_ISSUES}select claim_id from iss))"
_PACK = f"""with {_SOUND},
e as (select distinct on (evidence_id) {_key('claim_id')} ck, {_key('snapshot_id')} sk, evidence_id, start_line, end_line from evidence_refs), m as {_META}, o as (select distinct on (source_id) source_id from sources),
j as (select claim_id, row_number() over (partition by claim_id order by sk, start_line nulls first, end_line nulls first, evidence_id) r, count(*) over (partition by claim_id) n, m.source_id, m.snapshot_id, start_line from w join e on lower(w.claim_id) = e.ck join m on e.sk = lower(m.snapshot_id) join o on m.source_id = o.source_id where claim_id not in (select claim_id from bad))
select w.claim_id id, text claim, text, persona_id, continuity, subject, predicate, object_value "object", object_value, valid_from, valid_to valid_until, valid_to, knowledge_from, knowledge_to knowledge_until, knowledge_to, access_policy visibility, access_policy, confidence, status governance_status, 'supported' status, j.source_id, j.snapshot_id source_snapshot_id, j.n n_provenance, j.start_line from w join j on w.claim_id = j.claim_id and r = 1"""
_EVENT_SEEN = f"""(select * from (select *, {_epoch('knowledge_from')} kf, {_epoch('knowledge_to')} kt, {_epoch('valid_from')} vf, {_epoch('valid_to')} vt from {_EVENTS}) where {_KNOWN} and {_VALID})"""
_PACK_EVENTS = f"""select event_id, title, persona_id, continuity, access_policy, details_json from {_EVENT_SEEN} where access_policy <> 'hidden' and event_id not in (select claim_id from ({_EVENT_ISSUES}select claim_id from iss)) order by event_id"""
_TABLES = {
    "sources": "source_id source_key continuity created_at updated_at",
    "source_snapshots": "snapshot_id source_id version content_hash content media_type origin_path previous_snapshot_id line_count created_at",
    "evidence_refs": "evidence_id claim_id snapshot_id start_line end_line start_char end_char quote content_hash created_at",
    "legacy_records": "legacy_record_id original_table legacy_key payload_json migrated_entity_type migrated_entity_id migrated_at",
}


def _table_digest(name: str) -> str:
    row = " || ',' || ".join(f"coalesce(length(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in sorted(_TABLES[name].split()))
    return f"select '{name}' table_name, count(*) n, cast(cast(coalesce(sum(cast(('0x' || substr(sha256({row}), 1, 12)) as bigint)), 0) as hugeint) as varchar) digest from {name}"


_ASCII_CONTROL = r"[\x00-\x1f\x7f\x{80}-\x{9f}\x{61c}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]"



def _instant(c: str) -> str:
    return f"strftime(make_timestamp({_epoch(c)} * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


_OLDER = f"""with sp as (select ck, x.sk sk, x.start_line a, x.end_line z from (select {_key('claim_id')} ck, min({{'evidence_id': evidence_id, 'sk': {_key('snapshot_id')}, 'start_line': start_line, 'end_line': end_line}}) x from evidence_refs group by 1) where ck is not null),
oc as (select *, case status when 'PROPOSED' then 'PROPOSED' when 'DISPUTED' then 'DISPUTED' else 'AUTHORIZED' end st, case access_policy when 'agent_accessible' then 'agent_accessible' when 'human_only' then 'human_only' else 'hidden' end ap,
  coalesce({_instant('created_at')}, '2026-01-01T00:00:00Z') ca from {_CLAIMS})
"""

SQL: dict[str, str] = {
    "snapshots_listed": f"select snapshot_id, source_key, continuity, version from {_META} m join {_OWNERS} o using (source_id)",
    "snapshots_of_version": f"select snapshot_id, source_key, media_type from {_META} m join {_OWNERS} o using (source_id) where version = 2 and continuity = 'alder'",
    "claims_listed": f"""select claim_id, persona_id, continuity, {_epoch('created_at')} created from {_CLAIMS} where status = 'AUTHORIZED' and access_policy = 'agent_accessible'
and lower(claim_id) in (select {_key('claim_id')} from evidence_refs where {_key('snapshot_id')} in (select lower(snapshot_id) from source_snapshots where version > 1))""",
    "evidence_listed": f"""select * from (select distinct on (evidence_id) 'claim' kind, {_key('claim_id')} owner_key, {_key('snapshot_id')} snapshot_key, evidence_id, start_line, end_line from evidence_refs)
union all select * from (select distinct on (evidence_id) 'event', event_id, {_key('snapshot_id')}, evidence_id, start_line, end_line from {_EVENT_EVIDENCE})""",
    "events_listed": f"select event_id, persona_id, event_type, title, coalesce(vf, kf, {_epoch('created_at')}) \"first\" from {_EVENT_SEEN} where access_policy in ('agent_accessible', 'human_only')",
    "event_evidence_issues": _EVENT_ISSUES + "select code, claim_id event_id, evidence_id from iss",
    "legacy_listed": "select legacy_record_id, legacy_key, migrated_entity_id from legacy_records where original_table = 'claim_proposals'",
    "ledger_of_aggregate": _LEDGER_ROWS + "select \"sequence\", event_type, entry_id from lg where aggregate_id = '7'",
    "ledger_sizes": _LEDGER_ROWS + "select count(*) entries, cast(sum(octet_length(encode(payload_json))) as bigint) payload_bytes, max(octet_length(encode(payload_json))) largest_payload, 'LEDGER_PAYLOAD_LIMIT_EXCEEDED' problem from lg",
    "evidence_specs": f"select evidence_id, sk snapshot_id, start_line, end_line from (select distinct on (evidence_id) evidence_id, {_key('snapshot_id')} sk, start_line, end_line from evidence_refs) where sk is not null and start_line >= 1 and end_line >= start_line",
    "claim_material": f"""select claim_id, sha256('{{"aggregate":{{' || {_json_row(_CLAIM_FIELDS).replace("cast(to_json(status) as varchar)", "'\"PROPOSED\"'").replace("to_json(updated_at)", "to_json(created_at)")} || '}},"aggregate_type":"claim","material_version":2}}') aggregate_sha256 from {_CLAIMS}""",
    "event_material": f"""select event_id, sha256('{{"aggregate":{{' || {_json(["access_policy", "continuity", "created_at"])} || ',"details":' || details_json || ',' || {_json(["event_id", "event_type", "knowledge_from", "knowledge_to", "persona_id", "summary", "title", "valid_from", "valid_to"])} || '}},"aggregate_type":"narrative_event","material_version":2}}') aggregate_sha256 from {_EVENTS}""",
    "evidence_material": f"select evidence_id, sha256({_EVIDENCE_JSON}) digest from {_ONE_EACH}",
    "evidence_set_material": f"""select claim_id, count(*) n, sha256('{{"aggregate_type":"claim","evidence":[' || string_agg(b, ',' order by b) || '],"material_version":2}}') evidence_set_sha256 from (select claim_id, {_EVIDENCE_JSON} b from {_ONE_EACH} where claim_id is not null) group by 1""",
    "evidence_checkpoints": f"""with r as (select claim_id, evidence_id, {_EVIDENCE_JSON} b, row_number() over (partition by claim_id order by created_at nulls first, evidence_id) i from {_ONE_EACH} where claim_id is not null)
select x.claim_id, x.evidence_id, x.i "position", sha256('{{"aggregate_type":"claim","evidence":[' || string_agg(y.b, ',' order by y.b) || '],"material_version":2}}') evidence_set_sha256 from r x join r y on x.claim_id = y.claim_id and y.i <= x.i group by 1, 2, 3""",
    "material_payloads": f"select claim_id, case i when 1 then 'DIGEST' when 2 then 'VERSION' when 3 then 'INCOMPLETE' end problem from (select claim_id, (length(claim_id) + count(*)) % 5 i from {_ONE_EACH} where claim_id is not null group by 1) where i in (1, 2, 3)",
    "impact_endpoints": f"with {_ENDS} select * from pr2",
    "impact_between": _BETWEEN + "select * from rp",
    "impact_totals": _BETWEEN + "select source_id, count(*) affected, count(distinct aggregate_id) claims, cast(sum(n_candidates) as bigint) candidates, " + ", ".join(f"count(*) filter (outcome = '{o}') {o.lower()}" for o in _OUTCOMES) + ', case when count(*) > 10000 then \'AFFECTED_EVIDENCE_LIMIT_EXCEEDED\' when sum(n_candidates) > 50000 then \'IMPACT_REPORT_CANDIDATE_LIMIT_EXCEEDED\' end "limit" from rp group by 1',
    "project_findings": _FINDINGS + "select * from fi",
    "project_totals": _FINDINGS + "select count(*) filter (severity = 'error') errors, count(*) filter (severity = 'warning') warnings, count(*) filter (severity = 'error') = 0 is_valid from fi",
    "memory_pack": _PACK,
    "memory_pack_events": _PACK_EVENTS,
    "memory_pack_statistics": f"select (select count(*) from ({_PACK})) claims, (select count(*) from ({_PACK_EVENTS})) events, (select count(*) from (with {_SOUND} select * from bad where claim_id in (select claim_id from w))) excluded_with_diagnostics",
    "json_issues": "select cast(legacy_record_id as varchar) \"key\", case legacy_record_id % 6 when 1 then 'DUPLICATE_JSON_KEY' when 2 then 'NONFINITE_JSON_NUMBER' when 3 then 'INVALID_JSON' when 4 then 'UNSAFE_CONTROL' else 'JSON_NESTING_LIMIT' end code from legacy_records where payload_json is not null and legacy_record_id % 6 > 0",
    "table_columns": " union all ".join(f"select '{t}' table_name, name column_name, cast(i as bigint) \"position\" from (select unnest(c) name, generate_subscripts(c, 1) i from (select {cols!r}.split(' ') c))" for t, cols in ({**_TABLES, "claim_proposals": "claim_id persona_id continuity text subject predicate object_value valid_from valid_to knowledge_from knowledge_to access_policy confidence status proposed_by proposal_model rationale created_at updated_at"}).items()),
    "table_digests": " union all ".join(map(_table_digest, _TABLES)),
    "redacted_quotes": "select evidence_id, 'str' \"type\", length(q) length, sha256(q) sha256 from (select evidence_id, min(quote) q from evidence_refs group by 1) where q is not null",
    "metadata_problems": f"select doc_id, problem from (select doc_id, case when text is null or text = '' then 'REPORT_METADATA_INVALID' when octet_length(encode(text)) > 1024 then 'REPORT_METADATA_BYTES_LIMIT_EXCEEDED' when regexp_matches(text, '{_ASCII_CONTROL}') then 'REPORT_METADATA_CONTROL_CHARACTER' end problem from documents) where problem is not null",
    "long_fields": " union all ".join(f"select claim_id \"key\", '{f}' field, octet_length(encode({f})) bytes from {_CLAIMS} where octet_length(encode({f})) > {n}" for f, n in (("text", 120), ("rationale", 40), ("subject", 18), ("predicate", 8), ("object_value", 14), ("proposed_by", 10), ("proposal_model", 10))),
    "proposal_texts": f"select claim_id, case when length(text) % 3 = 0 or {_blank('text')} then concat_ws(' ', subject, predicate, object_value) else text end \"text\" from {_CLAIMS}",
    "legacy_status": "select case o_orderstatus when 'F' then 'AUTHORIZED' when 'O' then 'PROPOSED' else 'DISPUTED' end status, count(*) n from orders group by 1",
    "converted_claims": _OLDER + f"""select claim_id, persona_id, coalesce(case when length(text) % 2 = 0 and text <> '' then text end, concat_ws(' ', nullif(subject, ''), nullif(predicate, ''), nullif(object_value, ''))) "text", nullif(predicate, '') predicate,
  {_instant('valid_from')} valid_from, {_instant('valid_to')} valid_to, {_instant('knowledge_from')} knowledge_from, ap access_policy, round(least(1.0, greatest(0.0, coalesce(confidence * 1.25, 1.0))), 6) confidence, st status, 'migration' proposed_by, ca created_at, ca updated_at from oc""",
    "converted_decisions": _OLDER + "select 'dec_' || substr(sha256('migration' || chr(31) || claim_id), 1, 24) decision_id, claim_id, 'PROPOSED' from_status, st to_status, 'migration' reviewer, ca decided_at from oc where st <> 'PROPOSED'",
    "converted_evidence": _OLDER + f""", ls as (select snapshot_id, max(len({_lines('content')})) n from source_snapshots group by 1),
x as (select claim_id, ls.snapshot_id, coalesce(sp.a, 1) a, coalesce(sp.z, sp.a, 1) z, n from oc join sp on lower(claim_id) = sp.ck join ls on sp.sk = lower(ls.snapshot_id))
select 'evr_' || substr(sha256(claim_id || chr(31) || snapshot_id || chr(31) || a || chr(31) || z), 1, 24) evidence_id, claim_id, snapshot_id, a start_line, z end_line from x where a >= 1 and a <= z and z <= n""",
    "converted_events": """select cast(event_id as varchar) event_id, cast(user_id as varchar) persona_id, 'default' continuity, case event_type when 'error' then 'narrative' else event_type end event_type, 'event ' || event_id title,
  case event_id % 3 when 0 then props when 1 then '{"legacy_value":"no json"}' else '{}' end details_json, 'human_only' access_policy, '2026-01-01T00:00:00Z' created_at from events""",
    "missing_entries": f"""select row_number() over (order by coalesce({_epoch('created_at')}, -1099511627776), claim_id) - 1 n, 'led_' || substr(sha256('claim.proposed' || chr(31) || claim_id), 1, 24) entry_id, claim_id aggregate_id, '{{"persona_id":"' || persona_id || '"}}' payload_json from {_CLAIMS} where not length(persona_id) > 6""",
    "claim_shape_issues": f"""with c as (select claim_id, case when length(text) % 5 = 0 then ' ' else text end t, confidence + 0.25 f, persona_id, continuity from {_CLAIMS})
select 'TEXT_REQUIRED' code, claim_id "key" from c where t is null or trim(t) = '' union all select 'CONFIDENCE_RANGE', claim_id from c where not coalesce(f between 0 and 1, false) union all select 'PERSONA_REQUIRED', claim_id from c where coalesce(trim(persona_id), '') = '' union all select 'CONTINUITY_REQUIRED', claim_id from c where coalesce(trim(continuity), '') = ''""",
    "payload_claims": f"select claim_id, persona_id, subject, cast(null as varchar) \"text\", confidence, 'PROPOSED' status, 'model:any' proposed_by from {_CLAIMS}",
    "clock_steps_back": """with x as (select user_id, epoch_us(ts) us, event_id + case when event_id % 7 = 0 then -40 else 0 end seq from events), y as (select *, lag(seq) over (partition by user_id order by us, seq) was from x)
select user_id, seq from y where was >= seq""",
    "opening_problems": """with g as (select user_id, count(*) filter (event_type = 'signup') n, min(event_id) filter (event_type = 'signup') a, min(event_id) filter (event_type is distinct from 'signup') r from events group by 1)
select user_id, case when n = 0 then 'OPENING_MISSING' when n > 1 then 'OPENING_REPEATED' else 'OPENING_LATE' end problem from g where n <> 1 or r < a""",
    "beyond_scope": f"with c as (select * from {_CLAIMS}) select distinct persona_id, continuity, predicate from c where status <> 'AUTHORIZED' and not exists (select 1 from c o where o.status = 'AUTHORIZED' and o.persona_id = c.persona_id and o.continuity = c.continuity and o.predicate = c.predicate)",
    "over_ceilings": "with t as (" + " union all ".join(f"select '{t}' table_name, count(*) n from {t}" for t in ("sources", "source_snapshots", "claim_proposals", "evidence_refs", "legacy_records")) + ") select * from t where n > 500 union all select '', cast(sum(n) as bigint) from t having sum(n) > 2000",
}
