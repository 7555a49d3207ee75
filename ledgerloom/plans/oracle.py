"""The SQL each query is compared with, for an engine that reads the same tables as views."""

from __future__ import annotations

_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}]"
_EOL = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _key(c: str) -> str:
    return f"nullif(lower({_strip(c)}), '')"


def _epoch(c: str) -> str:
    x = _strip(c)
    x = rf"regexp_replace({x}, '^(\d{{4}})(\d{{2}})(\d{{2}})(T|$)', '\1-\2-\3\4')"
    x = rf"regexp_replace({x}, 'T(\d{{2}})(\d{{2}})(\d{{2}})(Z|$|[+-])', 'T\1:\2:\3\4')"
    zoned = rf"regexp_matches({x}, '(Z|[+-]\d{{2}}:?\d{{2}})$') and not regexp_matches({x}, '^\d{{4}}-\d{{2}}-\d{{2}}$')"
    return f"cast(floor(case when {zoned} then epoch(try_cast({x} as timestamptz)) else epoch(try_cast({x} as timestamp)) end) as bigint)"


def _iso(c: str) -> str:
    return f"strftime(make_timestamp({c} * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


def _lines(c: str) -> str:
    parts = f"regexp_split_to_array({c}, '{_EOL}')"
    return f"(case when {parts}[-1] = '' then {parts}[:-2] else {parts} end)"


def _lf(c: str) -> str:
    return rf"regexp_replace({c}, '\r\n?', chr(10), 'g')"


def _digest(c: str) -> str:
    d = f"regexp_replace(lower(trim({c})), '^sha256:', '')"
    return f"(case when regexp_matches({d}, '^[0-9a-f]{{64}}$') then {d} end)"


_CLAIMS = f"""(select distinct on (claim_id) * from claim_proposals order by claim_id, {_epoch('updated_at')} desc nulls last, status desc nulls last, access_policy desc nulls last, confidence desc nulls last,
  rationale desc nulls last, valid_from desc nulls last, valid_to desc nulls last, knowledge_from desc nulls last, knowledge_to desc nulls last)"""
_SNAPS = "(select snapshot_id, max(source_id) source_id, max(version) as version, max(content) as content, max(line_count) line_count, max(content_hash) content_hash, max(origin_path) origin_path from source_snapshots group by 1)"
_VISIBLE = f"""select * from (select *, {_epoch('knowledge_from')} kf, {_epoch('knowledge_to')} kt, {_epoch('valid_from')} vf, {_epoch('valid_to')} vt
  from {_CLAIMS} where status = 'AUTHORIZED' and access_policy <> 'hidden')"""
_KNOWN = "(kf is null or kf <= 1735689600) and (kt is null or 1735689600 < kt)"
_VALID = "(vf is null or vf <= 1719792000) and (vt is null or 1719792000 < vt)"

_SNAP = f"select snapshot_id, min(source_id) source_id, min(version) as version, min({_key('previous_snapshot_id')}) prev, min({_epoch('created_at')}) born from source_snapshots group by 1"
_EV = f"select distinct on (evidence_id) *, {_key('claim_id')} ck, {_key('snapshot_id')} sk from evidence_refs"

_EVIDENCE_ISSUES = f"""
with e as ({_EV}),
s as (select lower(snapshot_id) sk, source_id, content, line_count from {_SNAPS}),
o as (select distinct on (source_id) source_id, continuity sc from sources),
c as (select distinct on (claim_id) lower(claim_id) ck, claim_id cid, continuity from claim_proposals),
j as (select e.evidence_id, c.cid, c.continuity, e.start_line a, e.end_line z, {_lf('e.quote')} q, e.content_hash h, {_digest('e.content_hash')} dg, e.sk ekey, s.sk there, s.content, s.line_count, o.sc,
        case when s.content is not null then {_lines('s.content')} end ln
      from e join c on e.ck = c.ck left join s on e.sk = s.sk left join o on s.source_id = o.source_id),
k as (select *, len(ln) n, (a >= 1 and z >= a) possible, case when a >= 1 and z >= a and z <= len(ln) then array_to_string(ln[a:z], chr(10)) end x from j),
r as (select cid, evidence_id, case
  when ekey is null then ['SNAPSHOT_ID_REQUIRED'] when a is null or z is null then ['INVALID_LINE_RANGE']
  when there is null then ['SNAPSHOT_NOT_FOUND'] when content is null then ['SNAPSHOT_CONTENT_MISSING']
  else list_filter([
    case when sc is null or trim(sc) = '' then 'SNAPSHOT_CONTINUITY_MISSING' end,
    case when trim(sc) <> '' and trim(continuity) <> '' and sc <> continuity then 'CONTINUITY_MISMATCH' end,
    case when line_count <> n then 'SNAPSHOT_LINE_COUNT_MISMATCH' end,
    case when not possible then 'INVALID_LINE_RANGE' end,
    case when possible and z > n then 'LINE_RANGE_OUT_OF_BOUNDS' end,
    case when q <> x then 'QUOTE_MISMATCH' end,
    case when x is not null and h is not null and dg is null then 'INVALID_CONTENT_HASH' end,
    case when dg <> sha256(x) then 'CONTENT_HASH_MISMATCH' end], lambda t: t is not null) end codes from k),
iss as (select unnest(codes) as code, cid as claim_id, evidence_id from r
  union all select 'CLAIM_CONTINUITY_MISSING', cid, null from c where continuity is null or trim(continuity) = ''
  union all select 'EVIDENCE_REQUIRED', cid, null from c where ck not in (select ck from e where ck is not null))
"""

_PAIRS = f"""
a as (select claim_id, persona_id p, continuity c, subject s, predicate r, object_value o, status, coalesce({_epoch('created_at')}, -4611686018427387904) t0, {_epoch('valid_from')} f, {_epoch('valid_to')} t
  from {_CLAIMS} where subject <> '' and predicate <> '' and object_value is not null),
pr as (select l.claim_id, m.claim_id other_id, l.status st, m.status st2, (l.t0, l.claim_id) < (m.t0, m.claim_id) early from a l join a m on l.p = m.p and l.c = m.c and l.s = m.s and l.r = m.r and l.o <> m.o
  where (l.f is null or m.t is null or l.f < m.t) and (m.f is null or l.t is null or m.f < l.t))
"""

_LINEAGE = f"""
sn as ({_SNAP}),
lb as (select sn.*, b.was from sn left join (select source_id, version + 1 as version, list(lower(snapshot_id)) was from sn group by 1, 2) b using (source_id, version)),
li as (select 'SNAPSHOT_VERSION_GAP' code, snapshot_id from lb where version > 1 and was is null
  union all select 'SNAPSHOT_CHAIN_BROKEN', snapshot_id from lb where not (case when version = 1 then prev is null else coalesce(list_contains(was, prev), false) end))
"""

_LOG = "select user_id claim, event_id seq, event_type to_status, case event_id % 3 when 0 then 'view' when 1 then 'click' else 'error' end from_status, value from events"


def _entry(previous: str, sequence: str = '"sequence"') -> str:
    part = lambda name, value: f"""'"{name}":"' || {value} || '"'"""
    strings = {"aggregate_id": "aggregate_id", "aggregate_type": "'user'", "created_at": "'2024-01-01T00:00:00Z'", "entry_id": "entry_id", "event_type": "event_type", "payload_json": """replace(payload_json, '"', chr(92) || '"')""", "previous_hash": previous}
    return "'{' || " + " || ',' || ".join(part(n, v) for n, v in strings.items()) + f""" || ',"sequence":' || {sequence} || '}}'"""


_LEDGER_ROWS = f"""with recursive ev as materialized (select event_id + 1 as "sequence", 'e' || event_id entry_id, event_type, cast(user_id as varchar) aggregate_id, props payload_json from events),
ch("sequence", h, prev) as (select 0::bigint, repeat('0', 64), '' union all select ev."sequence", sha256({_entry('ch.h', 'ev."sequence"')}), ch.h from ch join ev on ev."sequence" = ch."sequence" + 1),
lg as (select ev."sequence", entry_id, event_type, 'user' aggregate_type, aggregate_id, case when ev."sequence" % 89 = 0 then payload_json || ' ' else payload_json end payload_json,
  case when ev."sequence" % 97 = 0 then repeat('f', 64) else ch.prev end previous_hash, ch.h entry_hash from ev join ch on ev."sequence" = ch."sequence" where ev."sequence" % 101 <> 0)
"""

_ANCHOR = f"""select distinct on (evidence_id) evidence_id, {_key('snapshot_id')} sk, start_line a, end_line z, {_lf('quote')} q, content_hash h, {_digest('content_hash')} dg from evidence_refs"""
_ERROR = """case when sk is null then 'SNAPSHOT_ID_REQUIRED' when a is null or z is null or a < 1 or z < a then 'INVALID_LINE_RANGE' when q is null then 'QUOTE_REQUIRED'
  when len(string_split(q, chr(10))) <> z - a + 1 then 'QUOTE_SPAN_MISMATCH' when h is not null and dg is null then 'INVALID_CONTENT_HASH' when dg <> sha256(q) then 'CONTENT_HASH_MISMATCH' end"""
_IMPACT = f"""
with an as (select *, {_ERROR} err from ({_ANCHOR})),
nw as (select source_id, max((version, snapshot_id)) x from source_snapshots group by 1),
tg as (select distinct lower(s.snapshot_id) sk, nw.x[2] target_id from source_snapshots s join nw using (source_id)),
ask as (select an.*, tg.target_id, string_split(q, chr(10)) ql from an join tg on an.sk = tg.sk),
tl as (select distinct on (snapshot_id) snapshot_id target_id, {_lines('content')} ln from source_snapshots where snapshot_id in (select target_id from tg)),
pos as (select target_id, unnest(ln) l1, generate_subscripts(ln, 1) i from tl),
hit as (select ask.evidence_id, list(pos.i order by pos.i) c from ask join pos on ask.target_id = pos.target_id and ask.ql[1] = pos.l1 join tl on tl.target_id = pos.target_id
  where ask.err is null and pos.i + len(ask.ql) - 1 <= len(tl.ln) and tl.ln[pos.i : pos.i + len(ask.ql) - 1] = ask.ql group by 1),
rep as (select ask.evidence_id, ask.target_id, case when err is not null then 'INVALID_EVIDENCE' when list_contains(c, a) then 'SAME_POSITION' when len(c) = 1 then 'EXACT_MOVED_UNIQUE' when len(c) > 1 then 'EXACT_MOVED_AMBIGUOUS' else 'NO_EXACT_MATCH' end outcome,
  coalesce(len(c), 0) n_candidates, coalesce(array_to_string(c, ','), '') candidates from ask left join hit using (evidence_id))
"""

_P2_FOUND = f"""
with recursive sn as ({_SNAP}), par as (select a.snapshot_id id, b.snapshot_id p from sn a left join sn b on a.prev = lower(b.snapshot_id)),
down(id, root, d) as (select id, id, 0 from par where p is null union all select par.id, down.root, d + 1 from down join par on par.p = down.id),
lost as (select id, p from par where id not in (select id from down)),
walk(id, anc) as (select id, p from lost union select walk.id, lost.p from walk join lost on walk.anc = lost.id),
ring as (select id from walk where id = anc),
low as (select walk.id, min(walk.anc) root from walk join ring on walk.anc = ring.id group by 1)
"""

_DOWN = _P2_FOUND.replace("down(id, root, d) as (select id, id, 0 from par where p is null union all select par.id, down.root, d + 1 from", "down(id, root, d, path) as (select id, id, 0, [id] from par where p is null union all select par.id, down.root, d + 1, list_append(down.path, par.id) from")

_DIGESTED = ["access_policy", "claim_id", "confidence", "continuity", "object_value", "persona_id", "predicate", "subject", "text"]


def _json_row(fields: list[str]) -> str:
    part = lambda f: f"cast({f} as varchar)" if f == "confidence" else f"cast(to_json({f}) as varchar)"
    return " || ',' || ".join(f"'\"{f}\":' || coalesce({part(f)}, 'null')" for f in fields)


_P5 = f"""
with st as (select 'source_snapshots' t, lower(snapshot_id) k, min({_epoch('created_at')}) born from source_snapshots group by 1, 2
  union all select 'claim_proposals', lower(claim_id), min({_epoch('created_at')}) from claim_proposals group by 1, 2),
gone as (select distinct original_table t, {_key('legacy_key')} k from legacy_records),
ev as (select evidence_id, min({_epoch('created_at')}) born, min({_key('snapshot_id')}) sk, min({_key('claim_id')}) ck from evidence_refs group by 1),
rf as (select 'evidence_refs.snapshot_id' ref_field, evidence_id row_key, born, 'source_snapshots' t, sk k from ev
  union all select 'evidence_refs.claim_id', evidence_id, born, 'claim_proposals', ck from ev
  union all select 'source_snapshots.previous_snapshot_id', snapshot_id, born, 'source_snapshots', prev from ({_SNAP})),
fd as (select ref_field, row_key, case when st.k is not null then case when st.born > rf.born then 'late' end when gone.k is not null then 'deleted' else 'missing' end kind, strftime(make_timestamp(rf.born * 1000000), '%Y-%m') period
  from rf left join st on rf.t = st.t and rf.k = st.k left join gone on rf.t = gone.t and rf.k = gone.k where rf.k is not null)
"""

_FIELDS = ("item", "holder", "place", "count", "note")
_CELLS = r"regexp_split_to_array(replace(regexp_replace(regexp_replace(trim(l), '^[|]', ''), '[|]$', ''), chr(92) || '|', chr(1)), '[|]')"
_P3 = f"""
with s as (select snapshot_id id, min({_key('previous_snapshot_id')}) prev, min(lower(coalesce(media_type, ''))) media, min(coalesce(content, '')) content from source_snapshots where source_id in (select source_id from sources where source_key like 'register/%') group by 1),
k as (select *, media not like '%json%' or json_valid(content) ok from s),
pr as (select a.id pair, b.id old from k a join k b on a.prev = lower(b.id) where a.ok and b.ok),
js as (select id, unnest(cast(case when json_type(content) = 'ARRAY' then json(content) else json_extract(content, '$.entries') end as json[])) e from k where media like '%json%' and ok),
ln as (select id, unnest(x) l, generate_subscripts(x, 1) no from (select id, {_lines('content')} x from k where media not like '%json%')),
ce as (select id, no, list_transform({_CELLS}, lambda x: trim(replace(x, chr(1), '|'))) c from ln where l like '%|%'),
hd as (select id, arg_min(list_transform(c, lambda x: lower(x)), no) h, min(no) head_no from ce where list_contains(list_transform(c, lambda x: lower(x)), 'entry') group by 1),
md as (select ce.id, no, {', '.join(f"coalesce(c[list_position(h, '{f}')], '') f_{f}" for f in ('entry', *_FIELDS))} from ce join hd using (id) where no > head_no and len(list_filter(c, lambda x: not regexp_matches(x, '^:?-+:?$'))) > 0),
al as (select id, row_number() over () no, {', '.join(f"trim(coalesce(e->>'{f}', '')) f_{f}" for f in ('entry', *_FIELDS))} from js union all select * from md),
en as (select distinct on (id, f_entry) id, f_entry entry, [{', '.join(f'f_{f}' for f in _FIELDS)}] v from al where f_entry <> '' order by id, f_entry, no),
n as (select pair, entry, v from pr join en on en.id = pair), o as (select pair, entry, v from pr join en on en.id = old)
select coalesce(n.pair, o.pair) snapshot_id, coalesce(n.entry, o.entry) entry, case when o.pair is null then 'added' when n.pair is null then 'removed' else 'changed' end change from n full join o on n.pair = o.pair and n.entry = o.entry where n.v is distinct from o.v
"""


def _blank(c: str) -> str:
    return f"({c} is null or {_strip(c)} = '')"


def _axis(name: str, lo: str, hi: str) -> str:
    return f"""select persona_id, continuity, subject, predicate, '{name}' axis, case when {_blank(lo)} then -4611686018427387904 else {_epoch(lo)} end s, case when {_blank(hi)} then 4611686018427387904 else {_epoch(hi)} end e
  from claim_proposals where subject is not null and predicate is not null"""


_P6 = f"""
with iv as (select distinct * from ({_axis('valid', 'valid_from', 'valid_to')} union all {_axis('knowledge', 'knowledge_from', 'knowledge_to')}) where s < e),
w as (select *, max(e) over (partition by persona_id, continuity, subject, predicate, axis order by s, e rows between unbounded preceding and 1 preceding) pe from iv)
"""

SQL: dict[str, str] = {
    "p2_found": _P2_FOUND + "select id snapshot_id, root root_snapshot_id, cast(d as bigint) depth from down union all select low.id, low.root, cast(case when low.id in (select id from ring) then -1 else -2 end as bigint) from low",
    "p2_paths": _DOWN + "select id snapshot_id, root root_id, cast(d as bigint) depth, array_to_string(path, '/') path from down union all select low.id, low.root, cast(case when low.id in (select id from ring) then -1 else -2 end as bigint), null from low",
    "p2_sizes": _DOWN
    + """, n as (select anc, count(*) n from (select unnest(path) anc from down) group by 1)
select down.id snapshot_id, root root_id, cast(d as bigint) depth, n - 1 n_descendants, n n_subtree from down join n on anc = down.id union all select low.id, low.root, cast(case when low.id in (select id from ring) then -1 else -2 end as bigint), null, null from low""",
    "p3_found": _P3,
    "p2_descendants": _DOWN + "select path[i] ancestor_id, id descendant_id, cast(d + 1 - i as bigint) distance from (select id, d, path, unnest(range(1, d + 1)) i from down)",
    "p5_found": _P5 + "select * from fd where kind is not null",
    "p5_report": _P5 + "select ref_field, period, kind, count(*) n from fd where kind is not null group by all",
    "p6_found": _P6 + f"select persona_id, continuity, subject, predicate, axis, {_iso('pe')} gap_from, {_iso('s')} gap_to from w where s > pe",
    "p6_periods": _P6
    + f""", lab as (select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by persona_id, continuity, subject, predicate, axis order by s, e rows between unbounded preceding and current row) no from w),
per as (select persona_id, continuity, subject, predicate, axis, cast(no as bigint) period_no, min(s) a, max(e) z from lab group by all)
select persona_id, continuity, subject, predicate, axis, period_no, case when a > -4611686018427387904 then {_iso('a')} end period_from, case when z < 4611686018427387904 then {_iso('z')} end period_to from per""",
    "pack_asof_claims": f"select claim_id, persona_id, continuity, access_policy, {_iso('kf')} known_from, {_iso('vf')} valid_since from ({_VISIBLE}) where {_KNOWN} and {_VALID} order by coalesce(kf, -4611686018427387904), coalesce(vf, -4611686018427387904), claim_id",
    "pack_asof_known_only": f"select persona_id, count(*) claims, max(confidence) best from ({_VISIBLE}) where access_policy = 'agent_accessible' and {_KNOWN} group by 1",
    "pack_batch_cutoffs": f"with t as (select 1704067200 + i * 2592000 cutoff from range(24) r(i)) select persona_id, cast(cutoff as bigint) cutoff, count(*) claims from ({_VISIBLE}) v, t where (kf is null or kf <= cutoff) and (kt is null or cutoff < kt) group by all",
    "pack_provenance": f"""with c as (select lower(claim_id) ck, claim_id from ({_VISIBLE}) where {_KNOWN} and {_VALID}), e as ({_EV}),
s as (select distinct on (snapshot_id) lower(snapshot_id) sk, source_id, version from source_snapshots), o as (select distinct on (source_id) source_id, source_key from sources)
select c.claim_id, string_agg(concat_ws(':', source_key, version, start_line, end_line), ';' order by e.sk, start_line, end_line, evidence_id) provenance, count(*) n from c join e on c.ck = e.ck join s on e.sk = s.sk join o using (source_id) group by 1""",
    "claims_page": f"select claim_id, persona_id, created from (select claim_id, persona_id, {_epoch('created_at')} created from {_CLAIMS} where status = 'PROPOSED') order by created nulls first, claim_id limit 25 offset 50",
    "claims_with_evidence": f"select distinct claim_id, persona_id from claim_proposals c where exists (select 1 from ({_EV}) e join source_snapshots s on e.sk = lower(s.snapshot_id) where s.version = 1 and e.ck = lower(c.claim_id))",
    "scope_semi_orders": "select o_orderpriority, count(*) n from orders where o_orderkey in (select l_orderkey from lineitem group by 1 having sum(l_quantity) > 150) group by 1",
    "source_listing": "select source_key, continuity, coalesce(snapshots, 0) snapshots, newest from (select distinct source_id, source_key, continuity from sources) left join (select source_id, count(distinct snapshot_id) snapshots, max(version) newest from source_snapshots group by 1) using (source_id)",
    "ambiguous_source_keys": "select source_key, count(distinct continuity) continuities from sources group by 1 having count(distinct continuity) > 1",
    "lineage_interval": "select distinct snapshot_id, source_id, version, media_type from source_snapshots where version between 2 and 4",
    "revision_chain": """with h as (select source, coalesce(lang, 'none') lang, doc_id, sha256(coalesce(text, '')) content_hash from documents),
k as (select *, lag(content_hash) over (partition by source, lang order by doc_id) was from h)
select source, lang, doc_id, content_hash, row_number() over w as version, lag(doc_id) over w previous_id from k where was is null or was <> content_hash window w as (partition by source, lang order by doc_id)""",
    "revision_latest": "select source_id, x[2] snapshot_id, x[1] as version from (select source_id, max((version, snapshot_id)) x from source_snapshots where version is not null and source_id is not null group by 1)",
    "lineage_breaks": f"with {_LINEAGE} select * from li",
    "source_line_counts": f"select snapshot_id, len({_lines('content')}) \"lines\", line_count is not null and line_count <> len({_lines('content')}) wrong from {_SNAPS}",
    "document_lines": f"select sha256(l) line_digest, count(*) n from (select unnest({_lines('text')}) l from documents where text is not null) group by 1",
    "ingest_issues": f"""with x as (select doc_id, text, {_lines('text')} ln from documents where text is not null),
u as (select doc_id, length(regexp_extract(text, '^([^\\x00\\x1b\\x{{9b}}\\x{{61c}}\\x{{200e}}\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2066}}-\\x{{2069}}]*)', 1)) n, length(text) m from x)
select doc_id, 'FILE_BYTES' code, null::bigint "at" from x where octet_length(encode(text)) > 20000 union all select doc_id, 'LINES', len(ln) from x where len(ln) > 150
union all select doc_id, 'LINE_BYTES', null from x where len(list_filter(ln, lambda t: octet_length(encode(t)) > 2000)) > 0 union all select doc_id, 'UNSAFE_CONTROL', n from u where n < m""",
    "built_evidence": f"""with e as ({_EV}), s as (select distinct on (snapshot_id) lower(snapshot_id) sk, {_lines('content')} ln from source_snapshots),
q as (select evidence_id, array_to_string(ln[start_line:end_line], chr(10)) x from e join s on e.sk = s.sk where start_line >= 1 and end_line >= start_line and end_line <= len(ln))
select evidence_id, sha256(x) content_hash, length(x) chars from q""",
    "evidence_issues": _EVIDENCE_ISSUES + "select * from iss",
    "evidence_issue_counts": _EVIDENCE_ISSUES + "select code, count(*) n, count(distinct claim_id) claims from iss group by 1",
    "contradiction_pairs": f"with {_PAIRS} select claim_id, other_id from pr where early",
    "proposal_conflicts": f"with {_PAIRS} select claim_id, other_id from pr where st = 'PROPOSED' and st2 = 'AUTHORIZED'",
    "claim_field_issues": f"""with c as (select * from {_CLAIMS})
select 'CONFIDENCE_RANGE' code, claim_id "key" from c where confidence < 0 or confidence > 1 union all select 'TEXT_BYTES', claim_id from c where octet_length(encode(text)) > 200
union all select 'SUBJECT_MISSING', claim_id from c where subject is null union all select 'PREDICATE_MISSING', claim_id from c where predicate is null union all select 'RATIONALE_MISSING', claim_id from c where rationale is null and status = 'REJECTED'""",
    "claim_digests": f"select claim_id, sha256('{{' || {_json_row(_DIGESTED)} || '}}') digest from {_CLAIMS}",
    "evidence_set_digests": f"""with r as (select distinct {_key('claim_id')} claim_key, evidence_id, start_line, end_line from evidence_refs where {_key('claim_id')} is not null),
x as (select claim_key, sha256('{{"end_line":' || coalesce(cast(end_line as varchar), 'null') || ',"evidence_id":"' || evidence_id || '","start_line":' || coalesce(cast(start_line as varchar), 'null') || '}}') d from r)
select claim_key, count(*) n, sha256(string_agg(d, chr(10) order by d)) digest from x group by 1""",
    "foreign_keys": f"""select 'EVIDENCE_CLAIM' code, evidence_id "key" from (select distinct evidence_id, {_key('claim_id')} r from evidence_refs) where r is not null and r not in (select lower(claim_id) from claim_proposals)
union all select 'EVIDENCE_SNAPSHOT', evidence_id from (select distinct evidence_id, {_key('snapshot_id')} r from evidence_refs) where r is not null and r not in (select lower(snapshot_id) from source_snapshots)
union all select 'SNAPSHOT_SOURCE', snapshot_id from (select distinct snapshot_id, source_id r from source_snapshots) where r is not null and r not in (select source_id from sources)""",
    "quarantine": f"""with s as (select * from {_SNAPS}), b as (select 'HASH' code, snapshot_id "key" from s where {_digest('content_hash')} is null union all select 'ORIGIN', snapshot_id from s where origin_path is null)
select * from b union all select distinct 'DEPENDENT', evidence_id from ({_EV}) where sk in (select lower("key") from b)""",
    "alias_map": """select o_orderkey, case upper(substr(o_orderpriority, 3)) when 'LOW' then 'agent_accessible' when 'NOT SPECIFIED' then 'hidden' when 'HIGH' then 'human_only' when '' then 'agent_accessible' else 'hidden' end access_policy,
round(greatest(0.0, least(1.0, case when o_orderkey % 7 <> 0 then o_totalprice / 300000 else 1.0 end)), 3) confidence from orders""",
    "state_chain": f"select claim, count(*) steps, count(*) filter (from_status is distinct from was) broken from (select *, coalesce(lag(to_status) over (partition by claim order by seq), 'view') was from ({_LOG})) group by 1",
    "final_states": f"select claim, arg_max(to_status, seq) state, count(*) steps from ({_LOG}) group by 1",
    "state_in_force": f"""select claim, coalesce(x, 'none') in_force, count(*) n from (select claim, last_value(case when to_status in ('purchase', 'signup') then to_status end ignore nulls) over (partition by claim order by seq rows between unbounded preceding and 1 preceding) x from ({_LOG})) group by all""",
    "last_valid_value": f"""with recursive l as (select *, row_number() over (partition by claim order by seq) i from ({_LOG})),
f(claim, i, state, v) as (select distinct claim, 0::bigint, 'view', null::double from l
  union all select l.claim, l.i, case when l.from_status = f.state then l.to_status else f.state end, case when l.from_status = f.state then l.value else f.v end from f join l on l.claim = f.claim and l.i = f.i + 1)
select claim, arg_max(state, i) state, arg_max({{'v': v}}, i).v as "value" from f group by 1""",
    "log_reconcile": """with l as (select event_id, event_type, user_id from events where event_id % 11 <> 0),
r0 as (select event_id, case when event_id % 17 = 0 then 'other' else event_type end event_type, user_id from events where event_id % 13 <> 0), r as (select * from r0 union all select * from r0 where event_id % 19 = 0),
a as (select event_id, count(*) n, min(event_type) t, min(user_id) u from l group by 1), b as (select event_id, count(*) n, min(event_type) t, min(user_id) u from r group by 1)
select * from (select coalesce(a.event_id, b.event_id) event_id, case when b.n is null then 'MISSING_RIGHT' when a.n is null then 'MISSING_LEFT' when a.n > 1 or b.n > 1 then 'DUPLICATE' when (a.t, a.u) <> (b.t, b.u) then 'DIFFERENT' end verdict from a full join b on a.event_id = b.event_id) where verdict is not null""",
    "set_difference": f"""with s as (select distinct lower(snapshot_id) sk, source_id, version from source_snapshots where version is not null and source_id is not null), m as (select source_id, min(version) lo, max(version) hi from s group by 1),
c as (select distinct {_key('claim_id')} claim_key, {_key('snapshot_id')} sk from evidence_refs), j as (select source_id, claim_key, bool_or(version = lo) l, bool_or(version = hi) r from c join s using (sk) join m using (source_id) where claim_key is not null group by 1, 2)
select source_id, claim_key, case when l then 'left' else 'right' end only_in from j where l <> r""",
    "ledger_links": _LEDGER_ROWS
    + f""", j as (select lg.*, b.entry_hash was, sha256({_entry('lg.previous_hash')}) dg from lg left join (select "sequence" + 1 nx, entry_hash from lg) b on lg."sequence" = b.nx)
select "sequence", 'SEQUENCE_GAP' code from j where "sequence" > 1 and was is null union all select "sequence", 'LINK_MISMATCH' from j where previous_hash is distinct from case when "sequence" = 1 then repeat('0', 64) else was end and ("sequence" = 1 or was is not null)
union all select "sequence", 'DIGEST_MISMATCH' from j where dg <> entry_hash""",
    "ledger_digests": _LEDGER_ROWS + f"select \"sequence\", sha256({_entry('previous_hash')}) digest from lg",
    "ledger_bounds": _LEDGER_ROWS + "select count(*) entries, cast(sum(octet_length(encode(payload_json))) as bigint) payload_bytes, max(octet_length(encode(payload_json))) largest_payload from lg",
    "ledger_incremental": _LEDGER_ROWS + "select \"sequence\", event_type, aggregate_id from lg where \"sequence\" > 500 and event_type in ('purchase', 'signup') order by \"sequence\"",
    "event_gaps": "select event_id, epoch_us(ts) - lag(epoch_us(ts)) over (order by event_id) gap from events",
    "impact_report": _IMPACT + "select * from rep",
    "impact_summary": _IMPACT + "select " + ", ".join(f"count(*) filter (outcome = '{o}') {o.lower()}" for o in ("SAME_POSITION", "EXACT_MOVED_UNIQUE", "EXACT_MOVED_AMBIGUOUS", "NO_EXACT_MATCH", "INVALID_EVIDENCE")) + " from rep",
    "anchor_errors": f"select evidence_id, err error from (select *, {_ERROR} err from ({_ANCHOR})) where err is not null",
    "table_counts": " union all ".join(f"select '{t}' table_name, count(*) n from {t}" for t in ("sources", "source_snapshots", "claim_proposals", "evidence_refs", "legacy_records")),
    "scalar_bundle": "select count(*) entries, count(distinct evidence_id) ids, cast(sum(octet_length(encode(coalesce(quote, '')))) as bigint) quote_bytes, max(octet_length(encode(coalesce(quote, '')))) largest, count(*) filter (content_hash is null) no_hash from evidence_refs",
    "provenance_union": f"select case when ck like 'clm!_%' escape '!' then 'claim' else 'event' end kind, evidence_id, ck \"owner\", sk snapshot_key from (select distinct evidence_id, {_key('claim_id')} ck, {_key('snapshot_id')} sk from evidence_refs) where ck like 'clm!_%' escape '!' or ck like 'evt!_%' escape '!'",
    "project_issues": _EVIDENCE_ISSUES
    + f""", {_PAIRS}, {_LINEAGE}, st as (select claim_id, status from {_CLAIMS})
select code, severity, kind, id from (
select distinct code, case when status = 'AUTHORIZED' then 'error' else 'warning' end severity, 'claim' kind, claim_id id from iss join st using (claim_id) where status <> 'REJECTED'
union all select code, 'error', 'snapshot', snapshot_id from li
union all select 'SNAPSHOT_HASH_MISMATCH', 'error', 'snapshot', snapshot_id from {_SNAPS} where sha256(content) <> regexp_replace(lower(trim(content_hash)), '^sha256:', '')
union all select 'AUTHORIZED_CLAIM_CONTRADICTION', 'error', 'claim', claim_id from pr where early and st = 'AUTHORIZED' and st2 = 'AUTHORIZED')""",
}
