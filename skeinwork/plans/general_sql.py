"""SQL statements of the general data problems, for a second engine to check results by."""

_HEX = "lower(regexp_replace(id, '[^0-9a-fA-F]', '', 'g'))"
_RANKED = f"""
with m as (
  select *, case when length({_HEX}) = 32 and event is not null then {_HEX} end as k from usage_events),
r as (
  select *, row_number() over (partition by k, event order by coll_s nulls last, coll_ns nulls last, delivery_id) as n from m)
"""

_REFS = """
refs as (
  select 'raw_edges' as ref_table, edge_id as ref_id, 'source' as field, source as path, seen_at as at from raw_edges
  union all select 'raw_edges', edge_id, 'target', target, seen_at from raw_edges
  union all select 'findings', finding_id, 'subject', subject, found_at from findings
  union all select 'findings', finding_id, 'target', target, found_at from findings),
real as (
  select * from refs where path is not null and path <> '' and position('://' in path) = 0
    and not regexp_matches(lower(path), '^(mailto|tel|data|urn|javascript):')),
orphan as (
  select * from real r where not exists (
    select 1 from nodes n where n.path = r.path and (r.at is null or (
      n.first_seen <= r.at and (n.deleted_at is null or r.at < n.deleted_at))))),
firsts as (select path, min(first_seen) as f from nodes group by path)
"""
_ORPHANS = f"""with {_REFS}
select ref_table, ref_id, field,
  case when f.path is null then 'missing' when f.f > o.at then 'late' else 'deleted' end as reason,
  strftime(o.at, '%Y-%m') as period
from orphan o left join firsts f on f.path = o.path"""

def _unwrapped(x: str) -> str:
    """A JSON value, a string that holds an array or object read as that."""
    text = f"({x} ->> '$')"
    return (
        f"case when json_type({x}) = 'VARCHAR' and regexp_matches({text}, '^[ \\t\\n\\r]*[\\[{{]') and json_valid({text}) "
        f"then {text}::json else {x} end"
    )


def _key(x: str, key: str) -> str:
    return f"case when json_type({x}) = 'OBJECT' then json_extract({x}, '$.\"{key}\"') end"


def _listed(x: str) -> str:
    """A collection as a list of JSON values."""
    return (
        f"case when {x} is null or json_type({x}) = 'NULL' then []::json[] when json_type({x}) = 'ARRAY' "
        f"then json_extract({x}, '$[*]') else [{x}] end"
    )


def _walk(name: str, start: str, keys: tuple[str, ...], also: str = "") -> str:
    """Steps from ``v`` of table ``start`` down the keys, as tables; the last is ``name`` with a list ``xs``."""
    steps, before = [], start
    for i, key in enumerate(keys):
        steps.append(f"{name}_a{i} as (select {also}delivery_id, {_key('v', key)} as v from {before})")
        steps.append(f"{name}_b{i} as (select {also}delivery_id, {_unwrapped('v')} as v from {name}_a{i})")
        before = f"{name}_b{i}"
    steps.append(f"{name} as (select {also}delivery_id, {_listed('v')} as xs from {before})")
    return ",\n".join(steps)


_CHILDREN = f"""
with top as (select delivery_id, payload::json as v from usage_events where json_valid(payload)),
root as (select delivery_id, {_unwrapped('v')} as v from top),
{_walk("args", "root", ("argv",))},
{_walk("finds", "root", ("structured", "findings", "prefix", "records"))},
{_walk("hints", "root", ("structured", "hints", "records"))},
{_walk("errors", "root", ("structured", "error", "prefix", "records"))},
each_find as (select delivery_id, unnest(xs) as v0, generate_subscripts(xs, 1) - 1 as pos from finds),
find as (select delivery_id, pos, {_unwrapped('v0')} as v from each_find where json_type(v0) <> 'NULL'),
{_walk("lines", "find", ("lines",), "pos, ")},
{_walk("graphs", "find", ("_graphs",), "pos, ")},
every as (
  select delivery_id, 'arg' as child, -1 as parent_pos, unnest(xs) as v, generate_subscripts(xs, 1) - 1 as pos from args
  union all select delivery_id, 'finding', -1, unnest(xs), generate_subscripts(xs, 1) - 1 from finds
  union all select delivery_id, 'hint', -1, unnest(xs), generate_subscripts(xs, 1) - 1 from hints
  union all select delivery_id, 'error', -1, unnest(xs), generate_subscripts(xs, 1) - 1 from errors
  union all select delivery_id, 'line', pos, unnest(xs), generate_subscripts(xs, 1) - 1 from lines
  union all select delivery_id, 'graph', pos, unnest(xs), generate_subscripts(xs, 1) - 1 from graphs)
select delivery_id, child, cast(parent_pos as bigint) as parent_pos, cast(pos as bigint) as pos
from every where json_type(v) <> 'NULL'"""

_TREE = """
with recursive cur as (
  select source as node, max(target) as parent from (
    select source, target, rank() over (partition by source order by seen_at desc) as r
    from raw_edges where graph = 'outline' and source is not null) where r = 1 group by source),
links as (
  select node, parent from cur
  union all select distinct parent, null from cur where parent is not null and parent not in (select node from cur)),
up(node, anc) as (
  select node, parent from links where parent is not null
  union select u.node, l.parent from up u join links l on l.node = u.anc where l.parent is not null),
onloop as (select node from up where node = anc),
state as (
  select l.node, l.parent,
    case when l.node in (select node from onloop) then 2
         when exists (select 1 from up u join onloop o on o.node = u.anc where u.node = l.node) then 1 else 0 end as cyclic,
    (select count(*) from up u where u.node = l.node) as n
  from links l),
tree as (
  select s.node, case when cyclic > 0 then '' when parent is null then s.node else (
      select min(u.anc) from up u join links a on a.node = u.anc where u.node = s.node and a.parent is null) end as root,
    case when cyclic > 0 then -1 else n end as depth,
    (select count(*) from up u where u.anc = s.node and u.node <> s.node) as impact_radius, cyclic
  from state s)
"""

ORACLES = {
    "p1_found": _RANKED + "select delivery_id from r where k is not null and n > 1",
    "p1_kept": _RANKED + "select delivery_id, event, batch from r where k is null or n = 1",
    "p1_batches": f"""
with m as (select *, case when length({_HEX}) = 32 and event is not null then {_HEX} end as k from usage_events),
old as (select distinct k, event from m where k is not null and delivered_at < timestamp '2025-01-01 00:00:00'),
r as (select *, row_number() over (partition by k, event order by coll_s nulls last, coll_ns nulls last, delivery_id) as n
      from m where delivered_at >= timestamp '2025-01-01 00:00:00')
select delivery_id from r where k is null
  or (n = 1 and not exists (select 1 from old where old.k = r.k and old.event = r.event))""",
    "p3_found": _TREE + """select node, root, cast(depth as bigint) as depth, cast(impact_radius as bigint) as impact_radius,
  cast(cyclic as bigint) as cyclic from tree""",
    "p3_paths": _TREE + """
select t.node, cast(t.depth as bigint) as depth, case when t.cyclic = 0 then
  coalesce((select string_agg(u.anc, chr(10) order by a.depth) || chr(10) from up u join tree a on a.node = u.anc
            where u.node = t.node), '') || t.node end as full_path
from tree t""",
    "p3_descendants": _TREE + """
select u.anc as ancestor, u.node as descendant, cast(d.depth - a.depth as bigint) as steps
from up u join tree d on d.node = u.node join tree a on a.node = u.anc where d.cyclic = 0""",
    "p3_closure": _TREE + "select distinct anc as ancestor, node as descendant from up where anc <> node",
    "p4_found": _ORPHANS,
    "p4_report": f"select ref_table, field, period, reason, count(*) as orphans from ({_ORPHANS}) group by all",
    "p4_composite": """
with held as (select distinct snapshot_seq as s, path as p, hash as h from lock_nodes),
gone as (
  select e.*,
    exists (select 1 from held where s = e.snapshot_seq and p = e.target and h = e.target_hash) as whole,
    (e.snapshot_seq is null or exists (select 1 from held where s = e.snapshot_seq)) as has_s,
    exists (select 1 from held where p = e.target) as has_p,
    exists (select 1 from held where h = e.target_hash) as has_h,
    exists (select 1 from held where s = e.snapshot_seq and p = e.target) as has_sp,
    exists (select 1 from held where s = e.snapshot_seq and h = e.target_hash) as has_sh,
    exists (select 1 from held where p = e.target and h = e.target_hash) as has_ph
  from (select snapshot_seq, target, target_hash, count(*) as n from lock_edges group by all) e),
told as (
  select *, snapshot_seq is null as a, target is null as b, target_hash is null as c from gone),
judged as (
  select snapshot_seq, target, target_hash, n,
    not (a or b or c) and not whole as simple,
    case when a and b and c then false when not (a or b or c) then not whole
         when a and b then not has_h when a and c then not has_p when b and c then not has_s
         when a then not has_ph when b then not has_sh else not has_sp end as partial,
    case when a and b and c then false when a or b or c then true else not whole end as complete
  from told)
select 'simple' as match, snapshot_seq, target, target_hash, n as links from judged where simple
union all select 'partial', snapshot_seq, target, target_hash, n from judged where partial
union all select 'full', snapshot_seq, target, target_hash, n from judged where complete""",
    "p5_found": """
with n as (
  select snapshot_seq, path, list_sort(list(distinct coalesce('h' || hash, ''))) as h
  from lock_nodes where path is not null group by all),
e as (
  select snapshot_seq, source as path,
    list_sort(list(distinct coalesce('t' || target, '') || chr(1) || coalesce('h' || target_hash, ''))) as t
  from lock_edges group by all),
s as (select n.snapshot_seq, n.path, n.h, coalesce(e.t, []) as t from n left join e using (snapshot_seq, path)),
o as (select snapshot_seq, row_number() over (order by snapshot_seq) as i from (select distinct snapshot_seq from lock_nodes)),
x as (select s.*, o.i from s join o using (snapshot_seq))
select o.snapshot_seq, path, change from (
  select coalesce(b.i, a.i + 1) as i, coalesce(b.path, a.path) as path,
    case when a.path is null then 'added' when b.path is null then 'removed'
         when a.h <> b.h or a.t <> b.t then 'changed' end as change
  from x a full join x b on a.path = b.path and b.i = a.i + 1) d
join o on o.i = d.i where change is not null and d.i > 1""",
    "p6_found": _CHILDREN,
    "p6_records": """
select delivery_id, json_extract_string(payload, '$.event') as record_event,
  try_cast(json_extract_string(payload, '$.entry_wall_time.value.seconds') as bigint) as entry_seconds,
  json_extract_string(payload, '$.elapsed.status') as elapsed_status
from usage_events where json_valid(payload) and json_type(payload) = 'OBJECT'""",
}
