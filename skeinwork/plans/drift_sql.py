"""SQL statements of the drift engine's queries, for a second engine to check results by."""

from ..operators.usage import RETENTION_S
from .drift_queries import EVICT_BYTES, EVICT_FILES, NOW_S

_BASE = r"""
nodes_now as (
  select path, fs_type, fs_hash, anchors, blocks from (
    select *, row_number() over (partition by path order by first_seen desc, fs_hash desc nulls last) as r
    from nodes where deleted_at is null and path is not null) where r = 1),
ends as (
  select * from raw_edges where source is not null and target is not null and source <> '' and target <> ''),
occ as (
  select distinct graph, source, target, o.line as line, o.link as link, o.raw as raw
  from (select graph, source, target, unnest(occurrences) as o from ends)
  where o.line is not null or o.link is not null or o.raw is not null),
links as (select distinct graph, source, target from ends),
edges as (
  select l.source, l.target,
    list_sort(list(distinct '@' || l.graph)) as provenance,
    coalesce(list_sort(list(distinct o.line) filter (o.line is not null)), []) as lines,
    coalesce(list_sort(list(distinct o.raw) filter (o.raw is not null)), []) as raws
  from links l left join occ o on o.graph = l.graph and o.source = l.source and o.target = l.target
  group by l.source, l.target),
last as (select max(snapshot_seq) as s from lock_nodes),
ln as (select path, max(hash) as hash from lock_nodes, last where snapshot_seq = s group by path),
le as (select source, target, max(target_hash) as target_hash from lock_edges, last where snapshot_seq = s group by source, target)
"""
_W = f"with {_BASE}"
_URI = r"regexp_matches(lower({0}), '^([a-z][a-z0-9+.\-]*://|(mailto|tel|data|urn|javascript):)')"
_CHANGED = "changed as (select n.path, n.fs_hash, l.hash from nodes_now n join ln l on l.path = n.path where n.fs_hash <> l.hash)"
_LOCKN = """newlock as (
  select n.path, n.fs_hash as hash from nodes_now n
  where n.fs_hash is not null or n.path in (select source from edges))"""

_RULES = {
    "stale_node": f"""{_CHANGED}
select 'stale-node' as name, path as subject, null::varchar as target, null::bigint[] as lines,
  substr(fs_hash, 1, 13) || ' is not the locked ' || substr(hash, 1, 13) as message from changed""",
    "stale_edge": f"""{_CHANGED}
select 'stale-edge' as name, e.source as subject, e.target as target, e.lines as lines, '' as message
from le l join edges e on e.source = l.source and e.target = l.target join nodes_now n on n.path = l.target
where n.fs_hash <> l.target_hash and l.source not in (select path from changed)""",
    "new_edge": """x as (select 1)
select 'new-edge' as name, e.source as subject, e.target as target, e.lines as lines, '' as message from edges e
where not exists (select 1 from le l where l.source = e.source and l.target = e.target)""",
    "removed_node": """x as (select 1)
select 'removed-node' as name, path as subject, null::varchar as target, null::bigint[] as lines, '' as message
from ln where path not in (select path from nodes_now)""",
    "removed_edge": """x as (select 1)
select 'removed-edge' as name, l.source as subject, l.target as target, null::bigint[] as lines, '' as message from le l
where l.source in (select path from nodes_now)
  and not exists (select 1 from edges e where e.source = l.source and e.target = l.target)""",
    "unlocked_node": f"""{_LOCKN}
select 'unlocked-node' as name, path as subject, null::varchar as target, null::bigint[] as lines, '' as message
from newlock where path not in (select path from ln)""",
}


def _rule_text(sql: str) -> str:
    head, _, body = sql.partition("\nselect")
    return f"{_W}, {head}\nselect name, subject, target, array_to_string(lines, ',') as lines, message from (select{body})"


_UNRESOLVED = f"""lost as (
  select * from edges e where not {_URI.format('e.target')} and not exists (select 1 from nodes_now n where n.path = e.target))"""
_FRAGMENTS = f"""frag as (
  select o.source, o.target, regexp_extract(o.link, '^[^#]*#((.|\n)*)$', 1) as fragment, o.line
  from occ o where not {_URI.format('o.target')} and position('#' in o.link) > 0),
fgroup as (
  select source, target, fragment, coalesce(list_sort(list(distinct line) filter (line is not null)), []) as lines
  from frag where fragment <> '' group by all),
badfrag as (
  select g.*, n.anchors from fgroup g join nodes_now n on n.path = g.target
  where n.anchors is not null and not list_contains(n.anchors, g.fragment) and not list_contains(n.anchors, url_decode(g.fragment)))"""
_POLICY = r"""
  case name when 'stale-node' then 'error' when 'unresolved-edge' then 'error' when 'detached-node' then 'off'
            when 'removed-edge' then 'error' else 'warn' end"""
_KEPT = r"""severity <> 'off' and not regexp_matches(subject, '^[^/]*/archive/(.|\n)*$')
  and not (name = 'stale-node' and regexp_matches(subject, '^([^/]*/)*[^/]*\.csv$'))
  and not (name = 'new-edge' and regexp_matches(subject, '^([^/]*/)*img/[^/]*$'))"""

_SEEDS = r"seeds as (select path from nodes_now where regexp_matches(path, '^([^/]*/)*docs/index-[^/]*\.md$'))"


def _all_rules() -> str:
    """Every rule's findings, as the common table ``allf``."""
    parts = []
    for sql in _RULES.values():
        parts.append("select" + sql.partition("\nselect")[2])
    parts.append("select 'unresolved-edge', source, target, lines, '' from lost")
    parts.append("select 'unresolved-fragment', source, target, lines, '#' || fragment from badfrag")
    parts.append("select 'no-baseline', '.', null, null, '' where exists (select 1 from nodes_now where fs_hash is not null) and not exists (select 1 from ln)")
    body = " union all ".join(parts)
    return f"{_W}, {_CHANGED}, {_LOCKN}, {_UNRESOLVED}, {_FRAGMENTS}, allf as ({body})"


def _checked() -> str:
    return f"""{_all_rules()},
p as (select *, {_POLICY} as severity from allf), k as (select * from p where {_KEPT}),
c as (select * from k where name <> 'new-edge' or not exists (
  select 1 from k u where u.name = 'unlocked-node' and u.subject = k.subject))"""


def _normal(joined: str) -> str:
    """A path normalised, as an SQL expression over another."""
    parts = f"list_filter(string_split({joined}, '/'), lambda x: x <> '' and x <> '.')"
    folded = f"""list_reduce(list_concat([[]::varchar[]], list_transform({parts}, lambda x: [x])), lambda a, x:
      case when x[1] <> '..' then list_concat(a, x) when len(a) > 0 and a[len(a)] <> '..' then a[1:len(a) - 1]
           when starts_with({joined}, '/') then a else list_concat(a, x) end)"""
    text = f"array_to_string({folded}, '/')"
    return f"case when starts_with({joined}, '/') then '/' || {text} when {text} = '' then '.' else {text} end"


_TOP = f"""
pairs as (
  select regexp_extract(source, '^([^/]+)/', 1) as source, regexp_extract(target, '^([^/]+)/', 1) as target
  from raw_edges where graph <> 'outline'),
tally as (select source, target, count(*) as n from pairs where source <> '' and target <> '' and position(':' in target) = 0 group by all),
busy as (select source, max(n) as most from tally where source <> target group by source),
e as (select t.source, t.target from tally t join busy b on b.source = t.source where t.n >= 0.5 * b.most),
v as (select source as path from e union select target from e),
hop as (select distinct source, target from e where source <> target),
near(s, t, d) as (select path, path, 0 from v union select n.s, h.target, n.d + 1 from near n join hop h on h.source = n.t where n.d < (select count(*) from v)),
dist as (select s, t, min(d) as d from near group by s, t),
trail(s, t, d) as (
  select path, path, 0 from v union all
  select w.s, h.target, w.d + 1 from trail w join hop h on h.source = w.t join dist x on x.s = w.s and x.t = h.target and x.d = w.d + 1),
p as (select s, t, d, count(*)::double as n from trail group by all)"""


def _bfs(direction: str, depth: int | None) -> str:
    back, ahead = "select target as a, source as b from edges", "select source as a, target as b from edges"
    hops = {"inbound": back, "outbound": ahead, "both": f"{back} union {ahead}"}[direction]
    if depth is None:
        return f"""with recursive {_BASE}, {_SEEDS}, hops as materialized ({hops}),
walk(node, depth) as (
  select path, 0 from seeds union
  select h.b, w.depth + 1 from walk w join hops h on h.a = w.node where w.depth < 60)
select node, cast(min(depth) as bigint) as depth from walk where node not in (select path from seeds) group by node"""
    out, level = [], []
    for k in range(1, depth + 1):
        seen = " union ".join(["select path as node from seeds"] + [f"select node from l{i}" for i in range(1, k)])
        before = "select path as node from seeds" if k == 1 else f"select node from l{k - 1}"
        level.append(f"l{k} as (select distinct h.b as node from ({before}) p join hops h on h.a = p.node where h.b not in ({seen}))")
        out.append(f"select node, cast({k} as bigint) as depth from l{k}")
    return f"{_W}, {_SEEDS}, hops as ({hops}), {', '.join(level)} {' union all '.join(out)}"


_GROUPS = r"""
k as (
  select *, lower(regexp_replace(id, '[^0-9a-fA-F]', '', 'g')) as h from usage_events where id is not null),
kept as (
  select * from (
    select *, row_number() over (partition by h, event order by coll_s nulls last, coll_ns nulls last, delivery_id) as r
    from k where length(h) = 32) where r = 1),
g as (
  select h as id, count(*) filter (event = 'start') as s, count(*) filter (event = 'finish') as f,
    max(state) filter (event = 'start') as ss, max(state) filter (event = 'finish') as fs,
    max(bytes) filter (event = 'start') as sb, max(bytes) filter (event = 'finish') as fb,
    max(entry_s::hugeint * 1000000000 + entry_ns) filter (event = 'start') as se,
    max(entry_s::hugeint * 1000000000 + entry_ns) filter (event = 'finish') as fe,
    max(coll_s::hugeint * 1000000000 + coll_ns) filter (event = 'start') as sc,
    max(coll_s::hugeint * 1000000000 + coll_ns) filter (event = 'finish') as fc
  from kept group by h),
cover as (
  select id, case when ss = 'supported' and fs = 'supported' and se = fe and se <= sc and sc <= fc then fc end as last,
    coalesce(sb, 0) + coalesce(fb, 0) as bytes, cast((s > 0)::int + (f > 0)::int as bigint) as files
  from g)"""

ORACLES = {
    **{name: _rule_text(sql) for name, sql in _RULES.items()},
    "content_hash": "select doc_id, 's2:' || sha256(raw) as hash from documents",
    "duplicate_hash": """select sha256(raw) as hash, count(*) as pages, min(doc_id) as first_doc from documents
where raw is not null group by 1 having count(*) > 1""",
    "compose_nodes": """
select path, count(distinct ns) as n_blocks, string_agg(distinct ns, ',' order by ns) as provenance
from (select path, unnest(map_keys(blocks)) as ns from nodes where deleted_at is null and path is not null) group by path""",
    "compose_edges": f"""{_W} select source, target, array_to_string(lines, ',') as lines,
  array_to_string(raws, ',') as raws, array_to_string(provenance, ',') as provenance from edges""",
    "link_aggregate": f"""{_W} select l.graph, l.source, l.target, count(o.source) as n,
  coalesce(string_agg(coalesce(cast(o.line as varchar), '?'), ',' order by o.line nulls last) filter (o.source is not null), '') as lines
from links l left join occ o on o.graph = l.graph and o.source = l.source and o.target = l.target group by all""",
    "graph_sizes": f"""{_W},
a as (select substr(ns, 2) as graph, count(distinct path) as nodes from
  (select path, unnest(map_keys(blocks)) as ns from nodes where deleted_at is null and path is not null) group by 1),
b as (select graph, count(*) as edges from links group by 1)
select coalesce(a.graph, b.graph) as graph, coalesce(nodes, 0) as nodes, coalesce(edges, 0) as edges
from a full join b on a.graph = b.graph""",
    "lock_nodes_snapshot": f"{_W}, {_LOCKN} select path, hash from newlock",
    "lock_edges_snapshot": f"""{_W} select e.source, e.target, n.fs_hash as target_hash from edges e left join nodes_now n on n.path = e.target""",
    "lock_merge": f"""{_W}, {_LOCKN}
select path, hash from ln where not regexp_matches(path, '^[^/]*/docs/(.|\\n)*$')
union all select path, hash from newlock where regexp_matches(path, '^[^/]*/docs/(.|\\n)*$')""",
    "lock_dropped": f"{_W} select path from ln where path not in (select path from nodes_now)",
    "detached_node": f"""{_W} select path as subject from nodes_now n where fs_type <> 'directory'
  and not exists (select 1 from edges e where e.source = n.path) and not exists (select 1 from edges e where e.target = n.path)""",
    "no_baseline": f"{_W} select 'no-baseline' as name, '.' as subject where exists (select 1 from nodes_now where fs_hash is not null)",
    "policy_apply": f"""
with p as (select finding_id, name, subject, {_POLICY} as severity from findings where subject is not null),
k as (select * from p where name is not null and {_KEPT}
      union all select * from p where name is null and severity <> 'off' and not regexp_matches(subject, '^[^/]*/archive/(.|\\n)*$'))
select finding_id, severity from k where name is distinct from 'new-edge'
  or not exists (select 1 from k u where u.name = 'unlocked-node' and u.subject = k.subject)""",
    "unresolved_edge": f"""{_W}, {_UNRESOLVED},
m as (select distinct l.source, l.target from (select source, target, unnest(raws) as raw from lost) l
      where not regexp_matches(raw, '^(\\.\\.?/|/)') and raw in (select path from nodes_now))
select l.source as subject, l.target, array_to_string(l.lines, ',') as lines, m.source is not null as has_cause
from lost l left join m on m.source = l.source and m.target = l.target""",
    "unresolved_fragment": f"""{_W}, {_FRAGMENTS}
select source as subject, target, array_to_string(lines, ',') as lines, '#' || fragment as message,
  case when len(list_filter(anchors, lambda a: lower(a) in (lower(fragment), lower(url_decode(fragment))))) > 0
    then 'case differs: ' || list_filter(anchors, lambda a: lower(a) in (lower(fragment), lower(url_decode(fragment))))[1] end as cause
from badfrag""",
    "check_findings": f"{_checked()} select name, severity, subject, target, array_to_string(lines, ',') as lines, message from c",
    "check_summary": f"{_checked()} select count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warn') as warnings from c",
    "impact_via": f"""{_W}, {_SEEDS},
hops as (select target as a, source as b, 0 as way, lines from edges union all select source, target, 1, null from edges),
f as (select h.*, row_number() over (partition by b order by a, way) as r from hops h join seeds s on s.path = h.a
      where h.b not in (select path from seeds) and h.a <> h.b)
select b as node, a as via, 1::bigint as depth, array_to_string(lines, ',') as lines from f where r = 1""",
    "impact_diagnostics": f"""{_W}, {_SEEDS}, {_UNRESOLVED}
select 'unresolved-edge' as name, source as subject, target from lost where source in (select path from seeds) or target in (select path from seeds)
union all
select 'removed-edge', l.source, l.target from le l where l.source in (select path from nodes_now)
  and not exists (select 1 from edges e where e.source = l.source and e.target = l.target)
  and (l.source in (select path from seeds) or l.target in (select path from seeds))""",
    "betweenness": f"""with recursive {_TOP},
c as (select count(*) as k from v),
b as (select x.t as node, sum(x.n * y.n / z.n) as g from p x join p y on y.s = x.t join p z on z.s = x.s and z.t = y.t
      where z.d = x.d + y.d and x.s <> x.t and x.t <> y.t and x.s <> y.t group by x.t)
select v.path as node, round(coalesce(b.g, 0) / case when k > 2 then (k - 1) * (k - 2) else 1 end, 9) as betweenness
from v cross join c left join b on b.node = v.path""",
    "link_resolve": f"""
with s as (select edge_id, source, unnest(occurrences) as o, generate_subscripts(occurrences, 1) - 1 as pos from raw_edges where source is not null),
j as (select edge_id, pos, case when starts_with(o.raw, '/') or position('/' in source) = 0 then o.raw
  else regexp_replace(source, '/?[^/]*$', '') || '/' || o.raw end as joined from s where o.raw is not null)
select edge_id, cast(pos as bigint) as "at", {_normal('joined')} as resolved from j""",
    "bfs_inbound_all": _bfs("inbound", None),
    "bfs_inbound_1": _bfs("inbound", 1),
    "bfs_outbound_2": _bfs("outbound", 2),
    "bfs_both_2": _bfs("both", 2),
    "impact_radius": f"""with recursive {_BASE}, {_SEEDS}, hops as materialized (select distinct target as a, source as b from edges),
walk(node, got) as (
  select path, path from seeds union select w.node, h.b from walk w join hops h on h.a = w.got)
select node, count(*) - 1 as impact_radius from walk group by node""",
    "select_glob": f"{_W} select path from nodes_now where regexp_matches(path, '^([^/]*/)*docs/[^/]*\\.md$')",
    "select_subtree": f"{_W} select path, fs_type from nodes_now where path = 'handbook' and fs_type <> 'directory' or starts_with(path, 'handbook/')",
    "project_nodes": f"{_W} select path, blocks['@frontmatter'] as frontmatter from nodes_now where map_contains(blocks, '@frontmatter')",
    "project_fields": f"""{_W} select path, json_extract_string(blocks['@frontmatter'], '$.purpose') as purpose from nodes_now
where map_contains(blocks, '@frontmatter') and json_exists(blocks['@frontmatter'], '$.purpose')""",
    "project_edges": f"""{_W} select source, target from edges where list_contains(provenance, '@frontmatter')
  and source in (select path from nodes_now where regexp_matches(path, '^([^/]*/)*docs/[^/]*\\.md$'))""",
    "beneath": f"""{_W}, parts as (select path, string_split(path, '/') as p from nodes_now),
up as (select array_to_string(p[1:i], '/') as path from (select p, unnest(range(1, len(p))) as i from parts)),
c as (select path, count(*) as n from up group by path)
select d.path, coalesce(c.n, 0) as beneath from nodes_now d left join c on c.path = d.path where d.fs_type = 'directory'""",
    "usage_classify": """
with c as (select delivery_id, state, case
    when not coalesce(json_valid(payload), false) or json_type(payload) <> 'OBJECT' or json_extract_string(payload, '$.event') is distinct from event
      or try_cast(json_extract_string(payload, '$.revision') as bigint) is null then 'malformed'
    when try_cast(json_extract_string(payload, '$.revision') as bigint) >= 2 then 'unsupported' else 'supported' end as class
  from usage_events)
select state, class, count(*) as deliveries from c group by all""",
    "event_pairing": f"with {_GROUPS} select id, case when s > 0 and f > 0 then 'paired' when s > 0 then 'incomplete' else 'orphan' end as pairing from g",
    "event_coverage": f"with {_GROUPS} select id, bytes, files from cover where last is not null",
    "event_ttl": f"with {_GROUPS} select id from cover where {NOW_S}::hugeint * 1000000000 - last >= {RETENTION_S}::hugeint * 1000000000",
    "event_eviction": f"""with {_GROUPS},
o as (select *, coalesce(sum(bytes) over w, 0) as bb, coalesce(sum(files) over w, 0) as bf from cover
      window w as (order by last is null, last, id rows between unbounded preceding and 1 preceding)),
t as (select sum(bytes) as b, sum(files) as f from cover)
select id from o, t where t.b - bb > {EVICT_BYTES} or t.f - bf > {EVICT_FILES}""",
    "occupancy": "select state, count(*) as files, coalesce(sum(bytes), 0)::bigint as bytes from usage_events group by state",
    "prefix_admission": """
select finding_id from (
  select finding_id, sum(strlen(coalesce(message, ''))) over (partition by name, strftime(found_at, '%Y-%m') order by finding_id
    rows between unbounded preceding and current row) as s
  from findings where name is not null) where s <= 400""",
    "check_sorted": """
with d as (select distinct name, subject, lines, target, message from findings where name is not null and subject is not null)
select name, subject, array_to_string(lines, ',') as lines, target, message,
  row_number() over (order by name, subject, coalesce(lines, []), coalesce(target, ''), coalesce(message, '')) as place from d""",
    "snapshot_intervals": """
with n as (
  select snapshot_seq, path, list_sort(list(distinct coalesce('h' || hash, ''))) as h from lock_nodes where path is not null group by all),
e as (
  select snapshot_seq, source as path, list_sort(list(distinct coalesce('t' || target, '') || chr(1) || coalesce('h' || target_hash, ''))) as t
  from lock_edges group by all),
o as (select snapshot_seq, row_number() over (order by snapshot_seq) as i from (select distinct snapshot_seq from lock_nodes)),
s as (select n.path, o.i, n.h, coalesce(e.t, []) as t from n join o using (snapshot_seq) left join e using (snapshot_seq, path)),
m as (select *, case when lag(i) over w = i - 1 and lag(h) over w = h and lag(t) over w = t then 0 else 1 end as b
      from s window w as (partition by path order by i)),
g as (select *, sum(b) over (partition by path order by i) as island from m)
select path, min(i) as from_idx, max(i) as to_idx from g group by path, island""",
    "slugify": r"""select doc_id, replace(regexp_replace(lower(string_split(text, chr(10))[1]), '[^\p{L}\p{N}\p{M}_\- ]', '', 'g'), ' ', '-') as slug
from documents where text is not null""",
    "one_line": r"""select distinct path, replace(replace(replace(path, chr(10), '\n'), chr(13), '\r'), chr(9), '\t') as line from nodes where path is not null""",
}

_SAID = r"""
said as (
  select distinct source, '/' || regexp_replace(target, '[^A-Za-z0-9_/.:#-]', '-', 'g') as t from raw_edges
  where graph = 'markdown' and source is not null and target is not null and target <> '')"""
ORACLES |= {
    "markdown_links": f"""with {_SAID}
select source as path, row_number() over (partition by source order by t) - 1 as pos, t as target,
  row_number() over (partition by source order by t) + 2 as line from said""",
    "frontmatter_links": r"""
with said as (select distinct source, replace(replace(replace(target, chr(10), '\n'), chr(13), '\r'), chr(9), '\t') as t, target as raw from raw_edges
  where graph = 'frontmatter' and source is not null and target is not null and target <> '')
select source as path, t as target, row_number() over (partition by source order by raw) + 3 as line from said""",
}


def _relative() -> str:
    """How to write the target from the source's directory, as an SQL expression over both."""
    base = "list_filter(string_split(regexp_replace(source, '/?[^/]*$', ''), '/'), lambda x: x <> '')"
    to = "list_filter(string_split(target, '/'), lambda x: x <> '')"
    shared = (
        f"len(list_filter(range(1, 1 + least(len({base}), len({to}) - 1)), lambda i: ({base})[1:i] = ({to})[1:i]))"
    )
    ups = f"len({base}) - {shared}"
    rest = f"array_to_string(({to})[{shared} + 1:], '/')"
    return f"case when {ups} = 0 then './' || {rest} else repeat('../', {ups}) || {rest} end"


ORACLES |= {
    "impact_ranked": f"""with recursive {_BASE}, {_SEEDS}, hops as materialized (select distinct target as a, source as b from edges),
near as (select distinct h.b as node from seeds s join hops h on h.a = s.path where h.b not in (select path from seeds)),
walk(node, got) as (
  select node, node from near union select w.node, h.b from walk w join hops h on h.a = w.got)
select node, 1::bigint as depth, count(*) - 1 as impact_radius from walk group by node""",
    "raw_totals": f"""{_W},
a as (select distinct substr(ns, 2) as graph, path from
  (select path, unnest(map_keys(blocks)) as ns from nodes where deleted_at is null and path is not null))
select (select count(*) from (select graph from a union select graph from links)) as graphs,
  (select count(distinct path) from a) as nodes, (select count(*) from links) as edges""",
    "edge_blocks": f"""{_W},
told as (select graph, source, target, count(*) as n, min(line) as first_line from occ group by all)
select e.source, e.target, array_to_string(e.provenance, ',') as provenance, '@' || t.graph as ns,
  case when t.graph is not null then t.n end as n, t.first_line
from edges e left join told t on t.source = e.source and t.target = e.target""",
    "percent_decode": "select distinct target, coalesce(try(url_decode(target)), target) as decoded from raw_edges where target is not null",
    "link_functions": f"""
select edge_id, {_URI.format('target')} as uri, {_normal('target')} as normal,
  case when not {_URI.format('target')} and source <> '' and target <> '' then {_relative()} end as relative,
  split_part(target, '#', 1) as bare
from raw_edges where target is not null and source is not null""",
    "built_edges": f"""
with said as (
  select distinct source, '/' || regexp_replace(target, '[^A-Za-z0-9_/.:#-]', '-', 'g') as t from raw_edges
  where graph = 'markdown' and source is not null and target is not null and target <> ''),
cut as (select source, split_part(t, '#', 1) as t from said)
select source, {_normal('t')} as target, count(*) as n from cut group by all""",
}
