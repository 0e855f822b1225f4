"""Equivalent DuckDB SQL of the core queries, for the correctness gate."""

from codexmill.operators.timestamps import ABBREVIATIONS, MONTHS

_T = r"trim({}, E' \t\r\n')"

_P4 = f"""
with par as (
  select 'manifest' as space, pub_id, {_T.format("id")} as ref, loaded_at, removed_at is null as live from declarations
  union all select 'refines', pub_id, {_T.format("id")}, loaded_at, removed_at is null from declarations
  union all select 'refines', pub_id, id, loaded_at, removed_at is null from metadata_elements
  union all select 'refines', pub_id, id, loaded_at, true from metas
), known as (
  select space, pub_id, ref, min(loaded_at) filter (where live) as live_at from par where ref is not null group by all
), refs as (
  select 'declarations' as ref_table, 'fallback' as ref_field, decl_key as row_key, 'manifest' as space, pub_id, {_T.format("fallback")} as ref, loaded_at from declarations where {_T.format("fallback")} <> ''
  union all select 'declarations', 'media_overlay', decl_key, 'manifest', pub_id, {_T.format("media_overlay")}, loaded_at from declarations where {_T.format("media_overlay")} <> ''
  union all select 'reading_order', 'idref', itemref_key, 'manifest', pub_id, {_T.format("idref")}, loaded_at from reading_order where {_T.format("idref")} <> ''
  union all select 'metas', 'refines', meta_key, 'refines', pub_id, ltrim(refines, '#'), loaded_at from metas where refines <> ''
), arrived as (
  select ref_table, ref_field, row_key, space, pub_id, ref, min(loaded_at) as arrived_at from refs group by all
), judged as (
  select a.*, case when k.ref is null then 'missing' when k.live_at is null then 'deleted' when k.live_at > a.arrived_at then 'late' end as reason
  from arrived a left join known k on k.space = a.space and k.pub_id = a.pub_id and k.ref = a.ref
), found as (
  select ref_table, ref_field, row_key, reason, strftime(make_timestamp(epoch_us(arrived_at)), '%Y-%m') as period from judged where reason is not null
)
"""

_EDGES = f"""
decl as (select distinct pub_id, decl_key, {_T.format("id")} as id, {_T.format("fallback")} as fallback from declarations),
owner as (select pub_id, id, min(decl_key) as parent from decl where id is not null group by all having count(distinct decl_key) = 1),
pts as (select distinct pub_id, list_index, point_path, nav_key from nav_points where point_path is not null),
e as (
  select 'fallback' as tree, d.decl_key as node, o.parent from decl d join owner o on o.pub_id = d.pub_id and o.id = d.fallback
  union all
  select 'nav', c.nav_key, p.nav_key from pts c join pts p on p.pub_id = c.pub_id and p.list_index = c.list_index and len(c.point_path) > 1 and p.point_path = c.point_path[:len(c.point_path) - 1]
)"""

_P5_WALK = f"""
with recursive {_EDGES},
up as (  -- every walk from a node to its ancestors, until it ends or repeats a node
  select tree, node, parent as at, [node, parent] as walk, parent = node as looped from e
  union all
  select up.tree, up.node, e.parent, list_append(up.walk, e.parent), list_contains(up.walk, e.parent)
  from up join e on e.tree = up.tree and e.node = up.at where not up.looped
), last as (
  select tree, node, arg_max(walk, len(walk)) as walk, bool_or(looped) as looped from up group by all
), placed as (
  select *, list_position(walk, walk[len(walk)]) as first_at from last
), judged as (
  select tree, node as node_key,
    case when not looped then 'none' when first_at = 1 then 'on' else 'leads' end as cycle_state,
    case when not looped then walk[len(walk)] when first_at = 1 then list_min(walk) else walk[first_at] end as root_key,
    cast(case when not looped then len(walk) - 1 when first_at = 1 then 0 else first_at - 1 end as bigint) as depth,
    case when not looped then list_reverse(walk) when first_at = 1 then [node] else list_reverse(walk[:first_at]) end as path
  from placed
)
"""

_P1_NODES = """
with recursive whole as (
  select distinct set_key, cast(payload as json) as j from annotation_sets where json_valid(payload) and json_type(payload) = 'OBJECT'
), nodes as (
  select set_key, '' as node_path, '' as parent_path, 'root' as node_kind, j from whole
  union all
  select n.set_key, case when n.node_path = '' then '' else n.node_path || '/' end || m.name || case when x.i is null then '' else '/' || x.i end,
    n.node_path, m.kind, x.v
  from nodes n
  join (values ('root', 'items', 'annotation'), ('annotation', 'target', 'target'), ('annotation', 'body', 'body'), ('target', 'selector', 'selector'), ('selector', 'refinedBy', 'selector')) m(of, name, kind) on m.of = n.node_kind,
  lateral (
    select null as i, n.j -> m.name as v where json_type(n.j -> m.name) = 'OBJECT'
    union all
    select i, v from (select unnest(range(cast(json_array_length(n.j -> m.name) as bigint))) as i) r, lateral (select json_extract(n.j -> m.name, '$[' || r.i || ']') as v) w
    where json_type(n.j -> m.name) = 'ARRAY' and json_type(v) = 'OBJECT'
  ) x
)
"""

_MONTHS = "(case lower({}) " + " ".join(f"when '{n}' then {m}" for m, ns in MONTHS.items() for n in ns) + " end)"
_CIVIL = [  # pattern, names of its groups, month expression
    (r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(.*))?$", "y m d h i s f z", "g.m"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})(?: (\d{1,2}):(\d{2})(?::(\d{2}))?)?$", "y m d h i s", "g.m"),
    (r"^(\d{4})(\d{2})(\d{2})(?:T?(\d{2})(\d{2})(\d{2})?(Z)?)?$", "y m d h i s z", "g.m"),
    (r"^(\d{4})(?:-(\d{2}))?$", "y m", "coalesce(nullif(g.m, ''), '1')"),
    (r"^(?:\pL{3}, )?(\d{1,2}) (\pL+) (\d{4}) (\d{1,2}):(\d{2})(?::(\d{2}))? ?(.*)$", "d m y h i s z", _MONTHS.format("g.m")),
    (r"^(\d{1,2})\.? (\pL+) (\d{4})$", "d m y", _MONTHS.format("g.m")),
    (r"^(\pL+) (\d{1,2}), (\d{4})$", "m d y", _MONTHS.format("g.m")),
    (r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?:,? (\d{1,2}):(\d{2})(?: ?([AaPp][Mm]|Uhr))?)?$", "d m y h i ap", "g.m"),
]


def _civil(pattern: str, names: str, month: str) -> str:
    has = names.split()
    g = lambda n, other: f"coalesce(nullif(g.{n}, ''), '{other}')" if n in has else f"'{other}'"
    day, hour = g("d", "1"), g("h", "0")
    if "ap" in has:  # all numbers, the year last: the locale orders day and month
        day, month = "(case when locale like '%-US' then g.m else g.d end)", "(case when locale like '%-US' then g.d else g.m end)"
        hour = f"(case when upper(g.ap) in ('AM', 'PM') then cast(try_cast({hour} as int) % 12 + case when upper(g.ap) = 'PM' then 12 else 0 end as varchar) else {hour} end)"
    listed = ", ".join(f"'{n}'" for n in has)
    return f"""select tab, row_key, home_zone, try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', try_cast(g.y as int), cast({month} as int), try_cast({day} as int), try_cast({hour} as int), try_cast({g("i", "0")} as int), try_cast({g("s", "0")} as int)) as timestamp) as wall,
  cast(rpad(left({g("f", "0")}, 6), 6, '0') as bigint) as frac, trim({g("z", "")}) as z from (select *, regexp_extract(v, '{pattern}', [{listed}]) as g from src where regexp_matches(v, '{pattern}'))"""


_P3 = (
    f"""with src as (select tab, row_key, {_T.format("content")} as v, home_zone, locale from (
  select distinct 'metadata_elements' as tab, elem_key as row_key, content, feed from metadata_elements where kind = 'date'
  union select 'metas', meta_key, content, feed from metas where property like 'dcterms:%') left join feeds using (feed)),
civil as ("""
    + "\nunion all ".join(_civil(*c) for c in _CIVIL)
    + r"""), zoned as (select *,
  case when upper(z) = 'Z' then 0 when regexp_matches(z, '^[+-]\d{2}:?\d{2}$') then (cast(z[2:3] as int) * 60 + cast(right(z, 2) as int)) * (case when z[1] = '-' then -1 else 1 end) """
    + " ".join(f"when z = '{k}' then {v}" for k, v in ABBREVIATIONS.items())
    + r""" end as minutes, case when z = '' then home_zone when regexp_matches(z, '^\[[A-Za-z]+(/[A-Za-z_]+)*\]$') then z[2:-2] end as region from civil where wall is not null),
moment as (select *, timezone(region, wall) as one from zoned),
first as (select tab, row_key, frac + case when minutes is not null then epoch_us(wall) - cast(minutes as bigint) * 60000000 when timezone(region, one - interval 1 hour) = wall then epoch_us(one - interval 1 hour) else epoch_us(one) end as utc_us from moment)
select tab, row_key, cast(utc_us as bigint) as utc_us from first where utc_us is not null
union all select tab, row_key, cast(v as bigint) * 1000000 from src where regexp_matches(v, '^\d{10}$')
union all select tab, row_key, cast(v as bigint) * 1000 from src where regexp_matches(v, '^\d{13}$')"""
)

def _member(name: str) -> str:
    return f"case json_type(j -> '{name}') when 'VARCHAR' then j ->> '{name}' when 'ARRAY' then null when 'NULL' then null else cast(j -> '{name}' as varchar) end as {name}"


def _nodes_of(kind: str, *members: str) -> str:
    return _P1_NODES + f"select distinct set_key, node_path, parent_path, {', '.join(map(_member, members))} from nodes where node_kind = '{kind}'"


ORACLE = {
    "p1_annotations": _nodes_of("annotation", "id", "type", "created", "motivation"),
    "p1_targets": _nodes_of("target", "id", "type", "source"),
    "p1_selectors": _nodes_of("selector", "type", "value"),
    "p1_bodies": _P1_NODES
    + f"""select distinct set_key, node_path, parent_path, {_member("id")}, {_member("type")},
 case json_type(j -> 'value') when 'VARCHAR' then j ->> 'value' when 'OBJECT' then j -> 'value' ->> 'text' when 'ARRAY' then null when 'NULL' then null else cast(j -> 'value' as varchar) end as value,
 case when json_type(j -> 'value') = 'OBJECT' then j -> 'value' ->> 'language' end as language from nodes where node_kind = 'body'""",
    "p3_found": _P3,
    "p1_found": _P1_NODES + "select distinct set_key, node_path, parent_path, node_kind from nodes where node_kind <> 'root'",
    "p4_found": _P4 + "select * from found",
    "p4_report": _P4 + "select ref_table, ref_field, reason, period, count(*) as n_orphans from found group by all",
    "p5_found": _P5_WALK + "select tree, node_key, root_key, depth, cycle_state, array_to_string(path, '/') as node_path from judged",
    "p5_descendants": _P5_WALK
    + """, pairs as (select tree, path[i] as ancestor, len(path) - i as distance from (select tree, path, unnest(range(1, len(path))) as i from judged where cycle_state <> 'on'))
select tree, ancestor, count(*) as n_descendants, cast(max(distance) as bigint) as height from pairs group by all""",
}
