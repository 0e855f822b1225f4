"""Queries of the publication operators over whole tables, named by their inventory identifiers, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.functions import values as V
from codexmill.operators import catalog, content
from codexmill.operators import inventory as I
from codexmill.session import table

_XML = r"E' \t\r\n'"


def _typed(s: SparkSession, d: str) -> DataFrame:
    return I.typed_declarations(table(s, d, "declarations"), table(s, d, "publications"))


def _edges(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Typed declarations, and the manifest and navigation references on them."""
    t = _typed(s, d)
    return t, I.manifest_references(t), I.navigation_references(table(s, d, "nav_points"), table(s, d, "publications"), t)


def q_x01_path_errors(s, d):
    h = I.first_copy(table(s, d, "declarations"), "decl_key").where(F.col("href").isNotNull())
    return h.groupBy(F.coalesce(V.path_error(F.col("href")), F.lit("valid")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def q_x02_extensions(s, d):
    h = I.first_copy(table(s, d, "declarations"), "decl_key").where(F.col("href").isNotNull())
    return h.groupBy(F.coalesce(V.extension(F.col("href")), F.lit("")).alias("extension"), V.parent_dir(F.col("href")).alias("parent")).agg(F.count(F.lit(1)).alias("n"))


def q_x04_href_classes(s, d):
    a = table(s, d, "declarations").select(F.lit("declarations").alias("tab"), "href").union(table(s, d, "nav_points").select(F.lit("nav_points"), "authored_href"))
    return a.groupBy("tab", F.coalesce(V.href_class(F.col("href")), F.lit("none")).alias("href_class")).agg(F.count(F.lit(1)).alias("n"))


def q_x10_resolved_targets(s, d):
    return _typed(s, d).select("decl_key", "target_state", "address")


def q_x14_manifest_ids(s, d):
    return _typed(s, d).groupBy("id_state").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("manifest_id").alias("n_ids"))


def q_x16_collapsed_text(s, d):
    t = table(s, d, "documents")
    return t.select("doc_id", F.length(V.collapse_html(F.col("text"))).cast("bigint").alias("n_collapsed"), F.md5(V.collapse_html(F.col("text"))).alias("digest"))


def q_x22_media_types(s, d):
    return _typed(s, d).groupBy(F.coalesce("essence", F.lit("")).alias("essence"), F.coalesce("media_class", F.lit("")).alias("media_class")).agg(F.count(F.lit(1)).alias("n"))


def q_x40_f25_durations(s, d):
    return I.durations(table(s, d, "metas"), _typed(s, d))


def q_x53_utf16_lengths(s, d):
    return table(s, d, "documents").select("doc_id", V.utf16_length(F.col("text")).alias("n_utf16"), F.length("text").cast("bigint").alias("n_points"))


def q_j03_reading_order_targets(s, d):
    o = I.first_copy(table(s, d, "reading_order"), "itemref_key").select("pub_id", "itemref_key", "idref")
    return I.resolve_idrefs(o, _typed(s, d), "idref").select("itemref_key", "target_state", "target_decl", "target_address", "candidates")


def q_j04_r01_manifest_references(s, d):
    return I.manifest_references(_typed(s, d)).select("decl_key", "role", "idref", "target_state", "target_decl", "candidates")


def q_j06_n01_resources(s, d):
    return I.resources(table(s, d, "publications"), _typed(s, d)).select("pub_id", "resource_ord", "address_kind", "address", "n_declarations")


def q_j08_overlay_association(s, d):
    t = _typed(s, d)
    return I.overlay_association(table(s, d, "reading_order"), t, I.manifest_references(t)).select("itemref_key", "decl_key", "overlay_state", "overlay_decl")


def q_j09_presentation(s, d):
    return I.presentation(table(s, d, "reading_order"), table(s, d, "metas")).select("itemref_key", "layout_state", "layout", "spread_state")


def q_j21_refinement_targets(s, d):
    return I.refinement_targets(table(s, d, "metas"), table(s, d, "metadata_elements")).select("meta_key", "lookup")


def q_j23_unique_identifiers(s, d):
    return I.unique_identifiers(table(s, d, "publications"), table(s, d, "metadata_elements"))


def q_j24_selections(s, d):
    return I.selections(_typed(s, d))


def q_j26_duplicate_texts(s, d):
    return I.duplicate_groups(table(s, d, "documents"), "doc_id", "text")


def q_j27_members_of_duplicates(s, d):
    t = table(s, d, "documents").withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    return t.join(I.duplicate_groups(t, "doc_id", "text"), "digest", "left_semi").select("doc_id", "digest")


def q_f46_r05_navigation_targets(s, d):
    return _edges(s, d)[2].select("nav_key", "target_kind", "target_address", "fragment")


def q_f47_navigation_points(s, d):
    n = I.first_copy(table(s, d, "nav_points"), "nav_key")
    return n.groupBy("pub_id", "list_index", "semantic").agg(F.count(F.lit(1)).alias("n_points"), F.max(F.size("point_path")).cast("bigint").alias("depth"))


def q_f26_accessibility(s, d):
    return I.accessibility_values(table(s, d, "metas")).select("meta_key", "property", "value")


def q_n03_first_lists(s, d):
    return I.first_lists(table(s, d, "nav_points")).select("pub_id", "semantic", F.col("list_index").cast("bigint").alias("list_index"), "n_points")


def q_w01_broken_references(s, d):
    return I.broken_references(*_edges(s, d)[1:]).select("kind", "role", "source_key", "declared", "reason")


def q_w15_properties(s, d):
    t = _typed(s, d)
    p = t.select(F.lit("manifest").alias("tab"), F.explode("item_properties").alias("property")).union(I.first_copy(table(s, d, "reading_order"), "itemref_key").select(F.lit("spine"), F.explode("item_properties")))
    return p.groupBy("tab", "property").agg(F.count(F.lit(1)).alias("n"))


def q_g01_dependency_closure(s, d):
    c = I.dependency_closure(I.manifest_references(_typed(s, d)))
    return c.groupBy("root").agg(F.count(F.lit(1)).alias("n_reached"), F.max("distance").alias("farthest"))


def q_g05_removal_impact(s, d):
    t, m, n = _edges(s, d)
    return I.removal_impact(t, table(s, d, "reading_order"), m, n)


def q_a01_book_summary(s, d):
    t, m, n = _edges(s, d)
    p = table(s, d, "publications")
    return I.book_summary(p, t, table(s, d, "reading_order"), m, n, I.broken_references(m, n), I.resources(p, t))


def q_a07_corpus_totals(s, d):
    return I.corpus_totals(q_a01_book_summary(s, d))


def q_a11_declared_formats(s, d):
    return I.declared_formats(_typed(s, d))


def q_k12_dublin_core(s, d):
    e = I.first_copy(table(s, d, "metadata_elements"), "elem_key")
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pub_id").alias("books"), F.count("content").alias("n_values"))


def q_t07_compact_text(s, d):
    return table(s, d, "documents").select("doc_id", V.compact(F.col("text")).alias("short"))


def q_f01_text_streams(s, d):
    return content.stream_summary(content.extract(table(s, d, "documents"), "doc_id", "text"), "doc_id")


def q_f05_span_texts(s, d):
    return content.span_texts(content.extract(table(s, d, "documents"), "doc_id", "text"), "doc_id")


def q_w06_a04_executable_states(s, d):
    return content.executable_states(content.extract(table(s, d, "documents"), "doc_id", "text"))


def q_j19_annotation_targets(s, d):
    return content.annotation_targets(table(s, d, "annotation_sets"), table(s, d, "publications"), _typed(s, d)).select("set_key", "node_path", "state", "address", "fragment")


def q_j16_incoming_references(s, d):
    t, _, n = _edges(s, d)
    r = I.resources(table(s, d, "publications"), t)
    return catalog.incoming_references(n, r).groupBy("pub_id", "resource_ord").agg(F.count(F.lit(1)).alias("n_incoming"))


def q_k06_unique_ids(s, d):
    t = _typed(s, d)
    return I.id_targets(t).where(F.col("candidates") == 1).select("pub_id", "manifest_id", F.col("decl").alias("decl_key"))


def q_k07_manifest_resources(s, d):
    return catalog.manifest_resources(I.resources(table(s, d, "publications"), _typed(s, d))).select("pub_id", "resource_ord", "n_declarations")


def q_k16_landmarks(s, d):
    n = I.first_copy(table(s, d, "nav_points"), "nav_key")
    return catalog.list_of(n, "landmarks").select("nav_key", "list_index", "label")


def q_a02_a03_coverage(s, d):
    t, m, n = _edges(s, d)
    bad = lambda c, ok: F.when(F.col(c).isin(*ok), "complete").otherwise("unavailable")
    families = {
        "declarations": t.select(bad("target_state", ("resource",)).alias("state")),
        "manifest_references": m.select(F.when(F.col("target_state") == "ambiguous", "partial").otherwise(bad("target_state", ("declaration",))).alias("state")),
        "navigation_references": n.select(F.when(F.col("target_kind").isin("remote", "data", "external"), "not_applicable").otherwise(bad("target_kind", ("resource", "fragment"))).alias("state")),
    }
    return catalog.coverage(families)


QUERIES = {k: f for k, f in dict(globals()).items() if k.startswith("q_")}


# --- equivalent SQL


def _nodes_sql() -> str:
    from codexmill.plans.oracle import _P1_NODES

    return _P1_NODES


def _fix(x: str) -> str:
    return f"(case when contains({x}, ' ') and trim({x}) = {x} then replace({x}, ' ', '%20') else {x} end)"


def _ok(x: str) -> str:
    return rf"(not regexp_matches({x}, '[\s\x00-\x1F\x7F\\]') and not contains(regexp_replace({x}, '%[0-9A-Fa-f]{{2}}', '', 'g'), '%'))"


def _class(x: str) -> str:
    v = _fix(x)
    target = f"split_part({v}, '#', 1)"
    path = f"split_part({target}, '?', 1)"
    return rf"""(case when {x} is null then null when {x} = '' then 'empty' when not {_ok(v)} then 'invalid' when starts_with({v}, '#') then 'same-document'
      when starts_with({target}, '?') then 'local' when regexp_matches({target}, '^(//|(?i:https?://))') then case when regexp_matches({target}, '^[^/]*//[^/]') then 'remote' else 'invalid' end
      when regexp_matches({target}, '^(?i:data:)') then 'data' when regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*:') then 'external'
      when starts_with({path}, '/') or contains(split_part({path}, '/', 1), ':') or regexp_matches({path}, '(?i)%2f|%5c') then 'invalid' else 'local' end)"""


def _address(x: str, source: str) -> str:
    """Local address of a relative href without percent escapes left."""
    path = f"url_decode(split_part(split_part({_fix(x)}, '#', 1), '?', 1))"
    folded = rf"""list_reduce(list_concat([regexp_replace({source}, '/?[^/]*$', '')], string_split({path}, '/')), lambda a, s: case when a is null or s in ('', '.') then a when s = '..' then case when a = '' then null else regexp_replace(a, '/?[^/]*$', '') end when a = '' then s else a || '/' || s end)"""
    return f"(case when {_class(x)} = 'same-document' then {source} when {_class(x)} = 'local' then case when {path} = '' then {source} else {folded} end end)"


_RASTER = "case essence " + " ".join(f"when '{e}' then '{k}'" for k, es in V.MEDIA_CLASSES.items() for e in es) + " else case when essence like '%+xml' or essence like 'text/%' then 'text' end end"

_TYPED = rf"""d as (select distinct pub_id, decl_key, manifest_ord, id, href, media_type, item_properties, fallback, media_overlay from declarations),
t0 as (select d.*, p.package_path, trim(d.id, {_XML}) as bare, lower(nullif(regexp_extract(trim(media_type), '^([A-Za-z0-9!#$&^_.+-]+/[A-Za-z0-9!#$&^_.+-]+)\s*(?:;.*)?$', 1), '')) as essence,
  {_class("d.href")} as kind, {_address("d.href", "p.package_path")} as local from d left join publications p using (pub_id)),
t as (select pub_id, decl_key, manifest_ord, id, href, fallback, media_overlay, item_properties, essence, {_RASTER} as media_class,
  case when id is null then 'missing' when not regexp_matches(bare, '^[A-Za-z_][A-Za-z0-9._-]*$') then 'invalid' else 'valid' end as id_state,
  case when regexp_matches(bare, '^[A-Za-z_][A-Za-z0-9._-]*$') then bare end as manifest_id,
  case when href is null then 'missing-href' when local is not null or kind in ('remote', 'data', 'external') then 'resource' else 'invalid-href' end as target_state,
  case when local is not null then 'local' when kind in ('remote', 'data', 'external') then kind end as address_kind,
  coalesce(local, case when kind in ('remote', 'external') then split_part(href, '#', 1) when kind = 'data' then href end) as address from t0),
ids as (select pub_id, manifest_id, count(*) as candidates, min(decl_key) as decl, arg_min(address, decl_key) as decl_address from t where manifest_id is not null group by all)"""


def _verdict(ref: str) -> str:
    norm = f"trim({ref}, {_XML})"
    return f"case when {ref} is null then 'none' when not regexp_matches({norm}, '^[A-Za-z_][A-Za-z0-9._-]*$') then 'invalid' when i.candidates is null then 'missing' when i.candidates = 1 then 'declaration' else 'ambiguous' end"


def _ids(rows: str, ref: str) -> str:
    return f"{rows} r left join ids i on i.pub_id = r.pub_id and i.manifest_id = trim({ref}, {_XML})"


_MAN = f"""m0 as (select pub_id, decl_key, manifest_ord, 'fallback' as role, fallback as idref from t where fallback is not null union all select pub_id, decl_key, manifest_ord, 'media-overlay', media_overlay from t where media_overlay is not null),
m as (select r.*, {_verdict("r.idref")} as target_state, case when i.candidates = 1 then i.decl end as target_decl, coalesce(i.candidates, 0) as candidates from {_ids("m0", "r.idref")})"""

_ORD = "o as (select distinct pub_id, itemref_key, idref, item_properties from reading_order)"
_NAV = f"""n0 as (select distinct n.pub_id, nav_key, list_index, point_path, semantic, authored_href, package_path from nav_points n left join publications p using (pub_id) where authored_href is not null),
n1 as (select *, {_class("authored_href")} as kind, {_address("authored_href", "package_path")} as local, nullif(split_part(authored_href, '#', 2), '') as frag from n0),
known as (select distinct pub_id, address from (select pub_id, address from t where address_kind = 'local' union all select pub_id, package_path from publications)),
n as (select n1.pub_id, nav_key, semantic as role, authored_href as declared, local as target_address, case when local is not null then frag end as fragment,
  case when local is null then case when kind in ('remote', 'data', 'external') then kind else 'invalid' end when k.pub_id is null then 'missing-local' when frag is not null then 'fragment' else 'resource' end as target_kind
  from n1 left join known k on k.pub_id = n1.pub_id and k.address = n1.local)"""

_BROKEN = """b as (select pub_id, 'manifest' as kind, role, decl_key as source_key, idref as declared, target_state as reason from m where target_state in ('invalid', 'missing', 'ambiguous')
  union all select pub_id, 'href', role, nav_key, declared, target_kind from n where target_kind in ('missing-local', 'invalid'))"""

_RES = """seen as (select pub_id, address_kind, address, min(rank) as rank, min(seq) as seq, count(decl) as n_declarations from (
  select pub_id, 0 as rank, 0 as seq, 'local' as address_kind, package_path as address, null as decl from publications where package_path is not null
  union all select pub_id, 1, manifest_ord, address_kind, address, decl_key from t where address is not null) group by all),
res as (select pub_id, cast(row_number() over (partition by pub_id order by rank, seq, address_kind, address) - 1 as bigint) as resource_ord, address_kind, address, n_declarations from seen)"""

_SUM = """s as (select p.pub_id, p.status, p.archive_size_bytes,
  (select count(*) from res x where x.pub_id = p.pub_id) as resources, (select count(*) from t x where x.pub_id = p.pub_id) as declarations, (select count(*) from o x where x.pub_id = p.pub_id) as occurrences,
  (select count(*) from b x where x.pub_id = p.pub_id) as broken_references, (select count(*) from m x where x.pub_id = p.pub_id) + (select count(*) from n x where x.pub_id = p.pub_id) as "references" from publications p)"""

_ALL = f"with {_TYPED}, {_MAN}, {_ORD}, {_NAV}, {_BROKEN}, {_RES}"
_ONE = f"with {_TYPED}, {_MAN}"
_H = "with h as (select distinct decl_key, href from declarations where href is not null) "
_CLK = r"""with m9 as (select distinct pub_id, meta_key, content, ltrim(refines, '#') as ref from metas where property = 'media:duration'),
c as (select *, trim(content) as v from m9)"""

_SEGMENTS = r'''parts as (select doc_id, text, regexp_split_to_array(replace(text, '&#39;', chr(39)), '(?i)</?p>') as segs, regexp_extract_all(text, '(?i)</?p>') as tags from documents where text is not null),
 each as (select doc_id, text, unnest(range(len(segs))) as i, unnest(segs) as seg, unnest(list_prepend('', tags)) as tag from parts),
 clean as (select *, trim(regexp_replace(seg, '[\t\n\f\r ]+', ' ', 'g')) as t from each),
 seg as (select *, coalesce(sum(case when t <> '' then length(t) + 1 else 0 end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as pos, count(*) filter (lower(tag) = '<p>') over (partition by doc_id order by i) as n from clean)'''

ORACLE = {
    "q_x01_path_errors": _H
    + r"""select case when href = '' then 'empty' when href like '/%' then 'absolute' when contains(href, '\') then 'backslash' when regexp_matches(href, '[?#]') then 'query-or-fragment' when regexp_matches(href, '[\x00-\x1F\x7F]') then 'control-character'
 when regexp_matches(href, '//|/$') then 'empty-segment' when regexp_matches(href, '(^|/)\.\.?(/|$)') then 'dot-segment' when contains(split_part(href, '/', 1), ':') then 'scheme-like-first-segment' else 'valid' end as verdict, count(*) as n from h group by all""",
    "q_x02_extensions": _H + r"select regexp_extract(href, '(?:^|/)[^/]+\.([^./]*)$', 1) as extension, regexp_replace(href, '/?[^/]*$', '') as parent, count(*) as n from h group by all",
    "q_x04_href_classes": f"with a as (select 'declarations' as tab, href from declarations union all select 'nav_points', authored_href from nav_points) select tab, coalesce({_class('href')}, 'none') as href_class, count(*) as n from a group by all",
    "q_x10_resolved_targets": f"with {_TYPED} select decl_key, target_state, address from t",
    "q_x14_manifest_ids": f"with {_TYPED} select id_state, count(*) as n, count(distinct manifest_id) as n_ids from t group by all",
    "q_x16_collapsed_text": r"select doc_id, length(trim(regexp_replace(text, '[\t\n\f\r ]+', ' ', 'g'))) as n_collapsed, md5(trim(regexp_replace(text, '[\t\n\f\r ]+', ' ', 'g'))) as digest from documents",
    "q_x22_media_types": f"with {_TYPED} select coalesce(essence, '') as essence, coalesce(media_class, '') as media_class, count(*) as n from t group by all",
    "q_x40_f25_durations": f"{_CLK}, {_TYPED}"
    + rf""" select meta_key, r.pub_id, case when ref is null then 'total' else 'item' end as scope,
 case when regexp_matches(v, '^(\d+:)?[0-5]\d:[0-5]\d(\.\d+)?$') then coalesce(try_cast(regexp_extract(v, '^(?:(\d+):)?(\d\d):(\d\d)', 1) as bigint), 0) * 3600000 + cast(regexp_extract(v, '^(?:(\d+):)?(\d\d):(\d\d)', 2) as bigint) * 60000 + cast(regexp_extract(v, '^(?:(\d+):)?(\d\d):(\d\d)', 3) as bigint) * 1000 + coalesce(try_cast(rpad(left(regexp_extract(v, '\.(\d+)$', 1), 3), 3, '0') as bigint), 0)
 when regexp_matches(v, '^\d+(\.\d+)?(h|min|s|ms)?$') then (cast(regexp_extract(v, '^(\d+)', 1) as bigint) * 1000 + coalesce(try_cast(rpad(left(regexp_extract(v, '\.(\d+)', 1), 3), 3, '0') as bigint), 0)) * (case when v like '%min' then 60000 when v like '%ms' then 1 when v like '%h' then 3600000 else 1000 end) // 1000 end as duration_ms,
 {_verdict("r.ref")} as target_state, case when i.candidates = 1 then i.decl end as target_decl from {_ids("c", "r.ref")}""",
    "q_x53_utf16_lengths": r"select doc_id, length(text) + length(regexp_replace(text, '[\x{0}-\x{FFFF}]', '', 'g')) as n_utf16, length(text) as n_points from documents",
    "q_j03_reading_order_targets": f"with {_TYPED}, {_ORD} select itemref_key, {_verdict('r.idref')} as target_state, case when i.candidates = 1 then i.decl end as target_decl, case when i.candidates = 1 then i.decl_address end as target_address, coalesce(i.candidates, 0) as candidates from {_ids('o', 'r.idref')}",
    "q_j04_r01_manifest_references": f"{_ONE} select decl_key, role, idref, target_state, target_decl, candidates from m",
    "q_j06_n01_resources": f"with {_TYPED}, {_RES} select * from res",
    "q_j08_overlay_association": f"{_ONE}, {_ORD}, oo as (select itemref_key, i.decl as decl_key from {_ids('o', 'r.idref')} where i.candidates = 1) select itemref_key, oo.decl_key, m.target_state as overlay_state, m.target_decl as overlay_decl from oo join m on m.decl_key = oo.decl_key and m.role = 'media-overlay'",
    "q_j09_presentation": f"""with {_ORD}, mm as (select distinct pub_id, meta_key, property, content from metas where refines is null and property in ('rendition:layout', 'rendition:spread')),
 l as (select pub_id, count(*) filter (property = 'rendition:layout') as nl, min(content) filter (property = 'rendition:layout') as cl, count(*) filter (property = 'rendition:spread') as ns from mm group by all),
 x as (select o.itemref_key, list_filter(coalesce(item_properties, []), lambda p: p in ('rendition:layout-pre-paginated', 'rendition:layout-reflowable')) as own, list_filter(coalesce(item_properties, []), lambda p: p in ('rendition:spread-none', 'rendition:spread-landscape', 'rendition:spread-portrait', 'rendition:spread-both', 'rendition:spread-auto')) as sp, coalesce(nl, 0) as nl, cl, coalesce(ns, 0) as ns from o left join l using (pub_id)),
 y as (select *, case when len(own) > 0 then len(own) else nl end as n, case when len(sp) > 0 then len(sp) else ns end as k from x)
 select itemref_key, case when n = 0 then 'absent' when n = 1 then 'set' else 'ambiguous' end as layout_state, case when n = 1 then case when len(own) > 0 then replace(own[1], 'rendition:layout-', '') when cl in ('pre-paginated', 'reflowable') then cl end end as layout, case when k = 0 then 'absent' when k = 1 then 'set' else 'ambiguous' end as spread_state from y""",
    "q_j21_refinement_targets": """with m as (select distinct pub_id, meta_key, id, refines from metas), e as (select distinct pub_id, elem_key, id from metadata_elements),
 ids as (select pub_id, id, count(*) as n from (select pub_id, id from e union all select pub_id, id from m) where id is not null group by all)
 select meta_key, case when n is null then 'missing' when n = 1 then 'unique' else 'ambiguous' end as lookup from m left join ids on ids.pub_id = m.pub_id and ids.id = ltrim(m.refines, '#') where m.refines is not null""",
    "q_j23_unique_identifiers": """with e as (select distinct pub_id, elem_key, kind, id, content from metadata_elements where id is not null), i as (select pub_id, id, count(*) as n, min(kind) as kind, min(content) as content from e group by all)
 select p.pub_id, case when n = 1 and kind = 'identifier' then content end as identifier from publications p left join i on i.pub_id = p.pub_id and i.id = p.unique_identifier""",
    "q_j24_selections": f"""with {_TYPED}, r as (select unnest(['nav', 'cover']) as role, unnest(['nav', 'cover-image']) as property),
 c as (select t.pub_id, r.role, count(*) filter (list_contains(item_properties, property)) as candidates, min(decl_key) filter (list_contains(item_properties, property)) as decl from t cross join r group by all)
 select pub_id, role, case when candidates = 0 then 'absent' when candidates = 1 then 'selected' else 'ambiguous' end as state, case when candidates = 1 then decl end as decl_key, candidates from c""",
    "q_j26_duplicate_texts": "select sha256(text) as digest, count(distinct doc_id) as members, min(doc_id) as first_member from documents where text is not null group by all having count(distinct doc_id) > 1",
    "q_j27_members_of_duplicates": "with g as (select sha256(text) as digest from documents where text is not null group by all having count(distinct doc_id) > 1) select doc_id, sha256(text) as digest from documents where sha256(text) in (select digest from g)",
    "q_f46_r05_navigation_targets": f"with {_TYPED}, {_NAV} select nav_key, target_kind, target_address, fragment from n",
    "q_f47_navigation_points": "with n as (select distinct nav_key, pub_id, list_index, semantic, point_path from nav_points) select pub_id, list_index, semantic, count(*) as n_points, max(len(point_path)) as depth from n group by all",
    "q_f26_accessibility": r"""with m as (select distinct pub_id, meta_key, property, content from metas where refines is null and property like 'schema:access%'),
 v as (select meta_key, replace(property, 'schema:', '') as property, unnest(case when property = 'schema:accessModeSufficient' then regexp_split_to_array(content, '\s*,\s*|\s+') else [content] end) as value from m) select * from v where trim(value) <> ''""",
    "q_n03_first_lists": "with n as (select distinct nav_key, pub_id, list_index, semantic from nav_points), l as (select pub_id, semantic, list_index, count(*) as n_points from n group by all) select pub_id, semantic, cast(min(list_index) as bigint) as list_index, arg_min(n_points, list_index) as n_points from l group by all",
    "q_w01_broken_references": f"{_ALL} select kind, role, source_key, declared, reason from b",
    "q_w15_properties": f"with {_TYPED}, {_ORD} select 'manifest' as tab, property, count(*) as n from (select unnest(item_properties) as property from t) group by all union all select 'spine', property, count(*) from (select unnest(item_properties) as property from o) group by all",
    "q_g01_dependency_closure": f"""with recursive {_TYPED}, {_MAN}, e as (select distinct decl_key as a, target_decl as b from m where target_state = 'declaration'),
 w as (select a as root, b as reached, cast(1 as bigint) as distance from e union select w.root, e.b, w.distance + 1 from w join e on e.a = w.reached where w.distance < 64),
 c as (select root, reached, min(distance) as distance from w where root <> reached group by all) select root, count(*) as n_reached, max(distance) as farthest from c group by all""",
    "q_g05_removal_impact": f"""{_ALL}, own as (select pub_id, address, decl_key, manifest_id from t where address_kind = 'local'), own_id as (select distinct pub_id, address, manifest_id from own where manifest_id is not null),
 u as (select pub_id, address, 'declarations' as what from own
  union all select x.pub_id, x.address, 'occurrences' from (select distinct o.pub_id, a.address, itemref_key from o join own_id a on a.pub_id = o.pub_id and a.manifest_id = trim(o.idref, {_XML})) x
  union all select x.pub_id, x.address, x.role from (select distinct m.pub_id, a.address, m.role, m.decl_key from m join own_id a on a.pub_id = m.pub_id and a.manifest_id = trim(m.idref, {_XML})) x
  union all select pub_id, target_address, 'navigation' from n where target_kind in ('resource', 'fragment'))
 select pub_id, address, count(*) filter (what = 'declarations') as declarations, count(*) filter (what = 'occurrences') as occurrences, count(*) filter (what = 'fallback') as fallbacks, count(*) filter (what = 'media-overlay') as overlays, count(*) filter (what = 'navigation') as navigation from u group by all having count(*) filter (what = 'declarations') > 0""",
    "q_a01_book_summary": f"{_ALL}, {_SUM} select * from s",
    "q_a07_corpus_totals": f"""{_ALL}, {_SUM} select count(*) as books, count(*) filter (status = 'failed') as failed, case when count(archive_size_bytes) = count(*) then cast(sum(archive_size_bytes) as bigint) end as archive_size_bytes,
 cast(sum(resources) as bigint) as resources, cast(sum(declarations) as bigint) as declarations, cast(sum(occurrences) as bigint) as occurrences, cast(sum("references") as bigint) as "references", cast(sum(broken_references) as bigint) as broken_references from s""",
    "q_a11_declared_formats": f"""with {_TYPED}, f as (select pub_id, address, count(distinct media_class) as n, min(media_class) as one, count(*) filter (media_class is null) as untold from t where address is not null group by all)
 select pub_id, address, case when n = 0 then 'none' when n = 1 then 'one' else 'conflict' end as classification, case when n = 1 and untold = 0 then one end as hint from f""",
    "q_k12_dublin_core": "with e as (select distinct pub_id, elem_key, kind, content from metadata_elements) select kind, count(*) as n, count(distinct pub_id) as books, count(content) as n_values from e group by all",
    "q_j16_incoming_references": f"{_ALL} select n.pub_id, resource_ord, count(*) as n_incoming from n join res on res.pub_id = n.pub_id and res.address = n.target_address group by all",
    "q_k06_unique_ids": f"with {_TYPED} select pub_id, manifest_id, decl as decl_key from ids where candidates = 1",
    "q_k07_manifest_resources": f"with {_TYPED}, {_RES} select pub_id, resource_ord, n_declarations from res where n_declarations > 0",
    "q_k16_landmarks": "with n as (select distinct nav_key, pub_id, list_index, semantic, label from nav_points), f as (select pub_id, min(list_index) as list_index from n where semantic = 'landmarks' group by all) select nav_key, n.list_index, label from n join f using (pub_id, list_index)",
    "q_a02_a03_coverage": f"""{_ALL}, u as (select 'declarations' as family, case when target_state = 'resource' then 'complete' else 'unavailable' end as state from t
  union all select 'manifest_references', case target_state when 'ambiguous' then 'partial' when 'declaration' then 'complete' else 'unavailable' end from m
  union all select 'navigation_references', case when target_kind in ('remote', 'data', 'external') then 'not_applicable' when target_kind in ('resource', 'fragment') then 'complete' else 'unavailable' end from n)
 select family, count(*) filter (state <> 'not_applicable') as expected, count(*) filter (state = 'complete') as complete, count(*) filter (state = 'partial') as partial, count(*) filter (state = 'unavailable') as unavailable from u group by all""",
    "q_j19_annotation_targets": _nodes_sql()
    + f""", {_TYPED}, g as (select n.set_key, node_path, j ->> 'source' as src, json_type(j -> 'source') as kind, s.pub_id, p.package_path from nodes n join (select set_key, min(pub_id) as pub_id from annotation_sets group by all) s using (set_key) left join publications p on p.pub_id = s.pub_id where node_kind = 'target'),
 h as (select *, {_class("src")} as c, {_address("src", "package_path")} as a from g),
 kn as (select distinct pub_id, address from t where address_kind = 'local')
 select h.set_key, node_path, case when src is null then 'none' when a is null then 'unsupported' when kn.pub_id is null then 'missing' else 'declared' end as state, a as address, case when a is not null then nullif(split_part(src, '#', 2), '') end as fragment
 from h left join kn on kn.pub_id = h.pub_id and kn.address = h.a""",
    # the SQL reads the markup that the table holds: paragraphs and one character reference
    "q_f01_text_streams": f"with {_SEGMENTS} select doc_id, coalesce(length(string_agg(t, chr(10) order by i) filter (t <> '')), 0) as n_stream, count(*) filter (t <> '' and lower(tag) = '<p>') as n_spans, cast(0 as bigint) as n_links, cast(0 as bigint) as n_structure, regexp_matches(any_value(text), '(?i)<script|<[a-z][^<>]*[ ]on[a-z]+=') as executable from seg group by all",
    "q_f05_span_texts": f"with {_SEGMENTS} select doc_id, 'p' as element, cast(n as int) as element_ord, 'body' as role, cast(pos as int) as \"start\", cast(pos + length(t) as int) as \"end\", t as text from seg where t <> '' and lower(tag) = '<p>'",
    "q_w06_a04_executable_states": "select count(*) filter (x) as detected, count(*) filter (not x) as absent, cast(0 as bigint) as unknown from (select regexp_matches(text, '(?i)<script|<[a-z][^<>]*[ ]on[a-z]+=') as x from documents where text is not null)",
    "q_t07_compact_text": r"select doc_id, case when length(c) > 100 then left(c, 97) || '...' else c end as short from (select doc_id, trim(regexp_replace(text, '[\s\x{85}\p{Z}]+', ' ', 'g')) as c from documents)",
}
