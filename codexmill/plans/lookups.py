"""Queries of the catalog, value and edit operators over whole tables, with equivalent SQL. Base tables of the SQL are in ``reference``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.functions import values as V
from codexmill.operators import catalog, edit, hierarchy, references
from codexmill.operators import inventory as I
from codexmill.plans import oracle, problems
from codexmill.plans import reference as R
from codexmill.session import table


def _count(df: DataFrame, *by: Column | str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def _hrefs(s: SparkSession, d: str) -> DataFrame:
    return I.first_copy(table(s, d, "declarations"), "decl_key").where(F.col("href").isNotNull())


def _order(s: SparkSession, d: str) -> DataFrame:
    return I.first_copy(table(s, d, "reading_order"), "itemref_key")


def _points(s: SparkSession, d: str) -> DataFrame:
    return I.first_copy(table(s, d, "nav_points"), "nav_key")


def _resources(s: SparkSession, d: str, typed: DataFrame) -> DataFrame:
    return I.resources(table(s, d, "publications"), typed)


def _entries(typed: DataFrame, publications: DataFrame) -> DataFrame:
    """The entries a container of each book would have: its declared local files, its package and the control files."""
    fixed = F.explode(F.array(F.lit("mimetype"), F.lit("META-INF/container.xml"), F.col("package_path")))
    return typed.where(F.col("address_kind") == "local").select("pub_id", F.col("address").alias("path")).unionByName(publications.select("pub_id", fixed.alias("path"))).where(F.col("path").isNotNull()).distinct()


def q_s04_s18_entries(s, d):
    e = _entries(R._typed(s, d), table(s, d, "publications"))
    kept = e.where(~V.is_control_path(F.col("path")))
    return e.groupBy("pub_id").agg(F.count(F.lit(1)).alias("entries")).join(kept.groupBy("pub_id").agg(F.count(F.lit(1)).alias("resources")), "pub_id", "left")


def q_t01_m23_shared_files(s, d):
    return catalog.shared_files(R._typed(s, d))


def q_e02_e03_e33_preview(s, d):
    """Each declaration with a time of removal removes its file, each other writes it; the last declaration of a path counts."""
    t = R._typed(s, d)
    gone = table(s, d, "declarations").groupBy("decl_key").agg(F.bool_or(F.col("removed_at").isNotNull()).alias("gone"))
    points = R._edges(s, d)[2].where(F.col("target_kind").isin("resource", "fragment")).select("pub_id", F.col("target_address").alias("path")).distinct()
    rows = t.where(F.col("address_kind") == "local").join(gone, "decl_key")
    changes = rows.select("pub_id", F.col("decl_key").alias("seq"), F.when(F.col("gone"), "remove").otherwise("upsert").alias("op"), F.col("address").alias("path"), F.lit(None).cast("binary").alias("bytes"))
    package = table(s, d, "publications").select("pub_id", F.col("package_path").alias("path"))
    seen = edit.preview(points, changes, package)
    return _count(seen, "kind", F.coalesce("reason", F.lit("")).alias("reason"))


def q_e34_u05_committed(s, d):
    t = R._typed(s, d)
    gone = table(s, d, "declarations").groupBy("decl_key").agg(F.bool_or(F.col("removed_at").isNotNull()).alias("gone"))
    base = R._edges(s, d)[2].where(F.col("target_kind").isin("resource", "fragment")).select("pub_id", F.col("target_address").alias("path"), F.lit(None).cast("binary").alias("bytes")).distinct()
    rows = t.where(F.col("address_kind") == "local").join(gone, "decl_key")
    changes = rows.select("pub_id", F.col("decl_key").alias("seq"), F.when(F.col("gone"), "remove").otherwise("upsert").alias("op"), F.col("address").alias("path"), F.lit(None).cast("binary").alias("bytes"))
    return _count(edit.apply_changes(base, edit.preview(base, changes)), "pub_id")


def q_x03_directories(s, d):
    return _count(_hrefs(s, d), V.parent_dir(F.col("href")).alias("directory"), V.file_name(F.col("href")).alias("file"))


def q_x05_href_syntax(s, d):
    return _count(_hrefs(s, d), V.href_syntax_ok(F.col("href")).alias("ok"))


def q_x06_x07_schemes(s, d):
    h = _hrefs(s, d).select("href").unionAll(_points(s, d).where(F.col("authored_href").isNotNull()).select("authored_href"))
    return _count(h, F.coalesce(V.href_scheme(F.col("href")), F.lit("")).alias("scheme"), (V.href_class(F.col("href")) == "remote").alias("remote"))


def q_x08_encoded_separators(s, d):
    return _count(_hrefs(s, d), V.has_encoded_separator(F.col("href")).alias("encoded"))


def q_x09_percent_decoded(s, d):
    return _hrefs(s, d).where(V.href_syntax_ok(F.col("href"))).select("decl_key", V.percent_decoded(F.col("href")).alias("decoded"))


def q_x11_strict_paths(s, d):
    h = _hrefs(s, d).join(table(s, d, "publications").select("pub_id", "package_path"), "pub_id")
    return h.select("decl_key", V.strict_resource_path(F.col("href"), F.col("package_path")).alias("path"))


def q_x15_non_empty(s, d):
    e = I.first_copy(table(s, d, "metadata_elements"), "elem_key")
    return e.groupBy("kind").agg(F.count(V.non_empty(F.col("content"))).alias("n_values"), F.count("content").alias("n_present"))


def q_x17_unicode_collapsed(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(V.collapse_unicode(F.col("text"))).alias("digest"))


def q_x18_directions(s, d):
    return _count(I.first_copy(table(s, d, "metadata_elements"), "elem_key"), "kind", F.coalesce(V.text_direction(F.col("dir")), F.lit("")).alias("direction"))


def q_x20_x21_w19_semantics(s, d):
    c = F.col("semantic")
    return _count(_points(s, d), "semantic", F.coalesce(V.related_role(c), F.lit("")).alias("role"), V.is_deprecated_semantic(c).alias("deprecated"))


def q_x41_x42_clock_kinds(s, d):
    m = I.first_copy(table(s, d, "metas"), "meta_key").where((F.col("property") == "media:duration") & F.col("content").isNotNull())
    return m.groupBy(V.clock_kind(F.col("content")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(V.clock_ms(F.col("content"))).alias("total_ms"))


def q_x44_modified(s, d):
    return table(s, d, "publications").select("pub_id", V.modified_text(F.col("loaded_at")).alias("modified"))


def q_x47_numbers(s, d):
    m = I.first_copy(table(s, d, "metas"), "meta_key").where(F.col("property").isin("group-position", "display-seq"))
    return m.groupBy("property").agg(F.count(V.numeric(F.col("content"))).alias("n_numbers"), F.count(F.lit(1)).alias("n"), F.max(V.numeric(F.col("content"))).alias("greatest"))


def q_x55_tokens(s, d):
    return table(s, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.size(V.tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


def q_f06_text_ranges(s, d):
    return table(s, d, "documents").select("doc_id", V.text_range(F.col("text"), 40, 120).alias("part"))


def q_f28_terms(s, d):
    m = I.first_copy(table(s, d, "metas"), "meta_key")
    return _count(m, "property", F.coalesce(V.accessibility_term(F.col("property"), F.lit(None).cast("string")), F.lit("")).alias("term"))


def q_f29_access_modes(s, d):
    m = I.first_copy(table(s, d, "metas"), "meta_key").where(F.col("property") == "schema:accessMode")
    return _count(m.select(F.explode(F.filter(F.split("content", r"\s*,\s*|\s+"), lambda x: x != "")).alias("mode")), "mode")


def q_j01_href_targets(s, d):
    t, _, n = R._edges(s, d)
    kinds = t.select(F.lit("declarations").alias("tab"), F.coalesce("address_kind", "target_state").alias("target")).unionAll(n.select(F.lit("nav_points"), "target_kind"))
    return _count(kinds, "tab", "target")


def q_j07_reading_order_resources(s, d):
    t = R._typed(s, d)
    o = I.resolve_idrefs(_order(s, d).select("pub_id", "itemref_key", "idref"), t, "idref")
    r = _resources(s, d, t).where(F.col("address_kind").isNotNull()).select(F.col("pub_id").alias("r_pub"), F.col("address").alias("r_address"), "resource_ord")
    return o.join(r, (F.col("pub_id") == F.col("r_pub")) & (F.col("target_address") == F.col("r_address")), "left").select("itemref_key", "target_state", "resource_ord")


def q_j10_n02_fifo_pairs(s, d):
    """The n-th point that names a file with the n-th occurrence of that file in the reading order."""
    t, _, n = R._edges(s, d)
    links = n.where(F.col("target_address").isNotNull()).select("pub_id", F.col("target_address").alias("address"), F.col("nav_key").alias("ord"))
    o = I.resolve_idrefs(_order(s, d).select("pub_id", "itemref_key", "idref"), t, "idref").where(F.col("target_address").isNotNull())
    return catalog.fifo_pairs(links, o.select("pub_id", F.col("target_address").alias("address"), F.col("itemref_key").alias("ord")), "pub_id", "address").select(F.col("link_ord").alias("nav_key"), F.col("slot").alias("itemref_key"))


def q_j17_k20_declaration_references(s, d):
    m = I.manifest_references(R._typed(s, d))
    own = m.groupBy("decl_key").agg(F.count(F.lit(1)).alias("n_references"))
    incoming = m.where(F.col("target_decl").isNotNull()).groupBy(F.col("target_decl").alias("decl_key")).agg(F.count(F.lit(1)).alias("n_incoming"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return own.join(incoming, "decl_key", "full").select("decl_key", zero("n_references"), zero("n_incoming"))


def q_j22_u03_metadata_ids(s, d):
    e = I.first_copy(table(s, d, "metadata_elements"), "elem_key").select("pub_id", F.lit("elements").alias("space"), "id")
    m = I.first_copy(table(s, d, "metas"), "meta_key").select("pub_id", F.lit("metas").alias("space"), "id")
    ids = e.unionByName(m).where(F.col("id").isNotNull())
    return ids.groupBy("pub_id", "id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("space").alias("n_spaces"))


def q_k01_k03_k04_resource_by_path(s, d):
    return catalog.resource_by_path(_resources(s, d, R._typed(s, d)), "OEBPS/text/c001.xhtml").select("pub_id", "resource_ord", "n_declarations")


def q_k02_first_declarations(s, d):
    t = R._typed(s, d)
    return t.where(F.col("manifest_ord") == 0).select("pub_id", "decl_key", "address")


def q_k05_k14_declarations_with_id(s, d):
    return catalog.declarations_with_id(R._typed(s, d), " item000\n").select("pub_id", "decl_key")


def q_k06_declaration_by_id(s, d):
    return catalog.declaration_by_id(R._typed(s, d), "item000").select("pub_id", "decl_key")


def q_k08_declarations_of_resources(s, d):
    t = R._typed(s, d)
    several = catalog.manifest_resources(_resources(s, d, t)).where(F.col("n_declarations") > 1).select("pub_id", "address_kind", "address", "resource_ord")
    return t.select("pub_id", "address_kind", "address", "decl_key").join(several, ["pub_id", "address_kind", "address"]).select("pub_id", "resource_ord", "decl_key")


def q_k11_package_targets(s, d):
    p = table(s, d, "publications").where(F.col("package_path").isNotNull())
    found = p.select("pub_id", V.resolve_href(F.lit("../text/./c%2000.xhtml#a%20b"), F.col("package_path")).alias("t"))
    return found.select("pub_id", "t.kind", "t.address", "t.fragment")


def q_k15_page_list(s, d):
    return catalog.list_of(_points(s, d), "page-list").select("nav_key", "list_index", "label")


def q_k19_references_of_resources(s, d):
    m = I.manifest_references(R._typed(s, d)).where(F.col("source_address").isNotNull())
    return _count(m, "pub_id", "source_address", "role")


def q_k23_annotation_sources(s, d):
    return _count(R.q_j19_annotation_targets(s, d), "state")


def q_n07_neighbours(s, d):
    return catalog.neighbours(_order(s, d)).select("itemref_key", "place", "previous", "following")


def q_a08_merged_coverage(s, d):
    """Coverage counted per feed, then merged."""
    feeds = table(s, d, "publications").select("pub_id", "feed")
    t = R._typed(s, d).join(feeds, "pub_id", "left").withColumn("state", F.when(F.col("target_state") == "resource", "complete").otherwise("unavailable"))
    parts = t.groupBy("feed").agg(F.lit("declarations").alias("family"), F.count(F.lit(1)).alias("expected"), *(F.count_if(F.col("state") == x).alias(x) for x in ("complete", "partial", "unavailable")))
    return catalog.merged_coverage(parts)


def q_a09_searchable_resources(s, d):
    t = R._typed(s, d).where(F.col("essence").isin("application/xhtml+xml", "image/svg+xml") & F.col("address").isNotNull())
    return t.groupBy("pub_id").agg(F.count_distinct("address_kind", "address").alias("n_searchable"))


def q_a10_fingerprint_members(s, d):
    t = table(s, d, "documents").withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    g = I.duplicate_groups(t, "doc_id", "text")
    return t.select("doc_id", "digest").join(g, "digest").select("doc_id", "first_member", "members")


def q_a13_completeness(s, d):
    return catalog.completeness(R.q_a02_a03_coverage(s, d))


def q_a14_incomplete_closures(s, d):
    t = R._typed(s, d)
    c = I.dependency_closure(I.manifest_references(t))
    short = catalog.incomplete(t.withColumn("state", F.when(F.col("target_state") == "resource", "complete").otherwise("unavailable"))).select(F.col("decl_key").alias("reached"))
    return c.join(short, "reached").groupBy("root").agg(F.count(F.lit(1)).alias("n_incomplete"))


def q_a15_overlay_present(s, d):
    m = I.manifest_references(R._typed(s, d))
    return m.groupBy("pub_id").agg(F.bool_or((F.col("role") == "media-overlay") & (F.col("target_state") == "declaration")).alias("has_overlay"))


def q_a16_fragment_universe(s, d):
    n = R._edges(s, d)[2].where(F.col("target_kind") == "fragment")
    return n.groupBy("pub_id", "target_address").agg(F.count(F.lit(1)).alias("n_references"), F.min("nav_key").alias("first_key"), F.count_distinct("fragment").alias("n_fragments"))


def q_a17_n05_t06_budget(s, d):
    """The texts of each book as resources, with 20,000 code points and 30 texts a book allowed."""
    r = table(s, d, "documents").select("pub_id", F.col("doc_id").alias("resource_ord"), F.col("n_chars").alias("size_bytes"))
    return catalog.running_budget(r, 20_000, 30).select(F.col("resource_ord").alias("doc_id"), "state", "issue")


def q_w02_dependency_references(s, d):
    t, m, n = R._edges(s, d)
    roles = m.select("role").unionAll(n.select("role"))
    return _count(roles, "role", references.is_dependency(F.col("role")).alias("dependency"), references.is_navigation(F.col("role")).alias("navigation"))


def q_w04_relative_hrefs(s, d):
    return _count(_points(s, d).where(F.col("authored_href").isNotNull()), "pub_id", V.is_relative_href(F.col("authored_href")).alias("relative"))


def q_w09_w10_w11_incomplete(s, d):
    n = R._edges(s, d)[2].withColumn("state", F.when(F.col("target_kind").isin("remote", "data", "external"), "not_applicable").when(F.col("target_kind").isin("resource", "fragment"), "complete").otherwise("unavailable"))
    return catalog.incomplete(n).select("nav_key", "target_kind")


def q_w13_accessibility_of_property(s, d):
    a = I.accessibility_values(table(s, d, "metas")).where(F.col("property") == "accessibilityFeature")
    return _count(a, "value")


def q_w14_auxiliary_points(s, d):
    n = _points(s, d).withColumn("semantic", F.when(F.col("semantic") == "toc", F.lit(None)).otherwise(F.col("semantic")))
    return _count(catalog.auxiliary_lists(n), "pub_id")


def q_w16_spine_properties(s, d):
    o = _order(s, d)
    return o.groupBy("pub_id").agg(F.count_if(F.array_contains("item_properties", "page-spread-left")).alias("n_left"), F.count_if(F.array_contains("item_properties", "page-spread-right")).alias("n_right"))


def q_w17_essences(s, d):
    e = F.col("essence")
    return R._typed(s, d).agg(F.count_if(e == "application/xhtml+xml").alias("xhtml"), F.count_if(e == "text/css").alias("css"), F.count_if(e == "application/smil+xml").alias("smil"), F.count_if(e == "image/svg+xml").alias("svg"), F.count_if(e == "application/x-dtbncx+xml").alias("ncx"))


def q_g04_closure_pairs(s, d):
    return I.dependency_closure(I.manifest_references(R._typed(s, d)))


def q_g06_move_impact(s, d):
    t, _, n = R._edges(s, d)
    refs = n.join(table(s, d, "publications").select("pub_id", F.col("package_path").alias("source_address")), "pub_id")
    return catalog.move_impact(refs, t)


def q_g07_u06_occurrence_candidates(s, d):
    return catalog.candidates(_order(s, d), R._typed(s, d), "idref", "itemref_key")


def q_g08_manifest_candidates(s, d):
    t = R._typed(s, d)
    m = I.manifest_references(t).select("pub_id", F.concat_ws(":", "role", "decl_key").alias("edge"), "idref")
    return catalog.candidates(m, t, "idref", "edge")


def q_m15_repeated_ids(s, d):
    return catalog.repeated_ids(R._typed(s, d))


def q_m16_m17_spine_use(s, d):
    """Declarations that the spine uses, which therefore must stay, with how often."""
    o = I.resolve_idrefs(_order(s, d).select("pub_id", "itemref_key", "idref"), R._typed(s, d), "idref")
    return o.where(F.col("target_state") == "declaration").groupBy(F.col("target_decl").alias("decl_key")).agg(F.count(F.lit(1)).alias("n_occurrences"))


def q_r12_remote_documents(s, d):
    t = R._typed(s, d).where((F.col("address_kind") == "remote") & F.col("essence").isin("application/xhtml+xml", "text/css", "image/svg+xml", "application/smil+xml"))
    return t.select("pub_id", "address", "essence").distinct()


def q_r15_declared_types(s, d):
    return R._typed(s, d).where(F.col("address").isNotNull() & F.col("essence").isNotNull()).select("pub_id", "address", "essence").distinct()


def q_u02_j29_reference_slots(s, d):
    """Manifest and navigation references under one slot order of each book."""
    _, m, n = R._edges(s, d)
    rank = F.when(F.col("role") == "fallback", 0).otherwise(1)
    rows = m.select("pub_id", F.lit(0).alias("producer"), F.col("decl_key").alias("key"), rank.alias("i"), "role", F.col("idref").alias("declared")).unionByName(n.select("pub_id", F.lit(2).alias("producer"), F.col("nav_key").alias("key"), F.lit(0).alias("i"), "role", "declared"))
    return I.numbered(rows, "pub_id", ["producer", "key", "i"], "slot", I.Scratch(s, "slots")).select("pub_id", "slot", "role", "declared")


def _present(s: SparkSession, d: str) -> DataFrame:
    """Files that the texts of ``documents`` were read from, as entries of their books."""
    p = table(s, d, "publications").select("pub_id", V.parent_dir(F.col("package_path")).alias("home"))
    t = table(s, d, "documents").where(F.col("res_href").isNotNull()).select("pub_id", "res_href", "n_chars").join(p, "pub_id")
    path = F.when(F.col("home") == "", F.col("res_href")).otherwise(F.concat("home", F.lit("/"), "res_href"))
    return t.select("pub_id", path.alias("path"), F.col("n_chars").alias("size_bytes"))


def q_j05_presence(s, d):
    r = I.resources(table(s, d, "publications"), R._typed(s, d), _present(s, d))
    return r.select("pub_id", "resource_ord", "address_kind", "address", "n_declarations", "presence")


def q_w01_missing_resources(s, d):
    """Broken references where the container's files are known: what is declared and not there is broken as well."""
    t, m, n = R._edges(s, d)
    r = I.resources(table(s, d, "publications"), t, _present(s, d))
    return _count(I.broken_references(m, n, r), "kind", "role", "reason")


def q_k09_k10_selected_files(s, d):
    """The selected navigation document and cover of each book, and whether its file is there."""
    t = R._typed(s, d)
    chosen = I.selections(t).where(F.col("state") == "selected").select("role", "decl_key").join(t.select("decl_key", "pub_id", "address"), "decl_key")
    have = _present(s, d).select("pub_id", F.col("path").alias("address"), F.lit(True).alias("present")).distinct()
    return chosen.join(have, ["pub_id", "address"], "left").select("role", "decl_key", "address", F.coalesce("present", F.lit(False)).alias("present"))


def q_t05_first_labels(s, d):
    """The first three texts of each source by their identifier, and how many more there are."""
    t = table(s, d, "documents").where(F.col("source").isNotNull())
    first = t.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    placed = I.numbered(t.select("source", "doc_id"), "source", ["doc_id"], "place", I.Scratch(s, "samples")).where(F.col("place") < 3)
    return placed.join(first, "source").select("source", "doc_id", F.greatest(F.col("n") - 3, F.lit(0)).alias("more"))


def p5_descendant_pairs(s, d):
    return hierarchy.descendants(problems._hierarchy(s, d))


QUERIES = {k: f for k, f in dict(globals()).items() if k.startswith(("q_", "p5_"))}


# --- equivalent SQL

_U = r"[\s\x{85}\p{Z}]"
_P = "n as (select distinct nav_key, pub_id, list_index, semantic, label, authored_href, point_path from nav_points)"
_CLASS = R._class
_T = f"with {R._TYPED}"
_WS = r"E' \t\n\f\r'"
_CHANGED = """gone as (select decl_key, bool_or(removed_at is not null) as gone from declarations group by all), pts as (select distinct pub_id, target_address as path from n where target_kind in ('resource', 'fragment')),
 ch as (select t.pub_id, address as path, arg_max(gone, decl_key) as gone from t join gone using (decl_key) where address_kind = 'local' group by all)"""
_FILES = "fx as (select distinct pub_id, path from (select pub_id, address as path from t where address_kind = 'local' union all select pub_id, unnest(['mimetype', 'META-INF/container.xml', package_path]) from publications) where path is not null)"


_HAVE = """have as (select distinct d.pub_id, case when contains(package_path, '/') then regexp_replace(package_path, '/[^/]*$', '') || '/' else '' end || res_href as path from documents d join publications p using (pub_id) where res_href is not null), all_seen as (select pub_id, address_kind, address, min(place) as place, count(decl) as n_declarations from (
  select pub_id, 0 as place, 'local' as address_kind, package_path as address, null as decl from publications where package_path is not null
  union all select pub_id, 1000000000 + manifest_ord, address_kind, address, decl_key from t where address is not null
  union all select pub_id, 2000000000, 'local', path, null from have) group by all)"""


def _in(x: str, values: tuple | list) -> str:
    return f"{x} in ({', '.join(repr(v) for v in values)})"


ORACLE = {
    "q_s04_s18_entries": f"{_T}, {_FILES} select pub_id, count(*) as entries, nullif(count(*) filter (path <> 'mimetype' and not starts_with(path, 'META-INF/')), 0) as resources from fx group by all",
    "q_t01_m23_shared_files": f"{_T} select pub_id, address, count(*) as n_declarations from t where address_kind = 'local' group by all having count(*) > 1",
    "q_e02_e03_e33_preview": f"{R._ALL}, {_CHANGED} select case when p.package_path is not null then 'refused' when not gone and pts.path is not null then 'replaced' when not gone then 'added' when pts.path is not null then 'removed' else 'none' end as kind, case when p.package_path is not null then 'structural' else '' end as reason, count(*) as n from ch left join pts using (pub_id, path) left join publications p on p.pub_id = ch.pub_id and p.package_path = ch.path group by all",
    "q_e34_u05_committed": f"{R._ALL}, {_CHANGED}, w as (select pub_id, path from pts where (pub_id, path) not in (select (pub_id, path) from ch) union all select pub_id, path from ch where not gone) select pub_id, count(*) as n from w group by all",
    "q_x03_directories": R._H + "select case when contains(href, '/') then regexp_replace(href, '/[^/]*$', '') else '' end as directory, regexp_extract(href, '([^/]*)$', 1) as file, count(*) as n from h group by all",
    "q_x05_href_syntax": R._H + f"select {R._ok(R._fix('href'))} as ok, count(*) as n from h group by all",
    "q_x06_x07_schemes": f"with {_P}, h as (select decl_key, href from (select distinct decl_key, href from declarations) where href is not null union all select nav_key, authored_href from n where authored_href is not null) select lower(regexp_extract(href, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme, {_CLASS('href')} = 'remote' as remote, count(*) as n from h group by all",
    "q_x08_encoded_separators": R._H + "select regexp_matches(split_part(split_part(href, '#', 1), '?', 1), '(?i)%2f|%5c') as encoded, count(*) as n from h group by all",
    "q_x09_percent_decoded": R._H + f"select decl_key, url_decode(href) as decoded from h where {R._ok(R._fix('href'))}",
    "q_x11_strict_paths": f"{_T} select decl_key, case when kind = 'local' and not contains(href, '#') and not regexp_matches(split_part(href, '?', 1), '^/|//|/$|(^|/)\\.\\.?$') then local end as path from t0 where href is not null and package_path is not null",
    "q_x15_non_empty": rf"with e as (select distinct elem_key, kind, content from metadata_elements) select kind, count(nullif(regexp_replace(content, '^{_U}+|{_U}+$', '', 'g'), '')) as n_values, count(content) as n_present from e group by all",
    "q_x17_unicode_collapsed": rf"select doc_id, md5(trim(regexp_replace(text, '{_U}+', ' ', 'g'))) as digest from documents",
    "q_x18_directions": f"with e as (select distinct elem_key, kind, dir from metadata_elements) select kind, case when lower(trim(dir, {_WS})) in ('ltr', 'rtl', 'auto') then lower(trim(dir, {_WS})) else '' end as direction, count(*) as n from e group by all",
    "q_x20_x21_w19_semantics": f"with {_P} select semantic, case when semantic = 'page-list' then 'doc-pagelist' when {_in('semantic', V.ROLE_SEMANTICS)} then 'doc-' || semantic else '' end as role, {_in('semantic', V.DEPRECATED_SEMANTICS)} as deprecated, count(*) as n from n group by all",
    "q_x41_x42_clock_kinds": rf"""with m as (select distinct meta_key, trim(content) as v from metas where property = 'media:duration' and content is not null), k as (select *, case when regexp_matches(v, '^\d+:[0-5]\d:[0-5]\d(\.\d+)?$') then 'full' when regexp_matches(v, '^[0-5]\d:[0-5]\d(\.\d+)?$') then 'partial' when regexp_matches(v, '^\d+(\.\d+)?(h|min|s|ms)?$') then 'count' else 'invalid' end as kind from m),
 p as (select *, string_split(regexp_replace(v, '[^0-9:.]', '', 'g'), ':') as q, case when v like '%min' then 60000 when v like '%ms' then 1 when v like '%h' then 3600000 else 1000 end as unit from k),
 ms as (select kind, case kind when 'full' then cast(q[1] as bigint) * 3600000 + cast(q[2] as bigint) * 60000 + cast(split_part(q[3], '.', 1) as bigint) * 1000 + cast(rpad(left(split_part(q[3], '.', 2), 3), 3, '0') as bigint)
  when 'partial' then cast(q[1] as bigint) * 60000 + cast(split_part(q[2], '.', 1) as bigint) * 1000 + cast(rpad(left(split_part(q[2], '.', 2), 3), 3, '0') as bigint)
  when 'count' then (cast(split_part(q[1], '.', 1) as bigint) * 1000 + cast(rpad(left(split_part(q[1], '.', 2), 3), 3, '0') as bigint)) * unit // 1000 end as ms from p)
 select kind, count(*) as n, cast(sum(ms) as bigint) as total_ms from ms group by all""",
    "q_x44_modified": "select pub_id, strftime(make_timestamp(epoch_us(loaded_at)), '%Y-%m-%dT%H:%M:%SZ') as modified from publications",
    "q_x47_numbers": "with m as (select distinct meta_key, property, content from metas where property in ('group-position', 'display-seq')) select property, count(try_cast(content as double)) as n_numbers, count(*) as n, max(try_cast(content as double)) as greatest from m group by all",
    "q_x55_tokens": rf"select doc_id, cast(len(list_filter(regexp_split_to_array(text, '{_U}+'), lambda x: x <> '')) as bigint) as n_tokens from documents where text is not null",
    "q_f06_text_ranges": "select doc_id, case when length(text) >= 120 then substring(text, 41, 80) end as part from documents",
    "q_f28_terms": "with m as (select distinct meta_key, property from metas) select property, case when " + " or ".join(f"property in ({', '.join(repr((v + ':' if v else '') + n) for n in ns)})" for v, ns in V.ACCESSIBILITY_TERMS.items()) + " then case when contains(property, ':') then property else ':' || property end else '' end as term, count(*) as n from m group by all",
    "q_f29_access_modes": r"with m as (select distinct meta_key, content from metas where property = 'schema:accessMode'), v as (select unnest(regexp_split_to_array(content, '\s*,\s*|\s+')) as mode from m) select mode, count(*) as n from v where mode <> '' group by all",
    "q_j01_href_targets": f"{R._ALL}, k as (select 'declarations' as tab, coalesce(address_kind, target_state) as target from t union all select 'nav_points', target_kind from n) select tab, target, count(*) as n from k group by all",
    "q_j07_reading_order_resources": f"{R._ALL}, v as (select r.pub_id, itemref_key, {R._verdict('r.idref')} as target_state, case when i.candidates = 1 then i.decl_address end as address from {R._ids('o', 'r.idref')}) select itemref_key, target_state, resource_ord from v left join res on res.pub_id = v.pub_id and res.address = v.address",
    "q_j10_n02_fifo_pairs": f"{R._ALL}, l as (select pub_id, target_address as address, nav_key, row_number() over (partition by pub_id, target_address order by nav_key) as k from n where target_address is not null), q as (select r.pub_id, i.decl_address as address, itemref_key, row_number() over (partition by r.pub_id, i.decl_address order by itemref_key) as k from {R._ids('o', 'r.idref')} where i.candidates = 1 and i.decl_address is not null) select nav_key, itemref_key from l left join q using (pub_id, address, k)",
    "q_j17_k20_declaration_references": f"{R._ONE}, a as (select decl_key, 1 as own, 0 as inc from m union all select target_decl, 0, 1 from m where target_decl is not null) select decl_key, cast(sum(own) as bigint) as n_references, cast(sum(inc) as bigint) as n_incoming from a group by all",
    "q_j22_u03_metadata_ids": "with i as (select distinct pub_id, 'elements' as space, elem_key as k, id from metadata_elements union all select distinct pub_id, 'metas', meta_key, id from metas) select pub_id, id, count(*) as n, count(distinct space) as n_spaces from i where id is not null group by all",
    "q_k01_k03_k04_resource_by_path": f"{_T}, {R._RES} select pub_id, resource_ord, n_declarations from res where address_kind = 'local' and address = 'OEBPS/text/c001.xhtml'",
    "q_k02_first_declarations": f"{_T} select pub_id, decl_key, address from t where manifest_ord = 0",
    "q_k05_k14_declarations_with_id": f"{_T} select pub_id, decl_key from t where manifest_id = 'item000'",
    "q_k06_declaration_by_id": f"{_T} select pub_id, decl as decl_key from ids where manifest_id = 'item000' and candidates = 1",
    "q_k08_declarations_of_resources": f"{_T}, {R._RES} select t.pub_id, resource_ord, decl_key from t join res using (pub_id, address_kind, address) where n_declarations > 1",
    "q_k11_package_targets": "select pub_id, 'local' as kind, 'text/c 00.xhtml' as address, 'a b' as fragment from publications where package_path is not null and len(string_split(package_path, '/')) = 2 union all select pub_id, 'invalid', null, null from publications where package_path is not null and not contains(package_path, '/') union all select pub_id, 'local', regexp_replace(package_path, '/[^/]*/[^/]*$', '') || '/text/c 00.xhtml', 'a b' from publications where len(string_split(package_path, '/')) > 2",
    "q_k15_page_list": f"with {_P}, f as (select pub_id, min(list_index) as list_index from n where semantic = 'page-list' group by all) select nav_key, n.list_index, label from n join f using (pub_id, list_index)",
    "q_k19_references_of_resources": f"{R._ONE} select m.pub_id, t.address as source_address, m.role, count(*) as n from m join t using (decl_key) where t.address is not null group by all",
    "q_k23_annotation_sources": f"select state, count(*) as n from ({R.ORACLE['q_j19_annotation_targets']}) group by all",
    "q_n07_neighbours": "with o as (select distinct pub_id, itemref_key, ro_ord from reading_order) select itemref_key, cast(row_number() over w - 1 as bigint) as place, lag(itemref_key) over w as previous, lead(itemref_key) over w as following from o window w as (partition by pub_id order by ro_ord nulls first, itemref_key)",
    "q_a08_merged_coverage": f"{_T} select 'declarations' as family, count(*) as expected, count(*) filter (target_state = 'resource') as complete, cast(0 as bigint) as partial, count(*) filter (target_state <> 'resource') as unavailable from t",
    "q_a09_searchable_resources": f"{_T} select pub_id, count(distinct (address_kind, address)) as n_searchable from t where essence in ('application/xhtml+xml', 'image/svg+xml') and address is not null group by all",
    "q_a10_fingerprint_members": "with g as (select sha256(text) as digest, count(distinct doc_id) as members, min(doc_id) as first_member from documents where text is not null group by all having count(distinct doc_id) > 1) select doc_id, first_member, members from documents join g on sha256(text) = g.digest",
    "q_a13_completeness": f"select family, complete = expected as is_complete from ({R.ORACLE['q_a02_a03_coverage']})",
    "q_a14_incomplete_closures": R.ORACLE["q_g01_dependency_closure"].rsplit(" select root", 1)[0] + " select root, count(*) as n_incomplete from c join t on t.decl_key = c.reached where t.target_state <> 'resource' group by all",
    "q_a15_overlay_present": f"{R._ONE} select pub_id, bool_or(role = 'media-overlay' and target_state = 'declaration') as has_overlay from m group by all",
    "q_a16_fragment_universe": f"{R._ALL} select pub_id, target_address, count(*) as n_references, min(nav_key) as first_key, count(distinct fragment) as n_fragments from n where target_kind = 'fragment' group by all",
    "q_a17_n05_t06_budget": "with b as (select doc_id, sum(n_chars) over w > 20000 or row_number() over w > 30 as cut from documents window w as (partition by pub_id order by doc_id rows unbounded preceding)) select doc_id, case when coalesce(cut, false) then 'unavailable' else 'complete' end as state, case when coalesce(cut, false) then 'limit' end as issue from b",
    "q_w02_dependency_references": f"{R._ALL}, r as (select role from m union all select role from n) select role, role in ('fallback', 'media-overlay') as dependency, role in ('toc', 'page-list', 'landmarks') as navigation, count(*) as n from r group by all",
    "q_w04_relative_hrefs": f"with {_P} select pub_id, {_CLASS('authored_href')} in ('local', 'same-document', 'empty') as relative, count(*) as n from n where authored_href is not null group by all",
    "q_w09_w10_w11_incomplete": f"{R._ALL} select nav_key, target_kind from n where target_kind in ('missing-local', 'invalid')",
    "q_w13_accessibility_of_property": "with m as (select distinct meta_key, content from metas where refines is null and property = 'schema:accessibilityFeature') select content as value, count(*) as n from m where trim(content) <> '' group by all",
    "q_w14_auxiliary_points": f"with {_P} select pub_id, count(*) as n from n where semantic is null or semantic not in ('page-list', 'landmarks') group by all",
    "q_w16_spine_properties": f"with {R._ORD} select pub_id, count(*) filter (list_contains(item_properties, 'page-spread-left')) as n_left, count(*) filter (list_contains(item_properties, 'page-spread-right')) as n_right from o group by all",
    "q_w17_essences": f"{_T} select " + ", ".join(f"count(*) filter (essence = '{e}') as {n}" for n, e in (("xhtml", "application/xhtml+xml"), ("css", "text/css"), ("smil", "application/smil+xml"), ("svg", "image/svg+xml"), ("ncx", "application/x-dtbncx+xml"))) + " from t",
    "q_g04_closure_pairs": R.ORACLE["q_g01_dependency_closure"].rsplit(" select root", 1)[0] + " select root, reached, distance from c",
    "q_g06_move_impact": f"{R._ALL}, own as (select distinct pub_id, address from t where address_kind = 'local'), nr as (select n.*, package_path as source_address from n join publications using (pub_id)), inc as (select pub_id, target_address as address, count(*) as k from nr where source_address is distinct from target_address group by all), outg as (select pub_id, source_address as address, count(*) as k from nr where {_CLASS('declared')} in ('local', 'same-document', 'empty') group by all) select own.pub_id, own.address, coalesce(inc.k, 0) as incoming, coalesce(outg.k, 0) as outgoing from own left join inc on inc.pub_id = own.pub_id and inc.address = own.address left join outg on outg.pub_id = own.pub_id and outg.address = own.address",
    "q_g07_u06_occurrence_candidates": f"{_T}, {R._ORD} select itemref_key, t.decl_key from o join t on t.pub_id = o.pub_id and t.manifest_id = trim(o.idref, {R._XML})",
    "q_g08_manifest_candidates": f"{R._ONE} select m.role || ':' || m.decl_key as edge, t.decl_key from m join t on t.pub_id = m.pub_id and t.manifest_id = trim(m.idref, {R._XML})",
    "q_m15_repeated_ids": f"{_T} select pub_id, manifest_id, candidates as n from ids where candidates > 1",
    "q_m16_m17_spine_use": f"{_T}, {R._ORD} select i.decl as decl_key, count(*) as n_occurrences from {R._ids('o', 'r.idref')} where i.candidates = 1 group by all",
    "q_r12_remote_documents": f"{_T} select distinct pub_id, address, essence from t where address_kind = 'remote' and essence in ('application/xhtml+xml', 'text/css', 'image/svg+xml', 'application/smil+xml')",
    "q_r15_declared_types": f"{_T} select distinct pub_id, address, essence from t where address is not null and essence is not null",
    "q_u02_j29_reference_slots": f"{R._ALL}, u as (select pub_id, 0 as producer, decl_key as key, case role when 'fallback' then 0 else 1 end as i, role, idref as declared from m union all select pub_id, 2, nav_key, 0, role, declared from n) select pub_id, cast(row_number() over (partition by pub_id order by producer, key, i) - 1 as bigint) as slot, role, declared from u",
    "q_j05_presence": f"{R._ALL}, {_HAVE} select pub_id, cast(row_number() over (partition by pub_id order by place, address_kind, address) - 1 as bigint) as resource_ord, address_kind, address, n_declarations, case when address_kind <> 'local' then 'not-applicable' when (pub_id, address) in (select (pub_id, path) from have) then 'present' else 'missing' end as presence from all_seen",
    "q_w01_missing_resources": f"{R._ALL}, {_HAVE}, gone as (select distinct pub_id, address from all_seen where address_kind = 'local' and (pub_id, address) not in (select (pub_id, path) from have)), w as (select 'manifest' as kind, role, target_state as reason from m where target_state in ('invalid', 'missing', 'ambiguous') union all select 'href', role, case when target_kind in ('missing-local', 'invalid') then target_kind when g.pub_id is not null then 'missing-resource' end from n left join gone g on g.pub_id = n.pub_id and g.address = n.target_address) select kind, role, reason, count(*) as n from w where reason is not null group by all",
    "q_k09_k10_selected_files": f"{_T}, r as (select unnest(['nav', 'cover']) as role, unnest(['nav', 'cover-image']) as property), c as (select t.pub_id, r.role, min(decl_key) as decl from t join r on list_contains(item_properties, property) group by all having count(*) = 1), {_HAVE.split(', all_seen')[0]} select c.role, t.decl_key, t.address, t.address is not null and (t.pub_id, t.address) in (select (pub_id, path) from have) as present from c join t on t.decl_key = c.decl",
    "q_t05_first_labels": "select source, doc_id, greatest(n - 3, 0) as more from (select source, doc_id, row_number() over (partition by source order by doc_id) as k, count(*) over (partition by source) as n from documents where source is not null) where k <= 3",
    "p5_descendant_pairs": oracle._P5_WALK + "select tree, path[i] as ancestor, node_key, cast(len(path) - i as bigint) as distance from (select tree, node_key, path, unnest(range(1, len(path))) as i from judged where cycle_state <> 'on')",
}
