"""All authored references of books in one table, with their targets (one slot a reference).

The producers are united in a fixed order: manifest ids, package links and guide and collections, the selected navigation
document, other NCX documents, XHTML, CSS, SVG and media overlays. Each reference is resolved below the bases that
were authored for it; its target keeps the reason where there is none, and whether a fragment exists is true, false or,
where its document was not read whole or has none, null.

Defined results: a null href is no reference; copies of an occurrence are occurrences of their own; lists of a navigation
document that are no table of contents, page list or landmarks give no references.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexmill.functions import values as V
from codexmill.operators import inventory as I
from codexmill.parsers.hrefs import below_bases
from codexmill.session import Scratch

#: Producers by their place in the order of slots.
PRODUCERS = ("manifest", "package", "navigation", "ncx", "xhtml", "css", "svg", "smil")
# Roles that a publication depends on, and those of navigation.
DEPENDENCY_ROLES = ("audio", "css", "embed", "fallback", "font", "iframe", "image", "import", "media-overlay", "object", "poster", "script", "smil-audio", "smil-text", "source", "stylesheet", "svg", "track", "video")
NAVIGATION_ROLES = ("landmark", "landmarks", "ncx", "page-list", "toc")

_below = F.udf(below_bases, T.StringType(), useArrow=False)


def _no_bases() -> Column:
    return F.array().cast("array<string>")


def is_dependency(role: Column) -> Column:
    return role.isin(*DEPENDENCY_ROLES)


def is_navigation(role: Column) -> Column:
    return role.isin(*NAVIGATION_ROLES)


def book_declarations(tables: dict[str, DataFrame]) -> DataFrame:
    """The manifest items of parsed books in the columns of ``declarations``; the key is the hash of book and place."""
    i = tables["items"]
    return i.select("pub_id", F.xxhash64("pub_id", "ord").alias("decl_key"), F.col("ord").alias("manifest_ord"), "id", "href", "media_type", F.col("properties").alias("item_properties"), "fallback", "media_overlay", F.lit(None).cast("timestamp").alias("loaded_at"))


def _edges(tables: dict[str, DataFrame]) -> DataFrame:
    """Unresolved hrefs: pub_id, producer, place (order inside the producer), source_address, element_ord, link_ord, role, declared, bases."""
    none = lambda t: F.lit(None).cast(t)
    path = tables["publications"].select("pub_id", "package_path")
    order = lambda *c: F.array(*(x if isinstance(x, Column) else F.col(x).cast("bigint") for x in c))
    shape = lambda df, producer, place, source, role, declared, bases=None, element=None, link=None: df.select("pub_id", F.lit(PRODUCERS.index(producer)).alias("producer"), source.alias("source_address"), place.alias("place"), role.alias("role"), declared.alias("declared"), (bases if bases is not None else _no_bases()).alias("bases"), (element if element is not None else none("int")).alias("element_ord"), (link if link is not None else none("int")).alias("link_ord"))

    package = lambda df, kind, place, role, declared: shape(df.join(path, "pub_id"), "package", F.concat(order(F.lit(kind).cast("bigint")), place), F.col("package_path"), F.lit(role), F.col(declared))
    collections = tables["collections"].select("pub_id", "path", F.posexplode("links").alias("i", "href"))
    parts = [
        package(tables["metadata_links"], 0, order("ord"), "metadata", "href"),
        package(tables["guide"], 1, order("ord"), "guide", "href"),
        package(collections, 2, F.concat(F.transform("path", lambda x: x.cast("bigint")), order("i")), "collection", "href"),
    ]
    lists = tables["nav_lists"].select("pub_id", "document", "list_index", "source", "selected", "base")
    points = tables["nav_points"].join(lists, ["pub_id", "document", "list_index"])
    at = F.concat(order("list_index"), F.transform("point_path", lambda x: x.cast("bigint")))
    listed = (F.col("source") == "ncx") | F.col("list_semantic").isin("toc", "page-list", "landmarks")
    role = F.when(F.col("source") == "ncx", "ncx").otherwise(F.col("list_semantic"))
    base = F.when(F.col("base").isNotNull(), F.array("base")).otherwise(_no_bases())
    parts += [shape(points.where(listed & F.col("selected")), "navigation", at, F.col("document"), role, F.col("authored_href"), base), shape(points.where(~F.col("selected") & (F.col("source") == "ncx")), "ncx", at, F.col("document"), role, F.col("authored_href"))]
    links = tables["links"].join(tables["resources"].select("pub_id", "path", "format"), ["pub_id", "path"])
    parts += [shape(links.where(F.col("format") == f), f, order("place"), F.col("path"), F.col("role"), F.col("declared"), F.coalesce("bases", _no_bases()), F.col("element_ord"), F.col("place")) for f in ("xhtml", "css", "svg")]
    parts += [shape(tables["smil"], "smil", order("node_id", F.lit(k).cast("bigint")), F.col("path"), F.lit(r), F.col(c), element=F.col("node_id")) for k, (r, c) in enumerate((("smil-text", "text_ref"), ("smil-audio", "audio_src")))]
    return reduce(DataFrame.unionByName, parts).where(F.col("declared").isNotNull())


def _without_navigation_links(edges: DataFrame) -> DataFrame:
    """Links of the selected navigation document that its points already are, matched in order by what they declare, give no reference of their own; they share the point's (``shared`` is its place)."""
    points = edges.where(F.col("producer") == 2)
    links = edges.where(F.col("producer") == 4)
    rank = lambda df: df.withColumn("nth", F.row_number().over(Window.partitionBy("pub_id", "source_address", "declared").orderBy("place")))
    by = ["pub_id", "source_address", "declared", "nth"]
    matched = rank(links.join(points.select("pub_id", "source_address").distinct(), ["pub_id", "source_address"], "left_semi")).join(rank(points).select(*by, F.col("place").alias("shared")), by).select("pub_id", "source_address", "link_ord", "shared")
    told = edges.join(matched, ["pub_id", "source_address", "link_ord"], "left")
    return told


def resolve(edges: DataFrame, known: DataFrame, contents: DataFrame, fragments: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (pub_id, source_address, bases, declared) with target_kind, target_address, fragment, fragment_exists and presence of the target.

    ``known`` (pub_id, address, presence) are the resources, ``contents`` (pub_id, path, format, content_state), ``fragments`` (pub_id, path, id).
    """
    plain = edges.where(F.size("bases") == 0).withColumn("below", F.col("source_address"))
    based = edges.where(F.size("bases") > 0).withColumn("below", _below("source_address", "bases"))
    p = scratch.cut(V.with_target(plain.unionByName(based), "declared", "below"))
    k = known.groupBy(F.col("pub_id").alias("k_pub"), F.col("address").alias("k_address")).agg(F.max("presence").alias("target_presence"))
    c = contents.select(F.col("pub_id").alias("c_pub"), F.col("path").alias("c_path"), "format", "content_state")
    f = fragments.select(F.col("pub_id").alias("f_pub"), F.col("path").alias("f_path"), F.col("id").alias("f_id")).distinct()
    at = lambda pub, address: (F.col("pub_id") == F.col(pub)) & (F.col("t_address") == F.col(address))
    j = p.join(k, at("k_pub", "k_address") & (F.col("t_kind") == "local"), "left").join(c, at("c_pub", "c_path"), "left").join(f, at("f_pub", "f_path") & (F.col("t_fragment") == F.col("f_id")), "left")
    lost = F.col("below").isNull() & V.href_class(F.col("declared")).isin("local", "same-document")
    kind = F.when(lost, "unsupported-base").when(F.col("t_kind") != "local", F.col("t_kind")).when(F.col("k_pub").isNull(), "missing-local").when(F.col("t_fragment").isNotNull(), "fragment").otherwise("resource")
    exists = F.when(kind != "fragment", None).when(F.col("f_id").isNotNull(), True).when(F.col("format").isin("xhtml", "svg") & (F.col("content_state") == "complete"), False)
    return j.select(*edges.columns, kind.alias("target_kind"), F.col("t_address").alias("target_address"), F.col("t_fragment").alias("fragment"), exists.alias("fragment_exists"), "target_presence")


def all_references(tables: dict[str, DataFrame], typed: DataFrame) -> DataFrame:
    """The references of parsed books: pub_id, slot, producer, source_address, source_decl, element_ord, link_ord, role, declared, target_kind, target_address, target_decl, candidates, fragment, fragment_exists, target_presence.

    Rows without a slot of their own (links of the navigation document that its points are) carry the slot of the point and ``shared`` true.
    """
    scratch = Scratch(typed.sparkSession, "references")
    publications, res = tables["publications"], tables["resources"]
    edges = scratch.cut(_without_navigation_links(_edges(tables)))
    here = res.select("pub_id", F.col("path").alias("address"), F.lit("present").alias("presence"))
    declared = typed.where(F.col("address_kind") == "local").select("pub_id", "address", F.lit("missing").alias("presence"))
    known = here.unionByName(declared).unionByName(publications.where(F.col("package_path").isNotNull()).select("pub_id", F.col("package_path").alias("address"), F.lit("missing").alias("presence")))
    hrefs = resolve(edges, known, res, tables["fragments"], scratch)
    manifest = I.manifest_references(typed).select(
        "pub_id", F.lit(0).alias("producer"), "source_address", F.col("decl_key").alias("source_decl"), F.array(F.col("manifest_ord").cast("bigint"), F.when(F.col("role") == "fallback", 0).otherwise(1).cast("bigint")).alias("place"),
        "role", F.col("idref").alias("declared"), F.concat(F.lit("id-"), "target_state").alias("target_kind"), "target_address", "target_decl", "candidates",
    )
    whole = manifest.unionByName(hrefs, allowMissingColumns=True).withColumn("at", F.coalesce("shared", "place"))
    own = whole.where(F.col("shared").isNull())
    # what has no slot of its own takes that of the point it is
    order = ["producer", F.coalesce("source_address", F.lit("")), "place"]
    slots = scratch.cut(I.numbered(own.withColumn("source_order", order[1]), "pub_id", ["producer", "source_order", "place"], "slot", scratch).drop("source_order"))
    points = slots.where(F.col("producer") == 2).select("pub_id", "source_address", F.col("place").alias("shared"), "slot")
    twice = whole.where(F.col("shared").isNotNull()).join(points, ["pub_id", "source_address", "shared"])
    columns = ["pub_id", "slot", "producer", "source_address", "source_decl", "element_ord", "link_ord", "role", "declared", "target_kind", "target_address", "target_decl", "candidates", "fragment", "fragment_exists", "target_presence"]
    return slots.select(*columns, F.lit(False).alias("shared")).unionByName(twice.select(*columns, F.lit(True).alias("shared")))


def broken(references: DataFrame) -> DataFrame:
    """References known to be broken and why: invalid, missing-local, missing-fragment, missing-resource, or an id that is invalid, missing or ambiguous. Remote, data and external ones never are."""
    why = (
        F.when(F.col("target_kind").isin("missing-local", "invalid", "id-invalid", "id-missing", "id-ambiguous"), F.col("target_kind"))
        .when(F.col("fragment_exists") == F.lit(False), "missing-fragment")
        .when(F.col("target_kind").isin("resource", "fragment") & (F.col("target_presence") == "missing"), "missing-resource")
    )
    return references.where(~F.col("shared")).withColumn("reason", why).where(F.col("reason").isNotNull())


def closure(references: DataFrame, root: str) -> DataFrame:
    """What each resource or declaration needs: (pub_id, start, reached, distance, unresolved), addresses reached through dependency references.

    ``root`` is ``resource`` (each source address) or ``declaration`` (each declared address, fallbacks and overlays included).
    Missing local targets are reached and told by ``unresolved``.
    """
    scratch = Scratch(references.sparkSession, "references-closure")
    deps = references.where(~F.col("shared") & is_dependency(F.col("role")) & F.col("source_address").isNotNull() & F.col("target_address").isNotNull())
    local = deps.where(F.col("target_kind").isin("resource", "fragment", "missing-local", "id-declaration"))
    local = local if root == "declaration" else local.where(F.col("producer") != 0)
    edges = scratch.cut(local.select("pub_id", F.col("source_address").alias("at"), F.col("target_address").alias("to"), (F.col("target_kind") == "missing-local").alias("unresolved")).distinct())
    missing = edges.groupBy("pub_id", F.col("to").alias("reached")).agg(F.bool_or("unresolved").alias("unresolved"))
    return I.reach(edges, scratch, "pub_id").join(missing, ["pub_id", "reached"])


def incomplete_sources(closed: DataFrame, contents: DataFrame) -> DataFrame:
    """Reached documents whose own references are not wholly known, which leave a closure incomplete."""
    short = contents.where(F.col("content_state").isin("partial", "unavailable")).select("pub_id", F.col("path").alias("reached"), "content_state", "content_issue")
    return closed.join(short, ["pub_id", "reached"])


def occurrences(facts: DataFrame, references: DataFrame) -> DataFrame:
    """Media, form or script facts (pub_id, path, element_ord) with the slots of the references of their element, in order; none gives an empty list."""
    r = references.where(F.col("element_ord").isNotNull() & F.col("producer").isin(4, 6)).groupBy("pub_id", F.col("source_address").alias("path"), "element_ord").agg(F.sort_array(F.collect_list("slot")).alias("slots"))  # those of one element
    return facts.join(r, ["pub_id", "path", "element_ord"], "left").withColumn("slots", F.coalesce("slots", F.array().cast("array<bigint>")))


def overlay_nodes(smil: DataFrame, references: DataFrame) -> DataFrame:
    """Overlay nodes with the slots of their text and audio references, null where they have none."""
    r = references.where(F.col("producer") == 7)
    of = lambda role, name: r.where(F.col("role") == role).select("pub_id", F.col("source_address").alias("path"), F.col("element_ord").alias("node_id"), F.col("slot").alias(name))
    return smil.join(of("smil-text", "text_slot"), ["pub_id", "path", "node_id"], "left").join(of("smil-audio", "audio_slot"), ["pub_id", "path", "node_id"], "left")


def certifier_reports(links: DataFrame, references: DataFrame) -> DataFrame:
    """Metadata links that name the report of an accessibility certifier, with the slot of their reference."""
    reports = links.where(F.array_contains(F.split(F.coalesce("rel", F.lit("")), r"\s+"), "a11y:certifierReport")).select("pub_id", "ord", "href", "refines")
    r = references.where((F.col("producer") == 1) & (F.col("role") == "metadata"))
    # the n-th link with an href is the n-th metadata reference of its book
    n = links.where(F.col("href").isNotNull()).withColumn("nth", F.row_number().over(Window.partitionBy("pub_id").orderBy("ord"))).select("pub_id", "ord", "nth")
    slots = r.withColumn("nth", F.row_number().over(Window.partitionBy("pub_id").orderBy("slot"))).select("pub_id", "nth", "slot", "target_kind", "target_address")
    return reports.join(n, ["pub_id", "ord"], "left").join(slots, ["pub_id", "nth"], "left").drop("nth")


def fragment_universe(references: DataFrame, contents: DataFrame) -> DataFrame:
    """Documents that a fragment is looked up in, by their first reference, with the state of their content."""
    first = references.where(F.col("target_kind") == "fragment").groupBy("pub_id", F.col("target_address").alias("path")).agg(F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_references"))
    return first.join(contents.where(F.col("content_state") != "not_applicable").select("pub_id", "path", "content_state", "content_issue"), ["pub_id", "path"])


def producer_coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """How completely the references of each document are known: pub_id, producer, source_address, state, issue."""
    docs = tables["resources"].where(F.col("format").isin("xhtml", "css", "svg", "smil")).select("pub_id", F.col("format").alias("producer"), F.col("path").alias("source_address"), F.col("content_state").alias("state"), F.col("content_issue").alias("issue"))
    remote = V.href_class(F.col("href")) == "remote"
    kind = F.element_at(F.split(V.essence(F.col("media_type")), "/|\\+"), 2)
    document = V.essence(F.col("media_type")).isin("application/xhtml+xml", "text/css", "image/svg+xml", "application/smil+xml")
    away = tables["items"].where(remote & document).select("pub_id", kind.alias("producer"), F.col("href").alias("source_address"), F.lit("unavailable").alias("state"), F.lit("remote").alias("issue")).distinct()
    return docs.unionByName(away)


def fragment_selectors(selectors: DataFrame, fragments: DataFrame, contents: DataFrame) -> DataFrame:
    """Fragment selectors (pub_id, path, value) against the elements of their document: state broken, one, ambiguous or unavailable, and how many."""
    f = fragments.groupBy(F.col("pub_id").alias("f_pub"), F.col("path").alias("f_path"), F.col("id").alias("f_id")).agg(F.count(F.lit(1)).alias("n"))
    c = contents.select(F.col("pub_id").alias("c_pub"), F.col("path").alias("c_path"), "content_state")
    s = selectors.withColumn("wanted", V.percent_decoded(F.ltrim(F.col("value"), F.lit("#"))))
    j = s.join(f, (F.col("pub_id") == F.col("f_pub")) & (F.col("path") == F.col("f_path")) & (F.col("wanted") == F.col("f_id")), "left").join(c, (F.col("pub_id") == F.col("c_pub")) & (F.col("path") == F.col("c_path")), "left")
    state = F.when(F.col("n") > 1, "ambiguous").when(F.col("n") == 1, "one").when(F.col("content_state") == "complete", "broken").otherwise("unavailable")
    return j.select(*selectors.columns, state.alias("state"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n_elements"))


def incoming(references: DataFrame) -> DataFrame:
    """References by what they reach: (pub_id, address, n_incoming, n_from_others); an id reference reaches the file of its declaration."""
    r = references.where(~F.col("shared") & F.col("target_address").isNotNull() & F.col("target_kind").isin("resource", "fragment", "id-declaration"))
    other = ~F.col("source_address").eqNullSafe(F.col("target_address"))
    return r.groupBy("pub_id", F.col("target_address").alias("address")).agg(F.count(F.lit(1)).alias("n_incoming"), F.count_if(other).alias("n_from_others"))


def removal_impact(references: DataFrame, typed: DataFrame, order: DataFrame, publications: DataFrame) -> DataFrame:
    """What the removal of each local resource touches: declarations, occurrences, fallbacks, overlays, navigation and content references. The package document cannot be removed: ``refused``.

    ``order`` (pub_id, idref). Ambiguous ids count for every declaration that they may mean.
    """
    own = typed.where(F.col("address_kind") == "local").select("pub_id", "address", "decl_key", "manifest_id")
    at = own.where(F.col("manifest_id").isNotNull()).select("pub_id", "address", F.col("manifest_id").alias("norm")).distinct()
    by_id = lambda df, c: df.withColumn("norm", V.manifest_id(F.col(c))).join(at, ["pub_id", "norm"])
    local = references.where(~F.col("shared") & F.col("target_kind").isin("resource", "fragment")).select("pub_id", F.col("target_address").alias("address"), "role")
    ids = by_id(references.where(F.col("producer") == 0).select("pub_id", "declared", "role"), "declared")
    parts = {
        "declarations": own,
        "occurrences": by_id(order.select("pub_id", "idref"), "idref"),
        "fallbacks": ids.where(F.col("role") == "fallback"),
        "overlays": ids.where(F.col("role") == "media-overlay"),
        "navigation": local.where(is_navigation(F.col("role"))),
        "content": local.where(~is_navigation(F.col("role"))),
    }
    long = reduce(DataFrame.unionByName, [df.groupBy("pub_id", "address").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(k)) for k, df in parts.items()])
    wide = long.groupBy("pub_id", "address").agg(*(F.sum(F.when(F.col("what") == k, F.col("n")).otherwise(0)).alias(k) for k in parts))
    package = publications.select("pub_id", F.col("package_path").alias("address"), F.lit(True).alias("refused"))
    return wide.join(package, ["pub_id", "address"], "left").withColumn("refused", F.coalesce("refused", F.lit(False)))


def book_summary(tables: dict[str, DataFrame], typed: DataFrame, references: DataFrame) -> DataFrame:
    """One record a parsed book: its resources, declarations, occurrences, references, broken ones, searchable documents and the facts of its content, those of foreign objects included."""
    own = references.where(~F.col("shared"))
    res = tables["resources"]
    counts = {
        "resources": res,
        "searchable": res.where(F.length("text") > 0),
        "declarations": typed,
        "occurrences": tables["itemrefs"],
        "references": own,
        "broken_references": broken(references),
        "media": tables["media"],
        "forms": tables["forms"],
        "scripts": tables["scripts"],
        "foreign_objects": tables["svg_foreign"],
        "executable": res.where(F.col("executable")),
    }
    long = reduce(DataFrame.unionByName, [df.groupBy("pub_id").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(k)) for k, df in counts.items()])
    wide = long.groupBy("pub_id").agg(*(F.sum(F.when(F.col("what") == k, F.col("n")).otherwise(0)).alias(k) for k in counts))
    books = tables["publications"].select("pub_id", "status")
    return books.join(wide, "pub_id", "left").select("pub_id", "status", *(F.coalesce(k, F.lit(0).cast("bigint")).alias(k) for k in counts))
