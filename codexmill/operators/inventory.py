"""Resource inventory, identifier joins and authored references of a publication corpus.

Every join keeps its reason: an id names nothing, one or several declarations, and an href is invalid, missing or a
resource. All shuffles are on the book and the id or address; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.functions import values as V
from codexmill.session import Scratch


def first_copy(rows: DataFrame, key: str, by: str = "loaded_at") -> DataFrame:
    """One row a key: the copy that arrived first; of equal arrivals the smallest in the order of the columns."""
    first = Window.partitionBy(key).orderBy(by, *(c for c in rows.columns if c not in (key, by)))  # the few copies of a row
    return rows.withColumn("_copy", F.row_number().over(first)).where(F.col("_copy") == 1).drop("_copy")


def typed_declarations(declarations: DataFrame, publications: DataFrame) -> DataFrame:
    """Declarations with id state, resolved target and media type."""
    d = first_copy(declarations, "decl_key").join(publications.select("pub_id", "package_path"), "pub_id", "left")
    state = F.when(F.col("href").isNull(), "missing-href").when(F.col("t_kind") == "invalid", "invalid-href").otherwise("resource")
    typed = V.with_target(d, "href", "package_path").withColumns({"manifest_id": V.manifest_id(F.col("id")), "id_state": V.id_state(F.col("id")), "essence": V.essence(F.col("media_type"))})
    # written once: several joins read it, and a filter on its columns must not be pushed into the resolution
    return Scratch(declarations.sparkSession, "declarations").cut(_typed_columns(typed, state))


def _typed_columns(typed: DataFrame, state: Column) -> DataFrame:
    return typed.select("pub_id", "decl_key", "manifest_ord", "id", "id_state", "manifest_id", "href", state.alias("target_state"), F.when(F.col("t_kind") != "invalid", F.col("t_kind")).alias("address_kind"), F.col("t_address").alias("address"), "media_type", "essence", V.media_class(F.col("essence")).alias("media_class"), "item_properties", "fallback", "media_overlay")


def id_targets(typed: DataFrame) -> DataFrame:
    """(pub_id, manifest_id): how many declarations carry the id, and the one if it is one."""
    one = typed.where(F.col("manifest_id").isNotNull()).groupBy("pub_id", "manifest_id").agg(F.count(F.lit(1)).alias("candidates"), F.min("decl_key").alias("decl"), F.min_by("address", "decl_key").alias("decl_address"))
    return one


def resolve_idrefs(refs: DataFrame, typed: DataFrame, ref: str) -> DataFrame:
    """``refs`` with the verdict on the id in column ``ref``: target_state none, invalid, missing, declaration or ambiguous, target_decl, target_address, candidates."""
    ids = id_targets(typed).select(F.col("pub_id").alias("i_pub"), F.col("manifest_id").alias("i_id"), "candidates", "decl", "decl_address")
    r = refs.withColumn("norm", V.manifest_id(F.col(ref)))
    j = r.join(ids, (r.pub_id == F.col("i_pub")) & (F.col("norm") == F.col("i_id")), "left")
    state = F.when(F.col(ref).isNull(), "none").when(F.col("norm").isNull(), "invalid").when(F.col("candidates").isNull(), "missing").when(F.col("candidates") == 1, "declaration").otherwise("ambiguous")
    sure = lambda c: F.when(F.col("candidates") == 1, F.col(c))
    return j.select(*refs.columns, state.alias("target_state"), sure("decl").alias("target_decl"), sure("decl_address").alias("target_address"), F.coalesce("candidates", F.lit(0).cast("bigint")).alias("candidates"))


def numbered(rows: DataFrame, key: str, order: list[str], name: str, scratch: Scratch, amount: str | None = None) -> DataFrame:
    """``rows`` with their place from 0 on inside ``key``, in ``order``; with ``amount`` also its running sum as ``<name>_sum``.

    The rows are ranged over all tasks by key and order, numbered where they lie and moved by what the ranges before hold of
    their key, so that no task sorts a whole book. Of equal rows any may come first.
    """
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    held = scratch.cut(ranged.withColumn("_row", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_row", 33))
    # one row a task and key: what stands before each of them
    parts = held.groupBy(key, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(amount) if amount else F.lit(None), F.lit(0)).alias("_a"))
    ahead = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(ahead), F.lit(0)) - F.col("_first")).alias("_shift"), F.coalesce(F.sum("_a").over(ahead), F.lit(0)).alias("_base"))
    if amount:
        own = Window.partitionBy(key, "_part").orderBy("_row")  # inside one range
        held = held.withColumn("_run", F.coalesce(F.sum(amount).over(own), F.lit(0)))
    out = held.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p"))).withColumn(name, (F.col("_row") + F.col("_shift")).cast("bigint"))
    if amount:
        out = out.withColumn(f"{name}_sum", F.col("_run") + F.col("_base")).drop("_run")
    return out.drop("_row", "_p", "_key", "_part", "_shift", "_base")


def resources(publications: DataFrame, typed: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Distinct resources with ordinals by first appearance: the package, then declarations, then container entries.

    ``entries`` (pub_id, path, size_bytes) tells the presence of local resources; without it presence is null.
    """
    package = publications.where(F.col("package_path").isNotNull()).select("pub_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("seq"), F.lit("local").alias("address_kind"), F.col("package_path").alias("address"), F.lit(None).cast("bigint").alias("decl"))
    declared = typed.where(F.col("address").isNotNull()).select("pub_id", F.lit(1), F.col("manifest_ord").cast("bigint"), "address_kind", "address", "decl_key")
    parts = [package, declared]
    if entries is not None:
        kept = entries.where(~V.is_control_path(F.col("path")))
        parts.append(kept.select("pub_id", F.lit(2), F.lit(0).cast("bigint"), F.lit("local"), "path", F.lit(None).cast("bigint")))  # by their path
    seen = reduce(DataFrame.union, parts).groupBy("pub_id", "address_kind", "address").agg(F.min(F.struct("rank", "seq", F.coalesce("decl", F.lit(-1).cast("bigint")))).alias("at"), F.count("decl").alias("n_declarations"))
    placed = numbered(seen, "pub_id", ["at", "address_kind", "address"], "resource_ord", Scratch(typed.sparkSession, "resources")).drop("at")
    if entries is None:
        return placed.withColumn("presence", F.when(F.col("address_kind") != "local", "not-applicable"))
    have = entries.groupBy(F.col("pub_id").alias("e_pub"), F.col("path").alias("e_path")).agg(F.max("size_bytes").alias("size_bytes"))
    joined = placed.join(have, (F.col("pub_id") == F.col("e_pub")) & (F.col("address") == F.col("e_path")) & (F.col("address_kind") == "local"), "left")
    return joined.withColumn("presence", F.when(F.col("address_kind") != "local", "not-applicable").when(F.col("e_path").isNotNull(), "present").otherwise("missing")).drop("e_pub", "e_path")


def manifest_references(typed: DataFrame) -> DataFrame:
    """Fallback and overlay edges of the declarations, with their verdict."""
    parts = F.array(F.struct(F.lit("fallback").alias("role"), F.col("fallback").alias("idref")), F.struct(F.lit("media-overlay").alias("role"), F.col("media_overlay").alias("idref")))
    edges = typed.select("pub_id", "decl_key", "manifest_ord", F.col("address").alias("source_address"), F.explode(parts).alias("e")).select("pub_id", "decl_key", "manifest_ord", "source_address", "e.role", "e.idref").where(F.col("idref").isNotNull())
    return resolve_idrefs(edges, typed, "idref")


def navigation_references(points: DataFrame, publications: DataFrame, typed: DataFrame) -> DataFrame:
    """Edges of navigation points, resolved against the package document: target_kind resource, fragment, missing-local, invalid, remote, data or external."""
    n = first_copy(points, "nav_key").where(F.col("authored_href").isNotNull())
    p = Scratch(points.sparkSession, "navigation").cut(V.with_target(n.join(publications.select("pub_id", "package_path"), "pub_id", "left"), "authored_href", "package_path"))
    known = typed.where(F.col("address_kind") == "local").select(F.col("pub_id").alias("k_pub"), F.col("address").alias("k_address")).union(publications.select("pub_id", "package_path")).distinct()
    j = p.join(known, (F.col("pub_id") == F.col("k_pub")) & (F.col("t_address") == F.col("k_address")), "left")
    kind = F.when(F.col("t_kind") != "local", F.col("t_kind")).when(F.col("k_pub").isNull(), "missing-local").when(F.col("t_fragment").isNotNull(), "fragment").otherwise("resource")
    return j.select("pub_id", "nav_key", "list_index", "point_path", F.col("semantic").alias("role"), F.col("authored_href").alias("declared"), kind.alias("target_kind"), F.col("t_address").alias("target_address"), F.col("t_fragment").alias("fragment"))


def broken_references(manifest: DataFrame, navigation: DataFrame, resources_: DataFrame | None = None, content: DataFrame | None = None) -> DataFrame:
    """References known to be broken; remote, data and external ones never are, and what is unknown is not.

    With ``content`` also those of its documents, told by source_address.
    """
    if content is not None:
        navigation = navigation.unionByName(content, allowMissingColumns=True)
    m = manifest.where(F.col("target_state").isin("invalid", "missing", "ambiguous")).select("pub_id", F.lit("manifest").alias("kind"), "role", F.col("decl_key").alias("source_key"), F.col("idref").alias("declared"), F.col("target_state").alias("reason"))
    bad = F.col("target_kind").isin("missing-local", "invalid")
    rows = navigation.withColumn("reason", F.when(bad, F.col("target_kind")))
    if resources_ is not None:
        gone = resources_.where(F.col("presence") == "missing").select(F.col("pub_id").alias("g_pub"), F.col("address").alias("g_address"))
        rows = rows.join(gone, (F.col("pub_id") == F.col("g_pub")) & (F.col("target_address") == F.col("g_address")), "left").withColumn("reason", F.coalesce("reason", F.when(F.col("g_pub").isNotNull(), "missing-resource")))
    told = [] if content is None else ["source_address"]
    n = rows.where(F.col("reason").isNotNull()).select("pub_id", F.lit("href").alias("kind"), "role", F.col("nav_key").alias("source_key"), "declared", "reason", *told)
    return m.unionByName(n, allowMissingColumns=True)


def selections(typed: DataFrame) -> DataFrame:
    """Structural roles by manifest property: per book and role absent, selected or ambiguous."""
    roles = {"nav": "nav", "cover": "cover-image"}
    per = typed.groupBy("pub_id").agg(*(x for r, p in roles.items() for x in (F.count_if(F.array_contains("item_properties", p)).alias(f"n_{r}"), F.min(F.when(F.array_contains("item_properties", p), F.col("decl_key"))).alias(f"d_{r}"))))
    each = per.select("pub_id", F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"n_{r}").alias("candidates"), F.col(f"d_{r}").alias("decl")) for r in roles))).alias("s")).select("pub_id", "s.*")
    state = F.when(F.col("candidates") == 0, "absent").when(F.col("candidates") == 1, "selected").otherwise("ambiguous")
    return each.select("pub_id", "role", state.alias("state"), F.when(F.col("candidates") == 1, F.col("decl")).alias("decl_key"), "candidates")


def resource_selections(typed: DataFrame, spine: DataFrame, opf2_metas: DataFrame) -> DataFrame:
    """Navigation, cover and NCX of each book: absent, selected, ambiguous or unresolved, by what, and the declaration.

    The cover falls back to the id in the first legacy meta named cover only where no item has the property; the NCX is the id
    that the spine names. ``spine`` (pub_id, toc), ``opf2_metas`` (pub_id, ord, name, content).
    """
    marked = selections(typed).withColumn("source", F.when(F.col("role") == "nav", "nav-property").otherwise("cover-image-property"))
    legacy = opf2_metas.where(F.lower("name") == "cover").groupBy("pub_id").agg(F.min_by("content", "ord").alias("authored"))
    named = legacy.select("pub_id", F.lit("cover").alias("role"), "authored", F.lit("legacy-cover").alias("source")).unionByName(spine.where(F.col("toc").isNotNull()).select("pub_id", F.lit("ncx").alias("role"), F.col("toc").alias("authored"), F.lit("spine-toc").alias("source")))
    by_id = resolve_idrefs(named, typed, "authored")
    state = F.when(F.col("target_state") == "declaration", "selected").when(F.col("target_state") == "ambiguous", "ambiguous").otherwise("unresolved")
    by_id = by_id.select("pub_id", "role", state.alias("state"), F.col("target_decl").alias("decl_key"), "candidates", "source", "authored")
    plain = marked.where((F.col("role") == "nav") | (F.col("candidates") > 0))
    fallback = by_id.join(plain.select("pub_id", "role"), ["pub_id", "role"], "left_anti")
    found = plain.unionByName(fallback, allowMissingColumns=True)
    roles = spine.select("pub_id", F.explode(F.array(*(F.lit(r) for r in ("nav", "cover", "ncx")))).alias("role"))
    return roles.join(found, ["pub_id", "role"], "left").withColumn("state", F.coalesce("state", F.lit("absent")))


def overlay_metadata(metas: DataFrame) -> DataFrame:
    """Playback classes and narrators of the media overlays of each book, in their order: kind active-class, playback-active-class or narrator."""
    m = metas.where(F.col("property").isin("media:active-class", "media:playback-active-class", "media:narrator") & V.non_empty(F.col("content")).isNotNull())
    return m.select("pub_id", "ord", F.replace(F.col("property"), F.lit("media:"), F.lit("")).alias("kind"), V.non_empty(F.col("content")).alias("value"))


def refinement_targets(metas: DataFrame, elements: DataFrame) -> DataFrame:
    """Metas that refine something: whether their id names none, one or several elements or metas of the book."""
    m = first_copy(metas, "meta_key")
    ids = first_copy(elements, "elem_key").select("pub_id", F.col("id").alias("ref")).unionByName(m.select("pub_id", F.col("id").alias("ref"))).where(F.col("ref").isNotNull()).groupBy("pub_id", "ref").agg(F.count(F.lit(1)).alias("n"))
    r = m.where(F.col("refines").isNotNull()).withColumn("ref", F.ltrim(F.col("refines"), F.lit("#")))
    j = r.join(ids, ["pub_id", "ref"], "left")
    return j.select("pub_id", "meta_key", "property", "refines", F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("lookup"))


def presentation(order: DataFrame, metas: DataFrame) -> DataFrame:
    """Effective layout, flow, orientation, spread, page spread and centring of each occurrence: its own properties replace the package's as a whole.

    State absent, set or ambiguous; an unrecognised own property does not override. A column ``progression`` of ``order`` (the
    direction of the spine) is passed on.
    """
    known = {"layout": ("pre-paginated", "reflowable"), "flow": ("paginated", "scrolled-continuous", "scrolled-doc", "auto"), "orientation": ("landscape", "portrait", "auto"), "spread": ("none", "landscape", "portrait", "both", "auto")}
    m = first_copy(metas, "meta_key").where(F.col("refines").isNull() & F.col("property").isin([f"rendition:{k}" for k in known]))
    package = m.groupBy("pub_id").agg(*(x for k in known for x in (F.count_if(F.col("property") == f"rendition:{k}").alias(f"p_{k}"), F.min(F.when(F.col("property") == f"rendition:{k}", F.col("content"))).alias(f"c_{k}"))))
    o = first_copy(order, "itemref_key").join(package, "pub_id", "left")
    out = []
    for k, values in known.items():
        wanted = F.array(*(F.lit(f"rendition:{k}-{v}") for v in values))
        own = F.array_intersect(F.coalesce("item_properties", F.array().cast("array<string>")), wanted)
        n = F.when(F.size(own) > 0, F.size(own).cast("bigint")).otherwise(F.coalesce(f"p_{k}", F.lit(0).cast("bigint")))
        value = F.when(F.size(own) > 0, F.replace(own[0], F.lit(f"rendition:{k}-"), F.lit(""))).otherwise(F.when(F.col(f"c_{k}").isin(*values), F.col(f"c_{k}")))
        out += [F.when(n == 0, "absent").when(n == 1, "set").otherwise("ambiguous").alias(f"{k}_state"), F.when(n == 1, value).alias(k)]
    # only its own properties place a page; each token of the family is a candidate
    props = F.coalesce("item_properties", F.array().cast("array<string>"))
    pages = F.transform(F.filter(props, lambda p: p.rlike("^(rendition:)?page-spread-")), lambda p: F.regexp_replace(p, "^(rendition:)?page-spread-", ""))
    page = F.when(F.size(pages) == 1, F.when(pages[0].isin("left", "right", "center"), pages[0]))
    out += [F.when(F.size(pages) == 0, "absent").when(F.size(pages) == 1, "set").otherwise("ambiguous").alias("page_spread_state"), page.alias("page_spread")]
    centred = first_copy(metas, "meta_key").where(F.col("refines").isNull() & (F.col("property") == "rendition:align-x-center")).select(F.col("pub_id").alias("c_pub")).distinct()
    o = o.join(centred, F.col("pub_id") == F.col("c_pub"), "left")
    out.append((F.array_contains(props, "rendition:align-x-center") | F.col("c_pub").isNotNull()).alias("align_x_center"))
    return o.select("pub_id", "itemref_key", *out, *(["progression"] if "progression" in order.columns else []))


def book_summary(publications: DataFrame, typed: DataFrame, order: DataFrame, manifest: DataFrame, navigation: DataFrame, broken: DataFrame, inventory: DataFrame) -> DataFrame:
    """One record a book: counts of resources, declarations, occurrences, references and broken references."""
    counts = {"resources": inventory, "declarations": typed, "occurrences": first_copy(order, "itemref_key"), "broken_references": broken}
    counts["references"] = manifest.select("pub_id").unionByName(navigation.select("pub_id"))
    names = list(counts)
    long = reduce(DataFrame.unionByName, [df.groupBy("pub_id").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(k)) for k, df in counts.items()])
    wide = long.groupBy("pub_id").agg(*(F.sum(F.when(F.col("what") == k, F.col("n")).otherwise(0)).alias(k) for k in names))
    return publications.select("pub_id", "status", "archive_size_bytes").join(wide, "pub_id", "left").select("pub_id", "status", "archive_size_bytes", *(F.coalesce(k, F.lit(0).cast("bigint")).alias(k) for k in names))


def corpus_totals(summary: DataFrame) -> DataFrame:
    """Totals of all books; the archive size is null as soon as one is unknown."""
    sums = [F.sum(c).alias(c) for c in ("resources", "declarations", "occurrences", "references", "broken_references")]
    known = F.when(F.count("archive_size_bytes") == F.count(F.lit(1)), F.try_sum("archive_size_bytes"))
    return summary.agg(F.count(F.lit(1)).alias("books"), F.count_if(F.col("status") == "failed").alias("failed"), known.alias("archive_size_bytes"), *sums)


def reach(edges: DataFrame, scratch: Scratch, *keys: str) -> DataFrame:
    """All (keys, start, reached, distance) along ``edges`` (keys, at, to), with the least distance; nothing reaches itself.

    Breadth-first in doubling steps: what is 2^k to 2^(k+1) levels away is reached over what is exactly 2^k away, so that a
    chain of d levels takes log2(d) joins. Only what is new is followed, so that cycles end by themselves.
    """
    parts = [scratch.cut(edges.where(F.col("at") != F.col("to")).select(*keys, F.col("at").alias("start"), F.col("to").alias("reached"), F.lit(1).cast("bigint").alias("distance")).distinct())]
    step = 1
    while True:
        known = reduce(DataFrame.unionByName, parts)
        front = parts[-1].where(F.col("distance") == step).select(*keys, "start", F.col("reached").alias("via"))
        beyond = known.select(*keys, F.col("start").alias("via"), "reached", "distance")
        found = front.join(beyond, [*keys, "via"]).where(F.col("start") != F.col("reached")).groupBy(*keys, "start", "reached").agg((F.min("distance") + step).alias("distance"))
        new = scratch.cut(found.join(known.select(*keys, "start", "reached"), [*keys, "start", "reached"], "left_anti"))
        if new.isEmpty():
            return known
        parts.append(new)
        step *= 2


def dependency_closure(manifest: DataFrame) -> DataFrame:
    """Declarations that each declaration needs through fallbacks and overlays, with the least distance: (root, reached, distance)."""
    scratch = Scratch(manifest.sparkSession, "closure")
    edges = manifest.where(F.col("target_state") == "declaration").select(F.col("decl_key").alias("at"), F.col("target_decl").alias("to"))
    return reach(edges, scratch).withColumnRenamed("start", "root")


def removal_impact(typed: DataFrame, order: DataFrame, manifest: DataFrame, navigation: DataFrame, content: DataFrame | None = None) -> DataFrame:
    """What the removal of each local resource touches: its declarations, occurrences, fallback, overlay, navigation and, if given, content references.

    Ambiguous references count for every candidate they may mean.
    """
    own = typed.where(F.col("address_kind") == "local").select("pub_id", "address", "decl_key", "manifest_id")
    at = own.select(F.col("pub_id").alias("o_pub"), F.col("address"), F.col("manifest_id").alias("o_id")).where(F.col("o_id").isNotNull()).distinct()

    def hits(rows: DataFrame, ref: str, key: str) -> DataFrame:
        r = rows.withColumn("norm", V.manifest_id(F.col(ref)))
        return r.join(at, (F.col("pub_id") == F.col("o_pub")) & (F.col("norm") == F.col("o_id"))).select("pub_id", "address", key).distinct()

    parts = {
        "declarations": own.select("pub_id", "address"),
        "occurrences": hits(first_copy(order, "itemref_key"), "idref", "itemref_key").select("pub_id", "address"),
        "fallbacks": hits(manifest.where(F.col("role") == "fallback"), "idref", "decl_key").select("pub_id", "address"),
        "overlays": hits(manifest.where(F.col("role") == "media-overlay"), "idref", "decl_key").select("pub_id", "address"),
        "navigation": navigation.where(F.col("target_kind").isin("resource", "fragment")).select("pub_id", F.col("target_address").alias("address")),
    }
    if content is not None:
        parts["content"] = content.where(F.col("target_kind").isin("resource", "fragment")).select("pub_id", F.col("target_address").alias("address"))
    long = reduce(DataFrame.unionByName, [df.groupBy("pub_id", "address").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(k)) for k, df in parts.items()])
    wide = long.groupBy("pub_id", "address").agg(*(F.sum(F.when(F.col("what") == k, F.col("n")).otherwise(0)).alias(k) for k in parts))
    return wide.where(F.col("declarations") > 0)


def duplicate_groups(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Groups of rows with equal bytes: digest, members, first member. Null contents have no digest."""
    digest = F.sha2(F.col(content).cast("binary"), 256)
    return rows.where(F.col(content).isNotNull()).groupBy(digest.alias("digest")).agg(F.count_distinct(key).alias("members"), F.min(key).alias("first_member")).where(F.col("members") > 1)


def declared_formats(typed: DataFrame) -> DataFrame:
    """Per resource the verdict over its declarations' classes: none, one or conflict, and the hint if all agree."""
    per = typed.where(F.col("address").isNotNull()).groupBy("pub_id", "address").agg(F.count_distinct("media_class").alias("n"), F.min("media_class").alias("one"), F.count_if(F.col("media_class").isNull()).alias("untold"))
    return per.select("pub_id", "address", F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("conflict").alias("classification"), F.when((F.col("n") == 1) & (F.col("untold") == 0), F.col("one")).alias("hint"))


def overlay_association(order: DataFrame, typed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Occurrences whose declaration names an overlay: its state, and its declaration if it is one."""
    o = resolve_idrefs(first_copy(order, "itemref_key").select("pub_id", "itemref_key", "idref"), typed, "idref").where(F.col("target_state") == "declaration")
    m = manifest.where(F.col("role") == "media-overlay").select(F.col("decl_key").alias("m_decl"), F.col("target_state").alias("overlay_state"), F.col("target_decl").alias("overlay_decl"))
    return o.join(m, F.col("target_decl") == F.col("m_decl")).select("pub_id", "itemref_key", F.col("target_decl").alias("decl_key"), "overlay_state", "overlay_decl")


def durations(metas: DataFrame, typed: DataFrame) -> DataFrame:
    """Media durations in milliseconds: scope total or item, and the verdict on the declaration that an item names."""
    m = first_copy(metas, "meta_key").where(F.col("property") == "media:duration").withColumn("ref", F.ltrim(F.col("refines"), F.lit("#")))
    j = resolve_idrefs(m.select("pub_id", "meta_key", "content", "ref"), typed, "ref")
    return j.select("pub_id", "meta_key", F.when(F.col("ref").isNull(), "total").otherwise("item").alias("scope"), V.clock_ms(F.col("content")).alias("duration_ms"), "target_state", "target_decl")


def accessibility_values(metas: DataFrame) -> DataFrame:
    """Accessibility metadata of the books, one row a token of multi-valued properties."""
    m = first_copy(metas, "meta_key").where(F.col("refines").isNull() & F.col("property").startswith("schema:access"))
    many = F.when(F.col("property") == "schema:accessModeSufficient", F.split("content", r"\s*,\s*|\s+")).otherwise(F.array("content"))
    return m.select("pub_id", "meta_key", F.regexp_replace("property", "^schema:", "").alias("property"), F.explode(many).alias("value")).where(V.non_empty(F.col("value")).isNotNull())


def first_lists(points: DataFrame) -> DataFrame:
    """Per book and semantic the first list that carries it, and its points."""
    n = first_copy(points, "nav_key")
    lists = n.groupBy("pub_id", "semantic", "list_index").agg(F.count(F.lit(1)).alias("n_points"), F.max(F.size("point_path")).alias("depth"))
    return lists.groupBy("pub_id", "semantic").agg(F.min_by(F.struct("list_index", "n_points", "depth"), "list_index").alias("l")).select("pub_id", "semantic", "l.*")


def unique_identifiers(publications: DataFrame, elements: DataFrame) -> DataFrame:
    """The identifier element that a book's unique-identifier attribute names; none if it names anything else or several."""
    e = first_copy(elements, "elem_key").where(F.col("id").isNotNull())
    ids = e.groupBy("pub_id", "id").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind"), F.min("content").alias("content"))
    j = publications.join(ids, (publications.pub_id == ids.pub_id) & (publications.unique_identifier == ids.id), "left")
    return j.select(publications.pub_id, F.when((F.col("n") == 1) & (F.col("kind") == "identifier"), F.col("content")).alias("identifier"))


