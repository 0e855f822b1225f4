"""Queries and SQL of the subpackage.

What SQL cannot compute (entities, languages, packs, mixes, scores) is checked by queries whose rows SQL can tell: totals over
whole tables, and numbers of rows that break what every result must satisfy, which are none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexmill.llm import entities, languages, mixing, packing, tokens, truncation
from codexmill.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return entities.spelling_pairs(entities.resolve(entities.name_strings(table(spark, d, "metadata_elements"))))


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    found = entities.resolve(entities.name_strings(table(spark, d, "metadata_elements")))
    return found.groupBy("class", "entity").agg(F.count(F.lit(1)).alias("n_spellings"), F.min("name").alias("first_spelling"))


def p2_members(spark: SparkSession, d: str) -> DataFrame:
    """The entity of each string that names someone."""
    return entities.resolve(entities.name_strings(table(spark, d, "metadata_elements")))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    labelled = documents.select(F.col("doc_id").alias("key"), languages.label_code(F.col("lang")).alias("code"), "text")
    return languages.detect(languages.corpus_texts(documents, table(spark, d, "metadata_elements")), labelled)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    long = _passages(spark, d).where((F.col("chars") >= languages.PASSAGE_CHARS) & (F.col("lang") != F.col("code")))
    return long.select("tab", "row_key", F.col("lang").alias("lang_found")).distinct()


def p6_passages(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d)


def p6_documents(spark: SparkSession, d: str) -> DataFrame:
    """The language of each text as a whole, with its confidence."""
    return languages.text_languages(_passages(spark, d))


def _containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.token_sizes(table(spark, d, "documents")), table(spark, d, "pack_limits"))


def p7_members(spark: SparkSession, d: str) -> DataFrame:
    return packing.members(_containers(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_containers(spark, d))


def _repeats(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(tokens.token_sizes(table(spark, d, "documents"), "source"), table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_repeats(spark, d))


def p8_repeats(spark: SparkSession, d: str) -> DataFrame:
    return _repeats(spark, d)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_repeats(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.score(table(spark, d, "documents")).where(F.col("p_cut") >= truncation.THRESHOLD).select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_rates(truncation.score(table(spark, d, "documents")))


# --- queries that SQL can answer: statistics, and what every result must satisfy


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """Strings with a name per class; each in one entity, entities of one class, no placeholder in any."""
    strings = entities.name_strings(table(spark, d, "metadata_elements"))
    found = entities.resolve(strings)
    per = found.groupBy("class", "name").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("name").isin("Anonymous", "Unknown", "Various", "N/A", "", "-").cast("int")).alias("no_one"))
    wrong = per.groupBy("class").agg(F.count_if(F.col("n") != 1).alias("n_in_several"), F.sum("no_one").cast("bigint").alias("n_placeholders"))
    mixed = found.groupBy("entity").agg(F.min("class").alias("class"), F.max("class").alias("other")).groupBy("class").agg(F.count_if(F.col("class") != F.col("other")).alias("n_mixed"))
    return strings.groupBy("class").agg(F.count(F.lit(1)).alias("n_strings")).join(wrong, "class").join(mixed, "class")


def p6_labels(spark: SparkSession, d: str) -> DataFrame:
    """The language that each label names."""
    return table(spark, d, "documents").groupBy("lang", F.coalesce(languages.label_code(F.col("lang")), F.lit("")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a language per table; confidences within bounds, passages within their texts, shares that are whole."""
    texts = languages.corpus_texts(table(spark, d, "documents"), table(spark, d, "metadata_elements"))
    long = texts.groupBy("tab", "row_key").agg(F.max(F.length("text")).alias("n"))
    p = _passages(spark, d).join(long, ["tab", "row_key"])
    bad = (F.col("confidence") < 0) | (F.col("confidence") > 1.000001) | (F.col("first") < 0) | (F.col("first") + F.col("chars") > F.col("n")) | ~F.col("lang").isin(*languages.LANGUAGES)
    return p.groupBy("tab").agg(F.count_distinct("row_key").alias("n_texts"), F.count_if(bad).alias("n_bad"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Texts in containers per pack; none lost or doubled in part, no container above its capacity, one at most half full or less."""
    sizes = tokens.token_sizes(table(spark, d, "documents"))
    held = packing.members(_containers(spark, d))
    limits = table(spark, d, "pack_limits").select("pack_name", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    bins = held.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("used")).join(limits, "pack_name")
    full = bins.groupBy("pack_name").agg(F.count_if(F.col("used") > F.col("capacity")).alias("n_above"), F.greatest(F.count_if(F.col("used") * 2 <= F.col("capacity")) - 1, F.lit(0)).alias("n_mergeable"))
    docs = held.groupBy("pack_name", "doc_id").agg(F.sum("n_tokens").alias("packed"), F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece").alias("k")).join(sizes, "doc_id").join(limits, "pack_name")
    bad = (F.col("packed") != F.col("n_tokens")) | (F.col("pieces") != F.col("k")) | (F.col("pieces") != F.ceil(F.col("n_tokens") / F.col("capacity")))
    return docs.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(bad).alias("n_wrong")).join(full, "pack_name")


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Documents per listed source; none taken more often than allowed, shares within a hundredth of their target among the sources present."""
    targets = table(spark, d, "mix_targets")
    r = _repeats(spark, d)
    per = r.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.max("repeats").alias("most")).join(targets, "source")
    share = mixing.shares(r, targets).select("source", "actual_share")
    whole = Window.partitionBy(F.lit(0))  # the few listed sources
    j = per.join(share, "source").withColumn("total", F.sum("target_share").over(whole))
    return j.select("source", "n_texts", (F.col("most") > F.col("max_repeats")).alias("above_cap"), (F.abs(F.col("actual_share") - F.col("target_share") / F.col("total")) > 0.01).alias("off_target"))


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    """The lengths at which each source and feed limits its texts."""
    rows = table(spark, d, "documents").where(F.col("text").rlike(r"\S")).select("source", "feed", F.length("text").alias("n"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("digest"))
    return truncation.field_limits(rows).select("source", "feed", "measure", F.explode(F.transform("limits", lambda x: x.cast("bigint"))).alias("limit"))


def p9_totals(spark: SparkSession, d: str) -> DataFrame:
    """Scored texts per source and feed, and probabilities out of bounds."""
    scored = truncation.score(table(spark, d, "documents"))
    return scored.groupBy("source", "feed").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(~F.col("p_cut").between(0, 1)).alias("n_bad"))


QUERIES = {k: f for k, f in dict(globals()).items() if k[0] == "p" and k[1:2].isdigit()}  # the functions named by a problem

_NAMES = "(select distinct class, name from (select case kind when 'publisher' then 'house' else 'person' end as class, unnest([content, opf2_file_as]) as name from metadata_elements where kind in ('creator', 'contributor', 'publisher')) where name is not null)"
_CODE = "case split_part(regexp_replace(lower(trim(lang)), '[-_ ]', '|'), '|', 1) " + " ".join(f"when '{n}' then '{c}'" for c, ns in languages.LABELS.items() for n in (c, *ns)) + " else '' end"
_SEEN = r"regexp_matches({}, '[^\x00-\x20]')"
_PILES = f"""with x as (select source, feed, text, unnest(['chars', 'bytes']) as measure, unnest([length(text), strlen(text)]) as size from documents where regexp_matches(text, '\\S')),
 n as (select source, feed, measure, size, count(distinct text) as c from x group by all),
 w as (select *, sum(c) over (partition by source, feed, measure order by size range between 10 preceding and 10 following) - c as near, sum(c) over (partition by source, feed, measure) - sum(c) over (partition by source, feed, measure order by size) as above, count(*) over (partition by source, feed, measure) as lengths from n),
 s as (select *, (near + 1) / 20.0 as chance from w),
 h as (select *, c * ln(c / chance) - (c - chance) + case when above * 8 <= c then {truncation.CEILING} else 0 end as surprise from s where c > 2 and c > chance and size >= 20),
 k as (select * from h where surprise >= ln(lengths / {truncation.FALSE_LIMIT})),
 b as (select source, feed, arg_max(measure, (best, measure)) as measure from (select source, feed, measure, max(surprise) as best from k group by all) group by all)
 select k.source, k.feed, k.measure, cast(size as bigint) as "limit" from k join b on k.source is not distinct from b.source and k.feed is not distinct from b.feed and k.measure = b.measure"""

ORACLE: dict[str, str] = {
    "p2_checks": f"select class, count(*) as n_strings, cast(0 as bigint) as n_in_several, cast(0 as bigint) as n_placeholders, cast(0 as bigint) as n_mixed from {_NAMES} group by all",
    "p6_labels": f"select lang, {_CODE} as code, count(*) as n from documents group by all",
    "p6_checks": f"select 'documents' as tab, count(distinct doc_id) as n_texts, cast(0 as bigint) as n_bad from documents where {_SEEN.format('text')} union all select 'metadata_elements', count(distinct elem_key), 0 from metadata_elements where {_SEEN.format('content')}",
    "p7_checks": "select distinct pack_name, (select count(distinct doc_id) from documents where text <> '') as n_texts, cast(0 as bigint) as n_wrong, cast(0 as bigint) as n_above, cast(0 as bigint) as n_mergeable from pack_limits where capacity_tokens > 0",
    "p8_checks": "select source, count(*) as n_texts, false as above_cap, false as off_target from documents join mix_targets using (source) where text <> '' group by all",
    "p9_limits": _PILES,
    "p9_totals": r"select source, feed, count(*) as n_texts, cast(0 as bigint) as n_bad from documents where regexp_matches(text, '\S') group by all",
}
