"""Content facts of documents that a table holds, and annotation targets against the inventory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.functions import values as V
from codexmill.operators.nested import annotation_tables
from codexmill.parsers.xhtml import has_executable_content, parse_xhtml
from codexmill.session import Scratch

FACTS = """stream string, executable boolean, activities array<string>,
 spans array<struct<element:string,element_ord:int,role:string,start:int,end:int>>,
 links array<struct<ord:int,element:string,attribute:string,role:string,declared:string>>,
 structure array<struct<ord:int,role:string,label:string>>"""
_KEEP = {"spans": ("element", "element_ord", "role", "start", "end"), "links": ("ord", "element", "attribute", "role", "declared"), "structure": ("ord", "role", "label")}


def extract(rows: DataFrame, key: str, markup: str, wrap: bool = True) -> DataFrame:
    """Facts of each markup value, read once: key and the columns of ``FACTS``. ``wrap`` puts fragments into a body.

    Null values have no facts; a truncated document still closes its spans.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, text in zip(pdf[key], pdf[markup], strict=True):
                f = parse_xhtml(f"<body>{text}" if wrap else text)
                out.append({key: k, "stream": f.text, "executable": has_executable_content(f), "activities": sorted(f.activities)} | {n: [{c: x.get(c) for c in cols} for x in getattr(f, n)] for n, cols in _KEEP.items()})
            yield pd.DataFrame(out, columns=[key, "stream", "executable", "activities", *_KEEP])

    source = rows.select(key, markup).where(F.col(markup).isNotNull())
    return source.mapInPandas(run, f"{key} {dict(source.dtypes)[key]}, {FACTS}")


def stream_summary(facts: DataFrame, key: str) -> DataFrame:
    """Length of the text stream and counts of the facts of each document."""
    size = lambda c: F.size(c).cast("bigint").alias(f"n_{c}")
    return facts.select(key, F.length("stream").cast("bigint").alias("n_stream"), size("spans"), size("links"), size("structure"), "executable")


def span_texts(facts: DataFrame, key: str) -> DataFrame:
    """Spans with their text, cut out of the stream by code points."""
    s = facts.select(key, "stream", F.explode("spans").alias("s"))
    return s.select(key, "s.*", F.substring("stream", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("text"))


def executable_states(facts: DataFrame) -> DataFrame:
    """Documents with and without executable content, and those of which it is not known: unread ones, and partly read ones that show none."""
    state = F.col("content_state") if "content_state" in facts.columns else F.lit("complete")
    seen = F.coalesce("executable", F.lit(False))
    known = F.col("executable").isNotNull() & (state == "complete")
    return facts.agg(F.count_if(seen).alias("detected"), F.count_if(~seen & known).alias("absent"), F.count_if(~seen & ~known).alias("unknown"))


def script_counts(scripts: DataFrame) -> DataFrame:
    """Scripts and event handlers of each book, those of keys apart."""
    key = F.lower("attribute").isin("onkeydown", "onkeypress", "onkeyup")
    return scripts.groupBy("pub_id").agg(F.count_if(F.col("kind") != "event-handler").alias("scripts"), F.count_if(F.col("kind") == "event-handler").alias("handlers"), F.count_if((F.col("kind") == "event-handler") & key).alias("key_handlers"))


def annotation_targets(sets: DataFrame, publications: DataFrame, typed: DataFrame) -> DataFrame:
    """Annotation targets resolved to declared resources: state none, unsupported, missing or declared, and the address."""
    pub = sets.groupBy("set_key").agg(F.min("pub_id").alias("pub_id"))
    t = annotation_tables(sets)["target"].join(pub, "set_key").join(publications.select("pub_id", "package_path"), "pub_id", "left")
    told = Scratch(sets.sparkSession, "targets").cut(V.with_target(t, "source", "package_path"))
    known = typed.where(F.col("address_kind") == "local").select(F.col("pub_id").alias("k_pub"), F.col("address").alias("k_address")).distinct()
    j = told.join(known, (F.col("pub_id") == F.col("k_pub")) & (F.col("t_address") == F.col("k_address")), "left")
    state = F.when(F.col("source").isNull(), "none").when(F.col("t_kind") != "local", "unsupported").when(F.col("k_pub").isNull(), "missing").otherwise("declared")
    return j.select("set_key", "node_path", state.alias("state"), F.when(F.col("t_kind") == "local", F.col("t_address")).alias("address"), F.when(F.col("t_kind") == "local", F.col("t_fragment")).alias("fragment"))
