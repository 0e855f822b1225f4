"""Sizes of texts in tokens of a public tokenizer.

The vocabulary is read once, on the driver, checked against its size bound and sent with the job; workers read no folder of
their machine and run no code from one.
"""

from __future__ import annotations

import ast
import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies on the driver's machine; a parameter of everything that counts tokens.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: A rank file of more bytes is refused: it is sent to every executor.
MAX_VOCABULARY_BYTES = 32 << 20

_BUILT: dict[str, object] = {}


def split_pattern(folder: str) -> str:
    """The pattern that splits text before the merges, read as a literal from the folder's module."""
    with open(f"{folder}/__init__.py", encoding="utf-8") as file:
        tree = ast.parse(file.read())
    return next(ast.literal_eval(n.value) for n in tree.body if isinstance(n, ast.Assign) and any(getattr(t, "id", "") == "PATTERN" for t in n.targets))


def build(name: str, pattern: str, ranks: bytes):
    """The tokenizer of a rank file."""
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=merges, special_tokens={})


@lru_cache(2)
def vocabulary_bytes(folder: str, vocabulary: str) -> bytes:
    with open(f"{folder}/{vocabulary}", "rb") as file:
        data = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is above its bound")
    return data


def encoding(folder: str, vocabulary: str):
    """The tokenizer of a vocabulary file."""
    return build(vocabulary, split_pattern(folder), vocabulary_bytes(folder, vocabulary))


def _encoder(name: str, pattern: str, digest: str, ranks: Broadcast):
    """The tokenizer of a worker, built once from what the job sent."""
    if digest not in _BUILT:
        if hashlib.sha256(ranks.value).hexdigest() != digest:
            raise ValueError("the vocabulary arrived damaged")
        _BUILT[digest] = build(name, pattern, ranks.value)
    return _BUILT[digest]


def _count(name: str, pattern: str, digest: str, ranks: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(name, pattern, digest, ranks).encode_ordinary
        for pdf in frames:
            yield pdf.assign(n_tokens=[len(encode(t)) if t else 0 for t in pdf.text]).drop(columns="text")

    return run


def token_sizes(documents: DataFrame, *keep: str, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, the kept columns and n_tokens of the whole text; null and empty texts have 0."""
    rows = documents.select("doc_id", *keep, "text")
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *keep)) + ", n_tokens bigint"
    data = vocabulary_bytes(folder, vocabulary)
    ranks = documents.sparkSession.sparkContext.broadcast(data)
    return rows.withColumn("text", F.coalesce("text", F.lit(""))).mapInPandas(_count(vocabulary, split_pattern(folder), hashlib.sha256(data).hexdigest(), ranks), schema)
