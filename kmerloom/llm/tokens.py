"""Counting tokens of a public byte-pair vocabulary."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A ``.tiktoken`` rank file; a name without a folder is looked up in the installed ``public_tokenizers`` package.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

# What Unicode counts as white space.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_LOOKAHEAD = r"|\s+(?!\S)"


@cache
def _encoder(vocabulary: str):
    """The encoder without the pattern's look-ahead, and the pattern of the places that it would have cut at.

    Look-ahead keeps the regex engine from its fast path. It matters only in runs of two or more white-space letters before
    other text, where it leaves the last one to the next piece; cutting the text there beforehand gives the same pieces.
    """
    import tiktoken

    path, pattern = vocabulary, None
    import public_tokenizers

    if "/" not in vocabulary:
        path = public_tokenizers.path(vocabulary)
    pattern = public_tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = pattern.replace(_LOOKAHEAD, "")
    return tiktoken.Encoding("plain", pat_str=plain, mergeable_ranks=ranks, special_tokens={}), re.compile(f"[{_WHITE}]+(?=[{_WHITE}][^{_WHITE}])")


def token_count(text: str, vocabulary: str = VOCABULARY) -> int:
    encoder, cuts = _encoder(vocabulary)
    encode, n, at = encoder.encode_ordinary, 0, 0
    for cut in cuts.finditer(text):
        n += len(encode(text[at : cut.end()]))
        at = cut.end()
    return n + len(encode(text[at:]))


def with_token_counts(docs: DataFrame, key: str, text: str, source: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, source, n_tokens) of every row; a null text has no tokens. Sources are spelled alike: lower case, hyphens."""
    kind = docs.schema[key].dataType.simpleString()
    clean = F.lower(F.regexp_replace(F.trim(F.regexp_replace(F.col(source), r"\s+", " ")), "[ _]+", "-"))
    rows = docs.select(F.col(key).alias("id"), clean.alias("source"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [token_count(t, vocabulary) if (t := x.as_py()) else 0 for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["id", "source", "n_tokens"])

    return rows.mapInArrow(run, f"id {kind}, source string, n_tokens bigint")
