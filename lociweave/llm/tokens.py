"""Token counts of texts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranks of a byte-level BPE (`.tiktoken`), or a tokenizer file (`.json`); either is only read, never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are cut before the ranks apply. A fixed value that belongs to these public ranks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _tokenizer(path: str):
    """A function from a text to its number of tokens; kept by the process, outside of what is sent to workers."""
    kept = sys.modules.setdefault("_lociweave_kept", types.ModuleType("_lociweave_kept")).__dict__
    if path not in kept:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            kept[path] = lambda text: len(encode(text))
        else:
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(path)
            made.encode_special_tokens = True
            made.no_truncation()
            made.no_padding()
            kept[path] = lambda text: len(made.encode(text, add_special_tokens=False))
    return kept[path]


def counted(texts: list[str | None], vocabulary: str) -> list[int]:
    """Tokens of each whole text, without special tokens; an empty or missing text has none."""
    count = _tokenizer(vocabulary)
    return [count(t) if t else 0 for t in texts]


def with_tokens(df: DataFrame, text: str, *, keep: list[str], name: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns `keep` of `df` and the number of tokens (bigint) of its column `text`; the text itself goes no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.array(counted(batch.column(batch.num_columns - 1).to_pylist(), vocabulary), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], names=[*batch.schema.names[:-1], name])

    rows = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias("__text"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField(name, T.LongType())]))
