"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import spread

TOKENIZER_DIR = os.environ.get("CODELOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, object] = {}


def encoder(folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY):
    """The tokenizer, loaded once a process."""
    path = os.path.join(folder, vocabulary)
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(text: str, enc) -> int:
    """Tokens of a whole text, encoded in one piece whatever its length."""
    return len(enc.encode_ordinary(text))


def sized(df: DataFrame, keep: list[str], text: str = "text", folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and ``n_tokens``. A null text has 0 tokens. No shuffle; only the kept columns and the text are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, vocabulary)
        for b in batches:
            counts = [count_tokens(t, enc) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(counts, pa.int64())], [*keep, "n_tokens"])

    narrow = df.select(*keep, F.col(text).cast("string").alias("_text"))
    fields = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep)
    return spread(narrow, keep[0]).mapInArrow(run, f"{fields}, n_tokens bigint")
