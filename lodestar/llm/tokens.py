"""Text sizes in tokens of a public tokenizer. Tokenizer files are read from a folder, never copied."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Folder and file of the tokenizer; the split pattern its byte-level merges were made for (fixed value).
FOLDER, FILE = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load(folder: str = FOLDER, file: str = FILE):
    """The tokenizer as a tiktoken encoding without special tokens."""
    import tiktoken

    ranks = {}
    for line in Path(folder, file).read_bytes().splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding(file, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), folder: str = FOLDER, file: str = FILE) -> DataFrame:
    """(key, keep..., n_tokens) of whole texts; null texts have 0 tokens."""
    src = docs.select(key, *keep, F.col(text).alias("__text"))
    schema = src.drop("__text").schema.add("n_tokens", LongType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = load(folder, file)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) if isinstance(t, str) else 0 for t in b["__text"]]
            yield b.drop(columns="__text").assign(n_tokens=sizes)

    return src.mapInPandas(run, schema)
