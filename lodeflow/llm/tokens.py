"""Token counts of texts by a public tokenizer."""

from __future__ import annotations

import base64
import functools
import importlib.util
import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Folder of the tokenizers' files on every executor, and the one used.
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"


@functools.cache
def encoder(folder: str = TOKENIZER_DIR, name: str = TOKENIZER):
    """The byte-level BPE of a rank file; special tokens' strings are ordinary text."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("_tokenizer_files", os.path.join(folder, "__init__.py"))
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """key, keep..., n_tokens (bigint) of each row whose text isn't NULL; an empty text has 0. Whole texts are encoded."""
    columns = [key, *keep]
    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", n_tokens bigint"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(folder, name)
        for b in batches:
            yield b[columns].assign(n_tokens=[len(e.encode_ordinary(t)) for t in b[text]])

    return docs.where(docs[text].isNotNull()).select(*columns, text).mapInPandas(run, schema)
