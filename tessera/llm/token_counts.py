"""Token counts (operator 3): batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from tessera.llm import kernel

#: Bytes of text handed to the library at once, and the length from which a text is split.
BATCH_BYTES = 1 << 18
SPLIT_BYTES = 1 << 16

_loaded: dict[int, tuple[object, bool]] = {}

# A letter or digit, then one white-space character: byte-level pre-tokenisation always ends a piece
# there, whatever stands around it, and no special token holds white space.
_SAFE = re.compile(r"(?<=[A-Za-z0-9])[ \n\t]")


def _load(spec: str) -> tuple[object, bool]:
    """The library's tokenizer, and whether texts may be split at ``_SAFE`` without changing its tokens."""
    key = hash(spec)
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        said = json.loads(spec)
        pre = said.get("pre_tokenizer") or {}
        plain = said.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        tame = not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in said.get("added_tokens", []))
        tokenizer = Tokenizer.from_str(spec)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded.clear()
        _loaded[key] = tokenizer, bool(plain and tame)
    return _loaded[key]


def pieces(text: str, most: int = SPLIT_BYTES) -> Iterator[str]:
    """Cuts a text at safe boundaries into pieces of about ``most`` characters; longer where there is none."""
    low = 0
    while len(text) - low > most:
        cut = _SAFE.search(text, low + most)
        if cut is None:
            break
        yield text[low : cut.start()]
        low = cut.start()
    yield text[low:] if low else text


def _sizes(texts: list[str], tokenizer, splits: bool, batch_bytes: int, split_bytes: int) -> np.ndarray:
    """Tokens of each text; pieces go to the library in batches of about ``batch_bytes`` bytes."""
    out = np.zeros(len(texts), np.int64)
    held: list[str] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        for i, e in zip(owner, tokenizer.encode_batch_fast(held, add_special_tokens=False)):
            out[i] += len(e)
        held.clear()
        owner.clear()
        size = 0

    for i, text in enumerate(texts):
        for piece in pieces(text, split_bytes) if splits and len(text) > split_bytes else (text,):
            held.append(piece)
            owner.append(i)
            size += len(piece) if piece.isascii() else len(piece.encode())
            if size >= batch_bytes:
                flush()
    if held:
        flush()
    return out


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", token_limit: int = 512, batch_bytes: int = BATCH_BYTES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > token_limit).

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows give repeated
    results; other columns are not read.  The tokenizer file is read on the driver and broadcast (a
    file of fixed size), so executors need no copy of it.  No shuffle: each scan task counts its rows,
    in blocks of as many rows as have ``batch_bytes`` bytes of text; a longer text is a block of its own
    and goes to the library in pieces.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, splits = _load(spec.value)
        for batch in batches:
            texts = batch.column(1)
            size = np.zeros(len(texts), np.int64)
            tokens = np.zeros(len(texts), np.int64)
            for low, high in kernel.blocks(texts, batch_bytes):
                part = texts.slice(low, high - low)
                size[low:high] = np.asarray(pa.compute.fill_null(pa.compute.binary_length(part), 0))
                tokens[low:high] = _sizes([x or "" for x in part.to_pylist()], tokenizer, splits, batch_bytes, split_bytes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(tokens), pa.array(tokens > token_limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
