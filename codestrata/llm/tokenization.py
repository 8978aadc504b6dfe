"""Encoding a corpus with a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from codestrata.session import ship

#: Where the rank file lies; a parameter of every operator here, as executors may keep it elsewhere.
RANKS = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are cut before encoding, only where the pattern would cut as well.
PIECE = 16_384
# White space begins a new word after any sign; between a digit and a letter a word ends in any case.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{N})(?=\p{L})|(?<=\p{L})(?=\p{N})")


def encoder(ranks: str = RANKS):
    """The byte-level encoding without special tokens, from a local rank file."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text in parts of about `size`, cut only where encoding the parts gives the ids of the whole."""
    out, at = [], 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if m is None or m.start() >= len(text):
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def encode(enc, text: str | None, size: int = PIECE) -> list[int]:
    """Token ids; none for null and empty texts. Strings of special tokens are ordinary text."""
    if not text:
        return []
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for part in pieces(text, size) for i in enc.encode_ordinary(part)]


def decode(enc, ids: list[int]) -> str:
    """The text of token ids: their bytes are joined first, since a character may span tokens."""
    return b"".join(enc.decode_tokens_bytes(list(ids))).decode("utf-8", errors="strict")


def encode_column(df: DataFrame, key: str, text: str, ranks: str = RANKS, counts_only: bool = False) -> DataFrame:
    """(key, ids) of each row, or (key, n_tokens). No shuffle; the encoder is built once per worker.

    Defined results: null and empty texts have an empty list (0 tokens), blank text is encoded as it stands, a row given twice gives two rows.
    """
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    cache: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = cache.get("enc") or cache.setdefault("enc", encoder(ranks))
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                ids = [encode(enc, t) for t in b.column(1).to_pylist()]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                if counts_only:
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes)], names=[key, "n_tokens"])
                    continue
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, " + ("n_tokens long" if counts_only else "ids array<int>"))


def decode_column(df: DataFrame, key: str, ranks: str = RANKS) -> DataFrame:
    """(key, text) of each row's ids; an empty list is the empty text."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(enc, x or []) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return df.select(key, "ids").mapInArrow(run, f"{key} {kind}, text string")
