"""Byte-level BPE encoding and decoding with a local rank file.

Each text is encoded as ``tiktoken`` does without special tokens, and decoded to raw bytes. Long texts are first cut at
safe boundaries: where an ASCII letter, digit or one of ``.,;:!?`` is followed by a space or a line feed. No match of the split
pattern crosses from a character that isn't white space to one that is, and the matches after such a place
don't depend on what precedes it; so the pieces' ids are those of the whole text.

Defined cases: null is the empty text; the empty text has no ids; repeated rows are each encoded; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import small_batches

#: A longer text is cut at the first safe boundary after so many characters.
PIECE_CHARS = 50_000
RANKS = "byte_bpe_50k.tiktoken"
_SAFE = re.compile(r"[A-Za-z0-9.,;:!?](?=[ \n])")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces that end at safe boundaries; a text without any is one piece."""
    at = 0
    while len(text) - at > size and (cut := _SAFE.search(text, at + size)):
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def encode(text: str, bpe: tiktoken.Encoding) -> np.ndarray:
    if len(text) <= PIECE_CHARS:
        return bpe.encode_to_numpy(text, disallowed_special=()).astype("<u4")
    return np.concatenate([bpe.encode_to_numpy(x, disallowed_special=()).astype("<u4") for x in pieces(text)])


def decode(ids: np.ndarray, bpe: tiktoken.Encoding) -> bytes:
    return bpe.decode_bytes(ids.tolist())


def encoded(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids, decoded) of each row: ids as little-endian unsigned 32-bit integers, decoded as bytes.

    The rank file is read where the task runs, from ``path`` there, by default the installed one.
    """

    def encode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(path or public_tokenizers.path(RANKS), pattern)
        for x in batches:
            for part in range(0, x.num_rows, 500):
                rows = x.slice(part, 500)
                ids = [encode(t.as_py() or "", bpe) for t in rows.column("text")]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([decode(i, bpe) for i in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode_all, "doc_id long, ids binary, decoded binary")


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the rows of ``encoded``."""
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
