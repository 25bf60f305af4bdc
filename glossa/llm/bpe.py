"""Operator 4: byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

``with_tokens`` adds the ids of every whole text, ``decode_tokens`` turns ids back into raw bytes. The rank file is
read once on the driver (size checked) and travels to the tasks in the function, so executors need no path. Each
worker process builds one encoder per rank file.

Long texts are cut at safe boundaries before the regex runs: between a letter or digit and a following space or line
feed. No alternative of the pattern crosses such a boundary (every match is one optional space plus a run of
non-spaces, or a run of white space) and its only look-ahead starts inside white space, so the matches, and the ids,
of the pieces joined are those of the whole text. A stretch without such a boundary stays whole.

Defined cases: null and empty texts have no ids (``n_tokens`` 0); rows, ties and repeated ids are independent; an
empty table gives an empty table; other columns pass through, and columns that clash with the new ones are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MAX_RANK_FILE_BYTES = 64 << 20
PIECE_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=[0-9A-Za-z])(?=[ \n])")
_encoders: dict[str, tiktoken.Encoding] = {}


def read_ranks(path: str) -> bytes:
    """The rank file's bytes; refuses a file that is too large to ship with a task."""
    if os.path.getsize(path) > MAX_RANK_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_FILE_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _encoders:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in pieces of at least ``size`` characters cut at safe boundaries."""
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m or m.start() >= len(text):
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


def encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in safe_pieces(text):
        ids.extend(enc.encode_ordinary(piece))
    return ids


def _without(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.select(*[df[c] for c in df.columns if c not in names])


def with_tokens(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` plus ``ids_col``, the token ids (array of int) of ``text_col``."""
    ranks = read_ranks(rank_path)
    base = _without(df, (ids_col,))
    schema = T.StructType(base.schema.fields + [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        enc = encoder(ranks, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            ids = pa.array([encode_text(enc, t or "") for t in texts], pa.list_(pa.field("element", pa.int32(), False)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, ids_col])

    return base.mapInArrow(run, schema)


def decode_tokens(df: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """``df`` plus ``out_col``, the raw bytes that ``ids_col`` stands for (null ids: no bytes). Bytes, not text: a cut
    id list may end inside a character."""
    ranks = read_ranks(rank_path)
    base = _without(df, (out_col,))
    schema = T.StructType(base.schema.fields + [T.StructField(out_col, T.BinaryType(), False)])

    def run(batches):
        enc = encoder(ranks, pattern)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            out = pa.array([enc.decode_bytes(x or []) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, out_col])

    return base.mapInArrow(run, schema)


ROUND_TRIP_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip_digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Per document the number of ids, the digest of the ids and the digest of the bytes they decode to. Ids and
    bytes stay inside the task, so only digests leave it."""
    ranks = read_ranks(rank_path)

    def run(batches):
        enc = encoder(ranks, pattern)
        for batch in batches:
            n, ids_sha, out_sha = [], [], []
            for t in batch.column(1).to_pylist():
                ids = encode_text(enc, t or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                out_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(out_sha)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, ROUND_TRIP_SCHEMA)
