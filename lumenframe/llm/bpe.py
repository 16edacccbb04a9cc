"""Byte-level BPE with the tiktoken library and a local file of ranks.

The driver reads the file (about a megabyte, whatever the corpus) and ships its bytes
with the task; workers build the encoder once.  A long text is split where the split
pattern must split it anyway, so that no call gets an unbounded string.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A text longer than this many characters is encoded piece by piece.
PIECE = 50_000
#: What the pattern's \s matches (Unicode White_Space).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The start of a run of white space.  No alternative of the pattern holds white space
#: after anything else, so a match always ends before it.
_SAFE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
#: A longer run of white space does not go through the library's pattern, which would
#: need a stack as deep as the run.
LONG_RUN = 10_000
_LONG = re.compile(f"[{WHITE}]{{{LONG_RUN + 1},}}")


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_pieces(text: str, piece: int = PIECE) -> Iterator[str]:
    """Pieces of about the given length, cut at safe boundaries only."""
    start = 0
    while len(text) - start > piece:
        cut = _SAFE.search(text, start + piece)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc, text: str | None) -> np.ndarray:
    """Ids of the text.  A long run of white space is one match of the pattern, without
    its last character if other text follows, and is encoded as that."""
    text, ids, start = text or "", [], 0
    for run in _LONG.finditer(text) if len(text) > LONG_RUN else ():
        ids += [enc.encode_ordinary(p) for p in safe_pieces(text[start : run.start()])]
        start = run.end() if run.end() == len(text) else run.end() - 1
        ids.append(enc._encode_single_piece(text[run.start() : start]))
    ids += [enc.encode_ordinary(p) for p in safe_pieces(text[start:])]
    return np.concatenate([np.array(x, dtype="<u4") for x in ids])


def _mapped(df: DataFrame, col: str, out: str, kind: T.DataType, make):
    """df with column out, made from column col by the function that make() returns.
    A column of that name is replaced."""
    df = df.select(*[c for c in df.columns if c.lower() != out.lower() or c == col])
    if out.lower() == col.lower():
        raise ValueError("the new column needs a name of its own")
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])
    arrow = pa.binary() if isinstance(kind, T.BinaryType) else pa.string()
    at = df.columns.index(col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                made = pa.array([f(x.as_py()) for x in part.column(at)], arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """df with a binary column of token ids, little-endian unsigned 32-bit each.

    Each match of the pattern is encoded by itself; no special tokens.  Null and empty
    texts give no ids.  All columns of df stay."""
    ranks = read_ranks(ranks_path)

    def make():
        enc = encoding(ranks, pattern)
        return lambda text: encode_text(enc, text).tobytes()

    return _mapped(df, text_col, out, T.BinaryType(), make)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with a binary column of the raw bytes that the ids stand for.  They need not
    be valid UTF-8, as a token may end inside a character.  Null ids give no bytes."""
    ranks = read_ranks(ranks_path)

    def make():
        enc = encoding(ranks, pattern)
        return lambda ids: enc.decode_bytes(np.frombuffer(ids or b"", dtype="<u4").tolist())

    return _mapped(df, ids_col, out, T.BinaryType(), make)


def token_count(ids_col: str = "ids") -> F.Column:
    return (F.octet_length(ids_col) / 4).cast("long")
