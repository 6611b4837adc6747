"""Byte-level BPE encoding and decoding by the tiktoken library and a local rank file.

Null text is empty text: no ids, and the digests of nothing. Each match of the pattern is encoded by itself, so a text
can be cut wherever a match must begin. Long texts are cut before `space letter` after a character that isn't space:
no match of the pattern crosses that place (` ?\\p{L}+` begins at the space, whatever went before has ended). A text
without such a place is encoded whole. Decoding works on raw bytes, so an id that ends inside a character is no fault.
Repeated rows give repeated rows, an empty table an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import bound_batches, slices, texts

#: Characters from which a text is cut, and about the length of a piece.
LONG, PIECE = 1 << 16, 1 << 14
#: Bytes of text whose ids are sent in one batch, about.
OUT = 1 << 19
SAFE = regex.compile(r"(?<=\S)(?= \p{L})")


@functools.cache
def encoder(path: str, pattern: str) -> tuple[tiktoken.Encoding, list[str]]:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), [str(i) for i in range(max(ranks.values()) + 1)]


def pieces(text: str, long: int = LONG, piece: int = PIECE) -> Iterator[str]:
    if len(text) <= long:
        yield text
        return
    start = 0
    while start < len(text):
        cut = SAFE.search(text, start + piece)
        stop = cut.start() if cut else len(text)
        yield text[start:stop]
        start = stop


def encode(text: str, path: str, pattern: str) -> list[int]:
    coder = encoder(path, pattern)[0]
    if len(text) <= LONG:
        return coder.encode_ordinary(text)
    return [i for piece in pieces(text) for i in coder.encode_ordinary(piece)]


def decode(ids: list[int], path: str, pattern: str) -> bytes:
    return encoder(path, pattern)[0].decode_bytes(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str, *, ids: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per row of docs: its key, n_tokens, the digests of its ids and of the bytes they decode to, and (ids=True) the ids themselves.

    path is the rank file's place on every executor.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = encoder(path, pattern)[1]
        for batch in (b.slice(i, j - i) for b in batches for i, j in slices(b.column(1), OUT)):
            found = []
            for value in texts(batch.column(1)).to_pylist():
                own = encode(value, path, pattern)
                said = " ".join([names[i] for i in own])
                found.append((len(own), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decode(own, path, pattern)).hexdigest(), own if ids else None))
            n, a, b, own = zip(*found, strict=True) if found else ((), (), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())] + [pa.array(own, pa.list_(pa.int32()))] * ids
            yield pa.RecordBatch.from_arrays(columns, names=out)

    kind = docs.schema[key].dataType.simpleString()
    out = [key, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
