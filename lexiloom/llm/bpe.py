"""Byte-level BPE: encoding by given ranks and decoding.

A piece's bytes are the leaves of a segment tree that stores, for every range, the least pair rank
and its leftmost place. A merge joins two neighbours, unlinks one and updates the ranks of the two
pairs around it, each along one path to the root, so a piece of n bytes costs O(n log n).
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import workspace

_NONE = 1 << 62
#: Pieces that each of a worker's two cache generations holds, and the longest of them in characters.
CACHE_PIECES, CACHE_CHARS = 250_000, 40
#: Bytes from which a piece is merged in packed arrays: memory is then about 50 bytes for each of its bytes.
LONG_PIECE = 4096


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 1).bit_length()
    row = list if n < LONG_PIECE else partial(array, "q")  # eight bytes a number
    tree = row([_NONE]) * (2 * size)  # rank * size + place: the least value is the leftmost least rank
    after, before = row(range(1, n + 1)), row(range(-1, n - 1))
    get, mask = ranks.get, size - 1
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    while (top := tree[1]) != _NONE:
        i = top & mask
        j = after[i]
        k = after[i] = after[j]
        r = None
        if k < n:
            before[k] = i
            r = get(piece[i : after[k]])
        changed = (j, _NONE), (i, _NONE if r is None else r * size + i)
        h = before[i]
        if h >= 0:
            r = get(piece[h:k])
            changed += ((h, _NONE if r is None else r * size + h),)
        for leaf, value in changed:
            at = leaf + size
            if tree[at] == value:
                continue
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
                if tree[at] == value:
                    break
                tree[at] = value
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Pieces(dict):
    """Packed ids by piece. A full generation is kept aside once, so common pieces stay."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.old = ranks, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = _pack(merge_piece(piece.encode(), self.ranks))
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pieces = _Pieces(self.ranks)
        self.split = regex.compile(pattern)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, pieces, part = [], self.pieces, []
        for m in self.split.finditer(text) if len(text) > 1 << 20 else self.split.findall(text):
            part.append(pieces[m if isinstance(m, str) else m.group()])
            if len(part) >= 1 << 16:
                out.append(b"".join(part))
                part = []
        return b"".join([*out, *part])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) for every row of ``docs(doc_id, text, ...)``.

    ``path`` names a rank file that exists on every worker. Null texts count as empty: no ids, and the
    digests of nothing. Equal rows give equal results; an empty table gives none; other columns are ignored.
    """
    workspace.ship(docs.sparkSession)

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            texts = batch.column("text")
            n, ids_hex, text_hex, ids_all = [], [], [], []
            for i in range(len(texts)):
                ids = c.encode(texts[i].as_py() or "")
                n.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if with_ids:
                    ids_all.append(np.frombuffer(ids, "<u4").astype(np.int32))
            out = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            if with_ids:
                out.append(pa.array(ids_all, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text from ``rows(doc_id, ids)``; bytes that are not UTF-8 become U+FFFD."""
    workspace.ship(rows.sparkSession)

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            texts = [c.decode(np.array(x or [], "<u4").tobytes()).decode(errors="replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
