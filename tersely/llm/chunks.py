"""Documents in chunks of a few MB, so that Python works on arrays and not on rows, and addresses within a chunk.

A document's chunk follows from its row's hash, and its place in the chunk from the order of (doc_id, rk). Both are the
same whenever the chunk is read again, so results found elsewhere can come back by (chunk, place), also after executors
have been lost. The exchange that deals documents to chunks is the same subplan each time and Spark reuses it.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersely.llm.common import NULL_ID, keyed, quoted
from tersely.llm.rolling import pack, unpack

#: Bytes of text that a chunk or a bucket stands for.
CHUNK_BYTES = 2 << 20
BLOBS = "bucket long, chunk long, kind int, blob binary"


def parts(docs: DataFrame, text_col: str, each: int = CHUNK_BYTES) -> int:
    """Into how many parts of so many bytes the texts go, by their counted bytes."""
    size = docs.agg(F.sum(F.octet_length(quoted(text_col).cast("string")).cast("long"))).first()[0]
    return max(1, math.ceil((size or 0) / each))


def chunked(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return keyed(docs, id_col, text_col).withColumn("chunk", F.pmod("rk", F.lit(n)).cast("long"))


def documents(table: pa.Table) -> tuple[list, np.ndarray, list[bytes]]:
    """Of a chunk: ids (null as None), ids for ordering, texts; in the order of places."""
    table = table.select(["doc_id", "rk", "text"])
    ids = table["doc_id"].fill_null(NULL_ID).to_numpy()
    order = np.lexsort((table["rk"].to_numpy(), ids))
    table = table.take(pa.array(order))
    return table["doc_id"].to_pylist(), ids[order], [t for c in table["text"].chunks for t in c.cast(pa.large_binary()).to_pylist()]


def blob_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = {"bucket": pa.int64(), "chunk": pa.int64(), "kind": pa.int32(), "blob": pa.binary()}
    return pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns, strict=True)})


def by_bucket(keys: np.ndarray, n: int):
    """Yields (bucket, indices) of the keys, bucket = key modulo n; the indices ascend."""
    bucket = (keys % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    cuts = np.flatnonzero(np.diff(ordered)) + 1
    for group in np.split(order, cuts):
        if len(group):
            yield int(bucket[group[0]]), group


class Spans:
    """Half-open spans of documents by chunk, gathered in pieces."""

    def __init__(self):
        self.found: dict[int, list] = defaultdict(list)

    def add(self, chunk: int, place: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        if len(place):
            self.found[chunk].append((place, start, end))

    def rows(self, bucket: int = 0, kind: int = 1) -> list[tuple[int, int, int, bytes]]:
        return [(bucket, chunk, kind, pack(*(np.concatenate([np.asarray(p[i], dtype=np.int64) for p in pieces]) for i in range(3)))) for chunk, pieces in self.found.items()]


def covered(table: pa.Table, sizes: list[int]) -> list[np.ndarray | None]:
    """For each document of a chunk, which of its units the spans in the table cover; None where there are none."""
    pieces = [unpack(b, np.int64, np.int64, np.int64) for b in table["blob"].to_pylist()]
    out: list[np.ndarray | None] = [None] * len(sizes)
    if not pieces:
        return out
    place, start, end = (np.concatenate(p) for p in zip(*pieces, strict=True))
    order = np.argsort(place, kind="stable")
    place, start, end = place[order], start[order], end[order]
    for group in np.split(np.arange(len(place)), np.flatnonzero(np.diff(place)) + 1):
        p = int(place[group[0]])
        depth = np.zeros(sizes[p] + 1, dtype=np.int64)
        np.add.at(depth, start[group], 1)
        np.add.at(depth, end[group], -1)
        out[p] = np.cumsum(depth[:-1]) > 0
    return out
