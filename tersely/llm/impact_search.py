"""Ranked lexical search on a bit-sliced impact index.

Documents lie in blocks, ordered by id. `term_counts` counts, in one pass, each wanted term in each document and stores the
counts by block; the totals (documents, terms, documents of each term) are sums over the blocks. From these a block's index
is built for the search: of each term, the impact (weight times saturated frequency, an integer) of every document, sliced
by bits. A slice is a bitmap over the block's documents, of which only the words of 64 documents that hold the term at all
are kept. A query's scores are the sum of its terms' slices by bitwise ripple-carry addition, for many queries side by side.
The best k are found descending from the most significant slice: documents with the bit set stay if k or more have it, else
they are surely in and the search goes on among the others. Equal scores remain candidates to the end, where the smallest
ids fill up. Blocks' best are then ranked by query.

What is stored are counts, not impacts, since every added document changes the totals that impacts depend on. Tasks get
the queries' terms in groups of at most `GROUP_BYTES`; each group is one pass over the documents, so any number of queries
can be asked, and no more than a group is held by the driver.

A null text has no terms, nor has an item without terms any results. Rows of `items` with equal id and text are one item. A
null doc_id ranks behind other ids of equal score; repeated rows are documents of their own; empty tables give no rows; other
columns are left alone. Texts are counted whole.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tersely.llm.common import NULL_ID, column_bytes, durable, id_text
from tersely.llm.rolling import pack, unpack

#: Terms are runs of ASCII letters and digits and of all other characters from 0x80 on; A-Z are lower-cased.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of distinct query terms that tasks get at a time.
GROUP_BYTES = 4 << 20
#: Documents and counts at which a block ends, and 64-bit words of score slices (queries side by side) that are worked on at a time.
BLOCK_DOCS, BLOCK_COUNTS, LANE_WORDS = 16_384, 1 << 19, 1 << 16
COUNTS = "ids array<long>, n_docs long, n_terms long, df array<struct<term:int,n:int>>, counts binary, lengths binary"


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """`item_id long, key long, terms array<binary>`: of each distinct item, its distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(set(terms(t))) for t in column_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(own, pa.list_(pa.binary()))], names=["item_id", "key", "terms"])

    rows = id_text(items, id_col, text_col).distinct().select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    return rows.mapInArrow(run, "item_id long, key long, terms array<binary>").filter(F.size("terms") > 0)


def term_counts(docs: DataFrame, wanted: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of counts: rows (document's place, term, frequency) of the wanted terms, packed; lengths; totals of the block."""
    at = {t: i for i, t in enumerate(wanted)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = at.get

        def block(ids: list, lengths: list, *rows: array) -> pa.RecordBatch:
            key = np.array([NULL_ID if i is None else i for i in ids], dtype=np.int64)
            order = np.argsort(key, kind="stable")
            rank = np.empty(len(order), dtype=np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            where, term, times = (np.frombuffer(x, dtype=np.int32) for x in rows)
            where = rank[where]
            by = np.lexsort((where, term))
            n = np.array(lengths, dtype=np.int64)[order]
            seen, df = np.unique(term, return_counts=True)
            pairs = pa.StructArray.from_arrays([pa.array(seen, pa.int32()), pa.array(df, pa.int32())], names=["term", "n"])
            arrays = [
                pa.array([[ids[i] for i in order.tolist()]], pa.list_(pa.int64())), pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(seen)], pa.int32()), pairs), pa.array([pack(where[by], term[by], times[by])], pa.binary()), pa.array([n.tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["ids", "n_docs", "n_terms", "df", "counts", "lengths"])

        ids, lengths, places, found, times = [], [], array("i"), array("i"), array("i")
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), column_bytes(batch, "text"), strict=True):
                words = terms(text)
                known = Counter(map(number, words))
                known.pop(None, None)
                places.extend([len(ids)] * len(known))
                found.extend(known.keys())
                times.extend(known.values())
                ids.append(doc_id)
                lengths.append(len(words))
                if len(ids) >= BLOCK_DOCS or len(places) >= BLOCK_COUNTS:
                    yield block(ids, lengths, places, found, times)
                    ids, lengths, places, found, times = [], [], array("i"), array("i"), array("i")
        if ids:
            yield block(ids, lengths, places, found, times)

    return id_text(docs, id_col, text_col).mapInArrow(run, COUNTS)


def sliced(where: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's index: slices (bits x cells), each cell's word (64 documents), and where each term's cells begin.

    The rows are ordered by term, then place."""
    words = int(where.max()) // 64 + 1 if len(where) else 1
    key = term.astype(np.int64) * words + where // 64
    first = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, dtype=np.int64)
    bit = np.left_shift(np.uint64(1), (where % 64).astype(np.uint64))
    bits = int(impact.max(initial=0)).bit_length()
    slices = np.zeros((bits, len(first)), dtype=np.uint64)
    for b in range(bits if len(first) else 0):
        slices[b] = np.bitwise_or.reduceat(np.where((impact >> b) & 1 == 1, bit, np.uint64(0)), first)
    return slices, key[first] % words, np.searchsorted(key[first], np.arange(n_terms + 1) * words)


def add(total: np.ndarray, at: np.ndarray, slices: np.ndarray) -> None:
    """Adds the slices to the columns `at` of the running total, with a carry from bit to bit."""
    carry = np.zeros(len(at), dtype=np.uint64)
    for b in range(len(total)):
        if b >= len(slices) and not carry.any():
            return
        held = total[b, at]
        if b < len(slices):
            either = held ^ slices[b]
            total[b, at] = either ^ carry
            carry = (held & slices[b]) | (carry & either)
        else:
            total[b, at] = held ^ carry
            carry &= held


def highest(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of slices (bits x queries x words): bitmaps of the documents that are surely among a query's best k, and of those
    with equal scores from which the rest is to be taken. Documents with score 0 are in neither."""
    sure = np.zeros(total.shape[1:], dtype=np.uint64)
    maybe = np.bitwise_or.reduce(total, axis=0)
    for b in range(len(total) - 1, -1, -1):
        with_bit = sure | (maybe & total[b])
        n = np.bitwise_count(with_bit).sum(axis=1)[:, None]
        few = n <= k
        maybe = np.where(few, np.where(n == k, np.uint64(0), maybe & ~total[b]), maybe & total[b])
        sure = np.where(few, with_bit, sure)
    return sure, maybe


def members(bitmap: np.ndarray, most: int | None = None) -> list[int]:
    """Places of the bits that are set, in ascending order, as many as asked for."""
    out: list[int] = []
    for w in np.flatnonzero(bitmap).tolist():
        word = int(bitmap[w])
        while word and (most is None or len(out) < most):
            out.append(64 * w + (word & -word).bit_length() - 1)
            word &= word - 1
    return out


def best(where: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, queries: list[list[int]], n_terms: int, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, place, score) of each query's best k documents of a block."""
    slices, word, begin = sliced(where, term, impact, n_terms)
    if not len(slices):
        return
    words = n_docs // 64 + 1
    lanes = max(1, LANE_WORDS // words)
    for lo in range(0, len(queries), lanes):
        group = queries[lo : lo + lanes]
        deep = max(map(len, group))
        total = np.zeros((len(slices) + deep.bit_length(), len(group) * words), dtype=np.uint64)
        for turn in range(deep):  # the turn-th term of every query of the group
            cells = [(q, begin[own[turn]], begin[own[turn] + 1]) for q, own in enumerate(group) if turn < len(own) and begin[own[turn]] < begin[own[turn] + 1]]
            if cells:
                at = np.concatenate([word[a:b] + q * words for q, a, b in cells])
                add(total, at, np.concatenate([slices[:, a:b] for _, a, b in cells], axis=1))
        cube = total.reshape(len(total), len(group), words)
        sure, maybe = highest(cube, k)
        for q in range(len(group)):
            chosen = members(sure[q])
            for place in chosen + members(maybe[q], k - len(chosen)):
                yield lo + q, place, sum(int(cube[b, q, place // 64] >> np.uint64(place % 64) & np.uint64(1)) << b for b in range(len(cube)))


def weights(n_docs: int, df: list[int]) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df], dtype=np.int64)


def impacts(times: np.ndarray, length: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int, b: int = 90) -> np.ndarray:
    """Weight times saturated frequency, in integers; a document's length counts against the mean."""
    norm = (100 - b) + (b * length * n_docs) // max(1, n_terms)
    return weight * ((1_000_000_000 * times.astype(np.int64)) // (1000 * times.astype(np.int64) + 8 * norm))


def search_group(docs: DataFrame, group: list, k: int, id_col: str, text_col: str) -> DataFrame:
    """Each block's best for the items of one group: (item_id, key, doc_id, score)."""
    wanted = sorted({t for r in group for t in r.terms})
    number = {t: i for i, t in enumerate(wanted)}
    queries = [[number[t] for t in r.terms] for r in group]
    item_ids, keys = [r.item_id for r in group], [r.key for r in group]
    blocks = durable(term_counts(docs, wanted, id_col, text_col), "counts")
    whole = blocks.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("terms")).first()
    df = [0] * len(wanted)
    for r in blocks.select(F.inline("df")).groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term of the group
        df[r.term] = r.n
    n_docs, n_terms = whole.n or 0, whole.terms or 0
    weight = weights(n_docs, df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, counts, lengths in zip(batch.column("ids"), batch.column("counts"), batch.column("lengths"), strict=True):
                where, term, times = unpack(counts.as_py(), np.int32, np.int32, np.int32)
                length = np.frombuffer(lengths.as_py(), dtype=np.int64)
                impact = impacts(times, length[where], weight[term], n_docs, n_terms)
                found = list(best(where, term, impact, len(length), queries, len(wanted), k))
                places = pa.array([p for _, p, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item_ids[q] for q, _, _ in found], pa.int64()), pa.array([keys[q] for q, _, _ in found], pa.int64()), ids.values.take(places), pa.array([s for *_, s in found], pa.int64())],
                    names=["item_id", "key", "doc_id", "score"],
                )

    return blocks.mapInArrow(run, "item_id long, key long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score; of equal scores the smaller doc_id first."""
    asked = durable(item_terms(items, item_col, item_text_col), "items")
    size = asked.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 8))).first()[0] or 0
    n = max(1, math.ceil(size / GROUP_BYTES))
    found = None
    for g in range(n):
        group = asked.filter(F.pmod(F.col("key"), F.lit(n)) == g).orderBy("key").collect()
        if group:
            own = search_group(docs, group, k, id_col, text_col)
            found = own if found is None else found.unionAll(own)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id", "key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
