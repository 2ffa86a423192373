"""Substring dedup by super-k-mer partitioning, over words.

A window is WIDTH consecutive words of one document. Its minimiser is the least hash of the GRAM-word runs within it.
Consecutive windows that share a minimiser travel as one packed string (a super-k-mer) to the minimiser's bucket; equal
windows have equal minimisers, so a bucket sees every occurrence of its windows, and sorting the windows' hashes there
counts them; bytes are compared before windows count as equal. Equal super-k-mers of a chunk are sent once (the
others are decided where they are), so a passage that a third of all documents share does not fill one bucket.

Words are runs of bytes other than ASCII white space, unchanged. Null or empty texts have none; texts shorter than a
window lose nothing. Rows that share a doc_id are separate documents, so repeated rows repeat each other's windows; a
null doc_id is carried along; an empty table gives an empty one; other columns are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tersely.llm.chunks import BLOBS, Spans, blob_table, by_bucket, chunked, covered, documents, parts
from tersely.llm.rolling import Prefix, hash_words, mix, pack, ranges, runs, sliding_min, unpack, words

WIDTH = 35
GRAM = 3
#: Bytes of text that are turned to arrays at once.
SLICE_BYTES = 4 << 20
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Words:
    """The words of several texts: normalised bytes (single spaces), starts, ends, hashes, the text and the place in it of each."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        start, end = words(data)
        lengths = end - start
        depth = np.zeros(len(data) + 1, dtype=np.int8)
        depth[start] += 1
        depth[end] -= 1
        gaps = np.cumsum(depth, dtype=np.int8).astype(bool)
        gaps[end] = True  # one byte after each word stays, as its separator
        padded = np.append(data, np.uint8(10))
        flat = padded[gaps]
        self.end = np.cumsum(lengths + 1) - 1
        self.start = self.end - lengths
        flat[self.end] = 32
        self.bytes = flat.tobytes()
        self.hash = hash_words(flat, self.start, lengths)
        self.flat, self.lengths = flat, lengths
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.text = np.searchsorted(offsets, start, side="right") - 1
        first = np.searchsorted(self.text, np.arange(len(texts)))
        self.place = np.arange(len(start)) - first[self.text] if len(start) else start


    def second(self) -> np.ndarray:
        """Other hashes of the words, independent of the first."""
        return hash_words(self.flat, self.start, self.lengths, 1)


def super_kmers(w: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First windows, numbers of windows and minimisers."""
    n = len(w.hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding_min(mix(Prefix(w.hash).windows(gram)), width - gram + 1)
    valid = w.text[:n] == w.text[width - 1 :]
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at, least[:0]
    first, last = runs((np.diff(at) == 1) & (least[at[1:]] == least[at[:-1]]) & (w.text[at[1:]] == w.text[at[:-1]]))
    return at[first], last - first, least[at[first]]


def slices(texts: list[bytes], most: int = SLICE_BYTES):
    """Ranges of texts of about `most` bytes each."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def send(chunk: int, texts: list[bytes], buckets: int, width: int, gram: int) -> pa.Table:
    """The super-k-mers of a chunk as blobs by bucket, and the spans that the chunk itself decides."""
    known: dict[bytes, int] = {}
    minimiser, counts, where = [], [], []  # of each distinct super-k-mer: its minimiser, windows, first occurrence
    repeated: list[bool] = []
    spans = Spans()
    for a, b in slices(texts):
        w = Words(texts[a:b])
        first, n, least = super_kmers(w, width, gram)
        if not len(first):
            continue
        lo, hi = w.start[first].tolist(), w.end[first + n + width - 2].tolist()
        place, at = (w.text[first] + a).tolist(), w.place[first].tolist()
        flat, own = w.bytes, []
        for i, key in enumerate([flat[x:y] for x, y in zip(lo, hi, strict=True)]):
            k = known.setdefault(key, len(known))
            if k == len(minimiser):
                minimiser.append(least[i])
                counts.append(n[i])
                where.append((place[i], at[i]))
                repeated.append(False)
            else:
                if not repeated[k]:
                    repeated[k] = True
                    own.append((*where[k], counts[k]))
                own.append((place[i], at[i], n[i]))
        if own:
            p, s, m = np.array(own, dtype=np.int64).T
            spans.add(chunk, p, s, s + m + width - 1)
    strings = list(known)
    minimiser, counts = np.array(minimiser, dtype=np.uint64), np.array(counts, dtype=np.int32)
    where, repeated = np.array(where, dtype=np.int32).reshape(-1, 2), np.array(repeated, dtype=bool)
    rows = spans.rows(bucket=chunk % buckets)
    for bucket, own in by_bucket(minimiser, buckets):
        own = own[np.lexsort((where[own, 1], where[own, 0]))]
        rows.append((bucket, chunk, 0, pack(counts[own], np.where(repeated[own], -1, where[own, 0]).astype(np.int32), where[own, 1], b" ".join([strings[i] for i in own.tolist()]))))
    return blob_table(rows)


def count_windows(table: pa.Table, width: int) -> pa.Table:
    """Spans of the windows of a bucket that start more than once; spans that came along pass."""
    spans, blobs, passed = Spans(), [], []
    for bucket, chunk, kind, blob in zip(*(table[c].to_pylist() for c in ("bucket", "chunk", "kind", "blob")), strict=True):
        if kind:
            passed.append((bucket, chunk, kind, blob))
        else:
            blobs.append((chunk, *unpack(blob, np.int32, np.int32, np.int32, None)))
    if not blobs:
        return blob_table(passed)
    chunk = np.repeat([b[0] for b in blobs], [len(b[1]) for b in blobs])
    n, place, at = (np.concatenate([b[i] for b in blobs]).astype(np.int64) for i in (1, 2, 3))
    w = Words([b" ".join([b[4] for b in blobs])])
    first = np.cumsum(n + width - 1) - (n + width - 1)  # the first word of each super-k-mer
    kmer = np.repeat(np.arange(len(n)), n)
    window = np.repeat(first, n) + ranges(n)
    hashes = Prefix(w.hash).windows(width)[window]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    begin, end = runs(same)
    total = np.add.reduceat(np.where(place[kmer[order]] < 0, 2, 1), begin)
    rep, many = np.empty(len(window), np.int64), np.empty(len(window), bool)
    rep[order] = np.repeat(order[begin], end - begin)
    many[order] = np.repeat(total > 1, end - begin)
    if not verified(w, window, kmer, rep, many, width):
        seen: dict[bytes, int] = {}
        keys = [w.bytes[a:b] for a, b in zip(w.start[window].tolist(), w.end[window + width - 1].tolist(), strict=True)]
        for k, own in zip(keys, np.where(place[kmer] < 0, 2, 1).tolist(), strict=True):
            seen[k] = seen.get(k, 0) + own
        many = np.array([seen[k] > 1 for k in keys])
    hit = np.flatnonzero(many & (place[kmer] >= 0))
    if len(hit):
        a, b = runs((np.diff(hit) == 1) & (kmer[hit[1:]] == kmer[hit[:-1]]))
        k = kmer[hit[a]]
        start = at[k] + window[hit[a]] - first[k]
        for c in np.unique(chunk[k]).tolist():
            own = chunk[k] == c
            spans.add(c, place[k[own]], start[own], start[own] + (b - a)[own] + width - 1)
    return blob_table(passed + spans.rows())


def verified(w: Words, window: np.ndarray, kmer: np.ndarray, rep: np.ndarray, many: np.ndarray, width: int) -> bool:
    """Whether windows of equal hash have equal bytes: compared in runs, each with the run of its representatives."""
    at = np.flatnonzero(many & (rep != np.arange(len(rep))))
    if not len(at):
        return True
    a, b = runs((np.diff(at) == 1) & (np.diff(rep[at]) == 1) & (np.diff(kmer[at]) == 0) & (np.diff(kmer[rep[at]]) == 0))
    x0, y0 = window[at[a]], window[rep[at[a]]]
    more = b - a + width - 2
    flat = w.bytes
    return all(flat[p:q] == flat[r:s] for p, q, r, s in zip(w.start[x0].tolist(), w.end[x0 + more].tolist(), w.start[y0].tolist(), w.end[y0 + more].tolist(), strict=True))


def dedup_substrings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", return_text: bool = False) -> DataFrame:
    """One row per document: words, words removed and the digest of the kept ones; `kept`, their text, on request."""
    n = parts(docs, text_col)
    inputs = chunked(docs, n, id_col, text_col)

    def sent(key, table):
        return send(key[0].as_py(), documents(table)[2], n, width, gram)

    def finish(key, left, right):
        ids, _, texts = documents(left)
        split = [t.split() for t in texts]
        marks = covered(right, [len(s) for s in split])
        kept = [s if m is None else [x for x, gone in zip(s, m.tolist(), strict=True) if not gone] for s, m in zip(split, marks, strict=True)]
        flat = [b" ".join(k) for k in kept]
        out = {
            "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(map(len, split), pa.int64()),
            "n_removed": pa.array([len(s) - len(k) for s, k in zip(split, kept, strict=True)], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(f).hexdigest() for f in flat], pa.string()),
        }
        if return_text:
            out["kept"] = pa.array([f.decode() for f in flat], pa.string())
        return pa.table(out)

    blobs = inputs.groupBy("chunk").applyInArrow(sent, BLOBS)
    spans = blobs.groupBy("bucket").applyInArrow(lambda table: count_windows(table, width), BLOBS)
    return inputs.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(finish, SCHEMA + (", kept string" if return_text else ""))
