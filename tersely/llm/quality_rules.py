"""Quality rules: base rules of a document, and line frequency across documents.

Lines are normalised (lower case, digits as 0, single spaces) and hashed. For each host and line, the documents that hold
the line are counted (partly before the shuffle). Lines in more than `max_documents` documents and more than `max_percent` of
the host's documents are removed, and documents of which too few words are left are rejected.

Words are runs of bytes other than ASCII white space. Null and empty texts have none (and fail the base rules); a null
host is a host of its own; a null doc_id is carried along; rows equal in id, host and text give equal results, and each counts
as a document; an empty table gives an empty one; other columns are left alone.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersely.llm.common import column_bytes, durable, per_batch, quoted
from tersely.llm.rolling import K_TRIPLE, mix

#: Documents of any host, and percent of a host's documents, that may hold a line.
MAX_DOCUMENTS, MAX_PERCENT = 10, 5
#: Percent of a document's words that must be left.
MIN_LEFT = 30
SYMBOLS = re.compile(rb"[#*$%&|<>]")
DIGITS = bytes(48 if 48 <= c <= 57 else c for c in range(256))
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, host string, content long, " + ", ".join(f"{s} long" for s in STATS) + ", lines array<struct<h:long,words:long>>"


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that are found twice or more; hashes find the windows that may be, words decide."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    window = mix(mix(mix(h[:-2]) + h[1:-1] * K_TRIPLE[0]) + h[2:] * K_TRIPLE[1])
    _, index, count = np.unique(window, return_inverse=True, return_counts=True)
    maybe = np.flatnonzero(count[index] > 1).tolist()
    if not maybe:
        return 0
    exact = Counter(tuple(words[i : i + 3]) for i in maybe)
    marked: set[int] = set()
    for i in maybe:
        if exact[tuple(words[i : i + 3])] > 1:
            marked.update((i, i + 1, i + 2))
    return len(marked)


def normalised(line: bytes) -> bytes:
    return b" ".join(line.decode().lower().encode().translate(DIGITS).split())


def stats(text: bytes) -> tuple[list[int], list[tuple[int, int]]]:
    """The figures of STATS, and (hash, words) of each distinct normalised line."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    by_hash: dict[int, int] = {}
    for line in lines:
        h = xxhash.xxh64_intdigest(normalised(line)) - (1 << 63)
        by_hash[h] = by_hash.get(h, 0) + len(line.split())
    chars = sum(map(len, words)) if text.isascii() else len(b"".join(words).decode())
    return [len(words), chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words)], list(by_hash.items())


def apply_rules(
    docs: DataFrame, max_documents: int = MAX_DOCUMENTS, min_left: int = MIN_LEFT, max_percent: int = MAX_PERCENT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", cleaned: bool = False
) -> DataFrame:
    """One row per document: the base figures, `base_failed`, words in removed lines, `kept`.

    `cleaned` adds the text without the removed lines; it then travels with the row's figures."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = column_bytes(batch, "text")
        rows = [stats(t) for t in texts]
        figures = [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(len(STATS))]
        flat = [x for r in rows for x in r[1]]
        offsets = np.concatenate(([0], np.cumsum([len(r[1]) for r in rows]))).astype(np.int32)
        struct = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], pa.int64()) for i in (0, 1)], names=["h", "words"])
        content = pa.array([xxhash.xxh64_intdigest(t) - (1 << 63) for t in texts], pa.int64())
        arrays = [batch.column("doc_id"), batch.column("host"), content, *figures, pa.ListArray.from_arrays(pa.array(offsets), struct)]
        names = ["doc_id", "host", "content", *STATS, "lines"]
        if cleaned:
            arrays, names = [*arrays, batch.column("text")], [*names, "text"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    inputs = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(host_col).cast("string").alias("host"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    base = durable(inputs.mapInArrow(per_batch(lambda: step), SCHEMA + (", text string" if cleaned else "")), "lines")
    lines = base.select("doc_id", "host", "content", F.explode("lines").alias("line")).select("doc_id", "host", "content", "line.h", "line.words")
    # A document's lines are distinct, so rows are documents.
    held = lines.groupBy("host", "h").agg(F.count("*").alias("documents")).filter(F.col("documents") > max_documents)
    hosts = base.groupBy(F.col("host").alias("at")).agg(F.count("*").alias("all"))
    over = held.join(hosts, F.col("host").eqNullSafe(F.col("at"))).filter(100 * F.col("documents") > max_percent * F.col("all"))
    frequent = durable(over.select("at", F.col("h").alias("line")), "frequent")
    hit = lines.join(frequent, (F.col("h") == F.col("line")) & F.col("host").eqNullSafe(F.col("at")))
    removed = hit.groupBy(F.col("doc_id").alias("id"), F.col("host").alias("at"), F.col("content").alias("ch")).agg(F.collect_set(F.struct("h", "words")).alias("gone"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("host").eqNullSafe(F.col("at")) & (F.col("content") == F.col("ch"))
    out = base.join(removed, same, "left")
    lost = F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda a, x: a + x["words"]), F.lit(0).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("n_line_words", lost).withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (100 * (F.col("n_words") - F.col("n_line_words")) >= min_left * F.col("n_words")))
    columns = ["doc_id", *STATS, "base_failed", "kept", "n_line_words"]
    if not cleaned:
        return out.select(*columns)
    hashes = F.coalesce(F.transform("gone", lambda x: x["h"]), F.array().cast("array<long>"))
    return out.select(*columns, without(hashes, F.col("text")).alias("cleaned"))


def without(hashes, text):
    """The text without the lines of these hashes."""
    @F.pandas_udf("string")
    def strip(gone: pd.Series, texts: pd.Series) -> pd.Series:
        def one(own, t: str) -> str:
            known = set(own.tolist())
            return "\n".join(x for x in t.split("\n") if xxhash.xxh64_intdigest(normalised(x.encode())) - (1 << 63) not in known) if known else t

        return pd.Series([one(g, t) for g, t in zip(gone, texts, strict=True)], dtype=object)

    return strip(hashes, text)
