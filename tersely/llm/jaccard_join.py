"""N-gram Jaccard join with signature trees.

A document's set holds the hashes of its distinct `k`-word shingles (fewer words: the whole sequence as one). Documents
link when 100 * intersection >= percent * union.

1. Documents of equal sets form a class; only the class's least doc_id goes on. A class is told by 128 bits, of two
   independent hashes of the words.
2. Candidates, without loss: shingles are ordered by how many documents hold them, rarest first, then by hash. Linked sets share
   one of their first n - ceil(percent * n / 100) + 1 shingles, whatever the order; with this one, passages that many
   documents share hardly ever come first, and shingles that one document holds need no further look. To count, chunks of
   documents send their shingles, each once with its count, in order and packed, to buckets by hash, which answer with those that
   more than one document holds. The documents that have a shingle among their first meet, and the least of them is its pivot.
3. The documents of one pivot are compared together by signature trees: nodes hold the OR of their sets' bitmaps and their
   range of sizes, and a dual traversal leaves out pairs of nodes whose greatest possible overlap is too small, or whose
   sets are connected already. Leaves are compared exactly, and a link counts once the words themselves confirm it. A
   pivot's documents beyond `block_shingles` are dealt in blocks, each with the pivot.
4. The links' components. What is left of pivots with several blocks are pairs of documents in different blocks that
   aren't connected yet: documents are dealt anew by component, and only blocks of different components and of sizes that
   can link meet. So a group of near copies, however large, is done after step 3.
5. Components of all links, and the classes' members, give every document its component.

No task holds all of a pivot's documents or a component; each set and the least one it is connected with come out, never all pairs.

Null or empty texts have no shingles and link with nothing. A row with a null doc_id links with nothing and has a null
component. Rows are documents of their own; of rows that share a doc_id, those that are the least of their class count as
linked. An empty table gives an empty one; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersely.llm.chunks import parts
from tersely.llm.common import PIECE_BYTES, column_bytes, durable, id_text, pieces
from tersely.llm.components import components
from tersely.llm.rolling import Prefix, mix, pack, ranges, runs, unpack
from tersely.llm.substring_dedup import Words, slices

#: Shingles that a block of a pivot's documents holds, more or less.
BLOCK_SHINGLES = 60_000
LEAF_SETS, LEAF_SHINGLES, FANOUT = 64, 20_000, 8
#: Bytes of text whose shingles are sorted and packed at once, and those that a bucket stands for.
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
LOW = np.uint64(0xFFFFFFFF)

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
K1, K2, K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingles(w: Words, n_texts: int, k: int, stream: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of several texts: the text of each distinct shingle and its hash, ordered by both; two streams of hashes are independent."""
    prefix = Prefix(w.hash if stream == 0 else w.second())
    hashes = prefix.windows(k)
    text = w.text[: len(hashes)]
    valid = text == w.text[k - 1 :] if len(hashes) else np.zeros(0, dtype=bool)
    counts = np.bincount(w.text, minlength=n_texts) if len(w.text) else np.zeros(n_texts, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    first = (np.cumsum(counts) - counts)[short]
    whole = prefix.of(first, first + counts[short]) + counts[short].astype(np.uint64) * K3
    text = np.concatenate((text[valid], short))
    hashes = mix(np.concatenate((hashes[valid], whole)))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[new], hashes[new]


def per_text(texts: list[bytes], k: int) -> Iterator[tuple[int, int, Words, np.ndarray, np.ndarray]]:
    """By slice of the texts: (first text, one past the last, words, text of each shingle counted from the first, hash)."""
    for a, b in slices(texts, PIECE_BYTES):
        w = Words([t.translate(LOWER) for t in texts[a:b]])
        yield (a, b, w, *shingles(w, b - a, k))


def exact(text: bytes, k: int) -> set[bytes]:
    """The shingles themselves."""
    words = text.translate(LOWER).split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def sums(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each text, modulo 2**64; texts ascend."""
    total = np.concatenate(([np.uint64(0)], np.cumsum(values, dtype=np.uint64)))
    edge = np.searchsorted(text, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]


def first_shingles(text: np.ndarray, often: np.ndarray, keys: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's first shingles, those that others hold too: text and key, by text.

    Given are all shingles that others hold too (text, count of documents, key) and the sizes of all the texts' sets."""
    order = np.lexsort((keys, often, text))
    text, keys = text[order], keys[order]
    shared = np.bincount(text, minlength=len(sizes))
    alone = sizes - shared  # these come first
    place = np.arange(len(text)) - np.repeat(np.cumsum(shared) - shared, shared)
    first = place < (sizes + (-percent * sizes // 100) + 1 - alone)[text]
    first[1:] |= first[:-1] & (text[1:] == text[:-1]) & (keys[1:] == keys[:-1])
    return text[first], keys[first]


class Forest:
    """Disjoint sets with the least member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


class Node:
    """Of a signature tree: the sets below, the OR of their bitmaps, their sizes' range, their most hashes beyond one a bit."""

    def __init__(self, members: list[int], bits: np.ndarray, low: int, high: int, extra: int, below: list[Node] | None = None):
        self.members, self.bits, self.low, self.high, self.extra, self.below = members, bits, low, high, extra, below


def tree(members: list[int], sets: list[np.ndarray], width: int) -> Node:
    """A signature tree over sets in the order of their sizes; `width` bits (a power of two) a bitmap."""
    members = sorted(members, key=lambda i: (len(sets[i]), int(sets[i][0])))
    level, own, volume = [], [], 0
    for i in [*members, None]:
        if own and (i is None or len(own) == LEAF_SETS or volume + len(sets[i]) > LEAF_SHINGLES):
            bits, extra = np.zeros(width // 64, dtype=np.uint64), 0
            for j in own:
                mine = np.zeros(width, dtype=bool)
                mine[(sets[j] & np.uint64(width - 1)).astype(np.int64)] = True
                bits |= np.packbits(mine, bitorder="little").view(np.uint64)
                extra = max(extra, len(sets[j]) - int(mine.sum()))
            level.append(Node(own, bits, len(sets[own[0]]), len(sets[own[-1]]), extra))
            own, volume = [], 0
        if i is not None:
            own.append(i)
            volume += len(sets[i])
    while len(level) > 1:
        groups = [level[i : i + FANOUT] for i in range(0, len(level), FANOUT)]
        level = [Node([m for x in g for m in x.members], np.bitwise_or.reduce([x.bits for x in g]), g[0].low, g[-1].high, max(x.extra for x in g), g) for g in groups]
    return level[0]


def possible(a: Node, b: Node, percent: int) -> bool:
    """Whether sets of two nodes can link: by their sizes, and by the greatest overlap that the bitmaps allow."""
    if 100 * min(a.high, b.high) < percent * max(a.low, b.low):
        return False
    overlap = int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.extra, b.extra)
    return (100 + percent) * min(overlap, a.high, b.high) >= percent * (a.low + b.low)


def compare(a: list[int], b: list[int], sets: list[np.ndarray], percent: int, forest: Forest, confirm: Callable[[int, int], bool] | None = None) -> None:
    """Join what links between the sets of two leaves and, where asked, is confirmed by the words."""
    members = sorted({*a, *b})
    _, column = np.unique(np.concatenate([sets[i] for i in members]), return_inverse=True)
    sizes = np.array([len(sets[i]) for i in members])
    matrix = np.zeros((len(members), int(column.max()) + 1), dtype=np.float32)
    matrix[np.repeat(np.arange(len(members)), sizes), column] = 1
    where = {m: r for r, m in enumerate(members)}
    ra, rb = [where[i] for i in a], [where[i] for i in b]
    common = (matrix[ra] @ matrix[rb].T).astype(np.int64)
    linked = 100 * common >= percent * (sizes[ra][:, None] + sizes[rb][None, :] - common)
    for i, j in np.argwhere(linked).tolist():
        if forest.root(a[i]) != forest.root(b[j]) and (confirm is None or confirm(a[i], b[j])):
            forest.join(a[i], b[j])


def linked(left: list[int], right: list[int] | None, sets: list[np.ndarray], percent: int, confirm: Callable[[int, int], bool] | None = None) -> Forest:
    """The components of the links within one group of sets, or between two."""
    forest = Forest(len(sets))
    most = max(len(s) for s in sets)
    width = 1 << max(9, (min(most, LEAF_SHINGLES) * 16 - 1).bit_length())
    a = tree(left, sets, width)
    b = tree(right, sets, width) if right is not None else a
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if x is not y and not possible(x, y, percent):
            continue
        roots = {forest.root(i) for i in x.members} | {forest.root(i) for i in y.members}
        if len(roots) == 1 and len(x.members) + len(y.members) > 1:
            continue
        if x.below is None and y.below is None:
            compare(x.members, y.members, sets, percent, forest, confirm)
        elif x is y:
            stack += [(p, q) for i, p in enumerate(x.below) for q in x.below[i:]]
        elif y.below is None or x.below is not None and len(x.members) > len(y.members):
            stack += [(p, y) for p in x.below]
        else:
            stack += [(x, q) for q in y.below]
    return forest


SURVEY = "kind int, doc_id long, n_shingles long, k1 long, k2 long, bucket long, chunk long, blob binary"
DIGEST, OFFER, LOCAL = 0, 1, 2


def survey(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """Rows of three kinds, in one pass over the texts.

    DIGEST: `doc_id, n_shingles, k1, k2` of each document: its set's size and 128-bit digest (without shingles, of its doc_id).
    OFFER: of a chunk, the keys in a bucket (their lower halves, in order), how many documents hold each, and the place of the first.
    LOCAL: of a chunk, its documents and their sizes, and which documents hold the key at each place. The key of a shingle is
    its bucket and half of its hash: shingles that share a key only make more candidates."""
    names = [c.split()[0] for c in SURVEY.split(", ")]
    kinds = [pa.int32(), *[pa.int64()] * 6, pa.binary()]

    def rows(n: int, kind: int, **columns) -> pa.RecordBatch:
        given = columns | {"kind": [kind] * n}
        return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in zip(names, kinds, strict=True)], names=names)

    def chunk(number: int, ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        numbers = np.array([0 if i is None else i for i in ids], dtype=np.int64).view(np.uint64)
        sizes, owners, keys = [], [], []
        for a, b, w, text, hashes in per_text(texts, k):
            size = np.bincount(text, minlength=b - a)
            text2, hashes2 = shingles(w, b - a, k, 1)
            one = np.where(size == 0, mix(numbers[a:b] ^ K1), sums(mix(hashes ^ K1), text, b - a))
            two = np.where(size == 0, mix(numbers[a:b] ^ K2), sums(mix(hashes2 ^ K2), text2, b - a))
            yield rows(b - a, DIGEST, doc_id=ids[a:b], n_shingles=size, k1=one.view(np.int64), k2=two.view(np.int64))
            sizes.append(size)
            owners.append((text + a).astype(np.int32))
            keys.append(((hashes >> np.uint64(32)) * np.uint64(buckets)) & ~LOW | (hashes & LOW))
        owner, key = np.concatenate(owners), np.concatenate(keys)
        del owners, keys
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        owner, key = owner[order], key[order]
        begin, end = runs(key[1:] == key[:-1])
        key, held = key[begin], (end - begin).astype(np.int32)
        del order, begin, end
        yield rows(1, LOCAL, chunk=[number], blob=[pack(np.array([-1 if i is None else i for i in ids]), np.array([i is None for i in ids]), np.concatenate(sizes), held, owner)])
        bucket = (key >> np.uint64(32)).astype(np.int64)
        first, last = runs(bucket[1:] == bucket[:-1])
        low = (key & LOW).astype(np.uint32)
        blobs = [pack(np.array([a], dtype=np.int64), np.diff(low[a:b], prepend=np.uint32(0)), held[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        yield rows(len(blobs), OFFER, bucket=bucket[first], chunk=[number] * len(blobs), blob=blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in (x for b in batches for x in pieces(b, "text")):
            for i, t in zip(batch.column("doc_id").to_pylist(), column_bytes(batch, "text"), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t) + 1
                if size >= CHUNK_BYTES:
                    yield from chunk(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield from chunk(number, ids, texts)

    return docs.mapInArrow(run, SURVEY)


def shared_keys(table: pa.Table) -> pa.Table:
    """Of a bucket's offers: for each chunk, the places of keys that more than one document holds, the keys, their counts."""
    bucket = table["bucket"][0].as_py()
    offers = [unpack(b, np.int64, np.uint32, np.int32) for b in table["blob"].to_pylist()]
    low = [np.cumsum(o[1], dtype=np.uint32) for o in offers]
    known, index = np.unique(np.concatenate(low), return_inverse=True)
    often = np.bincount(index, weights=np.concatenate([o[2] for o in offers])).astype(np.int64)
    chunks, blobs, at = [], [], 0
    for chunk, (start, _, _), own in zip(table["chunk"].to_pylist(), offers, low, strict=True):
        count = often[index[at : at + len(own)]]
        at += len(own)
        pick = np.flatnonzero(count > 1)
        if len(pick):
            chunks.append(chunk)
            blobs.append(pack(np.diff(pick + start[0], prepend=0).astype(np.int32), np.diff(own[pick], prepend=np.uint32(0)), np.minimum(count[pick], (1 << 31) - 1).astype(np.int32)))
    return pa.table({"bucket": pa.array([bucket] * len(chunks), pa.int64()), "chunk": pa.array(chunks, pa.int64()), "blob": pa.array(blobs, pa.binary())})


def first_of_chunk(local: pa.Table, answers: pa.Table, percent: int) -> pa.Table:
    """`doc_id, n, sigs` of the documents of a chunk that have first shingles which others hold too."""
    ids, null, sizes, held, owner = unpack(local["blob"][0].as_py(), np.int64, np.bool_, np.int64, np.int32, np.int32) if len(local) else (np.zeros(0, np.int64),) * 5
    told = [(b, *unpack(blob, np.int32, np.uint32, np.int32)) for b, blob in zip(answers["bucket"].to_pylist(), answers["blob"].to_pylist(), strict=True)]
    out_ids, out_sizes, offsets, sigs = ids[:0], sizes[:0], np.zeros(1, np.int32), np.zeros(0, np.uint64)
    if told:
        place = np.concatenate([np.cumsum(t[1], dtype=np.int64) for t in told])
        keys = np.concatenate([(np.uint64(b) << np.uint64(32)) | np.cumsum(low, dtype=np.uint32).astype(np.uint64) for b, _, low, _ in told])
        often = np.concatenate([t[3] for t in told])
        n = held[place].astype(np.int64)
        start = (np.cumsum(held, dtype=np.int64) - held)[place]
        text, sigs = first_shingles(owner[np.repeat(start, n) + ranges(n)], np.repeat(often, n), np.repeat(keys, n), sizes, percent)
        keep = ~null[text]
        text, sigs = text[keep], sigs[keep]
        some = np.unique(text)
        out_ids, out_sizes = ids[some], sizes[some]
        offsets = np.append(np.searchsorted(text, some), len(text)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sigs.view(np.int64)))
    return pa.table({"doc_id": pa.array(out_ids, pa.int64()), "n": pa.array(out_sizes, pa.int64()), "sigs": lists})


def group_links(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """`a, b`: of the groups (`pivot, i, j`) of rows `pivot, i, j, doc_id, block, text` that are sorted by group and doc_id, each
    set linked with others and the least of them. Where i = j, all of a group are compared, else those of two blocks."""

    def flush(group: list[tuple[int, int, bytes]], i: int, j: int):
        flat = [g[2] for g in group]
        sets = []
        for a, b, _, text, hashes in per_text(flat, k):
            edge = np.searchsorted(text, np.arange(b - a + 1))
            sets += [hashes[x:y] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        left = [p for p, g in enumerate(group) if g[1] == i]
        right = None if i == j else [p for p, g in enumerate(group) if g[1] == j]
        words: dict[int, set[bytes]] = {}

        def confirm(p: int, q: int) -> bool:
            for x in (p, q):
                if x not in words:
                    if len(words) > LEAF_SETS:
                        words.clear()
                    words[x] = exact(flat[x], k)
            one, two = words.get(p) or exact(flat[p], k), words[q]
            common = len(one & two)
            return 100 * common >= percent * (len(one) + len(two) - common)

        if left and (right is None or right):
            forest = linked(left, right, sets, percent, confirm)
            # The rows ascend by doc_id, so a root is the least of its component.
            yield from ((g[0], group[r][0]) for p, g in enumerate(group) if (r := forest.root(p)) != p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []
        for batch in (x for b in batches for x in pieces(b, "text")):
            columns = [batch.column(c).to_pylist() for c in ("pivot", "i", "j", "doc_id", "block")]
            for c, i, j, d, block, text in zip(*columns, column_bytes(batch, "text"), strict=True):
                if (c, i, j) != key:
                    if group:
                        out += flush(group, key[1], key[2])
                    key, group = (c, i, j), []
                group.append((d, block, text))
            if len(out) > 10_000:
                yield edges(out)
                out = []
        if group:
            out += flush(group, key[1], key[2])
        if out:
            yield edges(out)

    def edges(out):
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    dealt = rows.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "doc_id")
    return dealt.mapInArrow(run, "a long, b long")


def candidates(sigs: DataFrame, percent: int) -> DataFrame:
    """`pivot, doc_id, n`: each document and the least of each bucket it is in."""
    rows = sigs.select("doc_id", "n", F.explode("sigs").alias("sig"))
    least = F.min(F.struct("doc_id", "n"))
    heads = rows.groupBy("sig").agg(least.alias("head"), F.count("*").alias("held")).filter("held > 1")
    heads = heads.select("sig", F.col("head.doc_id").alias("pivot"), F.col("head.n").alias("pivot_n"), "held")
    fits = 100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")
    # Of a bucket of two whose sizes don't fit, nothing can link; larger ones may link within.
    return rows.join(heads, "sig").filter((F.col("doc_id") != F.col("pivot")) & ((F.col("held") > 2) | fits)).select("pivot", "doc_id", "n").distinct()


def left_over(members: DataFrame, links: DataFrame, percent: int, block_shingles: int) -> DataFrame:
    """`pivot, i, j, doc_id, block` of documents (`pivot, doc_id, n`) that are dealt in blocks and not connected yet."""
    labels = components(links).withColumnRenamed("component", "label")
    known = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    apart = known.groupBy("pivot").agg(F.min("label").alias("one"), F.max("label").alias("other")).filter("one <> other").select("pivot")
    known = durable(known.join(apart, "pivot", "left_semi"), "apart")
    volume = known.groupBy("pivot", "label").agg(F.sum("n").alias("volume"))
    # A component of a block or more has blocks of its own; the others are put together whole.
    large = F.col("volume") >= block_shingles
    small = volume.filter(~large).groupBy("pivot").agg(F.ceil(F.sum("volume") / block_shingles).cast("int").alias("together"))
    volume = volume.join(small, "pivot", "left").select(
        "pivot", "label", F.when(large, F.col("label")).alias("own"), F.when(large, F.ceil(F.col("volume") / block_shingles)).otherwise(F.col("together")).cast("int").alias("blocks")
    )
    dealt = known.join(volume, ["pivot", "label"]).withColumn("nth", F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("label")).otherwise(F.col("doc_id"))), F.col("blocks")))
    dealt = durable(dealt.select("pivot", "doc_id", "n", "own", F.xxhash64("own", "nth").alias("block")), "dealt")
    blocks = dealt.groupBy("pivot", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("own").alias("own"))
    a, b = blocks.alias("a"), blocks.alias("b")
    fits = (100 * F.least("a.high", "b.high") >= percent * F.greatest("a.low", "b.low")) & ~F.coalesce(F.col("a.own") == F.col("b.own"), F.lit(False))
    meet = a.join(b, (F.col("a.pivot") == F.col("b.pivot")) & (F.col("a.block") <= F.col("b.block"))).filter(fits).select(F.col("a.pivot").alias("pivot"), F.col("a.block").alias("i"), F.col("b.block").alias("j"))
    either = meet.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    return dealt.join(either, ["pivot", "block"]).select("pivot", "i", "j", "doc_id", "block")


def join_similar(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document: `doc_id, n_shingles, component_id` (the smallest doc_id reachable by links)."""
    rows = id_text(docs, id_col, text_col)
    read = durable(survey(rows, k, parts(rows, "text", BUCKET_BYTES)), "survey")
    sized = read.filter(f"kind = {DIGEST}").select("doc_id", "n_shingles", "k1", "k2")
    classes = durable(sized.filter("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    known = rows.filter("doc_id is not null")
    answers = read.filter(f"kind = {OFFER}").select("bucket", "chunk", "blob").groupBy("bucket").applyInArrow(lambda table: shared_keys(table), "bucket long, chunk long, blob binary")
    local = read.filter(f"kind = {LOCAL}").select("chunk", "blob")
    first = local.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda left, right: first_of_chunk(left, right, percent), "doc_id long, n long, sigs array<long>")
    sigs = durable(first.join(reps, "doc_id", "left_semi"), "sigs")
    pairs = durable(candidates(sigs, percent), "pairs")
    blocks = pairs.groupBy("pivot").agg(F.greatest(F.ceil(F.sum("n") / block_shingles), F.lit(1)).cast("int").alias("blocks"))
    dealt = pairs.join(blocks, "pivot").select("pivot", "doc_id", "n", "blocks", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("long").alias("block"))
    everywhere = blocks.select("pivot", F.col("pivot").alias("doc_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"))
    grouped = dealt.select("pivot", "doc_id", "block").unionByName(everywhere).withColumn("i", F.col("block")).withColumn("j", F.col("block"))
    links = durable(group_links(known.join(grouped, "doc_id"), k, percent), "links")
    hot = dealt.filter("blocks > 1").select("pivot", "doc_id", "n")
    if not hot.isEmpty():
        more = left_over(hot, links, percent, block_shingles)
        links = links.unionByName(durable(group_links(known.join(more, "doc_id"), k, percent), "more"))
    found = components(links)
    groups = durable(
        classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id")), "groups"
    )
    out = sized.filter("doc_id is not null").join(groups, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    missing = sized.filter("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(missing)
