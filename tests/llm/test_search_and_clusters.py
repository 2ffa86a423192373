"""Ranked search, media containers and ball k-means against brute force, and on edge cases."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.corpus import EXTRA, FILL, LONG, edge_rows, edge_table, empty_table, random_texts, table
from tersely.llm import ball_kmeans, impact_search, media
from tersely.llm.ball_kmeans import Balls, cluster_vectors
from tersely.llm.impact_search import search
from tersely.llm.media import box, full, media_columns, store, text_media

# ---- ranked search


def brute_search(docs, items, k=10):
    terms = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in docs]
    n_docs, total = sum(map(bool, terms)), sum(map(len, terms))
    tf = [Counter(t) for t in terms]
    out = []
    for item, text in dict.fromkeys(items):
        scores = [0] * len(docs)
        for term in set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))):
            w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(term in x for x in tf) + 1)))
            for i, x in enumerate(tf):
                if f := x[term]:
                    scores[i] += w * (1_000_000_000 * f // (1000 * f + 8 * (10 + 90 * len(terms[i]) * n_docs // total)))
        order = sorted((-s, docs[i][0] is None, docs[i][0] or 0) for i, s in enumerate(scores) if s > 0)[:k]
        out += [(item, r, None if no_id else i, -s) for r, (s, no_id, i) in enumerate(order, 1)]
    return Counter(out)


def found(frame):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_ranked_search(spark, monkeypatch, seed):
    monkeypatch.setattr(impact_search, "BLOCK_DOCS", 70)
    monkeypatch.setattr(impact_search, "LANE_WORDS", 5)
    texts = random_texts(300, seed)
    items = [(i, " ".join(random.Random(i).sample(t.split() or ["x"], min(12, len(t.split()) or 1)))) for i, t in enumerate(texts[:40])]
    got = found(search(table(spark, texts).repartition(3), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute_search(list(enumerate(texts)), items) and len(got) > 100


def test_ranked_search_in_groups_of_queries(spark, monkeypatch):
    monkeypatch.setattr(impact_search, "GROUP_BYTES", 200)
    texts = random_texts(80, 5)
    items = [(i % 7, t) for i, t in enumerate(texts[:12])]
    assert found(search(table(spark, texts), spark.createDataFrame(items, "item_id long, text string"))) == brute_search(list(enumerate(texts)), items)


def test_ranked_search_edges(spark):
    docs = [(i, t) for i, t, *_ in edge_rows()]
    items = [(1, "ALPHA gamma"), (1, "ALPHA gamma"), (1, "wort"), (None, "lang"), (2, None), (3, " .,- "), (4, "unknown"), (5, "é" * 70), (6, "alpha alpha nul")]
    asked = spark.createDataFrame([r + FILL for r in items], f"item_id long, text string, {EXTRA}")
    got = found(search(edge_table(spark), asked))
    assert got == brute_search(docs, items)
    assert [r.doc_id for r in search(edge_table(spark), asked).filter("item_id = 1 and score > 0").orderBy("rank").collect() if r.doc_id != 5][:1] == [1]
    assert search(empty_table(spark), asked).count() == 0 and search(edge_table(spark), asked.limit(0)).count() == 0


def test_ties_beyond_k_take_the_smallest_ids(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(500, 0, -1)] + [(1000 + i, "other") for i in range(600)], "doc_id long, text string").repartition(5)
    rows = search(docs, spark.createDataFrame([(7, "words")], "item_id long, text string")).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == list(range(1, 11)) and len({r.score for r in rows}) == 1


def test_carry_addition_and_descent():
    r = np.random.default_rng(4)
    values = r.integers(0, 1 << 34, (9, 200)) * (r.random((9, 200)) < 0.4)
    total = np.zeros((40, 4), dtype=np.uint64)
    for v in values:
        where = np.flatnonzero(v)
        slices, word, begin = impact_search.sliced(where, np.zeros(len(where), dtype=np.int32), v[where], 1)
        impact_search.add(total, word[begin[0] : begin[1]], slices)
    sums = [sum(int(total[b, i // 64] >> np.uint64(i % 64) & np.uint64(1)) << b for b in range(40)) for i in range(200)]
    assert sums == values.sum(axis=0).tolist()
    sure, maybe = impact_search.highest(total[:, None, :], 10)
    best = sorted(range(200), key=lambda i: (-sums[i], i))[:10]
    chosen = impact_search.members(sure[0])
    assert sorted(chosen + impact_search.members(maybe[0], 10 - len(chosen))) == sorted(best)


# ---- ball k-means


def brute_kmeans(rows, k=8, rounds=10, dim=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, v in kept:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(s) for x in zip(*s, strict=True)] if s else c for s, c in zip(own, centroids, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    spread = Counter()
    for _, d, j in last:
        spread[j] += d
    return Counter((i, j, d, spread[j], sum(spread.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in last)


def clusters(frame):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in frame.collect())


VECTORS = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("store_every", [1, 4])
def test_ball_kmeans(spark, monkeypatch, store_every):
    monkeypatch.setattr(ball_kmeans, "STORE_EVERY", store_every)
    r = random.Random(8)
    centres = [[r.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, 0.7) for x in r.choice(centres)]) for i in range(300)]
    assert clusters(cluster_vectors(spark.createDataFrame(rows, VECTORS).repartition(3))) == brute_kmeans(rows)


def test_ball_kmeans_edges(spark):
    same, zero = [0.25] * 64, [0.0] * 64
    rows = [(1, same), (1, same), (2, same), (3, zero), (None, same), (None, [float(i) for i in range(64)]), (4, None), (5, [1.0] * 63), (6, [None] + [1.0] * 63), (7, [float("nan")] * 64), (8, [float("-inf")] + [0.0] * 63), (9, [-0.0001] * 64), (10, []), (3, zero)]
    extra = spark.createDataFrame([(*x, 1, "c", "d") for x in rows], f"{VECTORS}, cluster int, home string, ids string").repartition(3)
    assert clusters(cluster_vectors(extra)) == brute_kmeans(rows)
    assert clusters(cluster_vectors(extra.filter("vec_id in (1, 3)"))) == brute_kmeans([x for x in rows if x[0] in (1, 3)])
    assert cluster_vectors(extra.limit(0)).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        cluster_vectors(spark.createDataFrame([(1, [1e300] * 64)], VECTORS)).collect()


def test_balls_compare_few_and_miss_none():
    r = np.random.default_rng(2)
    centroids = r.integers(-900, 900, (8, 16))
    vectors = np.concatenate([c + r.integers(-200, 200, (200, 16)) for c in centroids]).astype(np.int32)
    grid = np.concatenate([vectors, ((centroids[:, None] + centroids[None]) // 2).reshape(-1, 16).astype(np.int32)])
    every = np.stack([ball_kmeans.squared(grid, c) for c in centroids])
    balls = Balls(centroids)
    home, distance, all_compared = balls.assign(grid, np.zeros(len(grid), dtype=np.int32))
    assert home.tolist() == every.argmin(axis=0).tolist() and distance.tolist() == every.min(axis=0).tolist()
    again, _, compared = balls.assign(grid, home)
    assert again.tolist() == home.tolist() and len(grid) <= compared < 2 * len(grid) < all_compared


# ---- media columns


def media_rows(texts):
    out = []
    for i, text in texts:
        raw = (text or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        out.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    return Counter(out)


def test_media_of_texts(spark):
    texts = [(i, "é" * i + "x" * (37 * i)) for i in range(120)]
    rows = text_media(table(spark, [t for _, t in texts]).repartition(2)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == media_rows(texts)
    for r in rows:
        codec, ms, n, ranges = r.feature.split(":")
        places = [tuple(map(int, x.split("+"))) for x in ranges.split(",")]
        first = r.media_bytes - r.payload_bytes
        assert (codec, int(ms), int(n)) == ("raw ", r.payload_bytes // 192 * 40, r.payload_bytes // 192)
        assert places == [(first + 192 * k, 192) for k in range(0, int(n), 12)] and r.n_keyframes == len(places)


def test_media_of_texts_edges(spark, monkeypatch):
    monkeypatch.setattr(media, "BATCH_BYTES", 2000)
    rows = text_media(edge_table(spark)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == media_rows([(i, t) for i, t, *_ in edge_rows()])
    assert len({(r.media_sha256, r.feature) for r in rows if r.n_bytes == len(LONG)}) == 1
    assert text_media(empty_table(spark)).count() == 0


def u32(*values):
    return struct.pack(f">{len(values)}I", *values)


def two_tracks(first):
    """A film of five frames of given sizes in chunks of 2, 2 and 1, and sound of constant size in two chunks between them."""
    sizes, at = [10, 20, 30, 40, 50], first
    picture = [at, at + 30 + 16, at + 30 + 16 + 70 + 16]
    sound = [at + 30, at + 30 + 16 + 70]
    video = box(b"stbl", full(b"stsd", u32(1), box(b"avc1", bytes(24), struct.pack(">HH", 640, 360), bytes(50))), full(b"stts", u32(1, 5, 512)), full(b"stss", u32(2, 1, 4)), full(b"stsc", u32(2, 1, 2, 1, 3, 1, 1)), full(b"stsz", u32(0, 5, *sizes)), full(b"stco", u32(3, *picture)))
    audio = box(b"stbl", full(b"stsd", u32(1), box(b"twos", bytes(28))), full(b"stts", u32(1, 8, 1)), full(b"stsc", u32(1, 1, 4, 1)), full(b"stsz", u32(4, 8)), full(b"co64", u32(2), struct.pack(">2Q", *sound)))
    track = lambda n, kind, mdhd, stbl: box(b"trak", full(b"tkhd", u32(0, 0, n, 0, 0)), box(b"mdia", mdhd, full(b"hdlr", u32(0), kind, bytes(12)), box(b"minf", stbl)))
    long_mdhd = box(b"mdhd", bytes([1, 0, 0, 0]), bytes(16), struct.pack(">IQ", 8000, 8), bytes(4))
    moov = box(b"moov", track(1, b"vide", full(b"mdhd", u32(0, 0, 12800, 0, 0)), video), box(b"uuid", bytes(16), b"own"), track(2, b"soun", long_mdhd, audio))
    return moov, picture, sound, sizes


@pytest.mark.parametrize("moov_first", [True, False])
def test_boxes_of_two_tracks(moov_first):
    payload = bytes(range(182))
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload
    head = box(b"ftyp", b"isom", bytes(4)) + box(b"free")
    first = len(head) + 16 + (len(two_tracks(0)[0]) if moov_first else 0)
    moov, picture, sound, sizes = two_tracks(first)
    content = head + (moov + mdat if moov_first else mdat + moov)
    video, audio = (t.row() for t in media.probe(content))
    assert (video["track"], video["handler"], video["codec"], video["timescale"], video["duration"], video["width"], video["height"]) == (1, "vide", "avc1", 12800, 2560, 640, 360)
    assert video["keyframes"] == [{"offset": picture[0], "length": 10}, {"offset": picture[1] + 30, "length": 40}] and video["n_samples"] == 5 and video["n_bytes"] == 150
    assert (audio["codec"], audio["timescale"], audio["duration"], audio["n_samples"]) == ("twos", 8000, 8, 8)
    assert audio["keyframes"] == [{"offset": a, "length": 16} for a in sound] and not audio["damaged"]
    tracks = media.probe(content)
    assert media.samples(content, tracks[0]) == payload[:30] + payload[46:116] + payload[132:182] and media.samples(content, tracks[1]) == payload[30:46] + payload[116:132]
    if moov_first:  # the head suffices
        assert [t.row() for t in media.probe(content[: first - 16])] == [video, audio]


def test_fragments():
    trak = box(b"trak", full(b"tkhd", u32(0, 0, 7, 0, 0)), box(b"mdia", full(b"mdhd", u32(0, 0, 1000, 0, 0)), full(b"hdlr", u32(0), b"vide", bytes(12)), box(b"minf", box(b"stbl", full(b"stsd", u32(1), box(b"hvc1", bytes(78))), full(b"stsz", u32(0, 0))))))
    head = box(b"ftyp", b"iso6", bytes(4)) + box(b"moov", trak, box(b"mvex", full(b"trex", u32(7, 1, 40, 0, 0x10000))))
    own = full(b"tfhd", u32(7), flags=0x020000)
    run = lambda place: full(b"trun", u32(3), struct.pack(">i", place), u32(0x2000000), u32(5, 6, 7), flags=0x205)
    moof = lambda place: box(b"moof", full(b"mfhd", u32(1)), box(b"traf", own, run(place)))
    one = moof(len(moof(0)) + 8) + box(b"mdat", b"a" * 18)
    same = full(b"tfhd", u32(7, 50, 9, 0x10000), flags=0x020038)
    again = lambda place: box(b"moof", box(b"traf", same, full(b"trun", u32(4), struct.pack(">i", place), u32(0), flags=5)))
    content = head + one + again(len(again(0)) + 8) + box(b"mdat", b"b" * 36)
    (track,) = media.probe(content)
    assert (track.codec, track.n_samples, track.duration, track.damaged) == ("hvc1", 7, 3 * 40 + 4 * 50, False)
    assert media.samples(content, track) == b"a" * 18 + b"b" * 36
    assert [content[a : a + n] for a, n in track.keyframes.tolist()] == [b"a" * 5, b"b" * 9]


def test_damaged_files_end_defined(spark):
    moov, *_ = two_tracks(0)
    good = box(b"ftyp", b"isom", bytes(4)) + moov
    r = random.Random(6)
    for _ in range(3000):
        broken = bytearray(good)
        for _ in range(r.randint(1, 6)):
            broken[r.randrange(len(broken))] = r.choice((0, 1, 127, 255, r.randrange(256)))
        for t in media.probe(bytes(broken)):
            t.row()
    assert [t.damaged for t in media.probe(good + b"\0\0\0\5abcd")] == [True, True] and media.probe(good[:-1]) == []
    hostile = store(b"x" * 192).replace(u32(192, 1), u32(192, 0xFFFFFFFF))
    assert [t.damaged for t in media.probe(hostile)] == [True]
    nested = b""
    for _ in range(5000):
        nested = box(b"moov", nested)
    assert media.probe(nested) == [] and media.probe(box(b"moov", box(b"trak", nested)))[0].damaged
    rows = spark.createDataFrame([(1, good, "a"), (2, None, "b"), (None, b"text", None), (3, b"", "c")], "doc_id long, media binary, `tracks` string")
    with pytest.raises(ValueError, match="tracks"):
        media_columns(rows)
    got = {r.own: [t.codec for t in r.tracks] for r in media_columns(rows.withColumnRenamed("tracks", "own")).collect()}
    assert got == {"a": ["avc1", "twos"], "b": [], None: [], "c": []}
