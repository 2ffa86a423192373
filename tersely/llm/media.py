"""Media columns: ISO base media files (MP4, MOV) described from their boxes, without decoding payloads.

`probe` walks the nested boxes of a file and decodes the sample tables: codec, time scale and duration, number and bytes of
samples, and the byte ranges of the keyframes. Boxes with 32-bit and 64-bit sizes, up to the end of the file, of user types and
in fragments (`moof`, with the defaults of `trex` and `tfhd`) are known; others are skipped. Only boxes around the tables are
looked at, so a file's head suffices if `moov` comes first, and ranges may lie beyond the bytes given. Where all samples are
keyframes, the ranges are those of the chunks. A box that ends outside its parent ends the walk there, and tables that don't
fit each other or the bytes give a track without samples; in both cases `damaged` is true. Bytes that aren't such a file have no
tracks.

`store` writes payloads as such files: a track of uncompressed grey frames of 16 x 12 samples of 8 bits, so a frame
is 192 bytes, with a keyframe each `KEY_EVERY` frames and chunks of `CHUNK` frames. Texts are padded by spaces to whole
frames, at least one. `media_columns` and `text_media` are the operators over tables.

A null text counts as empty, null media have no tracks; a null doc_id is carried along, repeated rows give repeated results,
an empty table gives an empty one, other columns are left alone. Payloads are stored and read back whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersely.llm.common import column_bytes, id_text, quoted

WIDTH, HEIGHT, RATE, KEY_EVERY, CHUNK = 16, 12, 25, 12, 8
FRAME = WIDTH * HEIGHT
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf"}
#: How deep boxes nest at most; whole files need six levels.
DEEPEST = 32
#: Bytes of media that a batch of rows holds before it is handed on.
BATCH_BYTES = 4 << 20
TRACKS = "array<struct<track:long,handler:string,codec:string,timescale:long,duration:long,width:int,height:int,n_samples:long,n_bytes:long,keyframes:array<struct<offset:long,length:long>>,damaged:boolean>>"


@dataclass
class Track:
    number: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    width: int = 0
    height: int = 0
    n_samples: int = 0
    #: (offset, length) of all data in order, and of the keyframes.
    data: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), dtype=np.int64))
    keyframes: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), dtype=np.int64))
    damaged: bool = False

    def row(self) -> dict:
        ranges = [{"offset": o, "length": n} for o, n in self.keyframes.tolist()]
        return {"track": self.number, "handler": self.handler, "codec": self.codec, "timescale": self.timescale, "duration": self.duration, "width": self.width, "height": self.height, "n_samples": self.n_samples, "n_bytes": int(self.data[:, 1].sum()), "keyframes": ranges, "damaged": self.damaged}


class Damaged(ValueError):
    """A box or table that doesn't fit what holds it."""


def boxes(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(type, start, start and end of the content) of the boxes between two places; media data may run past the end."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise Damaged(kind)
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            head += 16
        if size < head or at + size > end and kind != b"mdat":
            raise Damaged(kind)
        yield kind, at, at + head, min(at + size, end)
        at += size


def numbers(data: memoryview, at: int, end: int, kind: str, columns: int = 1) -> np.ndarray:
    """A table's rows after its 32-bit count."""
    if at + 4 > end:
        raise Damaged("count")
    n = struct.unpack_from(">I", data, at)[0]
    kind = np.dtype(kind)
    if at + 4 + n * columns * kind.itemsize > end:
        raise Damaged("rows")
    out = np.frombuffer(data, dtype=kind, count=n * columns, offset=at + 4).astype(np.int64)
    return out.reshape(-1, columns) if columns > 1 else out


def versioned(data: memoryview, at: int, short: str, long: str) -> tuple:
    return struct.unpack_from(long if data[at] else short, data, at + 4)


def described(data: memoryview, at: int, end: int, track: Track) -> None:
    """Codec and frame size of the first sample entry."""
    for kind, _, a, b in boxes(data, at + 8, end):
        track.codec = kind.decode("latin-1")
        if track.handler == "vide" and a + 28 <= b:
            track.width, track.height = struct.unpack_from(">HH", data, a + 24)
        return


def sample_sizes(data: memoryview, found: dict[bytes, tuple[int, int]]) -> tuple[int, int, np.ndarray]:
    """Number of samples, their size if they share one, else 0 and the size of each."""
    if b"stsz" in found:
        at, end = found[b"stsz"]
        size, n = struct.unpack_from(">II", data, at + 4)
        return n, size, np.zeros(0, dtype=np.int64) if size else numbers(data, at + 8, end, ">u4")
    if b"stz2" not in found:
        return 0, 0, np.zeros(0, dtype=np.int64)
    at, end = found[b"stz2"]
    width, n = struct.unpack_from(">xxxBI", data, at + 4)
    if width not in (4, 8, 16) or at + 12 + (n * width + 7) // 8 > end:
        raise Damaged("stz2")
    raw = np.frombuffer(data, dtype=">u2" if width == 16 else "u1", count=(n + 1) // 2 if width == 4 else n, offset=at + 12).astype(np.int64)
    return n, 0, np.stack([raw >> 4, raw & 15], axis=1).reshape(-1)[:n] if width == 4 else raw


def tables(data: memoryview, found: dict[bytes, tuple[int, int]], track: Track) -> None:
    """Places of the samples that the tables of a track list. Samples of one size are not listed one by one."""
    if not track.duration and b"stts" in found:
        steps = numbers(data, found[b"stts"][0] + 4, found[b"stts"][1], ">u4", 2)
        track.duration = int((steps[:, 0] * steps[:, 1]).sum())
    n, size, sizes = sample_sizes(data, found)
    if not n:
        return
    key = b"co64" if b"co64" in found else b"stco"
    if key not in found or b"stsc" not in found:
        raise Damaged("stco")
    chunks = numbers(data, found[key][0] + 4, found[key][1], ">u8" if key == b"co64" else ">u4")
    runs = numbers(data, found[b"stsc"][0] + 4, found[b"stsc"][1], ">u4", 3)
    if not len(chunks) or chunks.min() < 0 or not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any():
        raise Damaged("stsc")
    per = runs[np.searchsorted(runs[:, 0], np.arange(1, len(chunks) + 1), side="right") - 1, 1]
    ends = np.minimum(np.cumsum(np.minimum(per, n)), n)  # of each chunk, in samples
    if ends[-1] < n:
        raise Damaged("stsc")
    begins = np.concatenate(([0], ends[:-1]))
    upto = np.concatenate(([0], np.cumsum(sizes)))

    def before(sample: np.ndarray) -> np.ndarray:
        return sample * size if size else upto[sample]

    spans = np.stack([chunks, before(ends) - before(begins)], axis=1)[ends > begins]
    if b"stss" in found:
        keys = numbers(data, found[b"stss"][0] + 4, found[b"stss"][1], ">u4") - 1
        if len(keys) and not (0 <= keys.min() and keys.max() < n):
            raise Damaged("stss")
        chunk = np.searchsorted(ends, keys, side="right")
        track.keyframes = np.stack([chunks[chunk] + before(keys) - before(begins[chunk]), before(keys + 1) - before(keys)], axis=1)
    else:
        track.keyframes = spans
    track.n_samples, track.data = n, spans


def trak(data: memoryview, at: int, end: int) -> Track:
    track, found = Track(), {}

    def walk(at: int, end: int, depth: int = 0) -> None:
        if depth > DEEPEST:
            raise Damaged("depth")
        for kind, _, a, b in boxes(data, at, end):
            if kind in NESTED:
                walk(a, b, depth + 1)
            elif kind == b"tkhd":
                track.number = versioned(data, a, ">8xI", ">16xI")[0]
            elif kind == b"mdhd":
                track.timescale, track.duration = versioned(data, a, ">8xII", ">16xIQ")
            elif kind == b"hdlr" and not track.handler:
                track.handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
            else:
                found.setdefault(kind, (a, b))

    try:
        walk(at, end)
        if b"stsd" in found:
            described(data, *found[b"stsd"], track)
        tables(data, found, track)
    except (Damaged, struct.error, OverflowError):
        track.damaged = True
    return track


def fragment(data: memoryview, start: int, at: int, end: int, tracks: dict[int, Track], defaults: dict[int, tuple]) -> None:
    """Adds the samples of a `moof`, which begins at `start`, to their tracks."""
    follows = start  # where data without a place of their own begin
    for kind, _, a, b in boxes(data, at, end):
        if kind != b"traf":
            continue
        track, base, duration, size, flags = None, start, 0, 0, 0
        for part, _, x, y in boxes(data, a, b):
            head = struct.unpack_from(">I", data, x)[0] & 0xFFFFFF
            if part == b"tfhd":
                number = struct.unpack_from(">I", data, x + 4)[0]
                track = tracks.setdefault(number, Track(number))
                duration, size, flags = defaults.get(number, (0, 0, 0))
                x += 8
                if head & 1:
                    base, x = struct.unpack_from(">Q", data, x)[0], x + 8
                    follows = base
                x += 4 * bool(head & 2)
                given = {}
                for bit in (8, 16, 32):
                    if head & bit:
                        given[bit], x = struct.unpack_from(">I", data, x)[0], x + 4
                duration, size, flags = given.get(8, duration), given.get(16, size), given.get(32, flags)
            elif part == b"trun" and track is not None:
                n, x = struct.unpack_from(">I", data, x + 4)[0], x + 8
                if head & 1:
                    follows, x = base + struct.unpack_from(">i", data, x)[0], x + 4
                first = flags
                if own_first := head & 4:
                    first, x = struct.unpack_from(">I", data, x)[0], x + 4
                names = [f for f in (0x100, 0x200, 0x400, 0x800) if head & f]
                if x + 4 * n * len(names) > y:
                    raise Damaged("trun")
                rows = np.frombuffer(data, dtype=">u4", count=n * len(names), offset=x).astype(np.int64).reshape(n, len(names)) if names else np.zeros((0, 0), dtype=np.int64)
                column = {f: rows[:, i] for i, f in enumerate(names)}
                if {0x200, 0x400} & set(names):
                    sizes = column.get(0x200, np.full(n, size, dtype=np.int64))
                    marks = column.get(0x400, np.full(n, flags, dtype=np.int64)).copy()
                    marks[: 1 if own_first else 0] = first
                    each = np.stack([follows + np.cumsum(sizes) - sizes, sizes], axis=1)
                    keys, total = each[marks & 0x10000 == 0], int(sizes.sum())
                else:  # samples of one size and, but for the first, of one kind
                    total, lead = n * size, int(bool(n and own_first))
                    spans = [(follows, size)] * (lead and first & 0x10000 == 0) + [(follows + lead * size, total - lead * size)] * (n > lead and flags & 0x10000 == 0)
                    keys = np.array(spans, dtype=np.int64).reshape(-1, 2)
                track.data = np.concatenate([track.data, np.array([[follows, total]], dtype=np.int64)[: 1 if total else 0]])
                track.keyframes = np.concatenate([track.keyframes, keys])
                track.n_samples += n
                track.duration += int(column[0x100].sum()) if 0x100 in column else n * duration
                follows += total


def probe(content: bytes) -> list[Track]:
    """The tracks of a file, in the order in which they are declared."""
    data, tracks, defaults = memoryview(content), {}, {}
    try:
        for kind, start, a, b in boxes(data, 0, len(data)):
            if kind == b"moov":
                for inner, _, x, y in boxes(data, a, b):
                    if inner == b"trak":
                        track = trak(data, x, y)
                        tracks[track.number if track.number and track.number not in tracks else -1 - len(tracks)] = track
                    elif inner == b"mvex":
                        for part, _, u, _ in boxes(data, x, y):
                            if part == b"trex":
                                number, _, *given = struct.unpack_from(">5I", data, u + 4)
                                defaults[number] = tuple(given)
            elif kind == b"moof":
                fragment(data, start, a, b, tracks, defaults)
    except (Damaged, struct.error, OverflowError):
        for track in tracks.values():
            track.damaged = True
    return list(tracks.values())


def samples(content: bytes, track: Track) -> bytes:
    """The bytes of all samples, in order."""
    return b"".join(content[a : a + n] for a, n in track.data.tolist())


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def store(payload: bytes) -> bytes:
    """A file with the payload, whole frames, as its only track."""
    n = len(payload) // FRAME
    chunks, rest = -(-n // CHUNK), n % CHUNK
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    runs = [(1, CHUNK, 1)] * (n >= CHUNK) + [(chunks, rest, 1)] * bool(rest)
    wide = len(payload) + (1 << 20) + 8 * chunks > 0xFFFFFFFF
    ftyp = box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  isom")

    def moov(first: int) -> bytes:
        places = first + FRAME * CHUNK * np.arange(chunks, dtype=np.int64)
        entry = box(b"raw ", struct.pack(">6xH16xHHIIIH32xHh", 1, WIDTH, HEIGHT, 72 << 16, 72 << 16, 0, 1, 40, -1))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"frames\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n, 0, 0, 0, 0), MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, n, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    first = len(ftyp) + len(moov(0)) + len(head)
    return b"".join((ftyp, moov(first), head, payload))


def padded(text: bytes) -> bytes:
    return text + b" " * (max(FRAME, -(-len(text) // FRAME) * FRAME) - len(text))


def media_columns(df: DataFrame, media_col: str = "media") -> DataFrame:
    """The table with `tracks` in place of the binary column of files. A column of that name must be renamed before."""
    rest = [c for c in df.columns if c != media_col]
    if "tracks" in rest:
        raise ValueError("the table has a column named tracks already")
    schema = ", ".join([*(f"`{c.replace('`', '``')}` {df.schema[c].dataType.simpleString()}" for c in rest), f"tracks {TRACKS}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("track", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("n_samples", pa.int64()), ("n_bytes", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))), ("damaged", pa.bool_())]))
        for batch in batches:
            tracks = [[t.row() for t in probe(x.as_py() or b"")] for x in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(tracks, kind)], names=[*rest, "tracks"])

    return df.select(*map(quoted, rest), quoted(media_col).cast("binary").alias(media_col)).mapInArrow(run, schema)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id long, n_bytes long, media binary`: each whole text as a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, begin, size = [], 0, 0
            texts = column_bytes(batch, "text")
            for i, text in enumerate(texts):
                held.append(store(padded(text)))
                size += len(held[-1])
                if size >= BATCH_BYTES or i + 1 == len(texts):
                    part = batch.slice(begin, len(held))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(held, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    held, begin, size = [], i + 1, 0

    rows = id_text(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_ms long, n_keyframes long"


def feature(track: Track) -> str:
    """codec:milliseconds:samples:keyframes as offset+length."""
    ranges = ",".join(f"{o}+{n}" for o, n in track.keyframes.tolist())
    return f"{track.codec}:{1000 * track.duration // max(1, track.timescale)}:{track.n_samples}:{ranges}"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its text stored as a file, and what the file's boxes and stored bytes say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column("media"):
                content = media.as_py()
                track = probe(content)[0]
                payload = samples(content, track)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(content), hashlib.sha256(content).hexdigest(), feature(track), track.codec, 1000 * track.duration // track.timescale, len(track.keyframes)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return store_texts(docs, id_col, text_col).mapInArrow(run, DIGESTS)
