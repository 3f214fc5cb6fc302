"""ISO base media files: a lossless writer of byte payloads, and an index read from boxes alone.

The writer stores a payload as 8-bit grey video frames of 24 by 24 samples (576 bytes each) in a raw
video track. The reader walks nested boxes, decodes the sample tables (stts, stss, stsc, stsz, stz2, stco,
co64) and the runs of movie fragments (trex, tfhd, trun), and tells codec, duration and the byte ranges that
begin at keyframes; it never looks into mdat.

Boxes are walked with a stack, and every count is held against the file's size before memory is taken, so
that damaged or hostile files cost no more than their bytes. They give null index columns and a message in
``error``, and null payload digests; so do null files, without a message. Null texts count as empty; an empty
text has one frame of padding. Very long texts are files of more frames (64-bit offsets where needed). Repeated
rows give equal files, an empty table gives no rows. A column of the input that bears the name of an output
column is replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tessera.llm.text import append_columns

SIDE = 24
FRAME = SIDE * SIDE
PAD = 255
TIMESCALE = 25
#: Every so many frames one is marked as a keyframe, to which a reader can seek.
KEY_EVERY = 12
FRAMES_PER_CHUNK = 24

#: Boxes that hold boxes, with the bytes between their header and the first of them.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"meta": 4}

RANGE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


class MediaError(ValueError):
    """The bytes are not a media file that can be indexed."""


def pad(data: bytes, unit: int = FRAME) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of ``unit``."""
    return data + bytes([PAD]) * (max(unit, -(-len(data) // unit) * unit) - len(data))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")


def write(payload: bytes) -> bytes:
    """A media file of the payload, whose length is a positive multiple of 576. Equal payloads, equal files."""
    if not payload or len(payload) % FRAME:
        raise MediaError("the payload is not a positive number of whole frames")
    n = len(payload) // FRAME
    chunks = -(-n // FRAMES_PER_CHUNK)
    rest = n - (chunks - 1) * FRAMES_PER_CHUNK
    runs = [(1, FRAMES_PER_CHUNK)] * (chunks > 1) + [(chunks, rest)] * (chunks == 1 or rest != FRAMES_PER_CHUNK)
    keys = range(1, n + 1, KEY_EVERY)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))

    def moov(first: int) -> bytes:
        offsets = [first + k * FRAMES_PER_CHUNK * FRAME for k in range(chunks)]
        wide = offsets[-1] > 0xFFFFFFFF
        table = _box(
            b"stbl",
            _full(b"stsd", 0, struct.pack(">I", 1), entry),
            _full(b"stts", 0, struct.pack(">III", 1, n, 1)),
            _full(b"stss", 0, struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", at, size, 1) for at, size in runs)),
            _full(b"stsz", 0, struct.pack(">II", FRAME, n)),
            _full(b"co64" if wide else b"stco", 0, struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)),
            _full(b"hdlr", 0, bytes(4), b"vide", bytes(12), b"\0"),
            _box(b"minf", _full(b"vmhd", 1, bytes(8)), _box(b"dinf", _full(b"dref", 0, struct.pack(">I", 1), _full(b"url ", 1))), table),
        )
        track = _full(b"tkhd", 3, struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), _MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16))
        head = _full(b"mvhd", 0, struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", head, _box(b"trak", track, media))

    size = len(moov(0))
    large = len(payload) + 8 > 0xFFFFFFFF
    header = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if large else struct.pack(">I4s", len(payload) + 8, b"mdat")
    made = moov(len(_FTYP) + size + len(header))
    if len(made) != size:  # the offsets need 64 bits
        size = len(made)
        made = moov(len(_FTYP) + size + len(header))
    return b"".join((_FTYP, made, header, payload))


def boxes(data: memoryview | bytes, start: int = 0, end: int | None = None):
    """The boxes of a byte range as (kind, body start, body end)."""
    at, end = start, len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if body + 8 > end:
                raise MediaError("a large box ends early")
            size = struct.unpack_from(">Q", data, body)[0]
            body += 8
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise MediaError(f"box {kind!r} has the wrong size")
        yield kind, body, at + size
        at += size


#: Flags of fragment boxes, and the flag of samples that are no keyframes.
BASE_OFFSET, DESCRIPTION, DURATION, SIZE, FLAGS = 0x1, 0x2, 0x8, 0x10, 0x20
RUN_OFFSET, RUN_FIRST_FLAGS, RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NO_KEYFRAME = 0x10000


@dataclass
class Track:
    """What the boxes of one track tell."""

    number: int = 0
    handler: str = ""
    codec: str = ""
    width: int = 0
    height: int = 0
    timescale: int = 0
    ticks: int = 0
    durations: list[tuple[int, int]] = field(default_factory=list)
    keys: np.ndarray | None = None
    chunk_runs: list[tuple[int, int]] = field(default_factory=list)
    sizes: np.ndarray | None = None
    chunks: np.ndarray | None = None
    #: Runs of samples in fragments: byte ranges, and which of them are keyframes.
    fragments: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def _listed(self) -> np.ndarray:
        """Byte ranges of the sample tables' samples, from chunk offsets, samples per chunk and sample sizes."""
        if self.sizes is None or self.chunks is None or not self.chunk_runs:
            if self.fragments and not (self.sizes is not None and len(self.sizes)):
                return np.zeros((0, 2), dtype=np.int64)
            raise MediaError("a sample table is missing")
        firsts = np.array([a for a, _ in self.chunk_runs] + [len(self.chunks) + 1])
        if firsts[0] != 1 or (np.diff(firsts) < 0).any():
            raise MediaError("sample-to-chunk runs are out of order")
        per = np.repeat([s for _, s in self.chunk_runs], np.diff(firsts))
        n = len(self.sizes)
        if per.sum() != n:
            raise MediaError("chunks and samples differ in number")
        before = np.concatenate([[0], np.cumsum(self.sizes)])
        chunk = np.repeat(np.arange(len(per)), per)
        first = np.concatenate([[0], np.cumsum(per)])[:-1]
        start = self.chunks[chunk] + before[:-1] - before[first[chunk]]
        return np.stack([start, start + self.sizes], axis=1)

    def samples(self) -> np.ndarray:
        """Byte ranges of all samples, those of the sample tables first."""
        return np.concatenate([self._listed(), *(x for x, _ in self.fragments)])

    def keyframes(self) -> np.ndarray:
        """Byte ranges from each keyframe to the next, joined where samples lie side by side."""
        listed = self._listed()
        if self.keys is not None and ((self.keys < 0).any() or (np.diff(self.keys) <= 0).any()):
            raise MediaError("keyframes are out of order")
        keys = [np.arange(len(listed)) if self.keys is None else self.keys[self.keys < len(listed)]]
        n = len(listed)
        for spans, sync in self.fragments:
            keys.append(np.flatnonzero(sync) + n)
            n += len(spans)
        spans, key = self.samples(), np.concatenate(keys)
        if not n or not len(key):
            return np.zeros((0, 2), dtype=np.int64)
        last = np.append(key[1:], n) - 1
        return np.stack([spans[key, 0], spans[last, 1]], axis=1)

    def length(self) -> int | None:
        """The duration in milliseconds."""
        ticks = sum(n * d for n, d in self.durations) or self.ticks
        out = ticks * 1000 // self.timescale if self.timescale else None
        if out is not None and out >= 1 << 63:
            raise MediaError("the duration is out of range")
        return out


def _u32(data, at: int, n: int, end: int) -> np.ndarray:
    if n * 4 > end - at:
        raise MediaError("a table ends early")
    return np.frombuffer(data, dtype=">u4", count=n, offset=at).astype(np.int64)


def _count(data, at: int, end: int) -> int:
    if at + 4 > end:
        raise MediaError("a table ends early")
    return struct.unpack_from(">I", data, at)[0]


def _table(data, kind: bytes, a: int, b: int, own: Track) -> None:
    """Take one box of a track."""
    if kind == b"tkhd":
        own.number = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
    elif kind == b"mdhd":
        if data[a] == 1:
            own.timescale, own.ticks = struct.unpack_from(">IQ", data, a + 20)
        else:
            own.timescale, own.ticks = struct.unpack_from(">II", data, a + 12)
    elif kind == b"hdlr":
        own.handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
    elif kind == b"stsd" and b - a > 16:
        own.codec = bytes(data[a + 12 : a + 16]).decode("latin-1")
        if own.handler == "vide" and b - a >= 8 + 36:
            own.width, own.height = struct.unpack_from(">HH", data, a + 8 + 32)
    elif kind == b"stts":
        table = _u32(data, a + 8, 2 * _count(data, a + 4, b), b)
        own.durations = list(zip(table[::2].tolist(), table[1::2].tolist(), strict=True))
    elif kind == b"stss":
        own.keys = _u32(data, a + 8, _count(data, a + 4, b), b) - 1
    elif kind == b"stsc":
        table = _u32(data, a + 8, 3 * _count(data, a + 4, b), b)
        own.chunk_runs = list(zip(table[::3].tolist(), table[1::3].tolist(), strict=True))
    elif kind == b"stsz":
        size, n = _count(data, a + 4, b), _count(data, a + 8, b)
        if size and size * n > len(data):
            raise MediaError("the samples are larger than the file")
        own.sizes = np.full(n, size, dtype=np.int64) if size else _u32(data, a + 12, n, b)
    elif kind == b"stz2":
        bits, n = _count(data, a + 4, b) & 0xFF, _count(data, a + 8, b)
        if bits not in (4, 8, 16) or n * bits > (b - a - 12) * 8:
            raise MediaError("a table ends early")
        raw = np.frombuffer(data, dtype=np.uint8, count=-(-n * bits // 8), offset=a + 12)
        if bits == 16:
            own.sizes = raw.view(">u2").astype(np.int64)
        else:
            own.sizes = (np.stack([raw >> 4, raw & 15], axis=1).ravel()[:n] if bits == 4 else raw).astype(np.int64)
    elif kind == b"stco":
        own.chunks = _u32(data, a + 8, _count(data, a + 4, b), b)
    elif kind == b"co64":
        n = _count(data, a + 4, b)
        if n * 8 > b - a - 8:
            raise MediaError("a table ends early")
        wide = np.frombuffer(data, dtype=">u8", count=n, offset=a + 8)
        if n and wide.max() >= 1 << 62:
            raise MediaError("a chunk lies outside the file")
        own.chunks = wide.astype(np.int64)


@dataclass
class _Fragment:
    """The state of the movie fragment and the track run that are being read."""

    start: int = 0  # of the moof box
    next: int = 0  # where the data of the next run begin
    track: Track | None = None
    base: int = 0
    defaults: tuple[int, int, int] = (0, 0, 0)  # duration, size, flags


def _head(data, a: int, b: int, by_number: dict[int, Track], trex: dict[int, tuple[int, int, int]], state: _Fragment) -> None:
    """A fragment's header for one track."""
    flags, number = (x & 0xFFFFFF if k == 0 else x for k, x in enumerate(struct.unpack_from(">II", data, a)))
    at, values = a + 8, list(trex.get(number, (0, 0, 0)))
    state.track = by_number.get(number)
    state.base = state.start
    if flags & BASE_OFFSET:
        state.base = struct.unpack_from(">Q", data, at)[0]
        at += 8
    at += 4 if flags & DESCRIPTION else 0
    for k, flag in enumerate((DURATION, SIZE, FLAGS)):
        if flags & flag:
            values[k] = _count(data, at, b)
            at += 4
    state.defaults, state.next = tuple(values), state.base


def _run(data, a: int, b: int, state: _Fragment) -> None:
    """A run of a fragment's samples."""
    flags, n = (x & 0xFFFFFF if k == 0 else x for k, x in enumerate(struct.unpack_from(">II", data, a)))
    duration, size, own_flags = state.defaults
    at = a + 8
    if flags & RUN_OFFSET:
        state.next = state.base + struct.unpack_from(">i", data, at)[0]
        at += 4
    first = None
    if flags & RUN_FIRST_FLAGS:
        first = _count(data, at, b)
        at += 4
    columns = [f for f in (RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT) if flags & f]
    if n > len(data) or (not flags & RUN_SIZE and n * size > len(data)):
        raise MediaError("the samples are larger than the file")
    table = _u32(data, at, n * len(columns), b).reshape(n, len(columns)) if columns else np.zeros((n, 0), dtype=np.int64)
    column = lambda f, other: table[:, columns.index(f)] if f in columns else np.full(n, other, dtype=np.int64)
    durations, sizes, kinds = column(RUN_DURATION, duration), column(RUN_SIZE, size), column(RUN_FLAGS, own_flags).copy()
    if first is not None and n:
        kinds[0] = first
    if not 0 <= state.next < 1 << 62:
        raise MediaError("a sample lies outside the file")
    ends = state.next + np.cumsum(sizes)
    if state.track is not None:
        state.track.fragments.append((np.stack([ends - sizes, ends], axis=1), (kinds & NO_KEYFRAME) == 0))
        state.track.durations.append((1, int(durations.sum())))
    state.next = int(ends[-1]) if n else state.next


def index(data: bytes) -> list[Track]:
    """The tracks of a media file. Raises MediaError for damaged or foreign bytes."""
    tracks: list[Track] = []
    by_number: dict[int, Track] = {}
    trex: dict[int, tuple[int, int, int]] = {}
    state = _Fragment()
    try:
        stack = [(boxes(data), None)]
        while stack:
            walk, track = stack[-1]
            found = next(walk, None)
            if found is None:
                stack.pop()
                continue
            kind, a, b = found
            if kind == b"trak":
                track = Track()
                tracks.append(track)
            elif kind == b"moof":
                state = _Fragment(start=a - 8, next=a - 8)
                by_number = {t.number: t for t in tracks}
            if kind in CONTAINERS:
                stack.append((boxes(data, a + CONTAINERS[kind], b), track))
            elif kind == b"trex":
                number, _, *values = struct.unpack_from(">5I", data, a + 4)
                trex[number] = tuple(values)
            elif kind == b"tfhd":
                _head(data, a, b, by_number, trex, state)
            elif kind == b"trun":
                _run(data, a, b, state)
            elif track is not None:
                _table(data, kind, a, b, track)
    except (struct.error, IndexError, ValueError, OverflowError) as e:
        raise e if isinstance(e, MediaError) else MediaError(str(e)) from e
    if not tracks:
        raise MediaError("there is no track")
    return tracks


def read_payload(data: bytes) -> bytes:
    """The stored samples of the first track, in order."""
    spans = index(data)[0].samples()
    if len(spans) and (spans[:, 1].max() > len(data) or spans.min() < 0):
        raise MediaError("a sample lies outside the file")
    gaps = np.flatnonzero(spans[1:, 0] != spans[:-1, 1]) + 1
    bounds = np.concatenate([[0], gaps, [len(spans)]]) if len(spans) else np.zeros(1, dtype=np.int64)
    return b"".join(data[spans[a, 0] : spans[b - 1, 1]] for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def text_to_media(docs: DataFrame, *, text: str = "text", out: str = "media") -> DataFrame:
    """``docs`` with the column ``out``: the media file that holds the text's UTF-8 bytes, padded."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        values = batch.column(batch.schema.get_field_index(text))
        return [pa.array([write(pad((v.as_py() or "").encode())) for v in values], pa.binary())]

    return append_columns(docs, [T.StructField(out, T.BinaryType())], compute, needs=[text])


INDEX_FIELDS = [
    T.StructField("codec", T.StringType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("n_samples", T.LongType()),
    T.StructField("keyframes", T.ArrayType(RANGE)),
    T.StructField("error", T.StringType()),
]
_ARROW = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]


def _describe(data: bytes | None) -> tuple:
    if data is None:
        return (None,) * 7
    try:
        tracks = index(data)
        t = next((t for t in tracks if t.handler == "vide"), tracks[0])
        keys = [{"start": a, "end": b} for a, b in t.keyframes().tolist()]
        return t.codec.strip(), t.width, t.height, t.length(), len(t.samples()), keys, None
    except MediaError as e:
        return (None,) * 6 + (str(e),)


def index_media(files: DataFrame, *, media: str = "media") -> DataFrame:
    """``files`` with codec, width, height, duration_ms, n_samples, keyframes (byte ranges) and error."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = [_describe(v.as_py()) for v in batch.column(batch.schema.get_field_index(media))]
        return [pa.array([r[i] for r in rows], t) for i, t in enumerate(_ARROW)]

    return append_columns(files, INDEX_FIELDS, compute, needs=[media])


DIGEST_FIELDS = [
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
]


def digest_payload(files: DataFrame, *, media: str = "media", tail: int = 32) -> DataFrame:
    """``files`` with size, sha256 and the crc32 of the last ``tail`` bytes of the payload read back (null if it cannot be)."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for v in batch.column(batch.schema.get_field_index(media)):
            try:
                data = read_payload(v.as_py()) if v.is_valid else None
            except MediaError:
                data = None
            rows.append((None,) * 3 if data is None else (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-tail:])))
        return [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))]

    return append_columns(files, DIGEST_FIELDS, compute, needs=[media])
