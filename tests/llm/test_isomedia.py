"""ISO media files: lossless storage, nested boxes, sample tables, damage."""

from __future__ import annotations

import hashlib
import random
import struct
import time
import zlib

import numpy as np
import pytest
from tessera.llm import isomedia, queries
from tessera.llm.isomedia import FRAME, MediaError, _box, _full, boxes, index, pad, read_payload, write


@pytest.mark.parametrize("n", [0, 1, FRAME - 1, FRAME, FRAME + 1, 24 * FRAME, 24 * FRAME + 1, 49 * FRAME, 200_000])
def test_round_trip(n):
    payload = pad(bytes(i % 251 for i in range(n)))
    assert len(payload) % FRAME == 0 and len(payload) >= max(FRAME, n)
    media = write(payload)
    assert read_payload(media) == payload and write(payload) == media
    [track] = index(media)
    assert (track.codec, track.handler, track.width, len(track.sizes)) == ("raw ", "vide", 24, len(payload) // FRAME)
    keys = track.keyframes()
    assert (keys[1:, 0] == keys[:-1, 1]).all() and media[keys[0, 0] : keys[-1, 1]] == payload


def test_other_layouts():
    """Samples of several sizes in chunks apart, 64-bit offsets, a meta box, no keyframe table."""
    parts = [b"aaaa", b"bb", b"cccccc"]
    mdat = _box(b"mdat", b"".join([parts[0], parts[1], b"gap!", parts[2]]))
    table = _box(
        b"stbl",
        _full(b"stsd", 0, struct.pack(">I", 1), _box(b"avc1", bytes(78))),
        _full(b"stts", 0, struct.pack(">IIIII", 2, 2, 10, 1, 5)),
        _full(b"stsc", 0, struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)),
        _full(b"stsz", 0, struct.pack(">IIIII", 0, 3, 4, 2, 6)),
        _full(b"co64", 0, struct.pack(">IQQ", 2, 8, 18)),
    )
    mdhd = _box(b"mdhd", struct.pack(">I", 1 << 24), struct.pack(">QQIQHH", 0, 0, 100, 25, 0, 0))
    trak = _box(b"trak", _box(b"mdia", mdhd, _full(b"hdlr", 0, bytes(4), b"vide", bytes(12), b"\0"), _box(b"minf", table)))
    media = mdat + _full(b"meta", 0, _box(b"free", b"x")) + _box(b"moov", trak)
    assert read_payload(media) == b"".join(parts)
    [track] = index(media)
    assert (track.codec, track.timescale, track.ticks, sum(n * d for n, d in track.durations)) == ("avc1", 100, 25, 25)
    assert track.keyframes().tolist() == [[8, 12], [12, 14], [18, 24]]


def test_damage():
    media = write(pad(b"x"))
    for bad in (b"", b"\0\0\0\x08free", media[:200], media.replace(b"stco", b"skip"), b"\0\0\0\x04moov", b"nonsense bytes"):
        with pytest.raises(MediaError):
            index(bad)[0].samples()
    with pytest.raises(MediaError):
        write(b"short")
    assert [k for k, _, _ in boxes(media)] == [b"ftyp", b"moov", b"mdat"]


def _track(*tables: bytes, number: int = 1) -> bytes:
    tkhd = _full(b"tkhd", 3, struct.pack(">IIIII", 0, 0, number, 0, 0), bytes(60))
    mdhd = _full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, 10, 0, 0, 0))
    return _box(b"trak", tkhd, _box(b"mdia", mdhd, _full(b"hdlr", 0, bytes(4), b"vide", bytes(12), b"\0"), _box(b"minf", _box(b"stbl", *tables))))


def test_fragments():
    """Two fragments: sizes in the run, then defaults; the first sample of each is a keyframe."""
    stsd = _full(b"stsd", 0, struct.pack(">I", 1), _box(b"avc1", bytes(78)))
    empty = [_full(k, 0, struct.pack(">I", 0)) for k in (b"stts", b"stsc", b"stco")] + [_full(b"stsz", 0, struct.pack(">II", 0, 0))]
    trex = _full(b"trex", 0, struct.pack(">5I", 7, 1, 5, 3, isomedia.NO_KEYFRAME))
    moov = _box(b"moov", _track(stsd, *empty, number=7), _box(b"mvex", trex))

    def moof(offset: int, flags: int, *rest: bytes) -> bytes:
        trun = _full(b"trun", flags | 5, rest[0], struct.pack(">iI", offset, 0), *rest[1:])
        return _box(b"moof", _full(b"mfhd", 0, bytes(4)), _box(b"traf", _full(b"tfhd", 0x20000, struct.pack(">I", 7)), trun))

    one = lambda at: moof(at, 0x300, struct.pack(">I", 2), struct.pack(">IIII", 4, 2, 6, 4))
    two = lambda at: moof(at, 0, struct.pack(">I", 3))
    media = moov + one(len(one(0)) + 8) + _box(b"mdat", b"aabbbb") + two(len(two(0)) + 8) + _box(b"mdat", b"cccdddeee")
    [track] = index(media)
    assert read_payload(media) == b"aabbbbcccdddeee" and (track.codec, track.length()) == ("avc1", (4 + 6 + 3 * 5) * 100)
    assert [media[a:b] for a, b in track.samples()] == [b"aa", b"bbbb", b"ccc", b"ddd", b"eee"]
    keys = track.keyframes()
    assert len(keys) == 2 and media[slice(*keys[0])] == b"aabbbb" and media[slice(*keys[1])] == b"cccdddeee"


def test_compact_sizes():
    for bits, packed in ((4, b"\x12\x30"), (8, b"\x01\x02\x03"), (16, b"\0\x01\0\x02\0\x03")):
        tables = [_full(b"stz2", 0, struct.pack(">II", bits, 3), packed), _full(b"stsc", 0, struct.pack(">IIII", 1, 1, 3, 1)), _full(b"stco", 0, struct.pack(">II", 1, 8))]
        media = _box(b"mdat", b"abbccc") + _box(b"moov", _track(*tables))
        assert [media[a:b] for a, b in index(media)[0].samples()] == [b"a", b"bb", b"ccc"]


def test_hostile_files_cost_little(spark):
    deep = b""
    for _ in range(20_000):
        deep = struct.pack(">I4s", len(deep) + 8, b"moov") + deep if len(deep) < 4000 else deep
    nested = b"".join(struct.pack(">I4s", (100_000 - k) * 8, b"moov") for k in range(100_000))
    huge = lambda kind, *x: _box(b"moov", _track(_full(kind, 0, struct.pack(f">{len(x)}I", *x))))
    bad = [deep, nested, huge(b"stsz", 1, 0xFFFFFFFF), huge(b"stsz", 0, 0xFFFFFFFF), huge(b"stz2", 4, 0xFFFFFFFF), huge(b"stts", 0xFFFFFFFF), huge(b"stsc", 0xFFFFFFFF), huge(b"co64", 0xFFFFFFFF), huge(b"co64", 1, 0xFFFFFFFF, 0xFFFFFFFF)]
    bad.append(_box(b"moov", _track(_full(b"stts", 0, struct.pack(">III", 1, 0xFFFFFFFF, 0xFFFFFFFF) * 1))) + _box(b"moof", _box(b"traf", _full(b"tfhd", 0, struct.pack(">I", 1)), _full(b"trun", 0, struct.pack(">I", 0xFFFFFFFF)))))
    table = [_full(b"stsz", 0, struct.pack(">II", 1, 2)), _full(b"stsc", 0, struct.pack(">IIII", 1, 1, 2, 1)), _full(b"stco", 0, struct.pack(">II", 1, 8))]
    bad.append(_box(b"moov", _track(*table, _full(b"stss", 0, struct.pack(">III", 2, 2, 0)))))
    start = time.perf_counter()
    for data in bad:
        assert isomedia._describe(data)[-1], data[:60]
    assert time.perf_counter() - start < 5
    rng = random.Random(5)
    good = write(pad(b"payload" * 300))
    for _ in range(400):  # any damage is told, or does not matter
        data = bytearray(good[: rng.randrange(len(good))] if rng.random() < 0.2 else good)
        for _ in range(rng.randrange(1, 6)):
            if data:
                data[rng.randrange(min(len(data), 700))] = rng.randrange(256)
        row = isomedia._describe(bytes(data))
        assert row[-1] is not None or row[4] >= 0
    files = spark.createDataFrame([(1, None), (2, bytes(bad[2])), (3, good)], "id int, media binary")
    got = {r.id: r.payload_bytes for r in isomedia.digest_payload(files).collect()}
    assert got == {1: None, 2: None, 3: len(pad(b"payload" * 300))}


def test_query(spark, tmp_path):
    rows = [(1, "é" * 400), (2, None), (3, ""), (4, "x" * 300_000), (4, "x" * 300_000), (None, "y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op4_media_columns(spark, str(tmp_path)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 6 and by_id[2].payload_sha256 == by_id[3].payload_sha256
    for own, text in rows:
        payload = pad((text or "").encode())
        r = by_id[own]
        assert (r.n_bytes, r.payload_bytes) == (len((text or "").encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_sha256 == hashlib.sha256(write(payload)).hexdigest() and r.media_bytes == len(write(payload))


def test_index_of_null_and_foreign_files(spark):
    files = spark.createDataFrame([(1, None, "z"), (2, b"junk", "z"), (3, write(pad(b"q")), "z")], "id int, media binary, codec string")
    got = {r.id: r for r in isomedia.index_media(files).collect()}
    assert got[1].codec is None and got[1].error is None and got[2].error and got[3].codec == "raw"
    assert [tuple(k) for k in got[3].keyframes] == [tuple(x) for x in index(write(pad(b"q")))[0].keyframes().tolist()]
    assert isomedia.index_media(files.limit(0)).count() == 0 and np.array(got[3].n_samples) == 1
