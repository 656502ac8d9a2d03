import hashlib
import zlib

import numpy as np

from tallyfield.llm import gif
from tests.llm.tables import collected, documents


def test_round_trip_of_whole_texts(spark, tmp_path):
    texts = ["", None, "a", "x" * 64, "é" * 100_000, "".join(map(chr, range(32, 2000))) * 40, "a"]
    got = collected(gif.op3_gif(spark, documents(spark, tmp_path, [(i, t, "s") for i, t in enumerate(texts)])))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[2][1:] == got[6][1:] and got[0][1:] == got[1][1:]


def _block(data):
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def _image(left, top, w, h, samples, disposal=0, transparent=None, interlaced=False):
    flags = disposal << 2 | (transparent is not None)
    control = b"\x21\xf9\x04" + bytes([flags]) + (5).to_bytes(2, "little") + bytes([transparent or 0, 0])
    place = b"".join(x.to_bytes(2, "little") for x in (left, top, w, h))
    return control + b"\x2c" + place + (b"\x40" if interlaced else b"\0") + b"\x08" + _block(gif.lzw_encode(bytes(samples)))


def _gif(w, h, *images):
    return b"GIF89a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + b"\xf7\0\0" + bytes(x for i in range(256) for x in (i, i, i)) + b"".join(images) + b"\x3b"


def test_transparency_and_disposal():
    data = _gif(2, 1, _image(0, 0, 2, 1, [10, 20]), _image(0, 0, 2, 1, [7, 99], disposal=3, transparent=7), _image(1, 0, 1, 1, [50], disposal=2), _image(0, 0, 1, 1, [60]))
    frames = gif.decode_gif(data)
    shown = [[tuple(map(int, p)) for p in f.canvas[0]] for f in frames]
    grey = lambda v: (v, v, v, 255)
    assert shown[0] == [grey(10), grey(20)]
    assert shown[1] == [grey(10), grey(99)]  # 7 lets the pixel below through
    assert shown[2] == [grey(10), grey(50)]  # the second frame was taken back
    assert shown[3][0] == grey(60) and shown[3][1][3] == 0  # the third frame's area was cleared
    assert [f.delay_ms for f in frames] == [50] * 4


def test_interlaced_rows():
    frame = gif.decode_gif(_gif(1, 8, _image(0, 0, 1, 8, [0, 4, 2, 6, 1, 3, 5, 7], interlaced=True)))[0]
    assert frame.canvas[:, 0, 0].tolist() == list(range(8))


def test_code_streams_of_any_size():
    rng = np.random.default_rng(3)
    for n in (1, 2, 255, 4096, 30_000):
        for samples in (bytes(n), rng.integers(0, 256, n, dtype=np.uint8).tobytes()):
            assert gif.lzw_decode(gif.lzw_encode(samples), 8, n) == samples


def test_frames_and_bad_media(spark):
    media = spark.createDataFrame([(1, bytearray(_gif(2, 1, _image(0, 0, 2, 1, [1, 2])))), (2, bytearray(b"no gif")), (3, None)], "doc_id long, media binary")
    rows = gif.frames_of(media).collect()
    assert [(r["doc_id"], r["frame"], sum(r["histogram"])) for r in rows] == [(1, 0, 2)]


def test_empty_table(spark, tmp_path):
    assert gif.op3_gif(spark, documents(spark, tmp_path, [])).count() == 0


def test_stored_frames_vary_and_keep_the_payload(spark):
    texts = [(2**62 + 1, "line of text\n" * 40_000), (None, "ab"), (3, " " * 64 * 3), (4, "x" * 64 * 2), (5, None)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in gif.with_frames(gif.store_texts(d)).collect()}
    assert set(rows) == {2**62 + 1, None, 3, 4, 5}  # ids beside a null stay exact
    frames = rows[2**62 + 1]["frames"]
    assert b"".join(f["samples"] for f in frames) == gif.padded(texts[0][1]) and len(frames) > 4
    assert {f["disposal"] for f in frames} == {0, 1, 2, 3} and {f["transparent"] for f in frames} == {-1, 0, 32}
    assert [f["shown_at_ms"] for f in frames] == [gif.FRAME_MS * i for i in range(len(frames))]
    assert sum(rows[3]["frames"][0]["histogram"]) in (0, 64 * 3)  # spaces show nothing where they are transparent
    for data in (gif.encode_gif(bytes(range(64)) * n) for n in (1, 2, 3, 4)):
        assert b"".join(f.samples for f in gif.decode_gif(data)) == bytes(range(64)) * (len(b"".join(f.samples for f in gif.decode_gif(data))) // 64)


def test_streams_are_read_together_and_each_to_its_end():
    rng = np.random.default_rng(5)
    images = [b"a", bytes(70_000), rng.integers(0, 4, 30_000, dtype=np.uint8).tobytes(), b"abcabcabc" * 50, bytes(range(256)) * 40]
    streams = gif.lzw_encode_all(images)
    assert streams == [gif.lzw_encode(x) for x in images] and gif.lzw_encode_all([]) == []
    broken = [b"", streams[3][:40], streams[3][:40] + b"\xff" * 9, streams[1] + b"more", b"\xff\xff"]
    got = gif.lzw_decode_all([*streams, *broken], 8, [*map(len, images), 99, 99, 99, 5, 99])
    assert got[:5] == images and got[5] == b"" and got[8] == bytes(5) and got[9] == b""
    assert images[3].startswith(got[6]) and len(got[6]) > 30 and got[7].startswith(got[6])


def test_each_gif_of_a_batch_has_its_own_frames():
    payloads = [gif.padded("line %d\n" % i * 30_000 * (i % 3)) for i in range(7)]
    media = gif.encode_gifs(payloads)
    assert media == [gif.encode_gif(p) for p in payloads]
    found = list(gif.decode_gifs([media[0], None, b"no gif", *media[1:]]))
    assert found[1] == found[2] == [] and [b"".join(f.samples for f in x) for x in (found[0], *found[3:])] == payloads
