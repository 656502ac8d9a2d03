"""GIF media columns: an encoder for byte payloads and a full decoder.

The decoder reads LZW code streams, local and global palettes, interlacing,
disposal and transparency, and gives timed frames with their samples and a
colour histogram of the canvas as it is shown.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm import arrays
from tallyfield.llm.keyed import map_keyed
from tallyfield.session import drop_written, materialise

WIDTH = 64
#: Rows a frame holds at most; a longer payload becomes more frames.
FRAME_ROWS = 1024
FRAME_MS = 40
#: Codes after which the encoder starts its table anew: then all 4096 codes are in use.
_SEGMENT = 4096 - 258
#: Bytes of payloads or media whose codes a task handles at a time.
_DECODED = 1_000_000


def _widths(n: int, root: int = 8) -> np.ndarray:
    """Bits of the k-th code after a clear, k from 0."""
    k = np.arange(n)
    free = (1 << root) + 2 + np.maximum(k - 1, 0)
    return np.clip(np.floor(np.log2(free)).astype(np.int64) + 1, root + 1, 12)


_WIDTHS = _widths(_SEGMENT + 1)


def _segments(samples: bytes) -> list[list[int]]:
    """LZW codes of 8-bit samples, a list for each table."""
    segments: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    get, put, free = table.get, codes.append, 258
    prefix = samples[0]
    for b in samples[1:]:
        key = prefix << 8 | b
        code = get(key)
        if code is not None:
            prefix = code
            continue
        put(prefix)
        table[key] = free
        free += 1
        prefix = b
        if free == 4096:
            segments.append(codes)
            codes, free = [], 258
            put = codes.append
            table.clear()
    put(prefix)
    segments.append(codes)
    return segments


def lzw_encode_all(images: list[bytes]) -> list[bytes]:
    """The code streams of images of 8-bit samples, without sub-block lengths. The bits of all of them are laid out together."""
    clear, end = 256, 257
    values, widths, sizes = array("i"), [], []
    for samples in images:
        segments = _segments(samples)
        values.append(clear)
        widths.append(_WIDTHS[:1])
        for s in segments:
            values.extend(s)
            values.append(clear)
            widths.append(_WIDTHS[: len(s) + 1])
        values[-1] = end
        sizes.append(1 + sum(len(s) + 1 for s in segments))
    if not sizes:
        return []
    v, w = np.frombuffer(values, np.int32), np.concatenate(widths)
    first = np.cumsum(sizes) - sizes
    used = -(-np.add.reduceat(w, first) // 8)  # bytes
    begins = np.cumsum(used) - used
    place = np.cumsum(w) - w
    bit = place + np.repeat(8 * begins - place[first], sizes)
    # A code of 9 to 12 bits lies in three bytes at most; no two codes share a bit, and none a first, second or third byte.
    spread, at = v << (bit & 7).astype(np.int32), bit >> 3
    out = np.zeros(int(used.sum()) + 2, np.uint8)
    for i in range(3):
        out[at + i] |= (spread >> 8 * i).astype(np.uint8)
    raw = out.tobytes()
    return [raw[a : a + n] for a, n in zip(begins.tolist(), used.tolist())]


def lzw_encode(samples: bytes) -> bytes:
    """The code stream of 8-bit samples, without sub-block lengths."""
    return lzw_encode_all([samples])[0]


def _stream_codes(streams: list[bytes], root: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of streams up to each one's end or first broken code, without clears: code, stream and place since the last clear.

    Codes of a run up to the next clear have widths that follow from their
    place alone, so the next runs of all streams are read together.
    """
    clear, end = 1 << root, (1 << root) + 1
    sizes = np.array([len(x) for x in streams])
    raw = np.frombuffer(b"".join(streams) + b"\0\0\0", np.uint8).astype(np.int32)
    three = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    begins, bits = 8 * (np.cumsum(sizes) - sizes), 8 * sizes
    at, window, live = np.zeros(len(streams), np.int64), np.full(len(streams), 4096), np.arange(len(streams))
    found = [(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))]
    while len(live):
        wide = _widths(int(window[live].max()) + 1, root)
        offsets = np.cumsum(wide) - wide
        fit = np.searchsorted(offsets, (bits - at)[live], "right") - 1
        live, n = live[fit > 0], np.minimum(fit, window[live])[fit > 0]
        if not len(live):
            break
        first = np.cumsum(n) - n
        k = np.arange(int(n.sum())) - np.repeat(first, n)
        bit = np.repeat(begins[live] + at[live], n) + offsets[k]
        code = three[bit >> 3] >> (bit & 7).astype(np.int32) & ((1 << wide) - 1).astype(np.int32)[k]
        most = np.minimum(end + 1 + np.arange(len(wide)), 4096)  # what the table holds by then, and the entry that is being made
        most[0] = clear
        halt = (code == clear) | (code == end) | (code >= most[k])
        stop = np.minimum.reduceat(np.where(halt, k, len(wide)), first)
        cleared = (stop < n) & (code[np.minimum(first + stop, len(code) - 1)] == clear)
        longer = (stop >= n) & (n == window[live])  # may go on: read again, twice as far
        kept = k < np.repeat(np.where(longer, 0, stop), n)
        found.append((code[kept], np.repeat(live, n)[kept], k[kept]))
        at[live[cleared]] += (offsets + wide)[stop[cleared]]
        window[live] = np.where(longer, 2 * window[live], 4096)
        live = live[cleared | longer]
    code, owner, k = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(owner, kind="stable")
    return code[order], owner[order], k[order]


def lzw_decode_all(streams: list[bytes], root: int, most: list[int]) -> list[bytes]:
    """Up to ``most`` samples of each code stream; what comes after its end, or is broken, is left out.

    An entry is the string of an earlier code and the first sample of the
    next one. Strings are followed back to a single sample, those of all codes
    a step at a time.
    """
    code, owner, k = _stream_codes(streams, root)
    if not len(code):
        return [b""] * len(streams)
    end, i = (1 << root) + 1, np.arange(len(code))
    made = code > end
    before = np.where(made, i - k + code - (end + 1), i)
    top, steps = before, made.astype(np.int64)
    while not ((further := top[top]) == top).all():
        steps += steps[top]
        top = further
    first = code[top].astype(np.uint8)
    last = np.where(made, first[np.minimum(before + 1, len(code) - 1)], code).astype(np.uint8)
    begin = np.cumsum(steps + 1) - (steps + 1)
    edges = np.searchsorted(owner, np.arange(len(streams) + 1))
    kept = begin - begin[edges[owner]] < np.array(most)[owner]
    size = np.where(kept, steps + 1, 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(ends[-1]), np.uint8)
    own = i[kept]
    place = ends[own + 1] - 1
    while len(own):
        out[place] = last[own]
        on = np.flatnonzero(made[own])
        own, place = before[own[on]], place[on] - 1
    raw = out.tobytes()
    return [raw[a : min(a + m, b)] for a, b, m in zip(ends[edges[:-1]].tolist(), ends[edges[1:]].tolist(), most)]


def lzw_decode(data: bytes, root: int, most: int) -> bytes:
    """``lzw_decode_all`` of one stream."""
    return lzw_decode_all([data], root, [most])[0]


def _blocks(data: bytes) -> bytes:
    """Sub-blocks of at most 255 bytes, with the empty one that ends them."""
    return b"".join(x for i in range(0, len(data), 255) for x in (bytes([min(255, len(data) - i)]), data[i : i + 255])) + b"\0"


_GREYS = bytes(x for i in range(256) for x in (i, i, i))
_TINTS = bytes(x for i in range(256) for x in (i, 255 - i, 7 * i & 255))
#: How frames are written, in turn: own palette, interlaced, disposal, transparent sample.
STYLES = ((False, False, 1, None), (True, False, 2, None), (False, True, 3, 32), (False, False, 0, 0))


def encode_gifs(payloads: list[bytes], rows: int = FRAME_ROWS) -> list[bytes]:
    """GIFs whose frames' samples, joined, are the payloads. Their lengths must be positive multiples of ``WIDTH``.

    Frames go through ``STYLES`` in turn, beginning where the payload's length
    says, so palettes, interlacing, disposal and transparency all occur; they
    change what is shown, never the samples.
    """
    heads, images = [], []
    for payload in payloads:
        height = len(payload) // WIDTH
        heads.append([])
        for i, top in enumerate(range(0, height, rows)):
            tinted, woven, disposal, clear = STYLES[(height + i) % len(STYLES)]
            own = payload[top * WIDTH : (top + rows) * WIDTH]
            n = len(own) // WIDTH
            if woven:
                own = np.frombuffer(own, np.uint8).reshape(n, WIDTH)[_interlaced(n)].tobytes()
            images.append(own)
            control = b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), FRAME_MS // 10, clear or 0) + b"\0"
            heads[-1].append(control + b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, n, (0x87 if tinted else 0) | (0x40 if woven else 0)) + (_TINTS if tinted else b"") + b"\x08")
    streams = iter(lzw_encode_all(images))
    out = []
    for payload, frames in zip(payloads, heads):
        start = b"GIF89a" + struct.pack("<HHBBB", WIDTH, min(len(payload) // WIDTH, rows), 0xF7, 0, 0) + _GREYS
        out.append(b"".join([start, *(x for head in frames for x in (head, _blocks(next(streams)))), b"\x3b"]))
    return out


def encode_gif(payload: bytes, rows: int = FRAME_ROWS) -> bytes:
    """``encode_gifs`` of one payload."""
    return encode_gifs([payload], rows)[0]


@dataclass
class Frame:
    """A frame: its place, delay in ms, disposal, transparent sample or -1, samples, and the canvas (rows, columns, RGBA) while it is shown."""

    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int
    samples: bytes
    canvas: np.ndarray


def _interlaced(height: int) -> np.ndarray:
    return np.concatenate([np.arange(first, height, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def _parsed(data: bytes) -> tuple[np.ndarray, list[tuple]]:
    """The empty canvas of a GIF and its images: place, palette, control, whether interlaced, and the code stream with its root. Raises ValueError if the bytes aren't one."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    screen_w, screen_h, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def palette(flag: int) -> np.ndarray:
        nonlocal at
        n = 2 << (flag & 7)
        colours = np.full((256, 4), (0, 0, 0, 255), np.uint8)
        colours[:n, :3] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return colours

    def blocks() -> bytes:
        nonlocal at
        out = []
        while at < len(data) and (n := data[at]):
            out.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(out)

    shared = palette(flags) if flags & 0x80 else np.full((256, 4), (0, 0, 0, 255), np.uint8)
    images, control = [], (0, 0, -1)
    while at < len(data) and data[at] != 0x3B:
        mark = data[at]
        at += 1
        if mark == 0x21:
            label = data[at]
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                control = ((body[0] >> 2) & 7, 10 * (body[1] | body[2] << 8), body[3] if body[0] & 1 else -1)
            continue
        if mark != 0x2C:
            raise ValueError(f"unknown block {mark:#x}")
        left, top, w, h, own = struct.unpack_from("<HHHHB", data, at)
        at += 9
        colours = palette(own) if own & 0x80 else shared
        root = data[at]
        at += 1
        images.append(((left, top, w, h), colours, control, bool(own & 0x40), root, blocks()))
        control = (0, 0, -1)
    return np.zeros((screen_h, screen_w, 4), np.uint8), images


def _shown(canvas: np.ndarray, images: list[tuple], decoded: list[bytes]) -> list[Frame]:
    """Frames of images and their samples, drawn one over the other."""
    frames = []
    for ((left, top, w, h), colours, (disposal, delay, transparent), woven, _, _), samples in zip(images, decoded):
        samples = samples.ljust(w * h, b"\0")
        grid = np.frombuffer(samples, np.uint8).reshape(h, w)
        if woven:
            straight = np.empty_like(grid)
            straight[_interlaced(h)] = grid
            grid, samples = straight, straight.tobytes()
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        shown = grid[: area.shape[0], : area.shape[1]]
        if transparent < 0:
            area[:] = colours[shown]
        else:
            opaque = shown != transparent
            area[opaque] = colours[shown][opaque]
        frames.append(Frame(left, top, w, h, delay, disposal, transparent, samples, canvas.copy()))
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = before
    return frames


def decode_gifs(media: list[bytes | None]) -> Iterator[list[Frame]]:
    """All frames of each GIF, in order; none of null and of what is no GIF. Code streams of about ``_DECODED`` bytes are read together."""
    for part in arrays.pieces_of(media, lambda x: len(x or b""), _DECODED):
        parsed: list[tuple | None] = []
        for data in media[part]:
            try:
                parsed.append(None if data is None else _parsed(data))
            except (ValueError, IndexError, struct.error):
                parsed.append(None)
        images = [x for p in parsed if p for x in p[1]]
        decoded: list[bytes] = [b""] * len(images)
        for root in {x[4] for x in images}:
            own = [i for i, x in enumerate(images) if x[4] == root]
            samples = lzw_decode_all([images[i][5] for i in own], root, [images[i][0][2] * images[i][0][3] for i in own])
            for i, x in zip(own, samples):
                decoded[i] = x
        at = 0
        for p in parsed:
            if p is None:
                yield []
                continue
            yield _shown(*p, decoded[at : at + len(p[1])])
            at += len(p[1])


def decode_gif(data: bytes) -> list[Frame]:
    """All frames of a GIF. Raises ValueError if the bytes aren't one."""
    canvas, images = _parsed(data)
    return _shown(canvas, images, [lzw_decode(stream, root, w * h) for (_, _, w, h), _, _, _, root, stream in images])


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Visible pixels by colour, two bits a channel: 64 counts, red highest."""
    r, g, b, a = (canvas[..., i].ravel() for i in range(4))
    return np.bincount(((r >> 6) << 4 | (g >> 6) << 2 | b >> 6)[a > 0], minlength=64)


def padded(text: str) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of ``WIDTH``."""
    raw = text.encode()
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0")


def store_texts(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each text as a GIF: the keys, n_bytes and media. Null texts are empty; a row for each row."""

    def run(batches):
        for pdf in batches:
            texts = pdf.pop("text")
            payloads = [padded(t) for t in texts]
            media = [m for part in arrays.pieces_of(payloads, len, _DECODED) for m in encode_gifs(payloads[part])]
            yield pdf.assign(n_bytes=[len(t.encode()) for t in texts], media=media)

    return map_keyed(docs.select(*keys, F.coalesce("text", F.lit("")).alias("text")), keys, run, "n_bytes long, media binary")


_FRAME = "frame:int,shown_at_ms:bigint,delay_ms:bigint,left:int,top:int,width:int,height:int,disposal:int,transparent:int,samples:binary,histogram:array<bigint>"
_FRAME_FIELDS = [x.split(":")[0] for x in _FRAME.split(",")]


def with_frames(media: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Timed frames of a media column, read back and decoded: the keys, media_bytes, media_sha256 and frames. Null media and what is no GIF have none."""

    def frames(found: list[Frame]) -> list[dict]:
        clock, out = 0, []
        for i, f in enumerate(found):
            out.append(dict(zip(_FRAME_FIELDS, (i, clock, f.delay_ms, f.left, f.top, f.width, f.height, f.disposal, f.transparent, f.samples, histogram(f.canvas).tolist()))))
            clock += f.delay_ms
        return out

    def run(batches):
        for pdf in batches:
            media = pdf.pop("media")
            yield pdf.assign(media_bytes=[-1 if m is None else len(m) for m in media], media_sha256=[m and hashlib.sha256(m).hexdigest() for m in media], frames=[frames(x) for x in decode_gifs(media.tolist())])

    out = map_keyed(media.select(*keys, "media"), keys, run, f"media_bytes long, media_sha256 string, frames array<struct<{_FRAME}>>")
    return out.withColumn("media_bytes", F.when(F.col("media_bytes") >= 0, F.col("media_bytes")))


def frames_of(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Timed frames of a media column, one row a frame."""
    return with_frames(media, (key,)).select(key, F.inline("frames"))


def media_digests(framed: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Of stored frames: digests of the payload, which their samples are when joined, and the feature: frames, size, time and the sum of their histograms."""

    def run(batches):
        for pdf in batches:
            payloads, features = [], []
            for frames in pdf.pop("frames"):
                payloads.append(b"".join(f["samples"] for f in frames))
                colours = sum((np.array(f["histogram"]) for f in frames), np.zeros(64, np.int64))
                shown = ",".join(f"{i}:{colours[i]}" for i in np.flatnonzero(colours))
                features.append(f"frames={len(frames)};width={frames[0]['width']};height={sum(f['height'] for f in frames)};ms={sum(f['delay_ms'] for f in frames)};histogram={shown}")
            yield pdf.assign(payload_bytes=[len(p) for p in payloads], payload_sha256=[hashlib.sha256(p).hexdigest() for p in payloads], tail_crc32=[zlib.crc32(p[-64:]) for p in payloads], feature=features)

    return map_keyed(framed.select(*keys, "frames"), keys, run, "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")


def op3_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GIFs and their timed frames are both stored; digests are of what is read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    media = materialise(store_texts(docs), "gif-media")
    framed = materialise(with_frames(media, ("doc_id", "n_bytes")), "gif-frames", level=9)
    drop_written(media)
    return media_digests(framed, ("doc_id", "n_bytes", "media_bytes", "media_sha256"))
