"""GIF images as table columns: LZW code streams, palettes, disposal, transparency, timed frames.

``decode`` reads any GIF87a or GIF89a: global and local palettes, interlaced frames, growing code widths,
clear codes anywhere, disposal (keep, to background, to what was before) and transparent indices; it
gives the palette indices stored in each frame and, on request, the canvas as it is shown. ``encode``
writes frames of palette indices, losslessly.

``frames`` turns a column of GIF files into one row per frame with its time and a colour histogram.

The query stores each text as frames of 24 x 24 indices, under a palette of three bits of red, three of green and
two of blue, in a written table of files with their timed frames and colour histograms; it reads the stored
files back from there, decodes them and digests what they hold.

Defined results: a null text counts as empty and gives one frame of padding; equal texts give equal
values; a null or damaged file, or one that declares more than MAX_CANVAS pixels or frames of more than MAX_PIXELS
together, gives no frames and the reason in ``error``; a code stream that ends early leaves the rest of its
frame at index 0; repeated rows are handled each by itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, arrow_schema, materialize, slices, slim, table

SIDE = 24
FRAME_BYTES = SIDE * SIDE
PAD = 255
DELAY_CS = 4
COLOURS = bytes(v for i in range(256) for v in ((i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85))
#: What a file may declare: pixels of the canvas, and of all frames together.
MAX_CANVAS, MAX_PIXELS = 1 << 24, 1 << 27


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    indices: bytes
    palette: bytes
    delay_cs: int = 0
    disposal: int = 0
    transparent: int | None = None


@dataclass
class Image:
    width: int
    height: int
    background: int
    palette: bytes
    loops: int | None
    frames: list[Frame]


@lru_cache
def _schedule(size: int, codes: int = 1 << 13):
    """Width of the k-th code after a clear code, and the bits before it: reader and writer both know
    how many entries the table has by then, so widths don't depend on the codes."""
    import numpy as np

    entries = (1 << size) + 1 + np.arange(codes)
    width = np.minimum(12, np.maximum(size + 1, np.floor(np.log2(entries)).astype(np.int64) + 1))
    return width, np.concatenate([[0], np.cumsum(width)])


@lru_cache
def _entries() -> list[int]:
    """An empty table of entries, by a string's code and the byte after it. Who fills it takes out again what it put in:
    that is cheaper than a new one for each short run."""
    return [0] * (4096 << 8)


def lzw_codes(data: bytes, size: int = 8) -> list[list[int]]:
    """The codes of ``data`` in runs, each up to the clear code, the last up to the end code. Codes have a byte of
    room below them, where the next byte makes them a key; what is in it is no part of the code."""
    clear, end = 1 << size << 8, (1 << size) + 1 << 8
    runs: list[list[int]] = [[clear]]
    run: list[int] = []
    if data:
        entries, free, full = _entries(), end + 256, 4096 << 8
        at = data[0] << 8
        try:
            for byte in data[1:]:
                key = at + byte
                code = entries[key]
                if code:
                    at = code
                    continue
                run.append(key)
                at = byte << 8
                if free < full:
                    entries[key] = free
                    free += 256
                else:
                    for key in run:
                        entries[key] = 0
                    run.append(clear)
                    runs.append(run)
                    run, free = [], end + 256
        finally:
            for key in run:
                entries[key] = 0
        run.append(at)
    run.append(end)
    runs.append(run)
    return runs


def lzw_pack(parts: list[list[list[int]]], size: int = 8) -> list[bytes]:
    """The code streams of several frames' runs, packed from the low bit up."""
    import numpy as np

    width, before = _schedule(size)
    codes = np.fromiter(chain.from_iterable(chain.from_iterable(parts)), np.int64) >> 8
    at, k, byte, ends = np.empty(len(codes), np.int64), 0, 0, []
    for runs in parts:
        bit = 8 * byte
        for run in runs:
            n = len(run)
            at[k : k + n] = bit + before[:n]
            bit += int(before[n])
            k += n
        byte = (bit + 7) >> 3
        ends.append(byte)
    value = codes << (at & 7)
    out = sum(np.bincount((at >> 3) + i, (value >> 8 * i) & 255, minlength=byte + 2) for i in range(3))
    data = out.astype(np.uint8).tobytes()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """LZW codes of ``data``, packed from the low bit up; clear code first, end code last."""
    return lzw_pack([lzw_codes(data, size)], size)[0]


def lzw_encode_all(datas: list[bytes]) -> list[bytes]:
    """``lzw_encode`` of each; codes are packed together, those of a bounded number of bytes at a time."""
    return [x for part in slices(datas, 1 << 18) for x in lzw_pack(list(map(lzw_codes, part)))]


def lzw_decode(stream: bytes, size: int, length: int) -> bytes:
    """At most ``length`` bytes from the code stream. The entry a code above the end code stands for is
    a stretch of what this run has put out before: the string of an earlier code and one byte more."""
    import numpy as np

    clear, end = 1 << size, (1 << size) + 1
    width, before = _schedule(size, 1 << max(13, (length + 8).bit_length()))
    total = 8 * len(stream)
    padded = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    window = padded[:-2] | padded[1:-1] << 8 | padded[2:] << 16
    out = bytearray()
    bit, more = 0, True
    while more and len(out) < length and bit + int(width[0]) <= total:
        n = int(np.searchsorted(before, total - bit, side="right")) - 1
        at = bit + before[:n]
        codes = window[at >> 3] >> (at & 7) & ((1 << width[:n]) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        if len(stops):
            n = int(stops[0])
            more = codes[n] == clear
            bit += int(before[n + 1])
        else:
            more = False
        starts: list[int] = []
        lengths: list[int] = []
        size_now = len(out)
        for k, c in enumerate(codes[:n].tolist()):
            starts.append(size_now)
            if c < clear:
                out.append(c)
                size_now += 1
                lengths.append(1)
                continue
            j = c - end - 1
            if j >= k:
                raise ValueError(f"code {c} before its entry")
            a, m = starts[j], lengths[j] + 1
            out += out[a : a + m]
            if j == k - 1:  # its last byte is the first of what is being put out
                out.append(out[a])
            size_now += m
            lengths.append(m)
            if size_now >= length:
                break
    return bytes(out[:length])


def _decode_single(streams: list[bytes], size: int, lengths: list[int]) -> list[bytes | None]:
    """As ``lzw_decode``, for many short streams at once; None where a stream isn't one run of sound codes between a
    clear and an end code. Entries and bytes point back to what they repeat; pointers are followed in doubled steps."""
    import numpy as np

    clear, end = 1 << size, (1 << size) + 1
    width, before = _schedule(size)
    have, want = np.array([len(x) for x in streams]), np.array(lengths)
    raw = np.frombuffer(b"".join(streams) + b"\0\0\0", np.uint8).astype(np.int64)
    window = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    base = np.cumsum(have) - have
    ok = (have > 2) & (window[base] & (2 << size) - 1 == clear)
    n = np.where(ok, np.searchsorted(before, 8 * have - size - 1, side="right") - 1, 0)
    first = np.cumsum(n) - n
    k = np.arange(n.sum()) - np.repeat(first, n)
    at = np.repeat(8 * base + size + 1, n) + before[k]
    codes = window[at >> 3] >> (at & 7) & (1 << width[k]) - 1
    stops = np.append(np.flatnonzero((codes == clear) | (codes == end)), len(codes))
    stop = stops[np.searchsorted(stops, first)]
    ok &= (stop > first) & (stop < first + n) & (np.append(codes, clear)[stop] == end)
    m = np.where(ok, stop - first, 0)
    mine = k < np.repeat(m, n)
    codes, k = codes[mine], k[mine]
    first, file = np.cumsum(m) - m, np.repeat(np.arange(len(m)), m)
    literal, entry = codes < clear, codes - end - 1
    wrong = ~literal & (entry >= k)
    ok[file[wrong]] = False
    literal |= wrong
    parent = np.where(literal, np.arange(len(codes)), first[file] + entry)
    longer, up = (~literal).astype(np.int64), parent
    while (more := longer[up]).any():
        longer, up = longer + more, up[up]
    long = longer + 1
    total = np.bincount(file, weights=long, minlength=len(m)).astype(np.int64)
    ok &= total >= want
    if (total > want + 4096).any():
        return [None] * len(streams)
    start = np.cumsum(long) - long
    of = np.repeat(np.arange(len(codes)), long)
    spot = np.arange(len(of))
    source = np.where(literal[of], spot, start[parent[of]] + spot - start[of])
    while ((back := source[source]) != source).any():
        source = back
    value = np.zeros(len(of), np.uint8)
    value[start[literal]] = codes[literal] & 255
    data, ends = value[source].tobytes(), np.cumsum(total)
    return [data[a : a + w] if good else None for a, w, good in zip((ends - total).tolist(), lengths, ok.tolist(), strict=True)]


def lzw_decode_all(streams: list[bytes], sizes: list[int], lengths: list[int]) -> list[bytes]:
    """``lzw_decode`` of each stream; short ones of one size are decoded together, a bounded number of bytes at a time."""
    out: list[bytes | None] = [None] * len(streams)
    for size in set(sizes):
        part, room = [], 0
        for i in [*(i for i, s in enumerate(sizes) if s == size and 0 < lengths[i] <= 1 << 14 and len(streams[i]) <= 1 << 14), None]:
            if i is None or room > 1 << 18:
                for x, found in zip(part, _decode_single([streams[x] for x in part], size, [lengths[x] for x in part]) if part else [], strict=True):
                    out[x] = found
                part, room = [], 0
            if i is not None:
                part.append(i)
                room += lengths[i] + len(streams[i])
    return [lzw_decode(s, z, n) if x is None else x for x, s, z, n in zip(out, streams, sizes, lengths, strict=True)]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(data[i : i + 255]),)) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode(image: Image) -> bytes:
    """The file of ``image``; palettes have 256 colours, frames are not interlaced."""
    return encode_all([image])[0]


def encode_all(images: list[Image]) -> list[bytes]:
    """``encode`` of each; the code streams of all are made together."""
    streams = iter(lzw_encode_all([f.indices for image in images for f in image.frames]))
    return [_file(image, streams) for image in images]


def _file(image: Image, streams: Iterator[bytes]) -> bytes:
    out = [b"GIF89a", struct.pack("<HHBBB", image.width, image.height, 0xF7, image.background, 0), image.palette]
    if image.loops is not None:
        out.append(b"!\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", image.loops) + b"\0")
    for f in image.frames:
        out.append(b"!\xf9\x04" + struct.pack("<BHBB", f.disposal << 2 | (f.transparent is not None), f.delay_cs, f.transparent or 0, 0))
        own = f.palette != image.palette
        out.append(b"," + struct.pack("<HHHHB", f.left, f.top, f.width, f.height, 0x87 if own else 0))
        if own:
            out.append(f.palette)
        out += [b"\x08", _blocks(next(streams))]
    out.append(b";")
    return b"".join(out)


def _data(file: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := file[at]:
        parts.append(file[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _interlaced(rows: bytes, width: int, height: int) -> bytes:
    order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, height, step)]
    out = bytearray(width * height)
    for k, y in enumerate(order):
        out[y * width : (y + 1) * width] = rows[k * width : (k + 1) * width]
    return bytes(out)


def decode(file: bytes) -> Image:
    return decode_all([file])[0]


def decode_all(files: list[bytes]) -> list[Image]:
    """``decode`` of each; the code streams of all are decoded together. A file that can't be read is an error for all."""
    parsed = [_parse(file) for file in files]
    found = [x for _, streams, _ in parsed for x in streams]
    decoded = iter(lzw_decode_all([x for x, _, _ in found], [size for _, size, _ in found], [n for _, _, n in found]))
    for image, _, interlaced in parsed:
        for f, odd in zip(image.frames, interlaced, strict=True):
            f.indices = next(decoded).ljust(f.width * f.height, b"\0")
            if odd:
                f.indices = _interlaced(f.indices, f.width, f.height)
    return [image for image, _, _ in parsed]


def _parse(file: bytes) -> tuple[Image, list[tuple[bytes, int, int]], list[bool]]:
    """The image without indices; of each frame the code stream, its code size and pixels, and whether it is interlaced."""
    if file[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF signature")
    if len(file) < 14:
        raise ValueError("the file ends early")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", file, 6)
    at = 13
    palette = b""
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        palette, at = file[at : at + n], at + n
    if width * height > MAX_CANVAS:
        raise ValueError(f"a canvas of {width} x {height}")
    image = Image(width, height, background, palette, None, [])
    control = (0, 0, None)
    pixels = 0
    found: list[tuple[bytes, int, int]] = []
    interlaced: list[bool] = []
    try:
        while True:
            kind = file[at]
            if kind == 0x3B:
                break
            if kind == 0x21:
                label = file[at + 1]
                data, at = _data(file, at + 2)
                if label == 0xF9 and len(data) >= 4:
                    packed, delay, index = struct.unpack_from("<BHB", data)
                    control = (delay, packed >> 2 & 7, index if packed & 1 else None)
                elif label == 0xFF and data[:11] == b"NETSCAPE2.0" and len(data) >= 14:
                    image.loops = struct.unpack_from("<H", data, 12)[0]
                continue
            if kind != 0x2C:
                raise ValueError(f"block of unknown kind {kind}")
            left, top, w, h, flags = struct.unpack_from("<HHHHB", file, at + 1)
            at += 10
            pixels += w * h
            if pixels > MAX_PIXELS:
                raise ValueError(f"frames of more than {MAX_PIXELS} pixels")
            own = palette
            if flags & 0x80:
                n = 3 << ((flags & 7) + 1)
                own, at = file[at : at + n], at + n
            size = file[at]
            if not 1 <= size <= 11:
                raise ValueError(f"code size {size}")
            stream, at = _data(file, at + 1)
            found.append((stream, size, w * h))
            interlaced.append(bool(flags & 0x40))
            image.frames.append(Frame(left, top, w, h, b"", own, *control))
            control = (0, 0, None)
    except (IndexError, struct.error) as e:
        raise ValueError("the file ends early") from e
    return image, found, interlaced


def shown(image: Image):
    """The canvas (height x width x RGBA) at each frame, after transparency and disposal."""
    import numpy as np

    canvas = np.zeros((image.height, image.width, 4), np.uint8)
    for f in image.frames:
        before = canvas.copy() if f.disposal == 3 else None
        pal = np.zeros((256, 4), np.uint8)
        colours = np.frombuffer(f.palette, np.uint8).reshape(-1, 3)
        pal[: len(colours), :3] = colours
        pal[:, 3] = 255
        idx = np.frombuffer(f.indices, np.uint8).reshape(f.height, f.width)
        h, w = max(0, min(f.height, image.height - f.top)), max(0, min(f.width, image.width - f.left))
        part, idx = canvas[f.top : f.top + h, f.left : f.left + w], idx[:h, :w]
        seen = np.ones(idx.shape, bool) if f.transparent is None else idx != f.transparent
        part[seen] = pal[idx][seen]
        yield canvas.copy()
        if f.disposal == 2:
            canvas[f.top : f.top + h, f.left : f.left + w] = 0
        elif f.disposal == 3:
            canvas = before


def histogram(canvas) -> list[int]:
    """Pixels seen in each of 64 colours: two bits of red, green and blue."""
    import numpy as np

    rgb = canvas.reshape(-1, 4)
    rgb = rgb[rgb[:, 3] > 0].astype(np.int64) >> 6
    return np.bincount(rgb[:, 0] << 4 | rgb[:, 1] << 2 | rgb[:, 2], minlength=64).tolist()


def histograms(image: Image) -> list[list[int]]:
    """``histogram`` of the canvas at each frame."""
    return histograms_all([image])[0].tolist()


def histograms_all(images: list[Image]) -> list:
    """``histograms`` of each, as arrays. Where every frame covers the canvas and hides nothing of itself, the canvas
    is that frame, and those of all images of one size and palette are counted at once."""
    import numpy as np

    out: list = [None] * len(images)
    alike: dict[tuple[bytes, int], list[int]] = {}
    for n, image in enumerate(images):
        size = image.width * image.height
        if size and image.frames and all((f.left, f.top, f.width, f.height, f.transparent, f.palette) == (0, 0, image.width, image.height, None, image.palette) for f in image.frames):
            alike.setdefault((image.palette, size), []).append(n)
        else:
            out[n] = np.array([histogram(c) for c in shown(image)], np.int64).reshape(-1, 64)
    for (palette, size), part in alike.items():
        pal = np.zeros((256, 3), np.uint8)
        colours = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        pal[: len(colours)] = colours
        pal = pal.astype(np.int64) >> 6
        kinds = pal[:, 0] << 4 | pal[:, 1] << 2 | pal[:, 2]
        counts = [len(images[n].frames) for n in part]
        idx = np.frombuffer(b"".join(f.indices for n in part for f in images[n].frames), np.uint8)
        at = kinds[idx] + np.repeat(np.arange(sum(counts)) << 6, size)
        found = np.bincount(at, minlength=64 * sum(counts)).reshape(-1, 64)
        for n, rows in zip(part, np.split(found, np.cumsum(counts)[:-1]), strict=True):
            out[n] = rows
    return out


_FRAME = "frame int, at_cs int, delay_cs int, disposal int, transparent int, width int, height int, indices binary, histogram array<int>"


def _timed(image: Image) -> list[dict]:
    """A row per frame, in order of time."""
    rows, at = [], 0
    for n, (f, h) in enumerate(zip(image.frames, histograms(image), strict=True)):
        rows.append({"frame": n, "at_cs": at, "delay_cs": f.delay_cs, "disposal": f.disposal, "transparent": f.transparent, "width": f.width, "height": f.height, "indices": f.indices, "histogram": h})
        at += f.delay_cs
    return rows


def frames(df: DataFrame, file: str = "gif", key: str = "doc_id") -> DataFrame:
    """One row per frame of each file: key, frame, at_cs, delay_cs, disposal, transparent, width, height,
    indices, histogram array<int>, error. A file that can't be read gives one row with the error."""
    schema = f"key {df.schema[key].dataType.simpleString()}, {_FRAME}, error string"
    kinds = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for b in slim(batches):
            rows, size = [], 0
            for k, data in zip(b["key"].to_pylist(), b["gif"].to_pylist(), strict=True):
                try:
                    if data is None:
                        raise ValueError("no file")
                    found = _timed(decode(data))
                except ValueError as e:
                    found = [{"error": str(e)}]
                for r in found:
                    rows.append({"key": k} | r)
                    size += len(r.get("indices") or b"") + 1000
                    if size > 1 << 24:  # rows of few files at a time
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    found = df.select(F.col(key).alias("key"), F.col(file).alias("gif")).mapInArrow(run, schema)
    return found.withColumnRenamed("key", key)


def image_of(payload: bytes) -> Image:
    parts = [payload[i : i + FRAME_BYTES] for i in range(0, len(payload), FRAME_BYTES)]
    return Image(SIDE, SIDE, 0, COLOURS, 0, [Frame(0, 0, SIDE, SIDE, p, COLOURS, DELAY_CS, 1) for p in parts])


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // FRAME_BYTES)) * FRAME_BYTES, bytes((PAD,))), len(raw)


def feature(image: Image, by_frame) -> str:
    """Frames, playing time, and the share (in ten-thousandths of all pixels shown) of each of 64 colours, from
    the histograms of the frames."""
    by_colour = by_frame.sum(axis=0)
    return f"frames={len(image.frames)};cs={sum(f.delay_cs for f in image.frames)};colours=" + ",".join(map(str, (by_colour * 10000 // max(1, int(by_colour.sum()))).tolist()))


def _each_once(values: list, run) -> list:
    """What ``run`` gives for values, in lists of a bounded number of bytes and once for equal ones: copies of a text
    are neighbours often enough."""
    known: dict = {}
    for part in slices(dict.fromkeys(values)):
        known.update(zip(part, run(part), strict=True))
    return [known[v] for v in values]


def _timed_column(images: list[tuple[list[int], object]]):
    """An Arrow column of frames with their times and colours, from the delays and histograms of each image."""
    import numpy as np
    import pyarrow as pa

    delays = [d for own, _ in images for d in own]
    times = [t for own, _ in images for t in list(accumulate(own, initial=0))[:-1]]
    colours = np.concatenate([h for _, h in images]).astype(np.int32)
    histogram = pa.ListArray.from_arrays(np.arange(0, colours.size + 1, 64, dtype=np.int32), colours.ravel())
    rows = pa.StructArray.from_arrays([pa.array(times, pa.int32()), pa.array(delays, pa.int32()), histogram], ["at_cs", "delay_cs", "histogram"])
    return pa.ListArray.from_arrays(np.cumsum([0, *(len(own) for own, _ in images)], dtype=np.int32), rows)


def store(docs: DataFrame) -> DataFrame:
    """Documents as GIF files with what is in them: doc_id, n_bytes, gif, frames (their times, and how many
    pixels each of 64 colours has)."""

    def files(texts):
        payloads, sizes = zip(*map(payload_of, texts), strict=True)
        images = list(map(image_of, payloads))
        return zip(sizes, encode_all(images), (([f.delay_cs for f in i.frames], h) for i, h in zip(images, histograms_all(images), strict=True)), strict=True)

    def run(b):
        sizes, gifs, timed = zip(*_each_once([t or "" for t in b["text"].to_pylist()], files), strict=True)
        return {"doc_id": b["doc_id"], "n_bytes": sizes, "gif": gifs, "frames": _timed_column(timed)}

    return arrow_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, gif binary, frames array<struct<at_cs:int,delay_cs:int,histogram:array<int>>>", rows=100)


def digest(stored: DataFrame) -> DataFrame:
    """Reads stored files back: sizes, digests and features of what they hold."""

    def held(gifs):
        images = decode_all(gifs)
        for gif, image, by_frame in zip(gifs, images, histograms_all(images), strict=True):
            payload = b"".join(f.indices for f in image.frames)
            yield len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(gif), hashlib.sha256(gif).hexdigest(), feature(image, by_frame)

    def run(b):
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        found = zip(*_each_once(b["gif"].to_pylist(), held), strict=True)
        return {"doc_id": b["doc_id"], "n_bytes": b["n_bytes"]} | dict(zip(names, found, strict=True))

    return arrow_rows(stored.select("doc_id", "n_bytes", "gif"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(materialize(spark, store(table(spark, sf_dir, "documents")), "media"))
