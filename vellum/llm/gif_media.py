"""GIF: bytes to animated frames and back, with timing and colour histograms.

``encode`` stores a payload as frames of ``side`` x ``side`` indexed pixels under a grey palette, each an
LZW code stream of its own. ``decode`` reads any GIF87a or GIF89a: global and local palettes, interlace,
sub-rectangles, transparency, disposal (keep, background, previous), delays, loop count.

A code's width depends only on how many codes came since the last clear, so a stream without a clear in
its middle is cut into codes by one vectorised read; other streams are read code by code.

``to_media`` stores texts as a GIF column with frame times and colour histograms; ``to_frames`` decodes any
column of GIFs into a table of timed frames, each with its own histograms of red, green and blue.

Defined results: a null text is empty and becomes one padded frame; texts of any length are as many frames as
they need (``to_frames`` hands frames on a few at a time); repeated rows are alike, and have rows of their
own; an empty table gives no rows; extra columns are ignored by ``to_media``. ``to_frames`` gives no row for a
null GIF, one row without a frame but with an ``error`` for a damaged one. ``decode`` raises ValueError.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common, tokens

SIDE = 24


@lru_cache(maxsize=4096)
def _layout(root: int, codes: int):
    """Widths and bit places of the first codes after a clear. The code that follows the k-th addition is wider once the table has outgrown the width."""
    import numpy as np

    first = (1 << root) + 2
    place = np.arange(codes)
    # code 0 is the clear itself and code 1 adds nothing; a reader's table holds first + (i - 1) entries after code i
    size = first + np.maximum(place - 2, 0)
    width = np.minimum(np.maximum(np.ceil(np.log2(size + 1)).astype(np.int64), root + 1), 12)
    return width, np.concatenate([[0], np.cumsum(width)])


def lzw_codes(data: bytes, root: int) -> list[int]:
    """Clear, codes, end; a full table is cleared."""
    clear = 1 << root
    out = [clear]
    if not data:
        return [clear, clear + 1]
    append, table, nxt = out.append, {}, clear + 2
    rest = iter(data)
    prefix = next(rest)
    for b in rest:
        key = prefix << 8 | b
        if key in table:
            prefix = table[key]
        else:
            append(prefix)
            table[key] = nxt
            nxt += 1
            prefix = b
            if nxt == 4096:
                append(clear)
                table, nxt = {}, clear + 2
    append(prefix)
    append(clear + 1)
    return out


def _widths(codes, root: int):
    """Widths of a stream's codes: by place after the last clear; a clear itself has the width reached before it."""
    import numpy as np

    clears = np.flatnonzero(np.asarray(codes) == 1 << root)
    edges = [*clears.tolist(), len(codes)]
    parts = [_layout(root, b - a + 1)[0] for a, b in zip(edges, edges[1:], strict=False)]
    out = [p[:-1].copy() for p in parts]
    for k in range(1, len(out)):
        out[k][0] = parts[k - 1][-1]
    return np.concatenate(out)


def pack_streams(streams: list, root: int) -> list[bytes]:
    """Lists of codes to bytes, low bits first, each stream on a byte of its own; one vectorised write for all."""
    import numpy as np

    width = np.concatenate([_widths(c, root) if c.count(1 << root) > 1 else _layout(root, len(c))[0] for c in streams])
    counts = np.array([len(c) for c in streams])
    last = np.cumsum(counts)
    total = np.cumsum(width)
    bits = np.diff(total[last - 1], prepend=0)
    size = (bits + 7) >> 3
    base = np.cumsum(size) - size
    at = total - width + np.repeat(base * 8 - (total[last - 1] - bits), counts)
    value = np.fromiter(chain.from_iterable(streams), np.uint32, int(counts.sum())) << (at & 7).astype(np.uint32)
    byte, n = at >> 3, int(size.sum()) + 3
    # bits never collide, so sums are ors; a byte's sum is below 256
    raw = sum(np.bincount(byte + k, value >> np.uint32(8 * k) & np.uint32(255), n) for k in range(3)).astype(np.uint8).tobytes()
    return [raw[a : a + n] for a, n in zip(base.tolist(), size.tolist(), strict=True)]


def cut_streams(streams: list[bytes], root: int) -> list[list[int]]:
    """All codes of each stream under the widths that hold while no clear comes again."""
    import numpy as np

    bits = np.array([len(r) * 8 for r in streams])
    width, at = _layout(root, 1 << int(bits.max() // (root + 1) + 1).bit_length())
    counts = np.searchsorted(at, bits, "right") - 1
    ends = np.cumsum(counts)
    idx = np.arange(int(ends[-1])) - np.repeat(ends - counts, counts)
    start = np.cumsum(bits) - bits
    place = at[idx] + np.repeat(start, counts)
    raw = b"".join(streams) + b"\0\0\0\0"
    word = np.ndarray((len(raw) - 3,), "<u4", raw, strides=(1,))[place >> 3]  # the four bytes from each byte on
    codes = ((word >> (place & 7).astype(np.uint32)) & ((1 << width[idx]) - 1).astype(np.uint32)).tolist()
    return [codes[e - n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def _one_by_one(raw: bytes, root: int):
    """Codes of a stream that clears its table in the middle."""
    clear, buffer, held, at, width, size = 1 << root, 0, 0, 0, root + 1, (1 << root) + 2
    fresh = True
    while True:
        while held < width:
            if at == len(raw):
                return
            buffer |= raw[at] << held
            at, held = at + 1, held + 8
        code = buffer & ((1 << width) - 1)
        buffer, held = buffer >> width, held - width
        yield code
        if code == clear:
            width, size, fresh = root + 1, clear + 2, True
        elif code == clear + 1:
            return
        elif fresh:
            fresh = False
        elif size < 4096:
            size += 1
            if size == 1 << width and width < 12:
                width += 1


_single = [bytes([i]) for i in range(256)]


def lzw_decode(raw: bytes, root: int, codes: list | None = None) -> bytes:
    """``codes``: the stream as ``cut_streams`` has it, if that is at hand."""
    clear, end = 1 << root, (1 << root) + 1
    codes = cut_streams([raw], root)[0] if codes is None else codes
    if not codes or codes[0] != clear:
        raise ValueError("no clear code at the start")
    stop = codes.index(end) if end in codes else -1
    if stop < 0 or codes.count(clear) > 1 and clear in codes[1:stop]:
        runs: list = []
        for code in _one_by_one(raw, root):
            if code == clear:
                runs.append([])
            elif code != end:
                runs[-1].append(code)
        return b"".join(_expand(r, root) for r in runs)
    return _expand(codes[1:stop], root)


def _expand(codes: list, root: int) -> bytes:
    """The codes between two clears."""
    if not codes:
        return b""
    table = [*_single[: 1 << root], b"", b""]
    grow, rest = table.append, iter(codes)
    first = next(rest)
    if first >= 1 << root:
        raise ValueError("code beyond the table")
    before = table[first]
    out = [before]
    append = out.append
    if len(codes) + len(table) <= 4096:
        for code in rest:
            try:
                entry = table[code]
                grow(before + entry[:1])
            except IndexError:
                if code != len(table):
                    raise ValueError("code beyond the table") from None
                entry = before + before[:1]
                grow(entry)
            append(entry)
            before = entry
        return b"".join(out)
    for code in rest:  # the table may fill up
        if code < len(table):
            entry = table[code]
        elif code == len(table):
            entry = before + before[:1]
        else:
            raise ValueError("code beyond the table")
        if len(table) < 4096:
            grow(before + entry[:1])
        append(entry)
        before = entry
    return b"".join(out)


def _blocks(raw: bytes) -> bytes:
    return b"".join(bytes([len(raw[i : i + 255])]) + raw[i : i + 255] for i in range(0, len(raw), 255)) + b"\0"


_GREY = bytes(x for i in range(256) for x in (i, i, i))


def encode_many(payloads: list[bytes], side: int = SIDE, delay: int = 4) -> list[bytes]:
    """Payloads of whole frames as animated GIFs, ``delay`` hundredths of a second a frame. Codes of many frames become bits at once."""
    area = side * side
    if any(not p or len(p) % area for p in payloads):
        raise ValueError("payload isn't a number of whole frames")
    head = [b"GIF89a" + struct.pack("<HHBBB", side, side, 0xF7, 0, 0) + _GREY, b"!\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    frame = b"!\xf9\x04\x04" + struct.pack("<H", delay) + b"\0\0" + b"," + struct.pack("<HHHHB", 0, 0, side, side, 0) + b"\x08"
    cut = [p[at : at + area] for p in payloads for at in range(0, len(p), area)]
    packed: list[bytes] = []
    for at in range(0, len(cut), 1024):
        packed += pack_streams([lzw_codes(x, 8) for x in cut[at : at + 1024]], 8)
    out, at = [], 0
    for p in payloads:
        n = len(p) // area
        out.append(b"".join([*head, *(x for stream in packed[at : at + n] for x in (frame, _blocks(stream))), b";"]))
        at += n
    return out


def encode(payload: bytes, side: int = SIDE, delay: int = 4) -> bytes:
    return encode_many([payload], side, delay)[0]


@dataclass
class Frame:
    """What the screen shows after a frame: red, green, blue, alpha; and for how long, in hundredths of a second."""

    pixels: Any
    delay: int


def parse(raw: bytes):
    """(width, height, images): each image's place, palette, code stream and rules, in order."""
    import numpy as np

    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        width, height, flags = struct.unpack_from("<HHB", raw, 6)
        at, palette = 13, None

        def colours(at, n):
            return np.frombuffer(raw[at : at + 3 * n], np.uint8).reshape(-1, 3), at + 3 * n

        def data(at):
            parts = []
            while raw[at]:
                parts.append(raw[at + 1 : at + 1 + raw[at]])
                at += 1 + raw[at]
            return b"".join(parts), at + 1

        if flags & 0x80:
            palette, at = colours(at, 2 << (flags & 7))
        images, delay, disposal, hidden = [], 0, 0, None
        while raw[at] != 0x3B:
            if raw[at] == 0x21:
                label = raw[at + 1]
                body, at = data(at + 2)
                if label == 0xF9:
                    packed, delay, index = struct.unpack("<BHB", body[:4])
                    disposal, hidden = packed >> 2 & 7, index if packed & 1 else None
                continue
            if raw[at] != 0x2C:
                raise ValueError("unknown block")
            x, y, w, h, f = struct.unpack_from("<HHHHB", raw, at + 1)
            at, own = at + 10, palette
            if f & 0x80:
                own, at = colours(at, 2 << (f & 7))
            root = raw[at]
            stream, at = data(at + 1)
            if own is None:
                raise ValueError("no palette")
            images.append((x, y, w, h, bool(f & 0x40), own, root, stream, delay, disposal, hidden))
            delay, disposal, hidden = 0, 0, None
    except (IndexError, struct.error):
        raise ValueError("cut short") from None
    return width, height, images


def _indices(images, many: int = 512) -> list[bytes]:
    """Each image's pixels as palette indices."""
    out = []
    for at in range(0, len(images), many):
        some = images[at : at + many]
        roots = {i[6] for i in some}
        cut = {r: iter(cut_streams([i[7] for i in some if i[6] == r], r)) for r in roots}
        for image in some:
            got = lzw_decode(image[7], image[6], next(cut[image[6]]))
            if len(got) < image[2] * image[3]:
                raise ValueError("too few pixels")
            out.append(got[: image[2] * image[3]])
    return out


def decode_many(raws: list[bytes]) -> list[tuple]:
    """(width, height, frames) of each GIF."""
    parsed = [parse(r) for r in raws]
    got = iter(_indices([i for _, _, images in parsed for i in images], 1024))
    return [(width, height, _shown(width, height, images, [next(got) for _ in images])) for width, height, images in parsed]


def decode(raw: bytes) -> tuple:
    """(width, height, frames)."""
    return decode_many([raw])[0]


def _shown(width: int, height: int, images, got: list[bytes]) -> list[Frame]:
    """The screen after each image, by the rules of transparency and disposal."""
    import numpy as np

    if images and all(i[:5] == (0, 0, width, height, False) and i[10] is None and i[9] < 3 and i[5] is images[0][5] for i in images):
        pixels = np.full((len(images), height, width, 4), 255, np.uint8)  # every frame covers the screen
        index = np.frombuffer(b"".join(got), np.uint8).reshape(len(images), height, width)
        pixels[..., :3] = images[0][5][np.minimum(index, len(images[0][5]) - 1)]
        return [Frame(p, i[8]) for p, i in zip(pixels, images, strict=True)]
    screen, frames = np.zeros((height, width, 4), np.uint8), []
    for (x, y, w, h, interlaced, palette, _, _, delay, disposal, hidden), flat in zip(images, got, strict=True):
        index = np.frombuffer(flat, np.uint8).reshape(h, w)
        if interlaced:
            rows = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(index)
            straight[rows] = index
            index = straight
        before = screen.copy() if disposal == 3 else None
        area = screen[y : y + h, x : x + w]
        shown = np.ones((h, w), bool) if hidden is None else index != hidden
        rgba = np.concatenate([palette[np.minimum(index, len(palette) - 1)], np.full((h, w, 1), 255, np.uint8)], 2)
        np.copyto(area, rgba[: area.shape[0], : area.shape[1]], where=shown[: area.shape[0], : area.shape[1], None])
        frames.append(Frame(screen.copy(), delay))
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            screen = before
    return frames


def payload_of(text: bytes, side: int = SIDE) -> bytes:
    """The text and bytes 255 up to a positive multiple of a frame."""
    area = side * side
    return text + b"\xff" * (area - len(text) if not text else -len(text) % area)


def histogram(frames, bins: int = 8):
    """Counts of each channel's values in equal bins over all frames: red, green, blue."""
    import numpy as np

    total = np.zeros((3, bins), np.int64)
    for f in frames:
        seen = f.pixels[..., 3] > 0
        for c in range(3):
            total[c] += np.bincount(f.pixels[..., c][seen] >> (8 - bins.bit_length() + 1), minlength=bins)
    return total


MEDIA = "doc_id long, n_bytes long, media binary, n_frames int, frame_ms array<int>, histogram array<long>"


def _grey_columns(frames):
    """Payload and histogram of frames whose channels are alike."""
    import numpy as np

    red = np.stack([f.pixels[..., 0] for f in frames])
    return red.tobytes(), np.bincount(red.ravel() >> 5, minlength=8)


def media_rows(texts: list[bytes]):
    """For each text: its length, the payload as decoded from its GIF, the GIF, its frames and their grey histogram."""
    gifs = encode_many([payload_of(t) for t in texts])
    for raw, gif, (_, _, frames) in zip(texts, gifs, decode_many(gifs), strict=True):
        back, counts = _grey_columns(frames)
        yield len(raw), back, gif, frames, counts


def media_batches(digest: bool):
    def run(batches):
        import hashlib
        import zlib

        import pyarrow as pa

        for whole in batches:
            for b in tokens.slices(whole, 64):
                rows = []
                texts = [raw or b"" for raw in b.column(1).cast(pa.binary()).to_pylist()]
                for doc_id, (n, back, gif, frames, counts) in zip(b.column(0).to_pylist(), media_rows(texts), strict=True):
                    times = [10 * f.delay for f in frames]
                    if digest:
                        feature = f"frames={len(times)};ms={sum(times)};grey=" + ",".join(map(str, counts))
                        rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(gif), hashlib.sha256(gif).hexdigest(), feature))
                    else:
                        rows.append((doc_id, n, gif, len(times), times, histogram(frames).ravel().tolist()))
                schema = DIGEST if digest else MEDIA
                kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
                fields = [c.split(" ") for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[f for f, _ in fields])

    return run


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def to_media(docs: DataFrame) -> DataFrame:
    """Every text as a GIF column with its frames' times and colour histogram (red, green, blue by eight bins)."""
    common.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(media_batches(False), MEDIA)


FRAMES = "frame int, delay_ms int, width int, height int, rgba binary, red array<long>, green array<long>, blue array<long>, error string"


def frame_batches(batches):
    """(id, GIF) to the id and ``FRAMES``; at most 64 frames go out at once."""
    import pyarrow as pa

    kinds = [pa.int32()] * 4 + [pa.binary()] + [pa.list_(pa.int64())] * 3 + [pa.string()]
    names = [c.split()[0] for c in FRAMES.split(", ")]

    def out(ids, rows):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["_gif", *names])

    for b in batches:
        ids, rows = [], []
        for own, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if raw is None:
                continue
            try:
                width, height, frames = decode(raw)
                found = ((i, 10 * f.delay, width, height, f.pixels.tobytes(), *histogram([f]).tolist(), None) for i, f in enumerate(frames))  # bytes made as they go out
            except ValueError as e:
                found = [(None,) * 8 + (str(e),)]
            for row in found:
                ids.append(own)
                rows.append(row)
                if len(rows) == 64:
                    yield out(ids, rows)
                    ids, rows = [], []
        yield out(ids, rows)


def to_frames(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row per frame of every GIF in a column, as the screen shows it: the row's key, the frame's place, time, size, pixels (RGBA, row by row) and histograms."""
    common.small_batches(media.sparkSession)
    rows = media.select(F.col(key).cast("long").alias("_gif"), F.col(column).alias("_raw"))
    return rows.mapInArrow(frame_batches, "_gif long, " + FRAMES).withColumnRenamed("_gif", key)


def media_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: digests of the payload read back from each document's GIF, and of the GIF."""
    docs = common.table(spark, sf_dir, "documents")
    common.small_batches(spark)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(media_batches(True), DIGEST)
