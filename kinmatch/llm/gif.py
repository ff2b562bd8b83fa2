"""GIF animations: reading them to timed frames with colour histograms, and writing lossless ones.

The reader takes GIF87a and GIF89a files: global and local palettes,
interlacing, transparency, disposal and delays, up to a number of pixels. Frames are drawn on the canvas
in turn, and each is stored as it is shown. The writer stores bytes as palette
indexes of grey frames, `FRAME_WIDTH` samples a row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import bounded_batches, byte_lists, chunks, released

BLOCK = 576
FRAME_WIDTH = 576
FRAME_ROWS = 64
DELAY = 10  # hundredths of a second
MOST_CODES = 4096
#: Pixels of a canvas or a frame that the reader takes, at most, so that no header makes it ask for any memory.
MOST_PIXELS = 1 << 24
#: Bins of a colour histogram: two bits of red, green and blue each.
BINS = 64


def lzw_encode(data: bytes, depth: int = 8) -> bytes:
    """A GIF code stream; the table is cleared when it is full."""
    clear, end = 1 << depth, (1 << depth) + 1
    codes, widths = [clear], [(0, depth + 1)]  # widths: (codes so far, width from there on)
    put = codes.append
    at, n = 0, len(data)
    while True:
        # one life of the table
        life, nxt, width_end, width = {}, end + 1, 1 << (depth + 1), depth + 1
        if at >= n:
            break
        prefix = data[at]
        at += 1
        full = False
        for at in range(at, n):  # noqa: B020
            key = prefix << 8 | data[at]
            code = life.get(key)
            if code is not None:
                prefix = code
                continue
            put(prefix)
            prefix = data[at]
            if nxt == MOST_CODES - 1:
                full = True
                break
            life[key] = nxt
            if nxt == width_end:
                width += 1
                width_end <<= 1
                widths.append((len(codes), width))
            nxt += 1
        if full:  # data[at] begins the next life
            put(clear)
            widths.append((len(codes), depth + 1))
            continue
        put(prefix)
        if nxt == width_end and width < 12:
            widths.append((len(codes), width + 1))
        break
    put(end)
    return _pack(codes, widths)


def _pack(codes: list[int], widths: list[tuple[int, int]]) -> bytes:
    values = np.array(codes, np.uint16)
    bits = []
    for k, (start, width) in enumerate(widths):
        stop = widths[k + 1][0] if k + 1 < len(widths) else len(codes)
        if start < stop:
            part = values[start:stop].astype("<u2").view(np.uint8).reshape(-1, 2)
            bits.append(np.unpackbits(part, axis=1, bitorder="little")[:, :width].ravel())
    return np.packbits(np.concatenate(bits), bitorder="little").tobytes()


class CodeReader:
    """Runs of codes of a width, from a GIF code stream."""

    def __init__(self, stream: bytes):
        self.bits = np.unpackbits(np.frombuffer(stream, np.uint8), bitorder="little")
        self.at = 0

    def take(self, count: int, width: int) -> list[int]:
        """Up to so many codes, without moving on."""
        count = min(count, (len(self.bits) - self.at) // width)
        part = self.bits[self.at : self.at + count * width].reshape(count, width)
        whole = np.zeros((count, 16), np.uint8)
        whole[:, :width] = part
        return np.packbits(whole, axis=1, bitorder="little").view("<u2").ravel().tolist()


def lzw_decode(stream: bytes, depth: int, most: int) -> bytes:
    """The samples of a code stream, `most` at the most; a stream that breaks off gives those before."""
    clear = 1 << depth
    roots = [bytes([k]) for k in range(clear)] + [b"", b""]  # neither the clear nor the end code has samples
    reader, out, made = CodeReader(stream), [], 0
    table, width, before = list(roots), depth + 1, b""
    while made < most:
        # a code adds an entry to the table, but for the first after a clear
        room = MOST_CODES if len(table) == MOST_CODES else (1 << width) - len(table) + (not before)
        codes = reader.take(max(1, room), width)
        if not codes:
            break
        start, used, entry = len(out), 0, b""
        if not before:
            used, before = 1, table[codes[0]] if codes[0] < len(table) else b""
            entry = before
            if before:
                out.append(before)
        if before and len(table) < MOST_CODES:
            put, add = out.append, table.append
            for used, code in enumerate(codes[used:], used + 1):  # noqa: B007
                try:
                    entry = table[code]
                except IndexError:
                    if code > len(table):
                        entry = b""
                        break
                    entry = before + before[:1]
                if not entry:
                    break
                put(entry)
                add(before + entry[:1])
                before = entry
        elif before:
            for used, code in enumerate(codes[used:], used + 1):
                entry = table[code]
                if not entry:
                    break
                out.append(entry)
                before = entry
        made += sum(map(len, out[start:]))
        code = codes[used - 1]
        if not entry and code != clear and used:
            break  # the end, or no code of this table
        reader.at += used * width
        if not entry:
            table, before, width = list(roots), b"", depth + 1
        else:
            width = max(width, min(12, len(table).bit_length()))
    return b"".join(out)[:most]


def _blocks(data: bytes) -> bytes:
    return b"".join([bytes([len(x)]) + x for k in range(0, len(data), 255) for x in [data[k : k + 255]]]) + b"\x00"


_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def write_gif(samples: bytes, width: int = FRAME_WIDTH, rows: int = FRAME_ROWS, delay: int = DELAY) -> bytes:
    """Samples, a multiple of width in number, as an animation of grey frames with up to `rows` rows each."""
    high = min(rows, len(samples) // width)
    head = b"GIF89a" + width.to_bytes(2, "little") + high.to_bytes(2, "little") + b"\xf7\x00\x00" + _GREY
    out = [head]
    for at in range(0, len(samples), width * rows):
        frame = samples[at : at + width * rows]
        control = b"\x21\xf9\x04\x04" + delay.to_bytes(2, "little") + b"\x00\x00"
        place = b"\x2c\x00\x00\x00\x00" + width.to_bytes(2, "little") + (len(frame) // width).to_bytes(2, "little") + b"\x00"
        out.append(control + place + b"\x08" + _blocks(lzw_encode(frame)))
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    """What one image of the file brought: its samples, and what the canvas then shows."""

    samples: bytes  # palette indexes, rows in order
    box: tuple[int, int, int, int]  # left, top, width, height
    delay: int
    disposal: int
    canvas: np.ndarray | None  # (height, width, 4) of red, green, blue, alpha
    histogram: np.ndarray  # shares of BINS colours, of what shows


def histogram(rgba: np.ndarray) -> np.ndarray:
    """How many visible pixels have each of the coarse colours."""
    parts = rgba.reshape(-1, 4)
    bins = (parts[:, 0] >> 6) * np.uint8(16) + (parts[:, 1] >> 6) * np.uint8(4) + (parts[:, 2] >> 6)
    bins[parts[:, 3] == 0] = BINS
    return np.bincount(bins, minlength=BINS + 1)[:BINS]


def read_gif(data: bytes, canvases: bool = True, most_pixels: int = MOST_PIXELS) -> Iterator[Frame]:
    """The frames of a file, with copies of the canvas if wanted.

    A file that breaks off ends with its last whole image, and one that goes
    wrong (no palette, a code size out of 2 to 8, a broken code stream, an
    image of more than most_pixels) with the last right one. What is no GIF,
    or has a canvas of more than most_pixels, has no frames.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return
    wide, high, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
    if wide * high > most_pixels:
        return
    at, palette = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        if at + n > len(data):
            return
        palette, at = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n
    canvas = np.zeros((high, wide, 4), np.uint8)
    delay, disposal, clear_index = 0, 0, -1

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while at < len(data):
        kind = data[at]
        if kind == 0x21 and at + 1 < len(data):
            label = data[at + 1]
            body, at = sub_blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                clear_index = body[3] if body[0] & 1 else -1
            continue
        if kind != 0x2C or at + 10 > len(data):
            return
        left, top, w, h = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (1, 3, 5, 7))
        own, at = data[at + 9], at + 10
        colours = palette
        if own & 0x80:
            n = 3 << ((own & 7) + 1)
            if at + n > len(data):
                return
            colours, at = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n
        if at >= len(data) or colours is None:
            return
        depth = data[at]
        if not 2 <= depth <= 8 or w * h > most_pixels:
            return
        stream, at = sub_blocks(at + 1)
        samples = lzw_decode(stream, depth, w * h)
        if len(samples) < w * h:
            return
        pixels = np.frombuffer(samples, np.uint8).reshape(h, w)
        if own & 0x40:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            rows = np.empty_like(pixels)
            rows[order] = pixels
            pixels, samples = rows, rows.tobytes()
        before = canvas.copy() if disposal == 3 else None
        spot = canvas[top : top + h, left : left + w]
        shown = pixels[: spot.shape[0], : spot.shape[1]]
        shades = np.full((256, 4), 255, np.uint8)
        shades[:, :3] = colours[np.minimum(np.arange(256), len(colours) - 1)]
        drawn = shades.view(np.uint32).ravel()[shown].view(np.uint8).reshape(*shown.shape, 4)
        if clear_index >= 0:
            seen = shown != clear_index
            spot[seen] = drawn[seen]
        else:
            spot[...] = drawn
        yield Frame(samples, (left, top, w, h), delay, disposal, canvas.copy() if canvases else None, histogram(canvas))
        if disposal == 2:
            spot[...] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear_index = 0, 0, -1


FRAMES_SQL = "array<struct<shown_at: bigint, delay: bigint, disposal: int, left: int, top: int, width: int, height: int, histogram: array<bigint>>>"
FRAMES = pa.list_(pa.struct([("shown_at", pa.int64()), ("delay", pa.int64()), *((n, pa.int32()) for n in ("disposal", "left", "top", "width", "height")), ("histogram", pa.list_(pa.int64()))]))


def with_frames(files: DataFrame, gif: str = "gif", column: str = "frames") -> DataFrame:
    """files with an array of the timed frames in the binary column `gif`, each with the colour histogram of the canvas it leaves.

    A null, an empty or no GIF has no frames, a broken one those before the
    break (see read_gif). Rows and other columns are kept; a column of the
    array's name is replaced; no files give no rows.
    """
    files = bounded_batches(files).drop(column).withColumn(column, F.array().cast(FRAMES_SQL))

    @released
    def run(batches):
        for batch in chunks(batches, 4 << 20, gif):
            out = []
            for data in batch.column(gif).to_pylist():
                clock, frames = 0, []
                for f in read_gif(data or b"", canvases=False):
                    frames.append(dict(zip(("shown_at", "delay", "disposal", "left", "top", "width", "height", "histogram"), (clock, f.delay, f.disposal, *f.box, f.histogram.tolist()), strict=True)))
                    clock += f.delay
                out.append(frames)
            k = batch.schema.get_field_index(column)
            yield batch.set_column(k, column, pa.array(out, FRAMES))

    return files.mapInArrow(run, files.schema)


def padded(text: bytes, block: int = BLOCK) -> bytes:
    size = max(1, -(-len(text) // block)) * block
    return text + b"\xff" * (size - len(text))


def media_columns(docs: DataFrame, keep: bool = False) -> DataFrame:
    """Each text stored as a GIF and read back.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature (frames, hundredths of a second shown, and the
    colour histogram summed over the frames), frames (start, delay, grey
    histogram's filled bins); with keep, also media, the file. A null text is
    empty; equal texts have equal values; null ids and repeated rows are kept,
    other columns ignored.
    """
    types = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("frames", pa.list_(pa.struct([("shown_at", pa.int64()), ("delay", pa.int64()), ("histogram", pa.list_(pa.int64()))]))), ("media", pa.binary()),
    ])
    sql = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<struct<shown_at: bigint, delay: bigint, histogram: array<bigint>>>, media binary"

    def store(text: bytes) -> tuple:
        media = write_gif(padded(text))
        parts, frames, total, clock = [], [], np.zeros(BINS, np.int64), 0
        for frame in read_gif(media, canvases=False):
            parts.append(frame.samples)
            frames.append({"shown_at": clock, "delay": frame.delay, "histogram": frame.histogram.tolist()})
            total += frame.histogram
            clock += frame.delay
        payload = b"".join(parts)
        filled = ",".join(f"{k:02x}:{n}" for k, n in enumerate(total.tolist()) if n)
        return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(frames)}|{clock}|{filled}", frames, media if keep else None

    @released
    def run(batches):
        for batch in chunks(batches, 4 << 20):
            rows = [(doc, *store(text)) for doc, text in zip(batch.column("doc_id").to_pylist(), byte_lists(batch.column("text")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types.types, strict=True)], schema=types)

    stored = bounded_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, sql)
    return stored if keep else stored.drop("media")
