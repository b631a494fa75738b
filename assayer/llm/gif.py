"""GIF images in columns: LZW streams, palettes, disposal and transparency, timed frames, colour histograms.

decode() reads any GIF87a or GIF89a: sub-blocks, interlace, local and global palettes, variable-width LZW codes with
clear codes and a full table, the three disposal methods and transparent pixels. Code streams are cut into codes in
whole arrays: between clear codes the n-th code's width is known beforehand. encode() writes frames of 8-bit samples
losslessly, with a grey palette, so that a sample is its colour.

For a text, payload() gives its UTF-8 bytes, filled with bytes 255 to a positive multiple of FRAME_BYTES; each such part
is one 24 x 24 frame. A null text is the empty one: a single white frame. Equal texts have equal results. A broken image
gives an error for its row (column `error`), not for the job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices

SIDE = 24
FRAME_BYTES = SIDE * SIDE
DELAY_CS = 4
BINS = 8
#: Frames whose code streams are decoded together.
FRAMES_HELD = 1024
_GREY = bytes(v for i in range(256) for v in (i, i, i))
_TABLE = 4096


def _widths(low_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Width of the n-th code after a clear code, and its offset in bits."""
    key = low_bits
    if key not in _WIDTHS:
        n = np.arange(1 << 16)
        last = (1 << low_bits) + 1
        width = np.clip(np.floor(np.log2(np.maximum(n + last, 1))).astype(np.int64) + 1, low_bits + 1, 12)
        _WIDTHS[key] = (width, np.concatenate([[0], np.cumsum(width)]))
    return _WIDTHS[key]


_WIDTHS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_EIGHT = [bytes([i]) for i in range(256)]


def lzw_codes(samples: bytes) -> list[int]:
    """Codes of 8-bit samples (fewer than a table holds), after the clear code and before the end code."""
    table: dict[int, int] = {}
    get, out, free = table.get, [], 258
    w = samples[0]
    for c in samples[1:]:
        k = w << 8 | c
        x = get(k)
        if x is None:
            out.append(w)
            table[k] = free
            free += 1
            w = c
        else:
            w = x
    out.append(w)
    return out


def _packed(streams: list[list[int]]) -> list[bytes]:
    """Each stream with its clear code (256) and end code (257), packed into bytes, lowest bit first."""
    width, offset = _widths(8)
    flat: list[int] = []
    for s in streams:
        flat.append(256)
        flat += s
        flat.append(257)
        flat.append(0)  # fills the last byte
    codes = np.array(flat, np.int16)
    counts = np.fromiter(map(len, streams), np.int64, len(streams)) + 3
    end = np.cumsum(counts)
    at = np.arange(len(codes)) - np.repeat(end - counts, counts)
    w = width[np.maximum(at - 1, 0)]
    used = 9 + offset[counts - 2]
    w[end - 1] = -used % 8
    step = np.arange(12, dtype=np.int16)
    bits = ((codes[:, None] >> step) & 1).astype(np.uint8)[step < w[:, None]]
    raw = np.packbits(bits, bitorder="little").tobytes()
    cut = np.concatenate([[0], np.cumsum((used + 7) // 8)]).tolist()
    return [raw[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]


def encode(frames: list[bytes], width: int, height: int, delay_cs: int = DELAY_CS) -> bytes:
    """A looping GIF89a of frames of width x height samples (at most 3800 in a frame)."""
    if width * height > 3800:
        raise ValueError("a frame must fit one code table")
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), _GREY, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    head = b"\x21\xf9\x04\x04" + struct.pack("<H", delay_cs) + b"\x00\x00\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + b"\x08"
    for data in _packed([lzw_codes(f) for f in frames]):
        out.append(head)
        for a in range(0, len(data), 255):
            part = data[a : a + 255]
            out += [bytes([len(part)]), part]
        out.append(b"\x00")
    return b"".join(out) + b"\x3b"


def lzw_decode_all(streams: list[bytes], low_bits: int, sizes: list[int]) -> list[bytes]:
    """The samples of many code streams. Those with a clear code only at their start and no full table are decoded
    together: the string of a code is that of an earlier code of its stream and one more sample, so lengths, first samples
    and all others follow these references in whole arrays. The others are decoded one by one."""
    clear, stop = 1 << low_bits, (1 << low_bits) + 1
    width, offset = _widths(low_bits)
    data = np.frombuffer(b"".join(s + bytes(4) for s in streams), np.uint8)
    nbytes = np.fromiter(map(len, streams), np.int64, len(streams))
    base = (np.cumsum(nbytes + 4) - nbytes - 4) * 8
    most = np.minimum(np.searchsorted(offset, nbytes * 8 - low_bits - 1, "right") - 1, _TABLE)
    most = np.maximum(most, 0)
    begin = np.cumsum(most) - most
    own = np.repeat(np.arange(len(streams)), most)
    at = np.arange(len(own)) - begin[own]
    pos = base[own] + low_bits + 1 + offset[at]
    byte = pos >> 3
    word = data[byte].astype(np.int64) | data[byte + 1].astype(np.int64) << 8 | data[byte + 2].astype(np.int64) << 16
    codes = (word >> (pos & 7)) & ((1 << width[at]) - 1)
    count = most.copy()
    ends = np.flatnonzero((codes == clear) | (codes == stop))
    first = ends[np.concatenate([np.ones(min(1, len(ends)), bool), own[ends][1:] != own[ends][:-1]])]
    count[own[first]] = at[first]
    head = (data[base >> 3].astype(np.int64) | data[np.minimum((base >> 3) + 1, len(data) - 1)].astype(np.int64) << 8) & ((1 << low_bits + 1) - 1)
    plain = (nbytes > 1) & (head == clear) & (most > 0) & (count < _TABLE - stop)
    plain[own[first[codes[first] == clear]]] = False
    ref_ok = (codes < clear) | ((codes > stop) & (codes - stop <= at))
    wrong = np.flatnonzero(~ref_ok & (at < count[own]))
    plain[own[wrong]] = False

    keep = (at < count[own]) & plain[own]
    c, n = codes[keep], np.where(plain, count, 0)
    start = np.repeat(np.cumsum(n) - n, n)
    literal = c < clear
    ref = np.where(literal, np.arange(len(c)), start + c - stop - 1)
    depth, root = (~literal).astype(np.int64), ref
    while not literal[root].all():
        depth += depth[root]
        root = root[root]
    length, initial = depth + 1, c[root].astype(np.uint8)
    end = np.cumsum(length)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    live, to = np.arange(len(c)), end - length
    while len(live):
        plain_now = literal[live]
        out[to[plain_now]] = c[live[plain_now]]
        live, to = live[~plain_now], to[~plain_now]
        out[to + length[live] - 1] = initial[ref[live] + 1]
        live = ref[live]
    raw = out.tobytes()
    total = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(n)), n), length, len(n)).astype(np.int64))]).tolist()
    return [raw[total[i] : total[i + 1]][:size] if plain[i] else lzw_decode(streams[i], low_bits, size) for i, size in enumerate(sizes)]


def lzw_decode(raw: bytes, low_bits: int, n_samples: int) -> bytes:
    """The samples of a code stream; at most n_samples."""
    data = np.frombuffer(raw + bytes(4), np.uint8)
    clear, stop = 1 << low_bits, (1 << low_bits) + 1
    width, offset = _widths(low_bits)
    base = [*_EIGHT[:clear], b"", b""]
    out, have, bit, done = [], 0, 0, False
    table, prev, count, chunk = base.copy(), None, 0, 1024
    while not done and have < n_samples:
        rest = _codes_from(data, low_bits, bit, count, chunk)
        if not len(rest):
            break
        special = np.flatnonzero((rest == clear) | (rest == stop))
        upto = int(special[0]) if len(special) else len(rest)
        for c in rest[:upto].tolist():
            if c < len(table):
                e = table[c]
            elif prev is not None and c == len(table):
                e = prev + prev[:1]
            else:
                raise ValueError("a code beyond the table")
            if prev is not None and len(table) < _TABLE:
                table.append(prev + e[:1])
            out.append(e)
            have += len(e)
            prev = e
        at = lambda k: int(offset[k]) if k < len(offset) else int(offset[-1]) + 12 * (k - len(offset) + 1)
        bit += at(count + upto) - at(count)
        count += upto
        if upto < len(rest):
            if rest[upto] == stop:
                done = True
            else:
                bit += int(width[count]) if count < len(width) else 12
                table, prev, count = base.copy(), None, 0
    return b"".join(out)[:n_samples]


def _codes_from(data: np.ndarray, low_bits: int, bit: int, count: int, most: int) -> np.ndarray:
    """Up to most codes from a bit position on, the first of which is the count-th after a clear code."""
    width, offset = _widths(low_bits)
    k = np.minimum(np.arange(count, count + most + 1), len(width) - 1)
    w = width[k]
    pos = bit + np.concatenate([[0], np.cumsum(w[:-1])])
    ok = pos[:-1] + w[:-1] <= (len(data) - 4) * 8
    pos, w = pos[:-1][ok], w[:-1][ok]
    at = pos >> 3
    word = data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8 | data[at + 2].astype(np.int64) << 16
    return (word >> (pos & 7)) & ((1 << w) - 1)


def _blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while raw[at]:
        parts.append(raw[at + 1 : at + 1 + raw[at]])
        at += 1 + raw[at]
    return b"".join(parts), at + 1


def decode(raw: bytes) -> tuple[int, int, list[tuple[int, np.ndarray]]]:
    """As shown_in(), all frames at once."""
    width, height, shown = shown_in(raw)
    return width, height, list(shown)


def shown_in(raw: bytes) -> tuple[int, int, Iterator[tuple[int, np.ndarray]]]:
    """Width, height, and for each frame its delay in ms and the canvas shown (height x width x RGBA). Frames are decoded some
    at a time as they are taken, so that memory doesn't follow their number."""
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", raw[6:13])
    at, shared = 13, None
    colours = lambda a, f: np.frombuffer(raw[a : a + 3 * (2 << (f & 7))], np.uint8).reshape(-1, 3)
    if flags & 0x80:
        shared = colours(at, flags)
        at += 3 * (2 << (flags & 7))
    drawn: list[tuple] = []
    delay, disposal, clear_index = 0, 0, None
    while at < len(raw) and raw[at] != 0x3B:
        kind = raw[at]
        if kind == 0x21:
            label = raw[at + 1]
            body, at = _blocks(raw, at + 2)
            if label == 0xF9:
                disposal, delay = body[0] >> 2 & 7, struct.unpack("<H", body[1:3])[0] * 10
                clear_index = body[3] if body[0] & 1 else None
        elif kind == 0x2C:
            x, y, w, h, f = struct.unpack("<HHHHB", raw[at + 1 : at + 10])
            at += 10
            palette = shared
            if f & 0x80:
                palette = colours(at, f)
                at += 3 * (2 << (f & 7))
            low_bits = raw[at]
            data, at = _blocks(raw, at + 1)
            if palette is None or not 2 <= low_bits <= 8:
                raise ValueError("no palette, or a bad code size")
            drawn.append((x, y, w, h, bool(f & 0x40), palette, low_bits, data, delay, disposal, clear_index))
            delay, disposal, clear_index = 0, 0, None
        else:
            raise ValueError("a block of no known kind")
    return width, height, _shown(width, height, drawn)


def _samples(drawn: list[tuple]) -> Iterator[bytes]:
    for a in range(0, len(drawn), FRAMES_HELD):
        part = drawn[a : a + FRAMES_HELD]
        samples = [b""] * len(part)
        for low_bits in {d[6] for d in part}:
            here = [i for i, d in enumerate(part) if d[6] == low_bits]
            for i, got in zip(here, lzw_decode_all([part[i][7] for i in here], low_bits, [part[i][2] * part[i][3] for i in here]), strict=True):
                samples[i] = got
        yield from samples


def _shown(width: int, height: int, drawn: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
    """The canvas after each image, under disposal and transparency."""
    canvas = np.zeros((height, width, 4), np.uint8)
    last, full = None, np.zeros((256, 4), np.uint8)
    for (x, y, w, h, woven, palette, _, _, delay, disposal, clear_index), got in zip(drawn, _samples(drawn), strict=True):
        index = np.frombuffer(got.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if woven:
            rows = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(index)
            straight[rows] = index
            index = straight
        if palette is not last:
            last, full = palette, np.zeros((256, 4), np.uint8)
            full[: len(palette), :3], full[:, 3] = palette, 255
        before = canvas.copy() if disposal == 3 else None
        here = canvas[y : y + h, x : x + w]
        index = index[: here.shape[0], : here.shape[1]]
        if clear_index is None:
            here[:] = full[index]
        else:
            solid = index != clear_index
            here[solid] = full[index[solid]]
        yield delay, canvas.copy()
        if disposal == 2:
            here[:] = 0
        elif disposal == 3:
            canvas = before


def histogram(canvas: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Pixels by brightness of red, green and blue, bins for each; transparent pixels aren't counted."""
    seen = canvas[canvas[..., 3] > 0]
    step = 256 // bins
    return np.concatenate([np.bincount(seen[:, c] // step, minlength=bins) for c in range(3)])


def payload(text: str | bytes | None) -> bytes:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw + b"\xff" * (-len(raw) % FRAME_BYTES if raw else FRAME_BYTES)


def from_text(text: str | None) -> bytes:
    """The GIF that stores a text."""
    p = payload(text)
    return encode([p[a : a + FRAME_BYTES] for a in range(0, len(p), FRAME_BYTES)], SIDE, SIDE)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media (the GIF of each text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(from_text, part.column("text").to_pylist()), pa.binary())], ["doc_id", "media"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, media binary")


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each frame: doc_id, frame, start_ms, delay_ms, width, height, rgb (pixels shown), histogram (reds, greens,
    blues), error. A broken image gives one row with the error; a null one none."""
    kind = [("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("rgb", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                if raw is None:
                    continue
                rows, start = [], 0
                try:
                    w, h, shown = shown_in(raw)
                    for i, (delay, canvas) in enumerate(shown):
                        rows.append((i, start, delay, w, h, canvas[..., :3].tobytes(), histogram(canvas).tolist(), None))
                        start += delay
                except (ValueError, IndexError, struct.error) as e:
                    rows = [(None,) * 7 + (str(e) or "cut short",)]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.int64()), *(pa.array(c, t) for c, (_, t) in zip(cols, kind, strict=True))], ["doc_id", *(n for n, _ in kind)])

    rows = media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(run, "doc_id long, frame int, start_ms long, delay_ms int, width int, height int, rgb binary, histogram array<long>, error string")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What identifies each text's stored and decoded form: doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32
    (of the payload read back from the GIF), media_bytes, media_sha256, feature (frames, ms, and the grey histogram)."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def one(text: str | None) -> tuple:
        media = from_text(text)
        _, _, shown = shown_in(media)
        n, ms, size, whole, tail, grey = 0, 0, 0, hashlib.sha256(), b"", np.zeros(BINS, np.int64)
        while some := list(islice(shown, FRAMES_HELD)):
            back = b"".join(c[..., 0].tobytes() for _, c in some)
            n, ms, size, tail = n + len(some), ms + sum(d for d, _ in some), size + len(back), (tail + back)[-32:]
            whole.update(back)
            grey += np.bincount(np.frombuffer(back, np.uint8) // (256 // BINS), minlength=BINS)
        feature = f"frames={n};ms={ms};grey={','.join(map(str, grey))}"
        return len((text or "").encode()), size, whole.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for part in slices(batches):
            cols = zip(*map(one, part.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", *names])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
