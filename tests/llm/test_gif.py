import hashlib
import random
import struct
import zlib

import numpy as np

from assayer.llm import gif


def slow_codes(raw, low_bits):
    """Reads codes bit by bit and decodes them plainly."""
    bits = [(b >> i) & 1 for b in raw for i in range(8)]
    clear, stop = 1 << low_bits, (1 << low_bits) + 1
    table, width, at, prev, out = {}, low_bits + 1, 0, None, []
    while at + width <= len(bits):
        c = sum(bits[at + i] << i for i in range(width))
        at += width
        if c == clear:
            table, width, prev = {i: [i] for i in range(clear)} | {clear: [], stop: []}, low_bits + 1, None
            continue
        if c == stop:
            break
        e = table[c] if c in table else prev + prev[:1]
        if prev is not None and len(table) < 4096:
            table[len(table)] = prev + e[:1]
        if len(table) == 1 << width and width < 12:
            width += 1
        out += e
        prev = e
    return bytes(out)


def slow_encode(samples, low_bits):
    """LZW with growing widths, left full for a while, then cleared."""
    clear, bits, full_for = 1 << low_bits, [], 0
    put = lambda c, w: bits.extend((c >> i) & 1 for i in range(w))
    fresh = lambda: ({(i,): i for i in range(clear)}, clear + 2, low_bits + 1)
    table, free, width = fresh()
    put(clear, width)
    w = ()
    for s in samples:
        if (*w, s) in table:
            w = (*w, s)
            continue
        put(table[w], width)
        if free < 4096:
            table[(*w, s)] = free
            if free == 1 << width and width < 12:
                width += 1
            free += 1
        else:
            full_for += 1
            if full_for == 50:
                put(clear, width)
                (table, free, width), full_for = fresh(), 0
        w = (s,)
    put(table[w], width)
    # the reader has one entry less than the writer, so the end code's width follows the reader's table
    put(clear + 1, min(12, width + (free == 1 << width and width < 12)))
    bits += [0] * (-len(bits) % 8)
    return bytes(sum(bits[a + i] << i for i in range(8)) for a in range(0, len(bits), 8))


def test_streams():
    rnd = random.Random(1)
    for low_bits, n, kinds in ((8, 576, 256), (8, 30_000, 256), (2, 20_000, 4), (4, 9000, 3), (8, 60_000, 2)):
        s = bytes(rnd.randrange(kinds) for _ in range(n))
        raw = slow_encode(s, low_bits)
        assert slow_codes(raw, low_bits) == s
        assert gif.lzw_decode(raw, low_bits, n) == s
        assert gif.lzw_decode_all([raw, raw[:50], b"", raw], low_bits, [n, 10, 5, 7]) == [s, gif.lzw_decode(raw[:50], low_bits, 10), b"", s[:7]]


def test_round_trip():
    rnd = random.Random(2)
    for n in (0, 1, 575, 576, 577, 20_000):
        t = "".join(rnd.choice("abé \n") for _ in range(n))
        p = gif.payload(t)
        assert len(p) % 576 == 0 and p.startswith(t.encode()) and len(p) > 0
        w, h, shown = gif.decode(gif.from_text(t))
        assert (w, h) == (24, 24) and b"".join(c[..., 0].tobytes() for _, c in shown) == p
    body, _ = gif._blocks(gif.from_text("abc" * 50), gif.from_text("abc" * 50).index(b"\x2c\x00\x00\x00\x00") + 11)
    assert slow_codes(body, 8) == gif.payload("abc" * 50)


def image(w, h, samples, at=(0, 0), palette=None, control=None, interlace=False):
    out = b"" if control is None else b"\x21\xf9\x04" + bytes([control[0] << 2 | (control[1] is not None)]) + struct.pack("<H", control[2]) + bytes([control[1] or 0, 0])
    out += b"\x2c" + struct.pack("<HHHHB", *at, w, h, (0x80 | 1 if palette else 0) | (0x40 if interlace else 0)) + (palette or b"")
    data = slow_encode(samples, 2)
    return out + b"\x02" + b"".join(bytes([len(data[a : a + 255])]) + data[a : a + 255] for a in range(0, len(data), 255)) + b"\x00"


def test_rules_of_frames():
    shared = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    own = bytes([9, 9, 9, 8, 8, 8, 7, 7, 7, 6, 6, 6])
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + shared
    raw = head + image(2, 2, bytes([1, 1, 1, 1]), control=(1, None, 10)) + image(1, 1, bytes([2]), (1, 1), control=(3, None, 5)) + image(2, 1, bytes([0, 3]), (0, 0), control=(2, 0, 7)) + image(1, 1, bytes([1]), (0, 1), own) + b"\x3b"
    w, h, f = gif.decode(raw)
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert [d for d, _ in f] == [100, 50, 70, 0]
    assert [c.tolist() for _, c in f] == [[[red, red], [red, red]], [[red, red], [red, green]], [[red, blue], [red, red]], [[none, none], [[8, 8, 8, 255], red]]]
    rows = bytes([0, 1, 2, 3, 1, 2, 3, 0, 1, 2])
    tall = b"GIF87a" + struct.pack("<HHBBB", 1, 10, 0x81, 0, 0) + shared
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    plain = gif.decode(tall + image(1, 10, rows) + b"\x3b")[2][0][1]
    woven = gif.decode(tall + image(1, 10, bytes(rows[i] for i in order), interlace=True) + b"\x3b")[2][0][1]
    assert np.array_equal(plain, woven)


def test_frames_and_report(spark):
    df = spark.createDataFrame([(1, "abc", 1), (2, None, 2), (2, "", 3), (3, "x" * 3000, 4)], "doc_id long, text string, media int")
    got = {(r.doc_id, r.n_bytes): r for r in gif.report(df).collect()}
    p = b"abc" + b"\xff" * 573
    r = got[1, 3]
    assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (576, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert len(got) == 3 and got[3, 3000].payload_bytes == 3456
    f = gif.frames(gif.store(df)).collect()
    assert sorted((x.doc_id, x.frame, x.start_ms) for x in f) == sorted([(1, 0, 0), (2, 0, 0), (2, 0, 0), *((3, i, 40 * i) for i in range(6))])
    assert all(sum(x.histogram) == 3 * 576 for x in f)
    bad = spark.createDataFrame([(1, bytearray(b"no")), (2, None), (3, bytearray(gif.from_text("a")[:-40]))], "doc_id long, media binary")
    assert [x.error is not None for x in gif.frames(bad).collect()] == [True, True]
    assert gif.report(df.limit(0)).count() == 0


def test_very_long_text(spark, monkeypatch):
    t = "".join(chr(97 + i * i % 23) for i in range(1_500_000))
    p = t.encode() + b"\xff" * (-len(t) % 576)
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    want = gif.report(df).first()
    assert (want.n_bytes, want.payload_bytes, want.payload_sha256, want.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert want.feature.startswith(f"frames={len(p) // 576};ms={40 * (len(p) // 576)};grey=0,0,0,{len(t)},0,0,0,{len(p) - len(t)}")
    assert len(list(gif.shown_in(gif.from_text(t))[2])) == len(p) // 576 > 2 * gif.FRAMES_HELD
