"""Lossless WebP: exact round trips, and transforms that the encoder doesn't choose against scalar code."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quillon.llm import media, webp

SHAPES = [b"", b"a", b"a" * 5000, b"abcd" * 3000, b"And " * 900, bytes(range(256)) * 20, bytes(range(3)) * 4000, bytes([7, 9]) * 100]


def padded(raw):
    return raw + b" " * (-len(raw) % 192 if raw else 192)


def test_round_trips():
    rng = random.Random(3)
    noise = [rng.randbytes(rng.randrange(20_000)) for _ in range(6)]
    ramps = [bytes((i // 7 + rng.randrange(2)) & 255 for i in range(6000)), b"".join(bytes([i & 255, i & 255, i & 255, 255]) for i in range(5000))]
    payloads = [padded(x) for x in [*SHAPES, *noise, *ramps, b"word and other words, " * 800 + noise[0]]]
    files = webp.write_files(payloads)
    for p, px in zip(payloads, webp.read_files(files), strict=True):
        assert px.astype("<u4").tobytes() == p
    assert len(files[2]) < 400 and files[2][:4] == b"RIFF"
    assert len(webp.frames(files[5])) == -(-len(payloads[5]) // (192 * webp.ROWS))


def scalar_prediction(mode, left, top, corner, right):
    def ch(v):
        return [v >> s & 255 for s in (0, 8, 16, 24)]

    def pack(c):
        return sum(max(0, min(255, v)) << 8 * i for i, v in enumerate(c))

    def avg(a, b):
        return pack([(x + y) // 2 for x, y in zip(ch(a), ch(b), strict=True)])

    if mode == 11:
        guess = [a + b - c for a, b, c in zip(ch(left), ch(top), ch(corner), strict=True)]
        dl = sum(abs(g - x) for g, x in zip(guess, ch(left), strict=True))
        dt = sum(abs(g - x) for g, x in zip(guess, ch(top), strict=True))
        return left if dl < dt else top
    if mode == 12:
        return pack([a + b - c for a, b, c in zip(ch(left), ch(top), ch(corner), strict=True)])
    if mode == 13:
        m = ch(avg(left, top))
        return pack([a + int((a - c) / 2) for a, c in zip(m, ch(corner), strict=True)])
    return [
        0xFF000000, left, top, right, corner, avg(avg(left, right), top), avg(left, corner), avg(left, top), avg(corner, top), avg(top, right), avg(avg(left, corner), avg(top, right))
    ][mode]


def stream(w, h, bits, kind, blocks, px):
    one = np.array([0])
    head = webp.Section.rows(one, 1, (0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3), (1, 1), (kind, 2), (bits - 2, 3))
    stop = webp.Section.rows(one, 1, (0, 1))
    parts = [head, *webp._image_sections(blocks, np.array([len(blocks)]), np.array([w]), False), stop, *webp._image_sections(px, np.array([len(px)]), np.array([w]), True)]
    return webp.write(parts, 1)[0]


@pytest.mark.parametrize("seed", range(3))
def test_all_predictors(seed):
    rng = np.random.default_rng(seed)
    w, h, bits = 13 + seed, 11, 2
    bw, bh = w + 3 >> 2, h + 3 >> 2
    modes = rng.permutation(np.resize(np.arange(14), bw * bh))
    px = rng.integers(0, 1 << 32, w * h, dtype=np.uint32) & np.uint32(0x3F0F7FFF)
    left_over = np.zeros_like(px)
    for i in range(w * h):
        y, x = divmod(i, w)
        if not i:
            p = 0xFF000000
        elif not y:
            p = int(px[i - 1])
        elif not x:
            p = int(px[i - w])
        else:
            p = scalar_prediction(int(modes[(y >> bits) * bw + (x >> bits)]), int(px[i - 1]), int(px[i - w]), int(px[i - w - 1]), int(px[i - w + 1]))
        left_over[i] = sum(((int(px[i]) >> s) - (p >> s) & 255) << s for s in (0, 8, 16, 24))
    got = webp.decode([stream(w, h, bits, webp.PREDICTOR, (modes << 8).astype(np.uint32), left_over)])[0]
    assert got[:2] == (w, h) and (got[2] == px).all()


def test_cross_colour():
    rng = np.random.default_rng(9)
    w, h, bits = 10, 9, 2
    bw, bh = w + 3 >> 2, h + 3 >> 2
    elements = rng.integers(0, 1 << 24, bw * bh, dtype=np.uint32)
    px = rng.integers(0, 1 << 32, w * h, dtype=np.uint32)

    def signed(v):
        return (v & 255) - 256 * ((v & 255) > 127)

    stored = np.zeros_like(px)
    for i, v in enumerate(px.tolist()):
        y, x = divmod(i, w)
        e = int(elements[(y >> bits) * bw + (x >> bits)])
        r, g, b = v >> 16 & 255, v >> 8 & 255, v & 255
        blue = b - (signed(e >> 8) * signed(g) >> 5) - (signed(e >> 16) * signed(r) >> 5)
        red = r - (signed(e) * signed(g) >> 5)
        stored[i] = v & 0xFF00FF00 | (red & 255) << 16 | blue & 255
    assert (webp.decode([stream(w, h, bits, webp.CROSS_COLOUR, elements, stored)])[0][2] == px).all()


def test_broken_streams_are_refused():
    good = webp.frames(webp.write_files([padded(b"some text " * 50)])[0])[0]
    for bad in (b"\0" + good[1:], good[: len(good) // 2]):
        with pytest.raises(ValueError):
            webp.decode([bad])


def test_query(spark):
    texts = [None, "", "x", "x", "é日🎉" * 3000, *(s.decode("latin-1") for s in SHAPES)]
    df = spark.createDataFrame([(i, t, b"") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    rows = {r.doc_id: r for r in media.digest(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        p = padded((t or "").encode())
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len((t or "").encode()), len(p))
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-16:])
    assert rows[2][1:] == rows[3][1:] and media.digest(df.limit(0)).count() == 0
    stored = media.store(df).orderBy("doc_id").collect()
    assert all(hashlib.sha256(bytes(s.media)).hexdigest() == rows[s.doc_id].media_sha256 for s in stored)
    loaded = media.load(media.store(df.filter("doc_id = 2"))).first()
    assert np.array(loaded.pixels, "<u4").tobytes() == padded(b"x")


class Bits:
    """A stream written bit by bit, the lowest of each byte first, by no code of the encoder."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]
        return self

    def one(self, symbol):
        """A prefix code of one symbol, which takes no bits."""
        return self.put(1, 1).put(0, 1).put(1, 1).put(symbol, 8)

    def two(self, a, b):
        """A prefix code of two symbols, a as 0 and b as 1."""
        return self.put(1, 1).put(1, 1).put(1, 1).put(a, 8).put(b, 8)

    def head(self, w, h):
        return self.put(0x2F, 8).put(w - 1, 14).put(h - 1, 14).put(1, 1).put(0, 3).put(0, 1)

    def bytes(self):
        padded = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(sum(b << i for i, b in enumerate(padded[k : k + 8])) for k in range(0, len(padded), 8))


def test_a_stream_with_meta_prefix_codes():
    rng = random.Random(5)
    w, h = 8, 6
    s = Bits().head(w, h).put(0, 1).put(1, 1).put(0, 3)  # no colour cache; blocks of four by four pixels
    s.put(0, 1).two(0, 1).one(0).one(0).one(255).one(0)  # the image of groups: green is the group
    groups = [0, 1, 1, 0]
    for g in groups:
        s.put(g, 1)
    s.two(10, 200).one(1).one(2).one(255).one(0)
    s.two(3, 4).two(7, 9).one(5).two(128, 129).one(0)
    want = []
    for y in range(h):
        for x in range(w):
            a, b, c = (rng.randrange(2) for _ in range(3))
            s.put(a, 1)
            if groups[y // 4 * 2 + x // 4]:
                s.put(b, 1).put(c, 1)
                want.append((128, 129)[c] << 24 | (7, 9)[b] << 16 | (3, 4)[a] << 8 | 5)
            else:
                want.append(255 << 24 | 1 << 16 | (10, 200)[a] << 8 | 2)
    ((got_w, got_h, px),) = webp.decode([s.bytes()])
    assert (got_w, got_h) == (w, h)
    assert np.asarray(px).ravel().tolist() == want


@pytest.mark.parametrize("bits", [1, 3])
def test_a_stream_with_a_colour_cache(bits):
    rng = random.Random(bits)
    colours = [255 << 24 | r << 16 | 10 << 8 | 2 for r in (1, 200)]

    def place(c):
        return (0x1E35A7BD * c & 0xFFFFFFFF) >> 32 - bits

    cached = place(colours[0])
    s = Bits().head(64, 1).put(1, 1).put(bits, 4).put(0, 1)
    # green: the literal 10 and one place of the cache, by lengths of codes: 17 and 18 are runs of zeros
    s.put(0, 1).put(0, 4)
    for _ in (17, 18, 0, 1):
        s.put(2, 3)
    s.put(0, 1)
    word = {0: (0, 0), 1: (0, 1), 17: (1, 0), 18: (1, 1)}

    def length(symbol):
        s.put(word[symbol][0], 1).put(word[symbol][1], 1)

    def zeros(n):
        while n:
            k = min(n, 138)
            if k >= 11:
                length(18)
                s.put(k - 11, 7)
            elif k >= 3:
                length(17)
                s.put(k - 3, 3)
            else:
                k = 1
                length(0)
            n -= k

    zeros(10)
    length(1)
    zeros(280 + cached - 11)
    length(1)
    zeros((1 << bits) - cached - 1)
    s.two(1, 200).one(2).one(255).one(0)
    cache, want = {}, []
    for i in range(64):
        if i and rng.randrange(2):
            s.put(1, 1)
            c = cache[cached]
        else:
            r = rng.randrange(2) if i else 0
            s.put(0, 1).put(r, 1)
            c = colours[r]
        cache[place(c)] = c
        want.append(c)
    ((_, _, px),) = webp.decode([s.bytes()])
    assert np.asarray(px).ravel().tolist() == want


def test_the_encoder_writes_a_colour_cache():
    rng = random.Random(9)
    colours = np.array([rng.getrandbits(32) for _ in range(700)], np.uint32)
    px = colours[[int(rng.paretovariate(1.1)) % 700 for _ in range(6400)]]
    sections = webp._image_sections(px, np.array([len(px)]), np.array([64]), True)
    assert sections[0].values[0] == 1  # the flag of a cache
    head = webp.Section.rows(np.array([0]), 1, (0x2F, 8), (63, 14), (99, 14), (1, 1), (0, 3), (0, 1))
    ((_, _, got),) = webp.decode(webp.write([head, *sections], 1))
    assert np.asarray(got).ravel().tolist() == px.tolist()
