"""Lossless WebP (VP8L): a decoder that takes many images a step at a time, and an encoder for byte payloads.

The decoder reads prefix codes (simple and normal, with meta prefix codes), back-references and the colour cache, and inverts the predictor, cross-colour, subtract-green and palette transforms. All images of a batch advance together, one pixel a step, so the work is in array operations. Pixels are 32-bit ARGB.

The encoder stores a byte payload as pixels of four bytes, WIDTH to a row, and picks for each image what its counts say is shortest: nothing, subtract green, cross-colour, a predictor, or a palette; then back-references, a colour cache where it is hit often, and prefix codes. Payloads of more than ROWS rows become frames of an animation, so no image is large.
"""

from __future__ import annotations

import struct

import numpy as np

WIDTH, ROWS = 48, 64
CACHE_BITS = 6

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
#: (columns to the left, rows up) of the distance codes 1 to 120.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)

_RB, _AG = np.uint32(0x00FF00FF), np.uint32(0xFF00FF00)
_reversed: dict[int, np.ndarray] = {}


def reversed_bits(n: int) -> np.ndarray:
    if n not in _reversed:
        v, out = np.arange(1 << n), np.zeros(1 << n, np.int64)
        for i in range(n):
            out |= (v >> i & 1) << (n - 1 - i)
        _reversed[n] = out
    return _reversed[n]


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of the four bytes, each modulo 256."""
    return (((a & _AG) + (b & _AG)) & _AG) | (((a & _RB) + (b & _RB)) & _RB)


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (((a | _RB) - (b & _AG)) & _AG) | (((a | _AG) - (b & _RB)) & _RB)


def half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (((a ^ b) & np.uint32(0xFEFEFEFE)) >> np.uint32(1)) + (a & b)


def channels(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a, np.uint32).view(np.uint8).reshape(*a.shape, 4).astype(np.int32)


def packed(c: np.ndarray) -> np.ndarray:
    return np.clip(c, 0, 255).astype(np.uint8).view(np.uint32)[..., 0]


def predicted(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Predictions of one mode from the pixels to the left, above, above left and above right."""
    if mode in (0, 14, 15):
        return np.full_like(left, 0xFF000000)
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return half(half(left, right), top)
    if mode <= 9:
        a, b = ((left, corner), (left, top), (corner, top), (top, right))[mode - 6]
        return half(a, b)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    lc, tc, cc = channels(left), channels(top), channels(corner)
    if mode == 11:  # the neighbour nearer to left + top - corner
        return np.where(np.abs(tc - cc).sum(-1) < np.abs(lc - cc).sum(-1), left, top)
    if mode == 12:
        return packed(lc + tc - cc)
    avg = lc + tc >> 1
    d = avg - cc
    return packed(avg + np.where(d < 0, -(-d // 2), d // 2))


def delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Product of two signed bytes over 32."""
    return (t.astype(np.uint8).view(np.int8).astype(np.int32) * c.astype(np.uint8).view(np.int8).astype(np.int32)) >> 5


# ---- reading ----


class Reader:
    """Bit positions in one buffer, one for each image."""

    def __init__(self, streams: list[bytes]):
        gap = b"\0" * 16
        data = np.frombuffer(b"".join(x for s in streams for x in (s, gap)) + gap, np.uint8)
        self.words = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 8,), (1,))
        size = np.array([len(s) for s in streams], np.int64)
        self.pos = 8 * (np.cumsum(size + 16) - (size + 16))
        self.end = self.pos + 8 * size

    def peek(self, i: np.ndarray) -> np.ndarray:
        p = np.minimum(self.pos[i], self.end[i])
        return self.words[p >> 3] >> (p & 7).astype(np.uint64)

    def read(self, i: np.ndarray, n) -> np.ndarray:
        n = np.asarray(n)
        v = self.peek(i) & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))
        self.pos[i] += n
        return v.astype(np.int64)


class Table:
    """Prefix codes of rows of code lengths, indexed by the next bits: symbol << 4 | length."""

    def __init__(self, lengths: np.ndarray, single: np.ndarray):
        n = len(lengths)
        used = np.count_nonzero(lengths, 1)
        single = np.where((single < 0) & (used == 1), lengths.argmax(1), single)
        single = np.where((single < 0) & (used == 0), 0, single)
        self.bits = max(1, int(lengths.max(initial=1)))
        row, sym = np.nonzero(lengths * (single < 0)[:, None])
        length = lengths[row, sym].astype(np.int64)
        one = np.flatnonzero(single >= 0)
        row, sym, length = np.concatenate([row, one]), np.concatenate([sym, single[one]]), np.concatenate([length, np.zeros(len(one), np.int64)])
        order = np.lexsort((sym, length, row))
        row, sym, length = row[order], sym[order], length[order]
        run = 1 << (self.bits - length)
        if (np.bincount(row, run, n) != 1 << self.bits).any():
            raise ValueError("a prefix code isn't complete")
        self.entries = np.repeat((sym << 4 | length).astype(np.uint16), run)
        self.reverse = reversed_bits(self.bits)
        self.mask = np.uint64((1 << self.bits) - 1)

    def look(self, row: np.ndarray, bits: np.ndarray) -> np.ndarray:
        return self.entries.take((row << self.bits) + self.reverse.take((bits & self.mask).astype(np.int64))).astype(np.int32)


def read_code(r: Reader, i: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code lengths, the only symbol or -1) of one prefix code of each image; size: of its alphabet."""
    lengths, single = np.zeros((len(i), int(size.max())), np.int64), np.full(len(i), -1)
    simple = r.read(i, 1) == 1
    s = np.flatnonzero(simple)
    if len(s):
        two, wide = r.read(i[s], 1) == 1, r.read(i[s], 1)
        a = r.read(i[s], 1 + 7 * wide)
        single[s[~two]] = a[~two]
        b = r.read(i[s[two]], 8)
        lengths[s[two], a[two]] = 1
        lengths[s[two], b] = 1
    s = np.flatnonzero(~simple)
    if not len(s):
        return lengths, single
    k = i[s]
    n = 4 + r.read(k, 4)
    own = np.zeros((len(s), 19), np.int64)
    for j, sym in enumerate(CODE_LENGTH_ORDER):
        some = np.flatnonzero(n > j)
        own[some, sym] = r.read(k[some], 3)
    table = Table(own, np.full(len(s), -1))
    left = size[s].copy()
    some = np.flatnonzero(r.read(k, 1) == 1)
    left[some] = 2 + r.read(k[some], 2 + 2 * r.read(k[some], 3))
    at, before = np.zeros(len(s), np.int64), np.full(len(s), 8)
    live = np.arange(len(s))
    while len(live):
        e = table.look(live, r.peek(k[live]))
        r.pos[k[live]] += e & 15
        sym = (e >> 4).astype(np.int64)
        left[live] -= 1
        plain = sym < 16
        p = live[plain]
        lengths[s[p], at[p]] = sym[plain]
        before[p] = np.where(sym[plain] > 0, sym[plain], before[p])
        at[p] += 1
        for code, bits, base in ((16, 2, 3), (17, 3, 3), (18, 7, 11)):
            q = live[sym == code]
            if len(q):
                n = base + r.read(k[q], bits)
                if (at[q] + n > size[s[q]]).any():
                    raise ValueError("a run of code lengths leaves its alphabet")
                for d in range(int(n.max()) if code == 16 else 0):
                    t = q[n > d]
                    lengths[s[t], at[t] + d] = before[t]
                at[q] += n
        live = live[(at[live] < size[s[live]]) & (left[live] > 0)]
    return lengths, single


def prefix_value(r: Reader, i: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A length or distance from its prefix code."""
    extra = np.maximum(code - 2 >> 1, 0) * (code >= 4)
    return np.where(code < 4, code, (2 + (code & 1)) << extra) + r.read(i, extra) + 1


def read_image(r: Reader, i: np.ndarray, w: np.ndarray, h: np.ndarray, main: bool) -> np.ndarray:
    """Pixels (step, image) of an entropy-coded image of each of the images i."""
    n = len(i)
    bits = np.zeros(n, np.int64)
    some = np.flatnonzero(r.read(i, 1) == 1)
    bits[some] = r.read(i[some], 4)
    if len(some) and ((bits[some] < 1) | (bits[some] > 11)).any():
        raise ValueError("a colour cache of an unknown size")
    groups, meta, meta_bits, meta_w = np.ones(n, np.int64), None, np.zeros(n, np.int64), np.ones(n, np.int64)
    if main:
        some = np.flatnonzero(r.read(i, 1) == 1)
        if len(some):
            meta_bits[some] = r.read(i[some], 3) + 2
            side = (1 << meta_bits[some]) - 1
            mw, mh = w[some] + side >> meta_bits[some], h[some] + side >> meta_bits[some]
            pixels = read_image(r, i[some], mw, mh, False).astype(np.int64) >> 8 & 0xFFFF
            meta = np.zeros((len(pixels), n), np.int64)
            meta[:, some] = pixels
            meta_w[some] = mw
            groups[some] = pixels.max(0) + 1
    first = np.cumsum(groups) - groups
    sizes = (280 + np.where(bits > 0, 1 << bits, 0), *[np.full(n, 256)] * 3, np.full(n, 40))
    total = int(groups.sum())
    lengths = [np.zeros((total, int(s.max())), np.int64) for s in sizes]
    single = [np.full(total, -1) for _ in sizes]
    for g in range(int(groups.max())):
        some = np.flatnonzero(groups > g)
        for j, s in enumerate(sizes):
            a, b = read_code(r, i[some], s[some])
            lengths[j][first[some] + g, : a.shape[1]] = a
            single[j][first[some] + g] = b
    green, red, blue, alpha, far = (Table(a, b) for a, b in zip(lengths, single, strict=True))
    # images with most pixels first: those with pixels left are a prefix
    px = w * h
    order = np.argsort(-px, kind="stable")
    left = px[order]
    out = np.zeros((int(left[0]), n), np.uint32)
    k, ow = i[order], w[order]
    pos, row0 = r.pos[k], first[order]
    end, words = r.end[k], r.words
    rem, dist = np.zeros(n, np.int64), np.zeros(n, np.int64)
    obits = bits[order]
    cached = bool(obits.any())
    cache = np.zeros((n, 1 << int(obits.max())), np.uint32) if cached else None
    shift = (32 - np.maximum(obits, 1)).astype(np.uint32)
    place = np.arange(n)
    steps, copying = np.searchsorted(-left, -np.arange(len(out)), "left"), 0
    for step, active in enumerate(steps.tolist()):
        p = pos[:active]
        at = np.minimum(p, end[:active])
        v = words[at >> 3] >> (at & 7).astype(np.uint64)
        row = row0[:active]
        if meta is not None:
            y, x = np.divmod(step, ow[:active])
            o = order[:active]
            row = row + meta[(y >> meta_bits[o]) * meta_w[o] + (x >> meta_bits[o]), o]
        g = green.look(row, v)
        used = g & 15
        sym = g >> 4
        v = v >> used.astype(np.uint64)
        c = red.look(row, v)
        colour = c >> 4 << 16
        n_lit = used + (c & 15)
        v = v >> (c & 15).astype(np.uint64)
        c = blue.look(row, v)
        colour |= c >> 4
        n_lit += c & 15
        v = v >> (c & 15).astype(np.uint64)
        c = alpha.look(row, v)
        n_lit += c & 15
        argb = (colour | sym << 8).astype(np.uint32) | (c >> 4).astype(np.uint32) << np.uint32(24)
        literal = sym < 256
        busy = None
        if copying:
            busy = rem[:active] > 0
            literal &= ~busy
        if literal.all():
            p += n_lit
        else:
            p += np.where(literal, n_lit, 0)
            odd = np.flatnonzero(~literal if busy is None else ~literal & ~busy)
            if len(odd):
                p[odd] += used[odd]
                hit = odd[sym[odd] >= 280]
                if len(hit):
                    argb[hit] = cache[hit, sym[hit] - 280]
                new = odd[sym[odd] < 280]
                if len(new):
                    r.pos[k[new]] = p[new]
                    n_copy = prefix_value(r, k[new], sym[new].astype(np.int64) - 256)
                    e = far.look(row[new], r.peek(k[new]))
                    r.pos[k[new]] += e & 15
                    d = prefix_value(r, k[new], (e >> 4).astype(np.int64))
                    near = np.array(NEAR)[np.minimum(d, 120) - 1]
                    d = np.where(d > 120, d - 120, np.maximum(near[:, 0] + near[:, 1] * ow[new], 1))
                    if (d > step).any() or (n_copy > left[new] - step).any():
                        raise ValueError("a back-reference leaves the image")
                    rem[new], dist[new] = n_copy, d
                    p[new] = r.pos[k[new]]
                    copying += len(new)
                    busy = rem[:active] > 0
            if busy is not None:
                b = np.flatnonzero(busy)
                if len(b):
                    argb[b] = out[step - dist[b], b]
                    rem[b] -= 1
                    copying -= int((rem[b] == 0).sum())
        out[step, :active] = argb
        if cached:
            slot = (argb * np.uint32(CACHE_FACTOR)) >> shift[:active]
            cache[place[:active], np.where(obits[:active] > 0, slot, 0)] = argb
    r.pos[k] = pos
    if (pos > end).any():
        raise ValueError("an image ends early")
    back = np.empty_like(out)
    back[:, order] = out
    return back


def undo_predictor(px: np.ndarray, w: np.ndarray, h: np.ndarray, modes: np.ndarray, bits: np.ndarray) -> None:
    """px, modes: (step, image); in place."""
    n = px.shape[1]
    mw = w + (1 << bits) - 1 >> bits
    col = np.arange(n)
    for step in range(len(px)):
        y, x = np.divmod(step, w)
        live = step < w * h
        left = px[step - 1] if step else np.full(n, 0xFF000000, np.uint32)
        top = px[np.maximum(step - w, 0), col]
        corner = px[np.maximum(step - w - 1, 0), col]
        right = px[np.maximum(step - w + 1, 0), col]
        block = np.minimum((y >> bits) * mw + (x >> bits), len(modes) - 1)
        mode = (modes[block, col] >> np.uint32(8) & np.uint32(15)).astype(np.int64)
        mode = np.where(y == 0, np.where(x == 0, 0, 1), np.where(x == 0, 2, mode))
        for m in np.unique(mode[live]).tolist():
            s = np.flatnonzero(live & (mode == m))
            px[step, s] = add(px[step, s], predicted(m, left[s], top[s], corner[s], right[s]))


def undo_cross_colour(px: np.ndarray, w: np.ndarray, elements: np.ndarray, bits: np.ndarray) -> np.ndarray:
    step = np.arange(len(px))[:, None]
    y, x = step // w, step % w
    mw = w + (1 << bits) - 1 >> bits
    e = np.take_along_axis(elements, np.minimum((y >> bits) * mw + (x >> bits), len(elements) - 1), 0)
    green = px >> np.uint32(8) & np.uint32(255)
    red = (px >> np.uint32(16) & np.uint32(255)).astype(np.int32) + delta(e, green)
    blue = (px & np.uint32(255)).astype(np.int32) + delta(e >> np.uint32(8), green) + delta(e >> np.uint32(16), red & 255)
    return px & _AG | (red & 255).astype(np.uint32) << np.uint32(16) | (blue & 255).astype(np.uint32)


def add_green(px: np.ndarray) -> np.ndarray:
    green = px >> np.uint32(8) & np.uint32(255)
    return add(px, green << np.uint32(16) | green)


def decode(streams: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """(width, height, ARGB pixels) of each VP8L stream."""
    if not streams:
        return []
    r, every = Reader(streams), np.arange(len(streams))
    if (r.read(every, 8) != 0x2F).any():
        raise ValueError("not a VP8L stream")
    w, h = r.read(every, 14) + 1, r.read(every, 14) + 1
    r.read(every, 1)
    if r.read(every, 3).any():
        raise ValueError("an unknown version")
    now = w.copy()  # palettes narrow the image that follows
    stack: list[tuple] = []
    live = every[r.read(every, 1) == 1]
    while len(live):
        kind = r.read(live, 2)
        for t in range(4):
            i = live[kind == t]
            if not len(i):
                continue
            if t in (PREDICTOR, CROSS_COLOUR):
                bits = r.read(i, 3) + 2
                side = (1 << bits) - 1
                stack.append((t, i, now[i].copy(), bits, read_image(r, i, now[i] + side >> bits, h[i] + side >> bits, False)))
            elif t == PALETTE:
                size = r.read(i, 8) + 1
                colours = read_image(r, i, size, np.ones_like(size), False)
                for c in range(1, len(colours)):
                    colours[c] = add(colours[c], colours[c - 1])
                colours = np.where(np.arange(len(colours))[:, None] < size, colours, 0).astype(np.uint32)
                pack = np.select([size <= 2, size <= 4, size <= 16], [3, 2, 1], 0)
                stack.append((t, i, now[i].copy(), pack, np.concatenate([colours, np.zeros((256 - len(colours), len(i)), np.uint32)])))
                now[i] = now[i] + (1 << pack) - 1 >> pack
            else:
                stack.append((t, i, None, None, None))
        live = live[r.read(live, 1) == 1]
    px = read_image(r, every, now, h, True)
    for t, i, width, bits, data in reversed(stack):
        own = px[:, i]
        if t == PREDICTOR:
            undo_predictor(own, width, h[i], data, bits)
        elif t == CROSS_COLOUR:
            own = undo_cross_colour(own, width, data, bits)
        elif t == SUBTRACT_GREEN:
            own = add_green(own)
        else:
            total = int((width * h[i]).max())
            y, x = np.divmod(np.arange(total)[:, None], width)
            source = np.minimum(y * (width + (1 << bits) - 1 >> bits) + (x >> bits), len(own) - 1)
            index = np.take_along_axis(own, source, 0).astype(np.int64) >> 8 & 255
            depth = 8 >> bits
            index = index >> (x & (1 << bits) - 1) * depth & (1 << depth) - 1
            own = np.take_along_axis(data, index, 0)
        if len(own) > len(px):
            px = np.concatenate([px, np.zeros((len(own) - len(px), px.shape[1]), np.uint32)])
        px[: len(own), i] = own
    px = np.ascontiguousarray(px.T)
    return [(int(a), int(b), px[j, : a * b]) for j, (a, b) in enumerate(zip(w, h, strict=True))]


def frames(file: bytes) -> list[bytes]:
    """VP8L streams of a WebP file in order: one, or one for each frame of an animation."""
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    out, at = [], 12
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"ANMF":
            at += 8 + 16  # into the frame's own chunks
            continue
        if name == b"VP8L":
            out.append(file[at + 8 : at + 8 + size])
        elif name == b"VP8 ":
            raise ValueError("a lossy image")
        at += 8 + size + (size & 1)
    return out


def read_files(files: list[bytes]) -> list[np.ndarray]:
    """ARGB pixels of each file, frames one after the other. Images are decoded by size, some hundred at a time."""
    parts = [frames(f) for f in files]
    flat = [s for p in parts for s in p]
    order = sorted(range(len(flat)), key=lambda j: -len(flat[j]))
    got: list[np.ndarray | None] = [None] * len(flat)
    for a in range(0, len(order), BATCH):
        some = order[a : a + BATCH]
        for j, (_, _, px) in zip(some, decode([flat[j] for j in some]), strict=True):
            got[j] = px
    out, at = [], 0
    for p in parts:
        out.append(np.concatenate(got[at : at + len(p)]))
        at += len(p)
    return out


#: Images that are decoded or encoded together.
BATCH = 2048


# ---- writing ----


class Section:
    """Bit fields of many images in order: values, widths and the number of each image's fields."""

    def __init__(self, values: np.ndarray, widths: np.ndarray, counts: np.ndarray):
        self.values, self.widths, self.counts = values.astype(np.uint64), widths.astype(np.int64), counts.astype(np.int64)

    @classmethod
    def rows(cls, image: np.ndarray, n: int, *fields: tuple) -> Section:
        """The same fields for each of the images in `image` (ascending), of n."""
        values = np.stack([np.broadcast_to(v, image.shape) for v, _ in fields], 1).ravel()
        widths = np.stack([np.broadcast_to(b, image.shape) for _, b in fields], 1).ravel()
        return cls(values, widths, np.bincount(image, minlength=n) * len(fields))


def write(sections: list[Section], n: int) -> list[bytes]:
    """Streams of n images, each the fields of all sections in turn, lowest bits first."""
    sums = []
    for s in sections:
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(s.widths)])
        ends = np.cumsum(s.counts)
        sums.append((upto, ends - s.counts, upto[ends] - upto[ends - s.counts]))
    bits = np.sum([t for _, _, t in sums], 0)
    base = np.cumsum((bits + 127 >> 6) * 64) - (bits + 127 >> 6) * 64
    out = np.zeros(int((bits + 127 >> 6).sum()) * 2 + 2, np.uint64)  # of 32 bits each
    start = base.copy()
    for s, (upto, first, total) in zip(sections, sums, strict=True):
        if len(s.values):
            off = upto[:-1] + np.repeat(start - upto[first], s.counts)
            word = off >> 5
            v = s.values << (off & 31).astype(np.uint64)
            edge = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            total_v = np.bitwise_or.reduceat(v, edge)
            out[word[edge]] |= total_v & np.uint64(0xFFFFFFFF)
            out[word[edge] + 1] |= total_v >> np.uint64(32)
        start += total
    raw = out.astype("<u4").tobytes()
    return [raw[b >> 3 : (b >> 3) + (k + 7 >> 3)] for b, k in zip(base.tolist(), bits.tolist(), strict=True)]


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of complete prefix codes for rows of counts: Shannon's, shortened until no code space is left."""
    n, size = counts.shape
    total = counts.sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        ideal = np.ceil(np.log2(total / counts) - 1e-9)
    length = np.where(counts > 0, np.clip(ideal, 1, 15), 0).astype(np.int64)
    many = np.count_nonzero(length, 1) >= 2
    hist = np.stack([(length == l).sum(1) for l in range(16)], 1)
    hist[:, 0] = 0
    free = (1 << 15) - (hist << (15 - np.arange(16))).sum(1)
    while (free[many] > 0).any():
        for l in range(2, 16):
            k = np.where(many, np.minimum(hist[:, l], free >> (15 - l)), 0)
            hist[:, l] -= k
            hist[:, l - 1] += k
            free = free - (k << (15 - l))
    # the most frequent get the shortest
    order = np.argsort(-counts, 1, kind="stable")
    unused = size - hist[:, 1:].sum(1)
    ranked = np.repeat(np.tile(np.arange(16), n), np.concatenate([hist[:, 1:], unused[:, None]], 1).ravel())  # lengths 1 to 15, then none
    ranked = (ranked.reshape(n, size) + 1) % 16
    out = np.zeros_like(length)
    np.put_along_axis(out, order, ranked, 1)
    return out


def code_words(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes with their bits reversed, as they are written."""
    row, sym = np.nonzero(lengths)
    length = lengths[row, sym]
    order = np.lexsort((sym, length, row))
    row, sym, length = row[order], sym[order], length[order]
    space = np.cumsum(1 << (15 - length))
    space -= 1 << (15 - length)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    code = space - np.repeat(space[first], np.diff(np.append(first, len(row)))) if len(row) else space
    out = np.zeros(lengths.shape, np.int64)
    out[row, sym] = reversed_bits(15)[code]
    return out


def code_header(counts: np.ndarray, lengths: np.ndarray, size: np.ndarray) -> Section:
    """One prefix code of each image: simple for up to two symbols under 256, else all lengths with runs of zeros, by a code of 4 bits for 0 to 13, 17 and 18."""
    n = len(counts)
    used = counts > 0
    k = used.sum(1)
    low = used.argmax(1)
    high = used.shape[1] - 1 - used[:, ::-1].argmax(1)
    simple = (k <= 1) | (k == 2) & (high < 256)
    parts = []
    s = np.flatnonzero(simple & (k == 0))
    parts.append((s, np.tile([1], (len(s), 1)), np.tile([4], (len(s), 1))))
    s = np.flatnonzero(simple & (k == 1))
    parts.append((s, np.stack([np.full(len(s), 0b101), low[s]], 1), np.tile([3, 8], (len(s), 1))))
    s = np.flatnonzero(simple & (k == 2))
    parts.append((s, np.stack([np.full(len(s), 0b111), low[s], high[s]], 1), np.tile([3, 8, 8], (len(s), 1))))
    values = [[] for _ in range(2)]
    owner = []
    for s, v, b in parts:
        owner.append(np.repeat(s, v.shape[1]))
        values[0].append(v.ravel())
        values[1].append(b.ravel())
    s = np.flatnonzero(~simple)
    if len(s):
        symbols = sorted([*range(14), 17, 18])
        word = {c: int(reversed_bits(4)[j]) for j, c in enumerate(symbols)}
        head = [(0, 1), (13, 4), *((4 if c in word else 0, 3) for c in CODE_LENGTH_ORDER[:17]), (0, 1)]
        owner.append(np.repeat(s, len(head)))
        values[0].append(np.tile([v for v, _ in head], len(s)))
        values[1].append(np.tile([b for _, b in head], len(s)))
        # items: a length, or a run of zeros inside one row
        inside = np.arange(lengths.shape[1]) < size[s][:, None]
        row, _ = np.nonzero(inside)
        flat = lengths[s][inside]
        zero = flat == 0
        new = np.ones(len(flat), bool)
        new[1:] = ~zero[1:] | ~zero[:-1] | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        run = np.diff(np.append(at, len(flat)))
        row, is_zero, length = row[at], zero[at], flat[at]
        full, rest = np.where(is_zero, run // 138, 0), np.where(is_zero, run % 138, 0)
        plain = np.where(is_zero, np.where(rest < 3, rest, 0), 1)
        tokens = full + (rest >= 3) + plain
        item = np.repeat(np.arange(len(at)), tokens)
        nth = np.arange(len(item)) - np.repeat(np.cumsum(tokens) - tokens, tokens)
        w4 = np.array([word.get(c, 0) for c in range(19)])
        is_full = nth < full[item]
        is_run = ~is_full & (rest[item] >= 3)
        long = is_run & (rest[item] >= 11)
        code = np.where(is_full | long, w4[18], np.where(is_run, w4[17], w4[np.minimum(length[item], 18)]))
        extra = np.where(is_full, 127, np.where(long, rest[item] - 11, np.where(is_run, rest[item] - 3, 0)))
        width = np.where(is_full | long, 7, np.where(is_run, 3, 0))
        owner.append(np.repeat(s[row[item]], 2))
        values[0].append(np.stack([code, extra], 1).ravel())
        values[1].append(np.stack([np.full(len(code), 4), width], 1).ravel())
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return Section(np.concatenate(values[0])[order], np.concatenate(values[1])[order], np.bincount(owner, minlength=n))


def prefix_fields(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix code, extra bits, their number) of lengths and distances."""
    m = np.maximum(v - 1, 1)
    top = np.floor(np.log2(m)).astype(np.int64)
    small = v <= 4
    width = np.where(small, 0, top - 1)
    return np.where(small, v - 1, 2 * top + (m >> np.maximum(top - 1, 0) & 1)), np.where(small, 0, m & (1 << width) - 1), width


def _matches(px: np.ndarray, image: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, distance) of a copy that could start at each pixel, 0 where none of at least 4 can: the last earlier place of the same three pixels."""
    n = len(px)
    length, dist = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 4:
        return length, dist
    key = (px[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (px[1:-1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (px[2:].astype(np.uint64) << np.uint64(17)) ^ (image[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    a, b = order[:-1], order[1:]
    same = (key[a] == key[b]) & (image[a] == image[b]) & (image[np.minimum(b + 2, n - 1)] == image[b])
    for d in range(3):
        same &= px[a + d] == px[b + d]
    dist[b[same]] = (b - a)[same]
    # runs of one distance are one long match
    have = dist > 0
    cut = np.ones(n + 1, bool)
    cut[1:n] = (dist[1:] != dist[:-1]) | (image[1:] != image[:-1])
    edges = np.flatnonzero(cut)
    run_end = edges[np.searchsorted(edges, np.arange(n), "right")]
    length = np.where(have, run_end - np.arange(n) + 2, 0)
    return np.where(length >= 4, length, 0), dist


def _image_sections(px: np.ndarray, counts: np.ndarray, width: np.ndarray, main: bool) -> list[Section]:
    """An entropy-coded image of each of len(counts) images, their pixels one after the other."""
    n = len(counts)
    every = np.arange(n)
    image = np.repeat(every, counts)
    first = np.cumsum(counts) - counts
    total = len(px)
    length, dist = _matches(px, image, first) if main else (np.zeros(total, np.int64), None)
    covered = np.zeros(total, bool)
    starts = np.flatnonzero(length)
    chosen, until = [], 0
    for s, m in zip(starts.tolist(), length[starts].tolist(), strict=True):
        if s >= until:
            chosen.append(s)
            until = s + m
    copy = np.zeros(total, bool)
    copy[chosen] = True
    if chosen:
        c = np.array(chosen)
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, c + 1, 1)
        np.add.at(edge, np.minimum(c + length[c], total), -1)
        covered = np.cumsum(edge[:-1]) > 0
    # a pixel is in the cache if the last one in its slot has its colour
    slot = (px * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - CACHE_BITS)
    hit = np.zeros(total, bool)
    bits = np.zeros(n, np.int64)
    if main and total:
        order = np.argsort(image * (1 << CACHE_BITS) + slot.astype(np.int64), kind="stable")
        a, b = order[:-1], order[1:]
        hit[b] = (image[a] == image[b]) & (px[a] == px[b])
        rate = np.bincount(image, hit & ~covered, n)
        bits = np.where(rate * 8 > counts + 512, CACHE_BITS, 0)
        hit &= (bits > 0)[image]
    token = np.flatnonzero(~covered)
    own, p = image[token], px[token]
    is_copy, is_hit = copy[token], hit[token] & ~copy[token]
    literal = ~is_copy & ~is_hit
    size = 280 + np.where(bits > 0, 1 << CACHE_BITS, 0)
    wide = int(size.max(initial=280))
    green = np.where(literal, p >> np.uint32(8) & np.uint32(255), 280 + slot[token]).astype(np.int64)
    n_len, d_code = np.zeros((2, len(token)), np.int64), np.zeros((3, len(token)), np.int64)
    if is_copy.any():
        c = np.flatnonzero(is_copy)
        code, extra, more = prefix_fields(length[token[c]])
        green[c] = 256 + code
        n_len[:, c] = extra, more
        d = dist[token[c]]
        w = width[own[c]]
        value = d + 120
        for j, (x, y) in reversed(list(enumerate(NEAR[:32]))):
            value = np.where(x + y * w == d, j + 1, value)
        d_code[:, c] = prefix_fields(value)
    symbols = [green, (p >> np.uint32(16) & np.uint32(255)).astype(np.int64), (p & np.uint32(255)).astype(np.int64), (p >> np.uint32(24)).astype(np.int64), d_code[0]]
    masks = [np.ones(len(token), bool), literal, literal, literal, is_copy]
    heads, words = [], []
    for j, (sym, mask) in enumerate(zip(symbols, masks, strict=True)):
        k = (wide, 256, 256, 256, 40)[j]
        hist = np.bincount(own[mask] * k + sym[mask], minlength=n * k).reshape(n, k)
        lens = code_lengths(hist)
        heads.append(code_header(hist, lens, size if j == 0 else np.full(n, k)))
        one = np.count_nonzero(hist, 1) <= 1
        lens = np.where(one[:, None], 0, lens)
        words.append((code_words(lens).ravel()[own * k + sym], np.where(mask, lens.ravel()[own * k + sym], 0)))
    g, r, b, a, d = words
    # a copy: length and extra, distance and extra; a literal: green, red, blue, alpha
    values = np.stack([g[0], np.where(is_copy, n_len[0], r[0] * literal), np.where(is_copy, d[0], b[0] * literal), np.where(is_copy, d_code[1], a[0] * literal)], 1)
    widths = np.stack([g[1], np.where(is_copy, n_len[1], r[1]), np.where(is_copy, d[1], b[1]), np.where(is_copy, d_code[2], a[1])], 1)
    cached = Section.rows(every, n, (bits > 0, 1), (np.where(bits > 0, CACHE_BITS, 0), np.where(bits > 0, 4, 0)), (0, int(main)))
    return [cached, *heads, Section(values.ravel(), widths.ravel(), np.bincount(own, minlength=n) * 4)]


def _entropy(symbols: np.ndarray, image: np.ndarray, n: int) -> np.ndarray:
    hist = np.bincount(image * 256 + symbols, minlength=n * 256).reshape(n, 256).astype(float)
    total = hist.sum(1)
    return total * np.log2(np.maximum(total, 1)) - (hist * np.log2(np.maximum(hist, 1))).sum(1)


def _cost(px: np.ndarray, image: np.ndarray, n: int) -> np.ndarray:
    return sum(_entropy((px >> np.uint32(s) & np.uint32(255)).astype(np.int64), image, n) for s in (0, 8, 16, 24))


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """VP8L streams of pixel arrays, each whole rows of WIDTH."""
    n = len(payloads)
    counts = np.array([len(p) for p in payloads], np.int64)
    px = np.concatenate(payloads).astype(np.uint32)
    image, first = np.repeat(np.arange(n), counts), np.cumsum(counts) - counts
    place = np.arange(len(px)) - np.repeat(first, counts)
    x, y = place % WIDTH, place // WIDTH
    before = np.concatenate([np.zeros(1, np.uint32), px[:-1]])
    above = np.concatenate([np.zeros(WIDTH, np.uint32), px[:-WIDTH]]) if len(px) > WIDTH else np.zeros_like(px)
    left = np.where(place == 0, np.uint32(0xFF000000), np.where(x == 0, above, before))
    top = np.where(y == 0, np.where(x == 0, np.uint32(0xFF000000), before), above)
    green = px >> np.uint32(8) & np.uint32(255)
    crossed = px & _AG | ((px >> np.uint32(16) & np.uint32(255)).astype(np.int32) - delta(np.full(1, 32), green) & 255).astype(np.uint32) << np.uint32(16) | ((px & np.uint32(255)).astype(np.int32) - delta(np.full(1, 32), green) & 255).astype(np.uint32)
    forms = [px, subtract(px, green << np.uint32(16) | green), crossed, subtract(px, left), subtract(px, top)]
    costs = [_cost(f, image, n) + extra for f, extra in zip(forms, (0, 3, 40, 40, 40), strict=True)]
    # colours of each image in ascending order
    key = image.astype(np.uint64) << np.uint64(32) | px
    colours, index = np.unique(key, return_inverse=True)
    owner = (colours >> np.uint64(32)).astype(np.int64)
    k = np.bincount(owner, minlength=n)
    index = index - (np.cumsum(k) - k)[image]
    small = k <= 256
    costs.append(np.where(small, 24.0 * k + 60 + _entropy(np.minimum(index, 255), image, n), np.inf))
    plan = np.argmin(costs, 0)
    main = np.select([plan[image] == j for j in range(5)], forms, px)
    sections = [Section.rows(np.arange(n), n, (0x2F, 8), (WIDTH - 1, 14), (counts // WIDTH - 1, 14), (1, 1), (0, 3))]

    def sub(some: np.ndarray, pixels: np.ndarray, sizes: np.ndarray) -> None:
        for s in _image_sections(pixels, sizes, sizes, False):
            spread = np.zeros(n, np.int64)
            spread[some] = s.counts
            sections.append(Section(s.values, s.widths, spread))

    for j, kind in ((1, SUBTRACT_GREEN), (2, CROSS_COLOUR), (3, PREDICTOR), (4, PREDICTOR), (5, PALETTE)):
        some = np.flatnonzero(plan == j)
        if not len(some):
            continue
        if kind == SUBTRACT_GREEN:
            sections.append(Section.rows(some, n, (1, 1), (kind, 2)))
        elif kind == PALETTE:
            sections.append(Section.rows(some, n, (1, 1), (kind, 2), (k[some] - 1, 8)))
            c = colours[np.isin(owner, some)].astype(np.uint32)
            at = np.cumsum(k[some]) - k[some]
            previous = np.concatenate([np.zeros(1, np.uint32), c[:-1]])
            previous[at] = 0
            sub(some, subtract(c, previous), k[some])
        else:
            sections.append(Section.rows(some, n, (1, 1), (kind, 2), (7, 3)))  # one block
            value = {2: 0xFF002020, 3: 0xFF000100, 4: 0xFF000200}[j]
            sub(some, np.full(len(some), value, np.uint32), np.ones(len(some), np.int64))
    sections.append(Section.rows(np.arange(n), n, (0, 1)))
    widths, main_counts = np.full(n, WIDTH), counts.copy()
    if (plan == 5).any():  # indices, several to a pixel where colours are few
        pack = np.select([k <= 2, k <= 4, k <= 16], [3, 2, 1], 0) * (plan == 5)
        widths = np.where(plan == 5, WIDTH + (1 << pack) - 1 >> pack, WIDTH)
        main_counts = np.where(plan == 5, widths * (counts // WIDTH), counts)
        new_first = np.cumsum(main_counts) - main_counts
        merged = np.zeros(int(main_counts.sum()), np.int64)
        ip = pack[image]
        pal = plan[image] == 5
        to = new_first[image] + y * widths[image] + (x >> ip)
        np.add.at(merged, to[pal], index[pal] << (x & (1 << ip) - 1)[pal] * (8 >> ip)[pal])
        merged = (merged << 8).astype(np.uint32) | np.uint32(0xFF000000)
        merged[to[~pal]] = main[~pal]
        main = merged
    sections += _image_sections(main, main_counts, widths, True)
    return write(sections, n)


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def _u24(v: int) -> bytes:
    return struct.pack("<I", v)[:3]


def write_files(payloads: list[bytes]) -> list[bytes]:
    """WebP files of payloads of whole rows (4 * WIDTH bytes each)."""
    tile = ROWS * WIDTH
    tiles, counts = [], []
    for p in payloads:
        px = np.frombuffer(p, "<u4")
        own = [px[a : a + tile] for a in range(0, len(px), tile)]
        tiles += own
        counts.append(len(own))
    order = sorted(range(len(tiles)), key=lambda j: -len(tiles[j]))
    streams: list[bytes] = [b""] * len(tiles)
    for a in range(0, len(order), BATCH):
        some = order[a : a + BATCH]
        for j, s in zip(some, encode([tiles[j] for j in some]), strict=True):
            streams[j] = s
    out, at = [], 0
    for p, k in zip(payloads, counts, strict=True):
        own = streams[at : at + k]
        if k == 1:
            body = _chunk(b"VP8L", own[0])
        else:
            rows = len(p) // (4 * WIDTH)
            body = [_chunk(b"VP8X", b"\x12\0\0\0" + _u24(WIDTH - 1) + _u24(rows - 1)), _chunk(b"ANIM", b"\0" * 6)]
            for j, s in enumerate(own):
                h = len(tiles[at + j]) // WIDTH
                body.append(_chunk(b"ANMF", _u24(0) + _u24(j * ROWS // 2) + _u24(WIDTH - 1) + _u24(h - 1) + _u24(0) + b"\x02" + _chunk(b"VP8L", s)))
            body = b"".join(body)
        out.append(b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body)
        at += k
    return out
