"""Lossless WebP (VP8L) images as NumPy arrays, after the public format description (RFC 9649).

decode() reads any lossless still image: prefix codes, back-references and colour cache in one loop over the
pixels, then the inverse of the transforms. decode_many() reads images without references and cache side by side, one
pixel of each at a time, and gives the same. encode() writes prefix codes whose lengths follow the frequencies and, on
request, transforms, colour cache and back-references; best_form() says what pays for an image.
"""

from __future__ import annotations

import functools
import itertools
import struct

import numpy as np

# Fixed values of the format: order in which the lengths of the code length code are stored.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Fixed values of the format: (columns, rows) back that the 120 short distances stand for.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD
MAX_SIDE = 1 << 14
#: Longest code that is written; the format allows 15 bits. Four of them fit a number of _Writer.
LONGEST = 12
#: So few images are read one by one.
ALONE = 24


class Bits:
    """Reads a byte string from the least significant bit on."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data):
            raise ValueError("the image ends early")
        out = int.from_bytes(self.data[a:b], "little") >> (self.at & 7) & (1 << n) - 1
        self.at += n
        return out

    def same(self, a: int, b: int, n: int) -> bool:
        """Whether the n bits from a and from b on are equal."""
        x, y = (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & (1 << n) - 1 for at in (a, b))
        return x == y and b + n <= 8 * len(self.data)

    def peek(self, n: int) -> int:
        a = self.at >> 3
        return int.from_bytes(self.data[a : a + 4], "little") >> (self.at & 7) & (1 << n) - 1


class Code:
    """A canonical prefix code given by its lengths. entries: for the next `bits` bits, 16 times the symbol plus its length."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, int)
        symbols = np.flatnonzero(lengths)
        self.last = int(symbols[-1]) if len(symbols) else 0
        if len(symbols) <= 1:
            self.bits, self.entries = 0, np.array([16 * self.last])
            return
        own = lengths[symbols]
        self.bits = int(own.max())
        if (1 << (self.bits - own)).sum() != 1 << self.bits:
            raise ValueError("not a complete prefix code")
        order = symbols[np.argsort(own, kind="stable")]
        # Codes are assigned in order of length and symbol; the stream has their bits from the first on.
        self.entries = np.repeat(16 * order + lengths[order], 1 << (self.bits - lengths[order]))[_turned(self.bits)]

    @functools.cached_property
    def table(self) -> list[int]:
        return self.entries.tolist()

    def read(self, bits: Bits) -> int:
        entry = self.table[bits.peek(self.bits)]
        bits.at += entry & 15
        if bits.at > 8 * len(bits.data):
            raise ValueError("the image ends early")
        return entry >> 4


@functools.cache
def _turned(n: int) -> np.ndarray:
    return reverse_bits(np.arange(1 << n), n)


def reverse_bits(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros_like(x)
    for i in range(n):
        out |= (x >> i & 1) << (n - 1 - i)
    return out


def _read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(max(size, 256), int)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    own = np.zeros(19, int)
    for i in range(4 + bits.read(4)):
        own[CODE_LENGTH_ORDER[i]] = bits.read(3)
    code, left = Code(own), size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    at, last = 0, 8
    while at < size and left:
        left -= 1
        x = code.read(bits)
        if x < 16:
            lengths[at], at, last = x, at + 1, x or last
            continue
        n, value = {16: (2, last), 17: (3, 0), 18: (7, 0)}[x]
        n = bits.read(n) + (11 if x == 18 else 3)
        if at + n > size:
            raise ValueError("code lengths beyond the alphabet")
        lengths[at : at + n] = value
        at += n
    return Code(lengths)


def _read_head(bits: Bits, width: int, height: int, top: bool) -> tuple[list[list[Code]], np.ndarray | None, int, int]:
    """What precedes the pixels: codes by group, the groups of the tiles, and the size of tiles and cache in bits."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, tiles, tile_bits = 1, None, 0
    if top and bits.read(1):
        tile_bits = bits.read(3) + 2
        across = -(-width >> tile_bits)
        tiles = _read_image(bits, across, -(-height >> tile_bits), False) >> 8 & 0xFFFF
        groups = int(tiles.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [_read_codes(bits, sizes) for _ in range(groups)]
    return codes, tiles, tile_bits, cache_bits


def _read_image(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """ARGB values, row by row, of an entropy-coded image."""
    return _read_pixels(bits, width, width * height, *_read_head(bits, width, height, top))


def _read_codes(bits: Bits, sizes: tuple[int, ...]) -> list[Code]:
    codes: list[Code] = []
    length = 0
    for size in sizes:
        start = bits.at
        # Encoders may repeat a code: the same bits are the same code, if the alphabet has its symbols.
        if length and codes[-1].last < size and bits.same(start - length, start, length):
            bits.at += length
            codes.append(codes[-1])
            continue
        codes.append(_read_code(bits, size))
        length = bits.at - start
    return codes


def _read_pixels(bits: Bits, width: int, n: int, codes: list[list[Code]], tiles: np.ndarray | None, tile_bits: int, cache_bits: int) -> np.ndarray:
    """n pixels. The bits ahead are in the integer `ahead`, `have` of them."""
    data, whole = bits.data, 8 * len(bits.data)
    out: list[int] = []
    cache, remembered, shift = [0] * (1 << cache_bits), 0, 32 - cache_bits
    across = -(-width >> tile_bits)
    byte = bits.at >> 3
    ahead, have = int.from_bytes(data[byte : byte + 8], "little") >> (bits.at & 7), 64 - (bits.at & 7)
    byte += 8
    greens, reds, blues, alphas, backs = ((c.table, (1 << c.bits) - 1) for c in codes[0])
    (green, green_mask), (red, red_mask), (blue, blue_mask), (alpha, alpha_mask), (back, back_mask) = greens, reds, blues, alphas, backs
    at, turn = 0, 0
    while at < n:
        if tiles is not None and at >= turn:
            # The codes of this tile, up to its edge or the end of the row.
            y, x = divmod(at, width)
            (green, green_mask), (red, red_mask), (blue, blue_mask), (alpha, alpha_mask), (back, back_mask) = (
                (c.table, (1 << c.bits) - 1) for c in codes[int(tiles[(y >> tile_bits) * across + (x >> tile_bits)])]
            )
            turn = min(y * width + (((x >> tile_bits) + 1) << tile_bits), (y + 1) * width)
        if have < 64:
            ahead |= int.from_bytes(data[byte : byte + 8], "little") << have
            byte += 8
            have += 64
        entry = green[ahead & green_mask]
        length = entry & 15
        ahead >>= length
        have -= length
        symbol = entry >> 4
        if symbol < 256:
            one = red[ahead & red_mask]
            length = one & 15
            ahead >>= length
            have -= length
            two = blue[ahead & blue_mask]
            length = two & 15
            ahead >>= length
            have -= length
            three = alpha[ahead & alpha_mask]
            length = three & 15
            ahead >>= length
            have -= length
            out.append((three >> 4) << 24 | (one >> 4) << 16 | symbol << 8 | two >> 4)
            at += 1
            continue
        if symbol < 280:
            pair = []
            for k in range(2):
                if k:
                    entry = back[ahead & back_mask]
                    ahead >>= entry & 15
                    have -= entry & 15
                    symbol = (entry >> 4) + 256
                prefix = symbol - 256
                if prefix < 4:
                    pair.append(prefix + 1)
                    continue
                extra = (prefix - 2) >> 1
                pair.append(((2 + (prefix & 1)) << extra) + (ahead & (1 << extra) - 1) + 1)
                ahead >>= extra
                have -= extra
            length, far = pair
            if far > 120:
                far -= 120
            else:
                x, y = NEAR[far - 1]
                far = max(1, x + y * width)
            if far > at or at + length > n:
                raise ValueError("reference beyond the image")
            if far >= length:
                out += out[at - far : at - far + length]
            else:
                out += (out[-far:] * (length // far + 1))[:length]
            at += length
            continue
        for v in out[remembered:at]:
            cache[(v * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = v
        remembered = at
        out.append(cache[symbol - 280])
        at += 1
    bits.at = 8 * byte - have
    if bits.at > whole:
        raise ValueError("the image ends early")
    return np.array(out, np.uint32)


def _split(argb: np.ndarray) -> np.ndarray:
    """alpha, red, green, blue as the last axis."""
    return np.stack([argb >> 24 & 255, argb >> 16 & 255, argb >> 8 & 255, argb & 255], -1).astype(np.int64)


def _join(parts: np.ndarray) -> np.ndarray:
    p = (parts & 255).astype(np.uint32)
    return p[..., 0] << 24 | p[..., 1] << 16 | p[..., 2] << 8 | p[..., 3]


def _predict(mode: int, left, top, corner, right) -> tuple:
    """The prediction of one pixel, a tuple of four channels, from its neighbours."""
    mean = lambda a, b: tuple((x + y) // 2 for x, y in zip(a, b, strict=True))
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return mean(mean(left, right), top)
    if mode in (6, 7, 8, 9):
        return mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        # The neighbour that the gradient left + top - corner is nearer to.
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    clamp = lambda v: min(255, max(0, v))
    if mode == 12:
        return tuple(clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True))
    if mode == 13:
        half = mean(left, top)
        return tuple(clamp(h + int((h - c) / 2)) for h, c in zip(half, corner, strict=True))
    return (255, 0, 0, 0)


def _predictor(argb: np.ndarray, width: int, height: int, modes: np.ndarray, size_bits: int, undo: bool) -> np.ndarray:
    """Adds (undo) or subtracts the predictions; predictions always come from the original pixels."""
    given = [tuple(p) for p in _split(argb).tolist()]
    plain = [None] * len(given) if undo else given
    out, across = [], -(-width >> size_bits)
    for i, pixel in enumerate(given):
        y, x = divmod(i, width)
        if not i:
            guess = (255, 0, 0, 0)
        elif not y:
            guess = plain[i - 1]
        elif not x:
            guess = plain[i - width]
        else:
            # The pixel right above the last of a row is the first of that row's successor: plain order.
            guess = _predict(int(modes[(y >> size_bits) * across + (x >> size_bits)]) & 15, plain[i - 1], plain[i - width], plain[i - width - 1], plain[i - width + 1])
        value = tuple((a + b if undo else a - b) & 255 for a, b in zip(pixel, guess, strict=True))
        if undo:
            plain[i] = value
        out.append(value)
    return _join(np.array(out, np.int64).reshape(-1, 4))


def _cross(argb: np.ndarray, width: int, height: int, factors: np.ndarray, size_bits: int, undo: bool) -> np.ndarray:
    signed = lambda v: (v.astype(np.int64) + 128 & 255) - 128
    y, x = np.divmod(np.arange(width * height), width)
    f = factors[(y >> size_bits) * -(-width >> size_bits) + (x >> size_bits)]
    red_to_blue, green_to_blue, green_to_red = (signed(f >> s & 255) for s in (16, 8, 0))
    p = _split(argb)
    green, red = signed(p[:, 2]), p[:, 1].copy()
    sign = 1 if undo else -1
    p[:, 1] = red + sign * (green_to_red * green >> 5) & 255
    p[:, 3] = p[:, 3] + sign * ((green_to_blue * green >> 5) + (red_to_blue * signed(p[:, 1] if undo else red) >> 5)) & 255
    return _join(p)


def _green(argb: np.ndarray, undo: bool) -> np.ndarray:
    p, sign = _split(argb), 1 if undo else -1
    p[:, 1] += sign * p[:, 2]
    p[:, 3] += sign * p[:, 2]
    return _join(p)


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _open(data: bytes) -> tuple:
    """The bits at the pixels of one file, width, height, width of the stored image, transforms to undo, and its head."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])
    if bits.read(8) != 0x2F:
        raise ValueError("wrong signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    inner, undo = width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            field = _read_image(bits, -(-inner >> size), -(-height >> size), False)
            undo.append((kind, inner, field >> 8 & 15 if kind == PREDICTOR else field, size))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, inner, None, 0))
        else:
            n = bits.read(8) + 1
            colours = _join(np.cumsum(_split(_read_image(bits, n, 1, False)), axis=0))
            undo.append((kind, inner, colours, _bundle(n)))
            inner = -(-inner >> _bundle(n))
    return bits, width, height, inner, undo, _read_head(bits, inner, height, True)


def _undo(argb: np.ndarray, height: int, undo: list[tuple]) -> np.ndarray:
    for kind, before, field, size in reversed(undo):
        if kind == PREDICTOR:
            argb = _predictor(argb, before, height, field, size, True)
        elif kind == CROSS_COLOUR:
            argb = _cross(argb, before, height, field, size, True)
        elif kind == SUBTRACT_GREEN:
            argb = _green(argb, True)
        else:
            packed, each = (argb >> 8 & 255).reshape(height, -1), 8 >> size
            index = np.stack([packed >> np.uint32(each * k) & np.uint32((1 << each) - 1) for k in range(1 << size)], -1).reshape(height, -1)[:, :before].ravel()
            table = np.zeros(256, np.uint32)
            table[: len(field)] = field
            argb = table[index]
    return argb


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """width, height, and ARGB values row by row, of one lossless WebP file."""
    bits, width, height, inner, undo, head = _open(data)
    return width, height, _undo(_read_pixels(bits, inner, inner * height, *head), height, undo)


def decode_many(files: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """decode() of each; those without references, cache and tiles are read together."""
    opened = [_open(f) for f in files]
    plain = [k for k, (_, _, _, _, _, (codes, tiles, _, cache_bits)) in enumerate(opened) if tiles is None and not cache_bits and codes[0][0].last < 256]
    pixels = dict(zip(plain, _read_side_by_side([(opened[k][0], opened[k][3] * opened[k][2], opened[k][5][0][0]) for k in plain]), strict=True))
    out = []
    for k, (bits, width, height, inner, undo, head) in enumerate(opened):
        argb = pixels[k] if k in pixels else _read_pixels(bits, inner, inner * height, *head)
        out.append((width, height, _undo(argb, height, undo)))
    return out


def _read_side_by_side(images: list[tuple[Bits, int, list[Code]]]) -> list[np.ndarray]:
    """Pixels of images of literals only: bits, number of pixels, codes. The longest images end alone, one by one."""
    order = sorted(range(len(images)), key=lambda k: -images[k][1])
    sizes = np.array([images[k][1] for k in order], np.int64)
    raw = [images[k][0].data + bytes(8) for k in order]
    begin = np.cumsum([0] + [len(r) for r in raw])[:-1]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    # The 32 bits from each byte on: no code that is written takes more than what is left of them.
    ahead = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24) if len(data) else data
    at = np.array([8 * b + images[k][0].at for b, k in zip(begin, order, strict=True)], np.int64)
    tables: dict[int, int] = {}
    parts, length = [], 0
    base, mask = np.zeros((4, len(order)), np.int64), np.zeros((4, len(order)), np.uint32)
    for i, k in enumerate(order):
        for c, code in enumerate(images[k][2][:4]):
            if id(code) not in tables:
                tables[id(code)] = length
                parts.append(code.entries)
                length += len(code.entries)
            base[c, i], mask[c, i] = tables[id(code)], (1 << code.bits) - 1
    table = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint32)
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0]) + 1 if len(sizes) else 1), side="right")
    step = 0
    while step < (int(sizes[0]) if len(sizes) else 0) and active[step] >= ALONE:
        n = int(active[step])
        pos, value = at[:n], np.zeros(n, np.int64)
        for c, shift in enumerate((8, 16, 0, 24)):
            entry = table[base[c, :n] + (ahead[pos >> 3] >> (pos & 7).astype(np.uint32) & mask[c, :n])]
            pos += entry & 15
            value |= entry >> 4 << shift
        out[first[:n] + step] = value
        step += 1
    result: list[np.ndarray] = [None] * len(order)
    for i, k in enumerate(order):
        bits, n, codes = images[k]
        done = min(step, n)
        bits.at = int(at[i]) - 8 * int(begin[i])
        if bits.at > 8 * len(bits.data):
            raise ValueError("the image ends early")
        own = out[first[i] : first[i] + n]
        if done < n:
            own[done:] = _read_pixels(bits, 1, n - done, [codes], None, 0, 0)
        result[k] = own
    return result


class _Writer:
    """Numbers with their lengths in bits (at most 60), packed from the least significant bit on."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self._single: list[tuple[int, int]] = []

    def put(self, value: int, n: int) -> None:
        self._single.append((value, n))

    def extend(self, values: np.ndarray, lengths: np.ndarray) -> None:
        if self._single:
            v, n = zip(*self._single, strict=True)
            self.values.append(np.array(v, np.uint64))
            self.lengths.append(np.array(n, np.uint64))
            self._single = []
        self.values.append(values.astype(np.uint64))
        self.lengths.append(lengths.astype(np.uint64))

    def bytes(self) -> bytes:
        self.extend(np.zeros(0), np.zeros(0))
        values, lengths = np.concatenate(self.values), np.concatenate(self.lengths)
        some = lengths > 0
        values, lengths = values[some], lengths[some]
        end = np.cumsum(lengths)
        begin = end - lengths
        word, shift = (begin >> np.uint64(6)).astype(np.int64), begin & np.uint64(63)
        out = np.zeros((int(end[-1]) >> 6) + 2, np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        # At most one number reaches into each next word.
        over = np.flatnonzero(shift + lengths > 64)
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
        return out.astype("<u8").tobytes()[: (int(end[-1]) + 7) >> 3]


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Lengths of a complete prefix code for the symbols that occur, two at least: near the information of each.

    Lengths are rounded up, so that a code exists; what room is left shortens the codes of frequent symbols.
    """
    symbols = np.flatnonzero(counts)
    symbols = symbols[np.argsort(-counts[symbols], kind="stable")]
    own = np.clip(np.ceil(np.log2(counts.sum() / counts[symbols]) - 1e-9), 1, longest).astype(int).tolist()
    whole = 1 << longest
    room = whole - sum(1 << (longest - n) for n in own)
    # Rounding cannot use too much room, but cutting at the longest length can: the rarest short codes get longer.
    k = len(own) - 1
    while room < 0:
        if own[k] < longest:
            own[k] += 1
            room += 1 << (longest - own[k])
        k = k - 1 if k else len(own) - 1
    while room:
        for k, n in enumerate(own):
            if n > 1 and 1 << (longest - n) <= room:
                room -= 1 << (longest - n)
                own[k] = n - 1
    lengths = np.zeros(len(counts), int)
    lengths[symbols] = own
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes by symbol, bits turned for the stream."""
    codes = np.zeros(len(lengths), np.uint64)
    symbols = np.flatnonzero(lengths)
    if not len(symbols):
        return codes
    symbols = symbols[np.argsort(lengths[symbols], kind="stable")]
    deep = int(lengths.max())
    step = 1 << (deep - lengths[symbols])
    # As numbers of `deep` bits the codes begin where those before them end; turned, the empty bits fall away.
    codes[symbols] = _turned(deep)[np.cumsum(step) - step]
    return codes


def _runs_of_lengths(lengths: list[int]) -> list[tuple[int, int, int]]:
    """Symbols for code lengths, with extra bits: zeros in runs of 3 to 138, other lengths one by one."""
    out = []
    for length, group in itertools.groupby(lengths):
        n = sum(1 for _ in group)
        if length:
            out += [(length, 0, 0)] * n
            continue
        while n:
            k = min(n, 138)
            out += [(18, k - 11, 7)] if k >= 11 else [(17, k - 3, 3)] if k >= 3 else [(0, 0, 0)] * k
            n -= k
    return out


def _code_for(used: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """A code for the used symbols (counts by symbol): codes and lengths, 0 for all if no bits are needed, and how it is written."""
    symbols = np.flatnonzero(used)
    if len(symbols) <= 1:
        only = int(symbols[0]) if len(symbols) else 0
        if only < 256:
            return np.zeros(len(used), np.uint64), np.zeros(len(used), int), (np.array([1 | 0 << 1 | 1 << 2 | only << 3]), np.array([11]))
        used = used.copy()
        used[0] = 1
    lengths = code_lengths(used, LONGEST)
    last = int(np.flatnonzero(lengths)[-1])
    told = _runs_of_lengths(lengths[: last + 1].tolist())
    if len(told) < 2:
        told = _runs_of_lengths([*lengths[: last + 1].tolist(), 0])
    symbol, extra, more = np.array(told).T
    kinds = np.bincount(symbol, minlength=19)
    single = np.count_nonzero(kinds) == 1
    own = np.where(kinds > 0, 1, 0) if single else code_lengths(kinds, 7)
    shown = max(3, max(i for i, x in enumerate(CODE_LENGTH_ORDER) if own[x]))
    # How many of these symbols follow; the lengths after them are 0.
    many = len(told) - 2
    pairs = max(0, (many.bit_length() - 1) >> 1)
    code, shift = (np.zeros(19, int), np.zeros(len(told), int)) if single else (canonical_codes(own).astype(int), own[symbol])
    values = [0 | (shown - 3) << 1, *own[list(CODE_LENGTH_ORDER[: shown + 1])].tolist(), 1 | pairs << 1 | many << 4]
    sizes = [5, *[3] * (shown + 1), 4 + 2 + 2 * pairs]
    return canonical_codes(lengths), lengths, (np.concatenate([values, code[symbol] | extra << shift]), np.concatenate([sizes, shift + more]))


def _write_code(out: _Writer, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, lengths, told = _code_for(used)
    out.extend(*told)
    return codes, lengths


def _samples(argb: np.ndarray) -> np.ndarray:
    """Green, red, blue and alpha of each pixel, in the order of the stream."""
    return np.ascontiguousarray(argb.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, [1, 2, 0, 3]]


def _counts(samples: np.ndarray) -> np.ndarray:
    """How often each of 256 values is in each of the four columns."""
    return np.bincount((samples + np.array([0, 256, 512, 768])).ravel(), minlength=1024).reshape(4, 256)


def _literals(samples: np.ndarray, codes: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The four codes of each pixel as one number, and its length."""
    if all(c is codes[0] for c in codes[:4]):
        code, length = codes[0][0][samples], codes[0][1][samples]
    else:
        code, length = (np.stack([c[k][samples[:, j]] for j, c in enumerate(codes[:4])], 1) for k in (0, 1))
    end = np.cumsum(length, axis=1)
    return (code << (end - length).astype(np.uint64)).sum(1, dtype=np.uint64), end[:, 3]


def _write_image(out: _Writer, argb: np.ndarray, width: int, top: bool, cache_bits: int = 0, references: bool = False) -> None:
    """Prefix codes; on request with a colour cache and references to earlier equal runs, found by their first pixels."""
    out.put(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    if top:
        out.put(0, 1)
    samples = _samples(argb)
    if not cache_bits and not references:
        used = _counts(samples)
        all_used = used.sum(0)
        if _bits(all_used[None]) <= _bits(used) + 3 * 8 * np.count_nonzero(all_used):
            # One code for all channels, written for each: what four would save is less than what they take.
            *code, told = _code_for(all_used)
            codes = [tuple(code)] * 4
            for _ in range(4):
                out.extend(*told)
        else:
            codes = [_write_code(out, u) for u in used]
        _write_code(out, np.zeros(40, int))
        out.extend(*_literals(samples, codes))
        return
    items, cache, seen, at, px = [], {}, {}, 0, argb.tolist()

    def prefix(v: int) -> tuple[int, int, int]:
        if v <= 4:
            return v - 1, 0, 0
        high = (v - 1).bit_length() - 1
        second = (v - 1) >> (high - 1) & 1
        return 2 * high + second, high - 1, (v - 1) - ((2 + second) << (high - 1))

    near = {}
    for k, (x, y) in reversed(list(enumerate(NEAR))):
        near[max(1, x + y * width)] = k + 1
    while at < len(px):
        back = at - seen[tuple(px[at : at + 3])] if references and at + 3 <= len(px) and tuple(px[at : at + 3]) in seen else 0
        length = 0
        while back and at + length < len(px) and length < 4096 and px[at + length] == px[at + length - back]:
            length += 1
        slot = (px[at] * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else -1
        if length >= 3:
            items.append((at, *prefix(length), *prefix(near.get(back, back + 120))))
        elif cache_bits and cache.get(slot) == px[at]:
            items.append((at, 24 + slot, 0, 0))
            length = 1
        else:
            items.append((at,))
            length = 1
        seen[tuple(px[at : at + 3])] = at
        if cache_bits:
            for v in px[at : at + length]:
                cache[(v * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = v
        at += length
    plain = np.array([x[0] for x in items if len(x) == 1], int)
    green, *used = _counts(samples[plain])
    used = [np.concatenate([green, np.zeros(24 + (1 << cache_bits if cache_bits else 0), int)]), *used]
    used[0] += np.bincount([256 + x[1] for x in items if len(x) > 1], minlength=len(used[0]))
    used.append(np.bincount([x[4] for x in items if len(x) > 4], minlength=40))
    codes = [_write_code(out, u) for u in used]
    (green, green_bits), (back, back_bits) = codes[0], codes[4]
    value, length = _literals(samples, codes)
    values, lengths = value.tolist(), length.tolist()
    for x in items:
        if len(x) == 1:
            out.put(values[x[0]], lengths[x[0]])
            continue
        out.put(int(green[256 + x[1]]), int(green_bits[256 + x[1]]))
        out.put(x[3], x[2])
        if len(x) > 4:
            out.put(int(back[x[4]]), int(back_bits[x[4]]))
            out.put(x[6], x[5])


def _bits(counts: np.ndarray) -> float:
    """Bits that prefix codes need for symbols with these counts, a row for each channel, about."""
    total = counts.sum(1)
    return float((total * np.log2(np.maximum(total, 1))).sum() - (counts * np.log2(np.maximum(counts, 1))).sum())


def best_form(argb: np.ndarray, width: int, height: int) -> dict:
    """What encode() should use for an image: references and cache where pixels repeat, else the transform that saves bits."""
    n = len(argb)
    colours = len(set(argb.tolist()))
    if 3 * colours < n:
        # Many equal pixels: those of a palette, if they are few, in places that references copy.
        few = {"transforms": ((PALETTE,),)} if colours <= 256 and 8 * colours < n else {"cache_bits": min(10, max(1, (colours - 1).bit_length()))}
        return {"references": True, **few}
    samples = _samples(argb)
    plain = _bits(_counts(samples))
    green = samples.copy()
    green[:, 1:3] -= samples[:, :1]
    left = samples.copy()
    left[1:] -= samples[:-1]
    tried = [(_bits(_counts(green)), (SUBTRACT_GREEN,)), (_bits(_counts(left)), (PREDICTOR, 1))]
    if min(tried)[0] < plain:
        # Half of green and red taken from red and blue: a factor of 16 of 32.
        half = samples.astype(np.int8) >> 1
        cross = samples.copy()
        cross[:, 1] -= half[:, 0].astype(np.uint8)
        cross[:, 2] -= (half[:, 0] + half[:, 1]).astype(np.uint8)
        tried.append((_bits(_counts(cross)), (CROSS_COLOUR, 0x101010)))
    bits, best = min(tried)
    return {"transforms": (best,)} if bits < 0.97 * plain - 256 else {}


def encode(argb: np.ndarray, width: int, height: int, transforms=(), cache_bits: int = 0, references: bool = False) -> bytes:
    """One lossless WebP file. transforms: of (PREDICTOR, mode), (CROSS_COLOUR, factor), (SUBTRACT_GREEN,), (PALETTE,)."""
    out, now, inner = _Writer(), np.asarray(argb, np.uint32), width
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    for kind, *how in transforms:
        out.put(1 | kind << 1, 3)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = 4
            n = (-(-inner >> size)) * (-(-height >> size))
            field = np.full(n, how[0] << 8 if kind == PREDICTOR else how[0], np.uint32)
            out.put(size - 2, 3)
            _write_image(out, field, -(-inner >> size), False)
            now = _predictor(now, inner, height, field >> 8, size, False) if kind == PREDICTOR else _cross(now, inner, height, field, size, False)
        elif kind == SUBTRACT_GREEN:
            now = _green(now, False)
        else:
            colours, index = np.unique(now, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("too many colours for a palette")
            out.put(len(colours) - 1, 8)
            _write_image(out, _join(np.diff(_split(colours), axis=0, prepend=0)), len(colours), False)
            size = _bundle(len(colours))
            per, each = 1 << size, 8 >> size
            index = np.pad(index.reshape(height, inner).astype(np.uint32), ((0, 0), (0, -inner % per)))
            inner = index.shape[1] // per
            shifts = (np.arange(per, dtype=np.uint32) * np.uint32(each)).astype(np.uint32)
            now = (np.uint32(255) << np.uint32(24)) | (index.reshape(height, inner, per) << shifts).sum(-1).astype(np.uint32).ravel() << np.uint32(8)
    out.put(0, 1)
    _write_image(out, now, inner, True, cache_bits, references)
    body = out.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
