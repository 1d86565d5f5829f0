"""Progressive JPEG: a decoder to full-resolution RGB, and a writer for coefficient arrays.

The decoder accumulates all scans (spectral selection and successive approximation) in one
coefficient array per component, transforms these back in numpy, repeats subsampled chroma and
converts to RGB. It reads 8-bit progressive files with Huffman coding, one to four components, any
sampling factors and restart intervals.

The entropy decoder works on arrays of bits. A run of equal symbols (same code and size) is read as a
matrix with one row per symbol; other first scans look up the symbol at every bit position at once
and follow the resulting jumps; the correction bits of an end-of-band run are added in one step.
Refinements with new coefficients go symbol by symbol.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

#: Row-major place of the k-th coefficient in zigzag order, built by its rule.
ZIGZAG = np.array([8 * r + c for s in range(15) for r, c in sorted(((i, s - i) for i in range(8) if 0 <= s - i < 8), key=lambda p: p[0] if s % 2 else -p[0])])
_BASIS = np.array([[(np.sqrt(1 / 8) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: (64 coefficients in zigzag order) @ _INVERSE = 64 samples.
_INVERSE = np.kron(_BASIS, _BASIS)[ZIGZAG].astype(np.float32)
_NEXT_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


class JpegError(ValueError):
    pass


@dataclass
class Huffman:
    """``symbol`` and ``length`` by the next 16 bits; length 0 where no code begins so."""

    symbol: np.ndarray
    length: np.ndarray
    code: dict[int, tuple[int, int]]

    @classmethod
    def build(cls, counts: list[int], symbols: bytes) -> Huffman:
        symbol, length, code, at, k = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), {}, 0, 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                symbol[at << (16 - n) : (at + 1) << (16 - n)] = symbols[k]
                length[at << (16 - n) : (at + 1) << (16 - n)] = n
                code[symbols[k]] = (at, n)
                at, k = at + 1, k + 1
            at <<= 1
        return cls(symbol, length, code)


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks per row and column that hold the picture
    high: int = 0
    row: int = 0  # blocks per stored row, a multiple of h
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int16))


@dataclass
class Picture:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comment: bytes = b""
    adobe: int | None = None

    def planes(self) -> list[np.ndarray]:
        """Samples of each component at full resolution."""
        hmax, vmax = max(c.h for c in self.components), max(c.v for c in self.components)
        out = []
        for c in self.components:
            q = self.quant[c.table].astype(np.float32)
            samples = c.coef.astype(np.float32) @ (_INVERSE * q[:, None])
            samples += 128.5
            np.clip(samples, 0, 255.49, out=samples)
            plane = samples.astype(np.uint8).reshape(-1, c.row, 8, 8).transpose(0, 2, 1, 3).reshape(-1, c.row * 8)
            if vmax != c.v:
                plane = np.repeat(plane, vmax // c.v, axis=0)
            if hmax != c.h:
                plane = np.repeat(plane, hmax // c.h, axis=1)
            out.append(plane[: self.height, : self.width])
        return out

    def rgb(self) -> np.ndarray:
        """height x width x 3 of uint8; one component is grey, three are YCbCr unless the file says RGB."""
        planes = self.planes()
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2)
        if len(planes) == 4:
            raise JpegError("four components have no RGB form here")
        if self.adobe == 0:
            return np.stack(planes, axis=2)
        y, cb, cr = (p.astype(np.float32) for p in planes)
        cb -= 128
        cr -= 128
        out = np.empty((self.height, self.width, 3), np.uint8)
        for k, value in enumerate((y + 1.402 * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + 1.772 * cb)):
            value += 0.5
            np.clip(value, 0, 255.49, out=value)
            out[:, :, k] = value
        return out


def _numbers(bits: np.ndarray) -> np.ndarray:
    """Rows of bits, first bit highest, as int32."""
    return bits.astype(np.int32) @ (1 << np.arange(bits.shape[1] - 1, -1, -1, dtype=np.int32))


def _extended(value: np.ndarray, size) -> np.ndarray:
    """The signed value of ``size`` extra bits."""
    half = np.left_shift(1, np.maximum(size, 1) - 1)
    return np.where(size == 0, 0, np.where(value < half, value - np.left_shift(1, size) + 1, value))


class _Bits:
    """The bits of one restart interval; past the end all bits are 1, as the padding is."""

    def __init__(self, data: bytes):
        self.raw = data.replace(b"\xff\x00", b"\xff")
        self.size = 8 * len(self.raw)
        self._bits: np.ndarray | None = None

    @property
    def bits(self) -> np.ndarray:
        if self._bits is None:
            self._bits = np.unpackbits(np.frombuffer(self.raw + b"\xff" * 8, np.uint8))
        return self._bits

    def windows(self, start: int, end: int) -> np.ndarray:
        """The 16 bits from each position in [start, end)."""
        x = np.frombuffer(self.raw + b"\xff" * 8, np.uint8).astype(np.int32)
        a, b = start >> 3, (end + 7) >> 3
        word = (x[a : b + 1] << 16) | (x[a + 1 : b + 2] << 8) | x[a + 2 : b + 3]
        all_positions = (word[:, None] >> np.arange(8, 0, -1)) & 0xFFFF
        return all_positions.reshape(-1)[start - 8 * a :][: end - start]

    def window(self, at: int) -> int:
        b = at >> 3
        return (int.from_bytes(self.raw[b : b + 3].ljust(3, b"\xff")) >> (8 - (at & 7))) & 0xFFFF

    def number(self, at: int, n: int) -> int:
        if not n:
            return 0
        return int.from_bytes(self.raw[at >> 3 : (at + n + 7) >> 3].ljust((n >> 3) + 2, b"\xff")[: ((at & 7) + n + 7) >> 3]) >> (-(at + n) & 7) & ((1 << n) - 1)


def _dc_first(src: _Bits, tables: list[Huffman], n: int) -> np.ndarray:
    """n differences, whose tables go round as ``tables``."""
    window = src.windows(0, src.size)
    if not len(window):
        raise JpegError("a scan ends early")
    jumps = []
    for t in {id(t): t for t in tables}.values():
        size = t.symbol[window]
        length = t.length[window]
        jumps.append((id(t), size, length, (np.arange(len(window)) + length + size).tolist(), length.tolist()))
    by = {j[0]: j for j in jumps}
    order = [by[id(t)] for t in tables]
    at, places, k = 0, [], 0
    try:
        for _ in range(n):
            nxt, ok = order[k][3], order[k][4]
            if not ok[at]:
                raise JpegError("bits without a code")
            places.append(at)
            at = nxt[at]
            k = k + 1 if k + 1 < len(order) else 0
    except IndexError as e:
        raise JpegError("a scan ends early") from e
    places = np.array(places, np.int64)
    out = np.zeros(n, np.int32)
    for k, (_, size, length, _, _) in enumerate(order):
        p = places[k :: len(order)]
        s = size[p]
        value = np.zeros(len(p), np.int32)
        for j in range(int(s.max(initial=0))):
            more = s > j
            value[more] = (value[more] << 1) | src.bits[np.minimum(p[more] + length[p[more]] + j, len(src.bits) - 1)]
        out[k :: len(order)] = _extended(value, s)
    return out


def _ac_first(src: _Bits, table: Huffman, n: int, band: int) -> np.ndarray:
    """n blocks by ``band`` coefficients."""
    out = np.zeros((n, band), np.int32)
    flat = out.reshape(-1)
    at, place, total = 0, 0, n * band
    while place < total:
        w = src.window(at)
        length, symbol = int(table.length[w]), int(table.symbol[w])
        if not length or at >= src.size:
            raise JpegError("a scan ends early")
        run, size = symbol >> 4, symbol & 15
        if size == 0 and run != 15:  # end of band, for a run of blocks
            place = (place // band + (1 << run) + src.number(at + length, run)) * band
            at += length + run
            continue
        if run == 0 and size:
            step = length + size
            most = min(total - place, (src.size - at) // step)
            code = w >> (16 - length)
            if step == 8 and at % 8 == 0:
                rows = np.frombuffer(src.raw, np.uint8, most, at >> 3)
                same = (rows >> size) == code
                value = rows & ((1 << size) - 1)
            else:
                rows = src.bits[at : at + most * step].reshape(most, step)
                same = _numbers(rows[:, :length]) == code
                value = None
            m = most if same.all() else int(np.argmin(same))
            if m >= 8 or m == total - place:
                value = value[:m].astype(np.int32) if value is not None else _numbers(rows[:m, length:])
                flat[place : place + m] = _extended(value, np.int32(size))
                at, place = at + m * step, place + m
                continue
        if place % band + run >= band:
            raise JpegError("a run leaves its block")
        if size:
            v = src.number(at + length, size)
            flat[place + run] = v if v >> (size - 1) else v - (1 << size) + 1
        at, place = at + length + size, place + run + 1
    return out


def _ac_refine(src: _Bits, table: Huffman, coef: np.ndarray, low: int) -> None:
    """Adds the bit ``low`` to the blocks-by-band array ``coef``."""
    n, band = coef.shape
    one, at, block, k = 1 << low, 0, 0, 0

    def corrected(part: np.ndarray, at: int) -> int:
        known = np.flatnonzero(part)
        if at + len(known) > src.size:
            raise JpegError("a scan ends early")
        old = part[known]
        part[known] = old + np.where(old > 0, one, -one) * src.bits[at : at + len(known)]
        return at + len(known)

    while block < n:
        w = src.window(at)
        length, symbol = int(table.length[w]), int(table.symbol[w])
        if not length or at >= src.size:
            raise JpegError("a scan ends early")
        at += length
        run, size = symbol >> 4, symbol & 15
        if size == 0 and run != 15:
            blocks = (1 << run) + src.number(at, run)
            at += run
            rest = coef[block : block + blocks].reshape(-1)[k:] if coef.flags.c_contiguous else None
            if rest is None:
                raise JpegError("a copy is needed here")
            at = corrected(rest, at)
            block, k = block + blocks, 0
            continue
        new = 0
        if size:
            new = one if src.bits[at] else -one
            at += 1
        row = coef[block]
        while k < band:
            if row[k]:
                if src.bits[at]:
                    row[k] += one if row[k] > 0 else -one
                at += 1
            elif run == 0:
                break
            else:
                run -= 1
            k += 1
        if k >= band and size:
            raise JpegError("a run leaves its block")
        if k < band:
            row[k] = new
            k += 1
        if k >= band:
            block, k = block + 1, 0


def decode(data: bytes) -> Picture:
    """All scans of a progressive file, as coefficient arrays."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no JPEG")
    at, picture, restart, done = 2, None, 0, False
    quant: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], Huffman] = {}
    comment, adobe = b"", None
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            raise JpegError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            done = True
            break
        if marker == 0xFF:
            at += 1
            continue
        if at + 4 > len(data):
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide, ident = body[0] >> 4, body[0] & 15
                n = 64 * (1 + wide)
                quant[ident] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                n = sum(counts)
                key = (body[0], hash(body[1 : 17 + n]))
                tables[(body[0] >> 4, body[0] & 15)] = _cached_table(key[1], counts, body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            depth, high, wide, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not high or not wide:
                raise JpegError("8 bits a sample and a size are needed")
            parts = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            hmax, vmax = max(c.h for c in parts), max(c.v for c in parts)
            across, down = -(-wide // (8 * hmax)), -(-high // (8 * vmax))
            for c in parts:
                c.wide, c.high, c.row = -(-(-(-wide * c.h // hmax)) // 8), -(-(-(-high * c.v // vmax)) // 8), across * c.h
                c.coef = np.zeros((across * c.h * down * c.v, 64), np.int16)
            picture = Picture(wide, high, parts, quant)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise JpegError("only progressive files with Huffman codes are read")
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            comment = body
        elif marker == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker == 0xDA:
            end = _NEXT_MARKER.search(data, at)
            stop = end.start() if end else len(data)
            if picture is None:
                raise JpegError("a scan before its frame")
            _scan(picture, tables, body, data[at:stop], restart)
            at = stop
    if picture is None or not done:
        raise JpegError("the file ends early")
    picture.comment, picture.adobe = comment, adobe
    return picture


_TABLES: dict[int, Huffman] = {}


def _cached_table(key: int, counts: list[int], symbols: bytes) -> Huffman:
    if key not in _TABLES:
        if len(_TABLES) > 64:
            _TABLES.clear()
        _TABLES[key] = Huffman.build(counts, symbols)
    return _TABLES[key]


def _scan(picture: Picture, tables: dict, head: bytes, data: bytes, restart: int) -> None:
    n = head[0]
    parts = [(next(c for c in picture.components if c.ident == head[1 + 2 * k]), head[2 + 2 * k] >> 4, head[2 + 2 * k] & 15) for k in range(n)]
    first, last, bits = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n]
    high, low = bits >> 4, bits & 15
    pieces = _RESTART.split(data) if restart else [data]
    if n > 1:  # whole MCUs: the stored places of the blocks in their order
        across = parts[0][0].row // parts[0][0].h
        mcus = len(parts[0][0].coef) // (parts[0][0].h * parts[0][0].v)
        order = []
        for c, _, _ in parts:
            m = np.arange(mcus)
            for y in range(c.v):
                for x in range(c.h):
                    order.append(((m // across) * c.v + y) * c.row + (m % across) * c.h + x)
        owners = [k for k, (c, _, _) in enumerate(parts) for _ in range(c.h * c.v)]
        units = mcus
    else:
        c = parts[0][0]
        whole = c.wide == c.row
        order = [np.arange(c.wide * c.high) if whole else (np.arange(c.high)[:, None] * c.row + np.arange(c.wide)).reshape(-1)]
        owners, units = [0], c.wide * c.high
    step = restart or units
    for k, piece in enumerate(pieces):
        a, b = k * step, min((k + 1) * step, units)
        if a >= b:
            break
        src = _Bits(piece)
        if first == 0:
            if last != 0:
                raise JpegError("a scan holds DC or AC, not both")
            if high:
                count = (b - a) * len(order)
                if count > src.size:
                    raise JpegError("a scan ends early")
                new = src.bits[:count].reshape(b - a, len(order)).astype(np.int16) << low
                for j, places in enumerate(order):
                    parts[owners[j]][0].coef[places[a:b], 0] |= new[:, j]
            else:
                diff = _dc_first(src, [tables[(0, parts[o][1])] for o in owners], (b - a) * len(order)).reshape(b - a, len(order))
                for o in range(n):
                    own = [j for j in range(len(order)) if owners[j] == o]
                    value = np.cumsum(diff[:, own].reshape(-1)).reshape(b - a, len(own)) << low
                    for i, j in enumerate(own):
                        parts[o][0].coef[order[j][a:b], 0] = value[:, i]
            continue
        if n > 1 or last < first or last > 63:
            raise JpegError("an AC scan has one component and one band")
        c, _, ac = parts[0]
        straight = c.wide == c.row
        places = slice(a, b) if straight else order[0][a:b]
        if high:
            part = np.ascontiguousarray(c.coef[places, first : last + 1])
            _ac_refine(src, tables[(1, ac)], part, low)
        else:
            part = _ac_first(src, tables[(1, ac)], b - a, last - first + 1) << low
        c.coef[places, first : last + 1] = part


# ---- writer -------------------------------------------------------------------------------------


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def _table(kind: int, ident: int, lengths: dict[int, int]) -> bytes:
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(v == n for v in lengths.values()) for n in range(1, 17))
    return _marker(0xC4, bytes([kind << 4 | ident]) + counts + bytes(symbols))


def _start(components: list[int], tables: int, first: int, last: int, high: int, low: int) -> bytes:
    return _marker(0xDA, bytes([len(components), *(x for c in components for x in (c, tables)), first, last, high << 4 | low]))


#: A payload byte b is the coefficient b + LIFT, so that without its two low bits each has size 7.
LIFT, LOW = 256, 2
#: Blocks per row of a stored picture, so that a side stays under 65,536 samples.
ROW = 8191
#: Most blocks of an end-of-band run.
_RUN = 32767
_DC_CODES = {k: 4 for k in range(8)}
_AC_FIRST = {0x07: 1}
_AC_REFINE = {k << 4: 4 for k in range(15)}
_HEAD = b"\xff\xd8" + _marker(0xDB, b"\x00" + bytes([1]) * 64)
_TABLES_OUT = _table(0, 0, _DC_CODES) + _table(1, 0, _AC_FIRST) + _table(1, 1, _AC_REFINE)


def _dc_code(d: int) -> str:
    size = abs(d).bit_length()
    return f"{size:04b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "")


_DC_TEXT = {d: _dc_code(d) for d in range(-127, 128)}


def _packed(bits: np.ndarray) -> bytes:
    """Bits as bytes, filled up with ones, with a zero after each byte 255."""
    if len(bits) % 8:
        bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _corrections(bits: np.ndarray) -> bytes:
    """A refinement of blocks (rows of bits) in which every coefficient is known: runs and their bits."""
    parts = []
    for a in range(0, len(bits), _RUN):
        own = bits[a : a + _RUN]
        run = len(own).bit_length() - 1
        text = f"{run:04b}" + (f"{len(own) - (1 << run):0{run}b}" if run else "")
        parts += [np.frombuffer(text.encode(), np.uint8) - 48, own.reshape(-1)]
    return _packed(np.concatenate(parts))


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients hold ``payload`` (a positive multiple of 192 bytes).

    Three components without subsampling; 64 bytes go to a block of each in turn, in zigzag order. The
    number of blocks is in the comment; blocks that only fill the last row hold byte 32.
    """
    if not payload or len(payload) % 192:
        raise ValueError("the payload is a positive multiple of 192 bytes")
    n = len(payload) // 192
    across = min(n, ROW)
    down = -(-n // across)
    raw = np.frombuffer(payload, np.uint8)
    if across * down != n:
        raw = np.concatenate([raw, np.full(192 * (across * down - n), 32, np.uint8)])
    blocks = raw.reshape(-1, 3, 64)
    out = [_HEAD, _marker(0xFE, b"blocks %d" % n), _marker(0xC2, struct.pack(">BHHB", 8, 8 * down, 8 * across, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])), _TABLES_OUT]
    high = (blocks >> LOW) + np.uint8(LIFT >> LOW)
    dc = high[:, :, 0].astype(np.int32)
    text = "".join(map(_DC_TEXT.__getitem__, np.diff(dc, axis=0, prepend=0).reshape(-1).tolist()))
    text += "1" * (-len(text) % 8)
    out += [_start([1, 2, 3], 0x00, 0, 0, 0, LOW), int(text, 2).to_bytes(len(text) // 8).replace(b"\xff", b"\xff\x00")]
    for c, first, last in ((0, 1, 5), (0, 6, 63), (1, 1, 63), (2, 1, 63)):
        out += [_start([c + 1], 0x00, first, last, 0, LOW), high[:, c, first : last + 1].tobytes()]
    for low in range(LOW - 1, -1, -1):
        bit = (blocks >> low) & 1
        for c in range(3):
            out += [_start([c + 1], 0x01, 1, 63, low + 1, low), _corrections(bit[:, c, 1:])]
        out += [_start([1, 2, 3], 0x00, 0, 0, low + 1, low), _packed(bit[:, :, 0].reshape(-1))]
    return b"".join(out) + b"\xff\xd9"


def payload_of(picture: Picture) -> bytes:
    """The payload that ``encode_payload`` put into the coefficients."""
    if not picture.comment.startswith(b"blocks "):
        raise JpegError("no payload")
    n = int(picture.comment[7:])
    out = np.empty((n, 3, 64), np.uint8)
    for k, c in enumerate(picture.components):
        out[:, k] = c.coef[:n] - LIFT
    return out.tobytes()
