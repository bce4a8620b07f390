"""Progressive JPEG: a decoder for any such file, and an encoder that stores bytes as coefficients.

The decoder accumulates spectral-selection and successive-approximation scans into coefficient
arrays, inverse-transforms them, upsamples chroma and returns an RGB tensor. Scans whose
Huffman tables have a single code have records of one width and are read as arrays; all
others are read code by code.

The encoder writes 8-bit units losslessly: a byte b of a block is the coefficient whose JPEG
bits of category 8 are b itself (b >= 128: b, else b - 255), the first of each block a DC
value sent bit by bit. Coefficients are never zero, so a scan's records have one width.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

BLOCK = 64
#: Blocks of a 16 x 16 unit: four of luma, one of each chroma component.
UNIT_BLOCKS = 6
_SAMPLING = ((1, 2, 2), (2, 1, 1), (3, 1, 1))
#: Bands of the first AC scans.
_BANDS = ((1, 5), (6, 63))


class JpegError(ValueError):
    pass


def _zigzag() -> np.ndarray:
    """Natural position of each coefficient in scan order: diagonals, alternately up and down."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in order])


ZIGZAG = _zigzag()


def _inverse_transform() -> np.ndarray:
    """64 x 64: coefficients in scan order times this are the samples of the block."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.where(k == 0, math.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * math.pi / 16)
    return np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)[ZIGZAG].astype(np.float32)


_IDCT = _inverse_transform()


# ---------------------------------------------------------------- encoder


def _marker(code: int, body: bytes) -> bytes:
    return bytes((0xFF, code)) + (len(body) + 2).to_bytes(2, "big") + body


def _one_code(kind: int, symbol: int) -> bytes:
    """A Huffman table (0: DC, 1: AC) whose only code, the bit 0, is symbol."""
    return _marker(0xC4, bytes([kind << 4, 1, *[0] * 15, symbol]))


def _scan(components: tuple[int, ...], start: int, end: int, high: int, low: int, bits: bytes) -> bytes:
    head = bytes([len(components), *[x for c in components for x in (c, 0)], start, end, high << 4 | low])
    return _marker(0xDA, head) + bits.replace(b"\xff", b"\xff\x00")


def _packed(bits: np.ndarray) -> bytes:
    """Bits as bytes, the last one filled with ones."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, dtype=np.uint8)])).tobytes()


def _planes(units: np.ndarray, high: int, wide: int) -> list[np.ndarray]:
    """Units (high * wide, 6, 64) as each component's blocks in raster order."""
    grid = units.reshape(high, wide, UNIT_BLOCKS, BLOCK)
    luma = grid[:, :, :4].reshape(high, wide, 2, 2, BLOCK).transpose(0, 2, 1, 3, 4).reshape(-1, BLOCK)
    return [luma, grid[:, :, 4].reshape(-1, BLOCK), grid[:, :, 5].reshape(-1, BLOCK)]


def encode_payload(payload: bytes) -> bytes:
    """A 4:2:0 progressive JPEG whose quantised coefficients are payload, a positive multiple of 64 bytes."""
    if not payload or len(payload) % BLOCK:
        raise JpegError("the payload must be a positive multiple of 64 bytes")
    units = -(-len(payload) // (BLOCK * UNIT_BLOCKS))
    wide = math.isqrt(units - 1) + 1
    high = -(-units // wide)
    data = np.zeros(high * wide * UNIT_BLOCKS * BLOCK, dtype=np.uint8)
    data[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    blocks = data.reshape(-1, BLOCK)
    frame = b"\x08" + (16 * high).to_bytes(2, "big") + (16 * wide).to_bytes(2, "big") + bytes([3])
    frame += bytes(x for c, h, v in _SAMPLING for x in (c, h << 4 | v, 0))
    out = [b"\xff\xd8", _marker(0xFE, b"%d" % len(payload)), _marker(0xDB, bytes([0] + [1] * BLOCK)), _marker(0xC2, frame)]
    # The first DC scan sends the bits above the 8th, which are none; eight more send one bit each.
    out += [_one_code(0, 0), _scan((1, 2, 3), 0, 0, 0, 8, _packed(np.zeros(len(blocks), dtype=np.uint8)))]
    for low in range(7, -1, -1):
        out.append(_scan((1, 2, 3), 0, 0, low + 1, low, _packed(blocks[:, 0] >> low & 1)))
    planes = _planes(blocks.reshape(-1, UNIT_BLOCKS, BLOCK), high, wide)
    # First AC scans leave out the last bit: a record is the code bit 0 and seven bits.
    out.append(_one_code(1, 0x07))
    for component, plane in enumerate(planes, 1):
        for start, end in _BANDS:
            out.append(_scan((component,), start, end, 0, 1, (plane[:, start : end + 1] >> 1).tobytes()))
    # Refinement: the code for the end of the block, then the last bit of each magnitude.
    out.append(_one_code(1, 0x00))
    for component, plane in enumerate(planes, 1):
        last = (plane ^ (plane < 128)) & 1
        last[:, 0] = 0
        out.append(_scan((component,), 1, 63, 1, 0, _packed(last.reshape(-1))))
    return b"".join([*out, b"\xff\xd9"])


# ---------------------------------------------------------------- decoder


@dataclass
class Component:
    identity: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks in a row of its own scans
    high: int = 0
    coefficients: np.ndarray = field(default=None, repr=False)  # (rows, columns, 64), scan order, whole units


@dataclass
class Frame:
    width: int
    height: int
    components: list[Component]
    quantisers: dict[int, np.ndarray]
    comment: bytes = b""


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            if self.at > len(self.data) + 8:
                raise JpegError("a scan ends early")
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.n += 8
        self.n -= n
        out = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return out

    def code(self, table: dict[tuple[int, int], int]) -> int:
        word = 0
        for length in range(1, 17):
            word = word << 1 | self.take(1)
            if (symbol := table.get((length, word))) is not None:
                return symbol
        raise JpegError("no such code")

    def signed(self, size: int) -> int:
        if not size:
            return 0
        raw = self.take(size)
        return raw if raw >> (size - 1) else raw - (1 << size) + 1


def _huffman(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    table, word, at = {}, 0, 0
    for length, n in enumerate(lengths, 1):
        for _ in range(n):
            table[length, word] = symbols[at]
            word, at = word + 1, at + 1
        word <<= 1
    return table


def _only(table: dict[tuple[int, int], int]) -> int | None:
    """The symbol of a table whose only code is the bit 0."""
    return table[1, 0] if len(table) == 1 and (1, 0) in table else None


def _fixed(data: bytes, rows: int, bits: int) -> np.ndarray:
    """The first rows * bits bits of data as an array (rows, bits)."""
    if len(data) * 8 < rows * bits:
        raise JpegError("a scan ends early")
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=-(-rows * bits // 8)), count=rows * bits).reshape(rows, bits)


def _order(components: list[Component]) -> tuple[list[tuple[Component, np.ndarray]], int]:
    """The blocks of a scan: for each component its flat block numbers (unit, block in the unit), and the number of units."""
    if len(components) == 1:
        c = components[0]
        rows, columns = np.divmod(np.arange(c.wide * c.high), c.wide)
        return [(c, (rows * c.coefficients.shape[1] + columns)[:, None])], c.wide * c.high
    out = []
    for c in components:
        rows, columns = c.coefficients.shape[0] // c.v, c.coefficients.shape[1] // c.h
        flat = np.arange(rows * c.v * columns * c.h).reshape(rows, c.v, columns, c.h)
        out.append((c, flat.transpose(0, 2, 1, 3).reshape(rows * columns, c.v * c.h)))
    return out, len(out[0][1])


def _dc_scan(data: bytes, parts, first: int, last: int, tables, high: int, low: int, before: dict[int, int]) -> None:
    """Units first to last of a DC scan."""
    n = last - first
    width = sum(blocks.shape[1] for _, blocks in parts)
    if high:
        bits, at = _fixed(data, n, width), 0
        for c, blocks in parts:
            own = blocks[first:last]
            flat = c.coefficients.reshape(-1, BLOCK)
            flat[own, 0] |= bits[:, at : at + own.shape[1]].astype(np.int32) << low
            at += own.shape[1]
        return
    if all(_only(tables[c.identity]) == 0 for c, _ in parts):  # no value differs from the one before
        _fixed(data, n, width)
        for c, blocks in parts:
            c.coefficients.reshape(-1, BLOCK)[blocks[first:last], 0] = before.get(c.identity, 0) << low
        return
    bits = _Bits(data)
    for unit in range(first, last):
        for c, blocks in parts:
            flat = c.coefficients.reshape(-1, BLOCK)
            for block in blocks[unit]:
                before[c.identity] = before.get(c.identity, 0) + bits.signed(bits.code(tables[c.identity]))
                flat[block, 0] = before[c.identity] << low


def _ac_first(data: bytes, flat: np.ndarray, blocks: np.ndarray, table, start: int, end: int, low: int) -> None:
    symbol, n = _only(table), end - start + 1
    if symbol is not None and 0 < symbol < 16:  # every record is a code bit and so many bits of a value
        if symbol == 7:
            if len(data) < len(blocks) * n:
                raise JpegError("a scan ends early")
            raw = np.frombuffer(data, dtype=np.uint8, count=len(blocks) * n).astype(np.int32)
        else:
            bits = _fixed(data, len(blocks) * n, 1 + symbol)[:, 1:].astype(np.int32)
            raw = bits @ (1 << np.arange(symbol - 1, -1, -1, dtype=np.int32))
        value = np.where(raw >> (symbol - 1), raw, raw - (1 << symbol) + 1) * (1 << low)
        flat[blocks, start : end + 1] = value.reshape(len(blocks), n)
        return
    bits, skip = _Bits(data), 0
    for block in blocks:
        if skip:
            skip -= 1
            continue
        k = start
        while k <= end:
            run, size = divmod(bits.code(table), 16)
            if size:
                k += run
                if k > end:
                    raise JpegError("a run leaves its band")
                flat[block, k] = bits.signed(size) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                skip = (1 << run) + bits.take(run) - 1
                break


def _ac_refine(data: bytes, flat: np.ndarray, blocks: np.ndarray, table, start: int, end: int, low: int) -> None:
    n, step = end - start + 1, 1 << low
    if _only(table) == 0 and (flat[blocks, start : end + 1] != 0).all():  # a code bit and a bit for each value
        bits = _fixed(data, len(blocks), 1 + n)[:, 1:].astype(np.int32)
        own = flat[blocks, start : end + 1]
        flat[blocks, start : end + 1] = own + np.where(own > 0, step, -step) * bits
        return
    bits, skip = _Bits(data), 0

    def correct(row: np.ndarray, k: int) -> None:
        if bits.take(1) and not abs(int(row[k])) & step:
            row[k] += step if row[k] > 0 else -step

    for block in blocks:
        row, k = flat[block], start
        if not skip:
            while k <= end:
                run, size = divmod(bits.code(table), 16)
                value = 0
                if size:
                    value = step if bits.take(1) else -step
                elif run < 15:
                    skip = (1 << run) + bits.take(run)
                    break
                while k <= end:
                    if row[k]:
                        correct(row, k)
                    elif run:
                        run -= 1
                    else:
                        row[k] = value
                        k += 1
                        break
                    k += 1
        if skip:
            for j in range(k, end + 1):
                if row[j]:
                    correct(row, j)
            skip -= 1


def _runs(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The entropy-coded data from at, cut at restart markers and unstuffed, and the next marker's place."""
    runs, begun = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise JpegError("the file ends in a scan")
        if data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            runs.append(data[begun:at].replace(b"\xff\x00", b"\xff"))
            at += 2
            begun = at
        else:
            runs.append(data[begun:at].replace(b"\xff\x00", b"\xff"))
            return runs, at


def decode_coefficients(data: bytes) -> Frame:
    """Read all scans of a progressive JPEG into its components' coefficient arrays."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no JPEG file")
    at, frame, restart, comment = 2, None, 0, b""
    quantisers: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
    while True:
        while at + 1 < len(data) and data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        if at + 1 >= len(data) or data[at] != 0xFF:
            raise JpegError("a marker is missing")
        code = data[at + 1]
        if code == 0xD9:
            if frame is None:
                raise JpegError("no frame")
            frame.comment = comment
            return frame
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if code == 0xDB:
            while body:
                wide, t = divmod(body[0], 16)
                n = BLOCK * (1 + wide)
                quantisers[t] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + n :]
        elif code == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[divmod(body[0], 16)] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif code == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif code == 0xFE:
            comment = body
        elif code == 0xC2:
            high, wide = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            own = [Component(body[i], *divmod(body[i + 1], 16), body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            if not high or not wide or len(own) not in (1, 3):
                raise JpegError("a frame must have a size and one or three components")
            h, v = max(c.h for c in own), max(c.v for c in own)
            for c in own:
                c.wide, c.high = -(-wide * c.h // (8 * h)), -(-high * c.v // (8 * v))
                c.coefficients = np.zeros((-(-high // (8 * v)) * c.v, -(-wide // (8 * h)) * c.h, BLOCK), dtype=np.int32)
            frame = Frame(wide, high, own, quantisers)
        elif 0xC0 <= code <= 0xCF and code not in (0xC8, 0xCC):
            raise JpegError("not a progressive Huffman-coded file")
        elif code == 0xDA:
            if frame is None:
                raise JpegError("a scan before the frame")
            n = body[0]
            by_id = {c.identity: c for c in frame.components}
            chosen = [(by_id[body[1 + 2 * i]], *divmod(body[2 + 2 * i], 16)) for i in range(n)]
            (start, end), (high, low) = body[1 + 2 * n : 3 + 2 * n], divmod(body[3 + 2 * n], 16)
            runs, at = _runs(data, at)
            parts, units = _order([c for c, _, _ in chosen])
            for i, run in enumerate(runs):
                first, last = (i * restart, min(units, (i + 1) * restart)) if restart else (0, units)
                if start == 0:
                    _dc_scan(run, parts, first, last, {c.identity: tables.get((0, dc), {}) for c, dc, _ in chosen}, high, low, {})
                else:
                    c, blocks = parts[0]
                    read = _ac_refine if high else _ac_first
                    read(run, c.coefficients.reshape(-1, BLOCK), blocks[first:last, 0], tables.get((1, chosen[0][2]), {}), start, end, low)


def to_rgb(frame: Frame) -> np.ndarray:
    """The full-resolution RGB tensor (height, width, 3) of a decoded frame."""
    planes = []
    h, v = max(c.h for c in frame.components), max(c.v for c in frame.components)
    for c in frame.components:
        rows, columns = c.coefficients.shape[:2]
        scaled = c.coefficients.reshape(-1, BLOCK).astype(np.float32) * frame.quantisers[c.table]
        samples = (scaled @ _IDCT).reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * columns)
        samples = np.clip(samples + np.float32(128), 0, 255)
        if c.v < v or c.h < h:
            samples = np.repeat(np.repeat(samples, v // c.v, axis=0), h // c.h, axis=1)
        planes.append(samples[: frame.height, : frame.width])
    if len(planes) == 1:
        return np.repeat(np.rint(planes[0]).astype(np.uint8)[:, :, None], 3, axis=2)
    y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
    out = np.empty((*y.shape, 3), dtype=np.uint8)
    for k, plane in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
        out[:, :, k] = np.rint(np.clip(plane, 0, 255))
    return out


def stored_payload(frame: Frame) -> bytes:
    """The bytes that encode_payload stored as the frame's coefficients."""
    luma, cb, cr = (c.coefficients for c in frame.components)
    high, wide = cb.shape[:2]
    units = np.empty((high, wide, UNIT_BLOCKS, BLOCK), dtype=np.int32)
    units[:, :, :4] = luma.reshape(high, 2, wide, 2, BLOCK).transpose(0, 2, 1, 3, 4).reshape(high, wide, 4, BLOCK)
    units[:, :, 4], units[:, :, 5] = cb, cr
    units[..., 1:] += 255 * (units[..., 1:] < 0)
    return units.astype(np.uint8).tobytes()[: int(frame.comment)]
