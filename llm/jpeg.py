"""Progressive JPEG in numpy: coefficients to a file and back, and pixels from coefficients.

A file is read scan by scan: spectral selection fills ranges of coefficients, successive
approximation adds lower bits to them, all into one coefficient array per component. Scans whose
Huffman table makes every code equally wide are read as arrays; others symbol by symbol.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np

#: Zigzag order of the 64 coefficients (fixed values): by anti-diagonals, turning at each.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_SCALE = 1 << 16
_one = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
#: Whole numbers, so that sums are exact in any order: coefficient (zigzag) to pixel.
_INVERSE = np.rint(np.einsum("ux,vy->uvxy", _one, _one).reshape(64, 64) * _SCALE)[ZIGZAG]
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _stuffed(bits: np.ndarray) -> bytes:
    """Bits as bytes, ones after the last, a zero byte after each 0xFF."""
    if len(bits) % 8:
        bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _table(kind: int, symbols: list[int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A Huffman table with codes of one length (none of ones only), and (code, length) by symbol."""
    length = len(symbols).bit_length()
    counts = [0] * 16
    counts[length - 1] = len(symbols)
    return _segment(0xC4, bytes([kind, *counts, *symbols])), {s: (i, length) for i, s in enumerate(symbols)}


def encode(coefficients: list[np.ndarray], height: int, width: int, comment: bytes = b"", cut: int = 5) -> bytes:
    """A progressive file of three components, each (blocks, 64) in zigzag order, the first with twice as many blocks (4:2:2) or as many (4:4:4).

    Magnitudes are 128 to 255. Scans: DC of each component, restarted at each block so that a value is
    coded as itself; AC but the lowest bit, of the first component in two spectral bands, of the others
    in one; then the lowest bits of each component.
    """
    wide = len(coefficients[0]) // len(coefficients[1])
    frame = struct.pack(">BHHB", 8, height, width, 3) + bytes([1, wide << 4 | 1, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, comment), _HEAD, _segment(0xC2, frame), _DC]
    for c, values in enumerate(coefficients):
        # the code 00000000 and eight bits, then a restart
        block = np.zeros((len(values), 4), np.uint8)
        block[:, 1] = values[:, 0] + np.where(values[:, 0] < 0, 255, 0)
        block[:, 2] = 0xFF
        block[:, 3] = 0xD0 + np.arange(len(values)) % 8
        out.append(_segment(0xDA, bytes([1, c + 1, 0, 0, 0, 0])))
        if (block[:, 1] == 0xFF).any():
            out.append(b"".join(x[:2].tobytes().replace(b"\xff", b"\xff\x00") + x[2:].tobytes() for x in block)[:-2])
        else:
            out.append(block.tobytes()[:-2])
    out.append(_AC)
    # the code 0 and seven bits: a byte for each value
    size = [np.abs(c) for c in coefficients]
    first = [np.where(c < 0, 127 - (m >> 1), m >> 1).astype(np.uint8) for c, m in zip(coefficients, size, strict=True)]
    for c, lo, hi in [(0, 1, cut), (0, cut + 1, 63), (1, 1, 63), (2, 1, 63)]:
        out += [_segment(0xDA, bytes([1, c + 1, 0, lo, hi, 0x01])), first[c][:, lo : hi + 1].tobytes()]
    # no coefficient is new: runs of blocks without, each followed by the blocks' correction bits
    runs = [[32767] * (len(c) // 32767) + ([len(c) % 32767] if len(c) % 32767 else []) for c in coefficients]
    table, codes = _table(0x10, sorted({(r.bit_length() - 1) << 4 for some in runs for r in some}))
    out.append(table)
    for c, some in enumerate(runs):
        low, at, bits = (size[c][:, 1:] & 1).astype(np.uint8).ravel(), 0, []
        for r in some:
            k = r.bit_length() - 1
            code, length = codes[k << 4]
            text = format(code, f"0{length}b") + (format(r - (1 << k), f"0{k}b") if k else "")
            bits += [np.frombuffer(text.encode(), np.uint8) - 48, low[at * 63 : (at + r) * 63]]
            at += r
        out += [_segment(0xDA, bytes([1, c + 1, 0, 1, 63, 0x10])), _stuffed(np.concatenate(bits))]
    out.append(b"\xff\xd9")
    return b"".join(out)


_HEAD = _segment(0xDB, bytes([0]) + b"\x01" * 64)
_DC = _segment(0xC4, bytes([0x00, *[0] * 7, 1, *[0] * 8, 8])) + _segment(0xDD, b"\x00\x01")
_AC = _segment(0xDD, b"\x00\x00") + _segment(0xC4, bytes([0x10, 1, *[0] * 15, 7]))


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)), 0

    def take(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + n].tolist():
            value = value << 1 | b
        self.at += n
        return value

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | int(self.bits[self.at])
            self.at += 1
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    def number(self, size: int) -> int:
        return _extended(self.take(size), size) if size else 0


def _extended(value: int, size: int) -> int:
    return value if value >> (size - 1) else value - (1 << size) + 1


@dataclass
class Image:
    height: int
    width: int
    sampling: list[tuple[int, int]]
    blocks: list[np.ndarray]  # (rows of blocks, blocks of a row, 64), zigzag order
    quantization: list[np.ndarray]
    comment: bytes


def decode(data: bytes) -> Image:
    """The coefficients that the scans of a progressive file add up to."""
    at, quant, huffman, restart, comment = 2, {}, {}, 0, b""
    image = ids = tables = None
    while data[at + 1] != 0xD9:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                quant[body[0] & 15] = np.frombuffer(body[1:65], np.uint8).astype(float)
                body = body[65:]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC4:
            while body:
                counts, symbols, code, k = body[1:17], body[17:], 0, 0
                table = {}
                for length, count in enumerate(counts, 1):
                    for _ in range(count):
                        table[length, code] = symbols[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                huffman[body[0]] = table
                body = body[17 + k :]
        elif marker == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            ids, sampling, tables = [], [], []
            for k in range(n):
                c, hv, t = body[6 + 3 * k : 9 + 3 * k]
                ids.append(c)
                sampling.append((hv >> 4, hv & 15))
                tables.append(t)
            wide, tall = max(h for h, _ in sampling), max(v for _, v in sampling)
            units = -(-height // (8 * tall)), -(-width // (8 * wide))
            image = Image(height, width, sampling, [np.zeros((units[0] * v, units[1] * h, 64), np.int32) for h, v in sampling], [quant[t] for t in tables], comment)
        elif marker == 0xDA:
            n = body[0]
            scan = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k]) for k in range(n)]
            lo, hi, approx = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
            end = _MARKER.search(data, at).start()
            _scan(image, scan, huffman, restart, lo, hi, approx >> 4, approx & 15, data[at:end])
            at = end
    return image


def _places(image: Image, scan: list) -> list[np.ndarray]:
    """Block numbers of each component of a scan in the order they are coded; interleaved scans go unit by unit."""
    wide, tall = max(h for h, _ in image.sampling), max(v for _, v in image.sampling)
    out = []
    for c, _ in scan:
        rows, columns = image.blocks[c].shape[:2]
        numbers = np.arange(rows * columns).reshape(rows, columns)
        h, v = image.sampling[c]
        if len(scan) == 1:
            numbers = numbers[: -(-(-(-image.height * v // tall)) // 8), : -(-(-(-image.width * h // wide)) // 8)]
            out.append(numbers.reshape(-1, 1))
        else:
            out.append(numbers.reshape(rows // v, v, columns // h, h).swapaxes(1, 2).reshape(-1, v * h))
    return out


def _scan(image: Image, scan: list, huffman: dict, restart: int, lo: int, hi: int, high: int, low: int, data: bytes) -> None:
    wide, tall = max(h for h, _ in image.sampling), max(v for _, v in image.sampling)
    # block order is coding order
    simple = (len(scan) == 1 or len(set(image.sampling)) == 1) and image.height % (8 * tall) == 0 and image.width % (8 * wide) == 0
    places = [np.arange(len(image.blocks[scan[0][0]]) * image.blocks[scan[0][0]].shape[1]).reshape(-1, 1)] * len(scan) if simple else _places(image, scan)
    flat = [image.blocks[c].reshape(-1, 64) for c, _ in scan]
    units = len(places[0])
    parts = [data]
    if lo == 0:
        # all DC values of a unit side by side
        which = [(k, j) for k in range(len(scan)) for j in range(places[k].shape[1])]
        if high:
            bits = _Bits(data).bits if not restart else np.concatenate([_Bits(p).bits[: len(which) * restart] for p in _RESTART.split(data)])
            bits = bits[: units * len(which)].reshape(units, -1).astype(np.int32)
            for column, (k, j) in enumerate(which):
                flat[k][places[k][:, j], 0] |= bits[:, column] << low
            return
        found = [huffman[t >> 4] for _, t in scan]
        shapes = [(next(iter(t))[0], next(iter(t.values()))) for t in found] if all(len(t) == 1 for t in found) else []
        taken = -(-sum(map(sum, shapes)) // 8)
        if restart == 1 and shapes and all(p.shape[1] == 1 for p in places) and taken <= 4:
            words = _units(data, units, taken)
            if words is not None:
                shift = 8 * taken
                for k, (length, size) in enumerate(shapes):
                    shift -= length + size
                    flat[k][places[k][:, 0], 0] = _extend((words >> shift & ((1 << size) - 1)).astype(np.int32), size) << low
                return
        parts = _RESTART.split(data) if restart else parts
        last = [0] * len(scan)
        for u in range(units):
            if u == 0 or restart and u % restart == 0:
                reader, last = _Bits(parts[u // restart if restart else 0]), [0] * len(scan)
            for k, j in which:
                last[k] += reader.number(reader.symbol(found[k]))
                flat[k][places[k][u, j], 0] = last[k] << low
        return
    table, block, order, band = huffman[0x10 | scan[0][1] & 15], flat[0], places[0][:, 0], hi - lo + 1
    whole = simple and len(order) == len(block)
    for p, data_part in enumerate(_RESTART.split(data) if restart else parts):
        mine = order[p * restart : (p + 1) * restart] if restart else order
        (length, _), symbol = next(iter(table.items())) if len(table) == 1 else ((0, 0), 0)
        if not high and length and symbol and symbol < 16:
            # one code, no run of zeros: equally wide numbers
            values = _even(data_part, len(mine) * band, length, symbol).reshape(len(mine), band) << low
            if whole and not restart:
                block[:, lo : hi + 1] = values
            else:
                block[mine, lo : hi + 1] = values
            continue
        reader = _Bits(data_part)
        run, i = 0, 0
        while i < len(mine):
            if not run:
                if high:
                    run = _refine(reader, table, block[mine[i]], lo, hi, 1 << low)
                else:
                    run = _first(reader, table, block[mine[i]], lo, hi, low)
                i += 1 if not run else 0
                continue
            # the run's blocks, this one included, have corrections only
            some = mine[i : i + run]
            if high:
                all_ = whole and len(some) == len(block)
                now = block[:, lo : hi + 1] if all_ else block[some, lo : hi + 1]
                start = _open_at.pop(id(reader), lo) - lo
                set_ = now != 0
                set_[0, :start] = False
                n = int(set_.sum())
                bits = reader.bits[reader.at : reader.at + n].astype(np.int32)
                reader.at += n
                if n == now.size:
                    bits = bits.reshape(now.shape)
                    bits[now < 0] *= -1
                    now += bits << low
                else:
                    now[set_] += np.where(now[set_] > 0, bits, -bits) << low
                if not all_:
                    block[some, lo : hi + 1] = now
            i += len(some)
            run = 0


#: Where the block that begins a run of ends has been read up to, by reader.
_open_at: dict[int, int] = {}


def _units(data: bytes, units: int, size: int) -> np.ndarray | None:
    """So many bytes (4 at most) of each restart interval as a number, if all have as many."""
    raw = np.frombuffer(data + b"\xff\xd0", np.uint8)
    whole = len(raw) == (size + 2) * units
    if whole:
        rows = raw.reshape(units, size + 2)
        whole = (rows[:, size] == 0xFF).all() and (rows[:, size + 1] & 0xF8 == 0xD0).all() and not (rows[:, :size] == 0xFF).any()
    if not whole:
        parts = [p.replace(b"\xff\x00", b"\xff") for p in _RESTART.split(data)]
        if len(parts) != units or any(len(p) != size for p in parts):
            return None
        rows = np.frombuffer(b"".join(parts), np.uint8).reshape(units, size)
    out = np.zeros(units, np.int64)
    for k in range(size):
        out = out << 8 | rows[:, k]
    return out


def _even(data: bytes, n: int, length: int, size: int) -> np.ndarray:
    """n numbers of ``size`` bits, each after a code of ``length`` bits."""
    raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)
    if length + size == 8:
        return _extend((raw[:n] & ((1 << size) - 1)).astype(np.int32), size)
    bits = np.unpackbits(raw)[: n * (length + size)].reshape(n, length + size)[:, length:]
    return _extend(bits.astype(np.int32) @ (1 << np.arange(size)[::-1]).astype(np.int32), size)


def _extend(value: np.ndarray, size: int) -> np.ndarray:
    value -= ((1 << size) - 1) * (value < 1 << (size - 1))
    return value


def _first(reader: _Bits, table: dict, block: np.ndarray, lo: int, hi: int, low: int) -> int:
    """Reads a block of a first AC scan; the length of a run of ends that begins in it, or 0."""
    k = lo
    while k <= hi:
        run, size = divmod(reader.symbol(table), 16)
        if size:
            k += run
            block[k] = reader.number(size) << low
            k += 1
        elif run == 15:
            k += 16
        else:
            return (1 << run) + (reader.take(run) if run else 0)
    return 0


def _refine(reader: _Bits, table: dict, block: np.ndarray, lo: int, hi: int, unit: int) -> int:
    """The same for a refining AC scan."""
    k = lo
    while k <= hi:
        run, size = divmod(reader.symbol(table), 16)
        if not size and run < 15:
            _open_at[id(reader)] = k
            return (1 << run) + (reader.take(run) if run else 0)
        value = (unit if reader.take(1) else -unit) if size else 0
        while k <= hi:
            if block[k]:
                if reader.take(1):
                    block[k] += unit if block[k] > 0 else -unit
            elif run == 0:
                if value:
                    block[k] = value
                k += 1
                break
            else:
                run -= 1
            k += 1
    return 0


def pixels(image: Image) -> np.ndarray:
    """The (height, width, 3) RGB tensor of a three-component image, chroma repeated to full size."""
    wide, tall = max(h for h, _ in image.sampling), max(v for _, v in image.sampling)
    # all components in one product
    flat = np.concatenate([b.reshape(-1, 64) * q for b, q in zip(image.blocks, image.quantization, strict=True)]) @ _INVERSE
    flat *= 1 / _SCALE
    flat += 128.5
    np.floor(np.clip(flat, 0, 255.5, out=flat), out=flat)
    planes, at = [], 0
    for blocks, (h, v) in zip(image.blocks, image.sampling, strict=True):
        rows, columns = blocks.shape[:2]
        plane = flat[at : at + rows * columns].astype(np.int32).reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8)
        at += rows * columns
        if (h, v) != (wide, tall):
            plane = plane.repeat(tall // v, axis=0).repeat(wide // h, axis=1)
        planes.append(plane[: image.height, : image.width])
    return _rgb(*planes)


def _rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    cb, cr = cb - 128, cr - 128
    rgb = np.empty((*y.shape, 3), np.uint8)
    # the conversion in 16-bit fixed point (fixed values)
    for k, x in enumerate((cr * 91881, cb * -22554 - cr * 46802, cb * 116130)):
        x += 32768
        x >>= 16
        x += y
        np.maximum(x, 0, out=x)
        rgb[..., k] = np.minimum(x, 255, out=x)
    return rgb
