"""Baseline JPEG in numpy: marker parsing, Huffman decoding of many restart segments in lockstep, DC thumbnails.

The decoder takes 8-bit baseline (SOF0) images with one interleaved scan: grey or colour, any sampling, Huffman tables and
restart interval. ``store_payload`` writes bytes losslessly as such an image: a byte b is the coefficient of category 8 whose
magnitude bits are b, the only category in the Huffman tables, so that a coefficient takes one code bit and those eight; each
8x8 block holds 64 bytes in zigzag order and is a restart interval of its own, which the decoder can then read side by side.
"""

from __future__ import annotations

import hashlib
import math
import struct
from dataclasses import dataclass, field

import numpy as np

SOI, EOI, SOF0, DHT, DQT, DRI, SOS, COM = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE


#: What broken bytes can raise in ``parse``, ``decode`` and ``thumbnail``.
BROKEN = (ValueError, IndexError, KeyError, TypeError, ZeroDivisionError, OverflowError, struct.error)


@dataclass
class Image:
    width: int
    height: int
    parts: list[tuple[int, int, int, int]]  # component id, horizontal and vertical sampling, quantisation table
    quant: dict[int, np.ndarray]
    scan: list[tuple[int, int, int]]  # part's index, DC table, AC table
    huff: dict[tuple[int, int], bytes]
    every: int  # MCUs in a restart interval, 0: one interval
    comment: bytes
    data: np.ndarray  # the entropy-coded bytes, without stuffing
    cuts: np.ndarray  # where restart segments begin in data
    coefs: np.ndarray | None = field(default=None)  # blocks in scan order x 64 in zigzag order

    @property
    def mcu(self) -> list[int]:
        """Part index of each block of an MCU."""
        if len(self.scan) == 1:
            return [self.scan[0][0]]
        return [p for p, _, _ in self.scan for _ in range(self.parts[p][1] * self.parts[p][2])]

    @property
    def grid(self) -> tuple[int, int]:
        """MCUs down and across."""
        h, v = (8, 8)
        if len(self.scan) > 1:
            h, v = 8 * max(p[1] for p in self.parts), 8 * max(p[2] for p in self.parts)
        return -(-self.height // v), -(-self.width // h)


def parse(data: bytes | memoryview) -> Image:
    """Reads the markers and takes the stuffing out of the scan. Raises ValueError for what is not baseline."""
    data = memoryview(data)
    if bytes(data[:2]) != b"\xff\xd8":
        raise ValueError("no SOI")
    quant, huff, every, comment, frame, at = {}, {}, 0, b"", None, 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("marker expected")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        (n,) = struct.unpack(">H", data[at + 2 : at + 4])
        body = bytes(data[at + 4 : at + 2 + n])
        at += 2 + n
        if kind == DQT:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                quant[k] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif kind == DHT:
            while body:
                m = 17 + sum(body[1:17])
                huff[body[0] >> 4, body[0] & 15] = body[1:m]
                body = body[m:]
        elif kind == DRI:
            (every,) = struct.unpack(">H", body)
        elif kind == COM:
            comment = body
        elif kind == SOF0:
            bits, height, width, k = struct.unpack(">BHHB", body[:6])
            if bits != 8:
                raise ValueError("not 8 bits a sample")
            frame = width, height, [(c, s >> 4, s & 15, q) for c, s, q in zip(*[iter(body[6 : 6 + 3 * k])] * 3, strict=True)]
        elif 0xC0 <= kind <= 0xCF and kind not in (DHT, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif kind == SOS:
            break
        elif kind == EOI:
            raise ValueError("no scan")
    if frame is None:
        raise ValueError("no frame")
    ids = [p[0] for p in frame[2]]
    scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
    if len(scan) != len(ids):
        raise ValueError("more than one scan")
    raw = np.frombuffer(data, np.uint8, offset=at)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    ends = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
    if not len(ends):
        raise ValueError("no EOI")
    raw, ff, after = raw[: ends[0]], ff[ff < ends[0]], after[ff < ends[0]]
    keep = np.ones(len(raw), bool)
    keep[ff + 1] = False
    rst = ff[after != 0]
    keep[rst] = False
    kept_before = np.cumsum(keep) - keep
    return Image(*frame, quant, scan, huff, every, comment, raw[keep], np.concatenate([[0], kept_before[rst]]).astype(np.int64))


def lookup(table: bytes) -> np.ndarray:
    """For each 16 bits: code length * 256 + symbol, 0 where no code fits."""
    out, code, k = np.zeros(65536, np.int32), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            lo = code << (16 - n)
            out[lo : lo + (1 << (16 - n))] = n * 256 + table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def decode(images: list[Image]) -> None:
    """Fills in ``coefs``: one symbol of every restart segment of all images at a time. Broken data raise ValueError."""
    tables: dict[bytes, int] = {}
    luts: list[np.ndarray] = []

    def base(img: Image, kind: int, k: int) -> int:
        if (kind, k) not in img.huff:
            raise ValueError("Huffman table missing")
        t = img.huff[kind, k]
        if t not in tables:
            tables[t] = len(luts) << 16
            luts.append(lookup(t))
        return tables[t]

    layouts: dict[tuple, int] = {}
    rows: list[tuple] = []
    pos, first, count, layout, at, blocks = [], [], [], [], 0, 0
    for img in images:
        key = tuple((p, base(img, 0, d), base(img, 1, a)) for p, d, a in img.scan for _ in range(img.mcu.count(p)))
        kind = layouts.setdefault(key, len(layouts))
        if kind == len(rows):
            rows.append(key)
        down, across = img.grid
        total, per = down * across, img.every or down * across
        n = -(-total // per)
        if len(img.cuts) < n:
            raise ValueError("restart segments missing")
        if total * len(key) > 4 * len(img.data):  # a block takes two bits at least; a broken header names any size
            raise ValueError("too few bytes")
        pos.append((img.cuts[:n] + at) * 8)
        first.append(blocks + np.arange(n, dtype=np.int64) * per * len(key))
        count.append(np.minimum(per, total - np.arange(n, dtype=np.int64) * per) * len(key))
        layout.append(np.full(n, kind))
        img.coefs = (blocks, blocks + total * len(key))  # type: ignore[assignment]
        at, blocks = at + len(img.data), blocks + total * len(key)
    buf = np.concatenate([i.data for i in images] + [np.zeros(8, np.uint8)]).astype(np.int64)
    window = buf[:-4] << 32
    for i in range(1, 5):
        window |= buf[i : len(buf) - 4 + i] << (32 - 8 * i)
    most = max(len(r) for r in rows)
    part = np.array([[r[j % len(r)][0] for j in range(most)] for r in rows])
    dc_at = np.array([[r[j % len(r)][1] for j in range(most)] for r in rows])
    ac_at = np.array([[r[j % len(r)][2] for j in range(most)] for r in rows])
    per_mcu = np.array([len(r) for r in rows])
    lut = np.concatenate(luts)
    pos, first, count, layout = map(np.concatenate, (pos, first, count, layout))
    out = np.zeros((blocks, 64), np.int16)
    flat = out.reshape(-1)
    k, done = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    before = np.zeros((len(pos), int(part.max()) + 1), np.int64)
    lane = np.arange(len(pos))
    last_bit = 8 * len(buf) - 64
    slot = np.zeros(len(pos), np.int64)
    dc, ac, own = dc_at[layout, slot], ac_at[layout, slot], part[layout, slot]
    while len(lane):
        bits, off = window[pos >> 3], pos & 7
        entry = lut[np.where(k == 0, dc, ac) + ((bits >> (24 - off)) & 0xFFFF)]
        length, symbol = entry >> 8, entry & 255
        if (length == 0).any() or pos.max() > last_bit:
            raise ValueError("no such code")
        size = symbol & 15
        value = (bits >> (40 - off - length - size)) & ((1 << size) - 1)
        value -= np.where((value << 1) >> size == 0, (1 << size) - 1, 0)
        pos = pos + length + size
        dcs = k == 0
        if dcs.any():
            i = np.flatnonzero(dcs)
            before[i, own[i]] += value[i]
            value[i] = before[i, own[i]]
            k = np.where(dcs, 0, k + (symbol >> 4))
            stop = ~dcs & (symbol == 0)
        else:
            k = k + (symbol >> 4)
            stop = symbol == 0
        put = (size > 0) & (k < 64) | dcs
        if put.all():
            flat[(first + done) * 64 + k] = value
        else:
            flat[((first + done) * 64 + k)[put]] = value[put]
        k = np.where(stop, 64, k + 1)
        over = k >= 64
        if over.any():
            done = done + over
            k = np.where(over, 0, k)
            left = done < count
            if not left.all():
                lane, pos, first, count, layout, k, done, before = (x[left] for x in (lane, pos, first, count, layout, k, done, before))
            slot = done % per_mcu[layout]
            dc, ac, own = dc_at[layout, slot], ac_at[layout, slot], part[layout, slot]
    for img in images:
        lo, hi = img.coefs  # type: ignore[misc]
        img.coefs = out[lo:hi]


def thumbnail(img: Image) -> np.ndarray:
    """One 8-bit grey pixel for each luminance block, from the DC coefficients alone."""
    down, across = img.grid
    mcu, (_, h, v, q) = img.mcu, img.parts[img.scan[0][0]]
    h, v = (1, 1) if len(img.scan) == 1 else (h, v)
    dc = img.coefs[:, 0].reshape(down, across, len(mcu))[:, :, : h * v].astype(np.int32)
    dc = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    pixels = np.clip((dc * int(img.quant[q][0]) + 1024) >> 3, 0, 255).astype(np.uint8)
    rows, columns = -(-img.height // 8), -(-img.width // 8)
    return pixels[: max(1, -(-rows * v // max(v, 1))), : max(1, columns)]


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits: whether brightness rises from one to the next of 8 rows by 9 columns taken evenly."""
    rows, columns = np.arange(8) * pixels.shape[0] // 8, np.arange(9) * pixels.shape[1] // 9
    small = pixels[rows][:, columns].astype(np.int16)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


#: One code, the bit 0, for category 8 (DC) and for run 0, category 8 (AC).
ONE_CODE = bytes([1, *[0] * 15, 8])
HEAD = (
    segment(DQT, bytes([0, 4, *[1] * 63]))
    + segment(DHT, b"\x00" + ONE_CODE + b"\x10" + ONE_CODE)
    + segment(DRI, struct.pack(">H", 1))
)
SCAN = segment(SOS, bytes([1, 1, 0x00, 0, 63, 0]))


def grid_of(blocks: int) -> tuple[int, int]:
    """Blocks down and across, about square; up to 4 GB fit the 65,535 pixels a side."""
    across = math.isqrt(blocks - 1) + 1
    return -(-blocks // across), across


def store_payloads(payloads: list[np.ndarray]) -> list[bytes]:
    """Images of payloads, each of a positive multiple of 64 bytes."""
    grids = [grid_of(len(p) // 64) for p in payloads]
    starts = np.concatenate([[0], np.cumsum([d * a for d, a in grids])]).astype(np.int64)
    raw = np.zeros((int(starts[-1]), 8, 8), np.uint8)
    flat = raw.reshape(-1)
    for p, s in zip(payloads, starts, strict=False):
        flat[s * 64 : s * 64 + len(p)] = p
    coded = np.empty((len(raw), 74), np.uint8)
    nine = coded[:, :72].reshape(len(raw), 8, 9)  # a copy where numpy cannot view it
    for k in range(8):
        nine[:, :, k] = raw[:, :, k] >> (k + 1)
        if k:
            nine[:, :, k] |= (raw[:, :, k - 1] & ((1 << k) - 1)) << (8 - k)
    nine[:, :, 8] = raw[:, :, 7]
    coded[:, :72] = nine.reshape(len(raw), 72)
    number = np.arange(len(raw)) - np.repeat(starts[:-1], np.diff(starts))
    coded[:, 72], coded[:, 73] = 0xFF, 0xD0 + number % 8
    stuffed = coded == 0xFF
    stuffed[:, 72:] = False
    times = 1 + stuffed.reshape(-1).astype(np.int8)
    ends = np.cumsum(times, dtype=np.int64)
    out = np.repeat(coded.reshape(-1), times)
    out[ends[stuffed.reshape(-1)] - 1] = 0
    images = []
    for (down, across), p, s, e in zip(grids, payloads, starts, starts[1:], strict=False):
        lo, hi = (0 if s == 0 else int(ends[s * 74 - 1])), int(ends[e * 74 - 1]) - 2  # without the last RST
        frame = segment(SOF0, struct.pack(">BHHBBBB", 8, down * 8, across * 8, 1, 1, 0x11, 0))
        images.append(
            b"\xff\xd8" + segment(COM, b"payload blocks %d" % (len(p) // 64)) + HEAD + frame + SCAN + out[lo:hi].tobytes() + b"\xff\xd9"
        )
    return images


def read_payload(img: Image) -> bytes:
    """The bytes that ``store_payloads`` stored, from the decoded coefficients."""
    blocks = int(img.comment.rsplit(b" ", 1)[1])
    value = img.coefs[:blocks]
    if (np.abs(value) < 128).any() or (np.abs(value) > 255).any():
        raise ValueError("not a stored payload")
    return (value + 255 * (value < 0)).astype(np.uint8).tobytes()


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
