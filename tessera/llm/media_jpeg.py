"""Media columns: baseline JPEG.

Decoding parses the markers, Huffman-decodes the scan that holds luminance of any baseline (SOF0, 8 bits, components in one
or several scans) image, keeps DC coefficients of luminance as a thumbnail of one pixel per 8x8 block, and hashes it.
Decoding runs over many images at once, whatever their tables and components: every restart interval is a lane, and numpy
steps all lanes by one symbol at a time, so that Python's cost per coefficient is shared by all of them.

``payload_to_jpeg`` stores bytes losslessly in the format's unit, the quantised coefficient: each run of 64 bytes is
one grey 8x8 block in zigzag order, byte - 128 each (samples would pass through the cosine transform and be
rounded). The DC step is 8, so that a thumbnail's pixel is the block's first byte. Each block is a restart
interval. A comment segment holds the payload's length; blocks beyond it, which fill the last row, are dropped on
reading.

Null and empty texts are 64 zero bytes. Equal texts give equal images. Broken files raise ValueError in
``decode`` and give null columns in ``describe``, whatever is wrong with them; a header whose size the scan cannot hold is refused
before anything is allocated. Work is done in blocks of LANES lanes, so memory follows the longest text or file. Repeated rows, empty tables and other columns do no harm.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lean, table

LANES = 1 << 14
UNIT = 64


# --- Huffman tables


def code_lengths(weights: dict[int, float], most: int = 16) -> dict[int, int]:
    """Lengths of a Huffman code; one extra symbol keeps the code of all ones free, as JPEG asks."""
    heap = [(w, s, (s,)) for s, w in sorted(weights.items())] + [(0.0, -1, (-1,))]
    heapq.heapify(heap)
    length = defaultdict(int)
    while len(heap) > 1:
        (w, a, x), (v, b, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            length[s] += 1
        heapq.heappush(heap, (w + v, min(a, b), x + y))
    if max(length.values()) > most:
        return code_lengths({s: w + sum(weights.values()) / 1000 for s, w in weights.items()}, most)
    longest = max((s for s in length), key=lambda s: (length[s], s == -1))
    length[longest], length[-1] = length[-1], length[longest]
    del length[-1]
    return dict(length)


def table_segment(lengths: dict[int, int]) -> tuple[bytes, bytes]:
    """(counts per length, symbols) of a DHT segment."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)), bytes(order)


def codes_of(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length), canonical."""
    out, code, at = [], 0, 0
    for k in range(1, 17):
        for _ in range(counts[k - 1]):
            if code >= 1 << k or at >= len(symbols):
                raise ValueError("bad Huffman table")
            out.append((symbols[at], code, k))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """By the next 16 bits: length of the code + 256 * symbol; 0 where no code fits."""
    out = np.zeros(1 << 16, np.uint32)
    for s, code, k in codes_of(counts, symbols):
        out[code << (16 - k) : (code + 1) << (16 - k)] = k | s << 8
    return out


# Weights by a rule: text bytes minus 128 are mostly of 3 to 7 bits, seldom after a run of zeros.
_DC = code_lengths({s: 2.0 ** -abs(s - 5) for s in range(12)})
_AC = code_lengths({0: 0.2, 0xF0: 1e-3} | {r << 4 | s: 4.0**-r * 2.0 ** -abs(s - 5) for r in range(16) for s in range(1, 11)})
DC_TABLE, AC_TABLE = table_segment(_DC), table_segment(_AC)


def _by_symbol(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
    for s, c, k in codes_of(counts, symbols):
        code[s], length[s] = c, k
    return code, length


_DC_CODE, _DC_LEN = _by_symbol(*DC_TABLE)
_AC_CODE, _AC_LEN = _by_symbol(*AC_TABLE)
_SIZE = np.array([int(abs(v)).bit_length() for v in range(-1024, 1024)], np.uint64)  # of v + 1024


# --- encoding


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode_blocks(coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of grey blocks, each an interval of its own: (bytes, with FF 00 stuffed; length by block)."""
    n = len(coefficients)
    most = 232  # 64 symbols of 27 bits and 16 more, in bytes
    out = np.zeros((n, most), np.uint8)
    flat = out.reshape(-1)
    base = np.arange(n, dtype=np.int64) * most
    bits = np.zeros(n, np.int64)

    def put(lanes, value, length):
        """lanes: their indices; value of so many bits, at most 27."""
        at = bits[lanes]
        byte, shift = base[lanes] + (at >> 3), (40 - (at & 7)).astype(np.uint64) - length
        value = value << shift
        for j in range(5):
            flat[byte + j] |= ((value >> np.uint64(32 - 8 * j)) & np.uint64(255)).astype(np.uint8)
        bits[lanes] = at + length.astype(np.int64)

    def put_values(lanes, v, code, length, symbols):
        size = _SIZE[v + 1024]
        extra = np.where(v < 0, v + (np.int64(1) << size.astype(np.int64)) - 1, v).astype(np.uint64)
        symbols = symbols | size.astype(np.int64)
        put(lanes, code[symbols] << size | extra, length[symbols] + size)

    everyone = np.arange(n)
    put_values(everyone, coefficients[:, 0].astype(np.int64), _DC_CODE, _DC_LEN, np.zeros(n, np.int64))
    run = np.zeros(n, np.int64)
    columns = np.ascontiguousarray(coefficients.T)
    for k in range(1, 64):
        v = columns[k].astype(np.int64)
        lanes = np.flatnonzero(v)
        if len(lanes) == n and not run.any():
            put_values(everyone, v, _AC_CODE, _AC_LEN, run)
            continue
        while len(long := lanes[run[lanes] > 15]):
            put(long, np.full(len(long), _AC_CODE[0xF0]), np.full(len(long), _AC_LEN[0xF0]))
            run[long] -= 16
        put_values(lanes, v[lanes], _AC_CODE, _AC_LEN, run[lanes] << 4)
        run += 1
        run[lanes] = 0
    ends = np.flatnonzero(run)
    put(ends, np.full(len(ends), _AC_CODE[0]), np.full(len(ends), _AC_LEN[0]))
    rest = np.flatnonzero(bits & 7)
    pad = (8 - (bits[rest] & 7)).astype(np.uint64)
    put(rest, (np.uint64(1) << pad) - np.uint64(1), pad)
    size = bits >> 3
    data = out[np.arange(most) < size[:, None]]
    full = data == 255
    lane = np.repeat(np.arange(n), size)
    data = np.insert(data, np.flatnonzero(full) + 1, 0)
    return data, size + np.bincount(lane[full], minlength=n)


def _shape(blocks: int) -> tuple[int, int]:
    """Blocks across and down: 64 across, or more where the height would not fit 16 bits."""
    across = min(blocks, 64)
    while -(-blocks // across) > 8191:
        across *= 2
    return across, -(-blocks // across)


def _head(across: int, down: int, length: int) -> bytes:
    quantiser = bytes([8]) + bytes([1]) * 63
    return b"".join((
        b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xFE, b"payload " + str(length).encode()), _segment(0xDB, b"\0" + quantiser),
        _segment(0xC0, struct.pack(">BHHB", 8, down * 8, across * 8, 1) + b"\1\x11\0"), _segment(0xC4, b"\0" + DC_TABLE[0] + DC_TABLE[1]), _segment(0xC4, b"\x10" + AC_TABLE[0] + AC_TABLE[1]),
        _segment(0xDD, struct.pack(">H", 1)), _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ))


def payloads_to_jpeg(payloads: list[bytes]) -> list[bytes]:
    """Each payload's length is a positive multiple of 64."""
    plans, parts = [], []
    for p in payloads:
        blocks = len(p) // UNIT
        across, down = _shape(blocks)
        plans.append((across, down, len(p)))
        b = np.zeros((across * down, UNIT), np.int16)
        b[:blocks] = np.frombuffer(p, np.uint8).reshape(blocks, UNIT).astype(np.int16) - 128
        parts.append(b)
    everything = np.concatenate(parts)
    coded = [encode_blocks(everything[i : i + LANES]) for i in range(0, len(everything), LANES)]
    data, sizes = np.concatenate([c[0] for c in coded]), np.concatenate([c[1] for c in coded])
    ends = np.cumsum(sizes)
    out, block = [], 0
    for across, down, length in plans:
        n = across * down
        own, begin = sizes[block : block + n], ends[block - 1] if block else 0
        scan = data[begin : ends[block + n - 1]]
        # restart markers D0 to D7 in turn between blocks
        cuts = np.cumsum(own)[:-1]
        marks = np.empty((n - 1, 2), np.uint8)
        marks[:, 0], marks[:, 1] = 0xFF, 0xD0 + np.arange(n - 1) % 8
        out.append(_head(across, down, length) + np.insert(scan, np.repeat(cuts, 2), marks.reshape(-1)).tobytes() + b"\xff\xd9")
        block += n
    return out


# --- decoding


@dataclass
class Image:
    """A parsed file. intervals: the scan's bytes between restart markers, still stuffed."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[tuple[int, int], tuple[bytes, bytes]] = field(default_factory=dict)
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component, DC table, AC table
    every: int = 0
    comment: bytes = b""
    data: bytes = b""

    def mcus(self) -> tuple[int, int]:
        """Across and down, of the scan; one component alone has a block per MCU, as many as its own samples need."""
        h, v = (max(c[i] for c in self.components) for i in (1, 2))
        if len(self.scan) > 1:
            return -(-self.width // (8 * h)), -(-self.height // (8 * v))
        _, own_h, own_v, _ = self.components[self.scan[0][0]]
        return -(-self.width * own_h // (8 * h)), -(-self.height * own_v // (8 * v))

    def units(self) -> list[tuple[int, int, int]]:
        """(component, DC table, AC table) of each block of an MCU."""
        out = []
        for c, dc, ac in self.scan:
            n = 1 if len(self.scan) == 1 else self.components[c][1] * self.components[c][2]
            out += [(c, dc, ac)] * n
        return out


#: What ends a scan: a marker that is neither a stuffed FF nor a restart nor fill.
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _scan_end(file: bytes, at: int) -> int:
    found = _MARKER.search(file, at)
    return found.start() if found else len(file)


def parse(file: bytes) -> Image:
    """Markers up to the scan that holds the first component, luminance; scans before it are passed over."""
    if file[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    image, at = Image(), 2
    while True:
        if at + 4 > len(file) or file[at] != 0xFF:
            raise ValueError("marker expected")
        marker = file[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(file[at + 2 : at + 4], "big")
        body = file[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise ValueError("segment cut short")
        at += 2 + size
        if marker == 0xC0:
            depth, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or not image.height or not image.width or len(body) != 6 + 3 * n or not 1 <= n <= 4:
                raise ValueError("frame header")
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if not all(1 <= h <= 4 and 1 <= v <= 4 for _, h, v, _ in image.components):
                raise ValueError("sampling factors")
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                image.tables[body[0] >> 4, body[0] & 15] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quantisers[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xDD:
            image.every = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            order = {c[0]: i for i, c in enumerate(image.components)}
            n = body[0]
            if not n or len(body) < 1 + 2 * n:
                raise ValueError("scan header")
            scan = [(order[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            end = _scan_end(file, at)
            if any(c == 0 for c, _, _ in scan):
                image.scan, image.data = scan, file[at:end]
                return image
            at = end


def _intervals(image: Image) -> tuple[np.ndarray, np.ndarray]:
    """(bytes without stuffing and markers, where each interval starts)."""
    d = np.frombuffer(image.data, np.uint8)
    ff = np.flatnonzero(d[:-1] == 255) if len(d) else np.zeros(0, int)
    after = d[ff + 1]
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(d), bool)
    keep[ff[after == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    kept_before = np.concatenate(([0], np.cumsum(keep)))
    return d[keep], np.concatenate(([0], kept_before[marks + 2]))


@dataclass
class Layout:
    """Of several images, what decoding looks up by image: number of units in an MCU, and of each unit its component and tables."""

    n: np.ndarray
    component: np.ndarray
    dc: np.ndarray
    ac: np.ndarray
    dc_tables: np.ndarray
    ac_tables: np.ndarray


def _layout(images: list[Image]) -> Layout:
    shape = (len(images), max(len(m.units()) for m in images))
    n, parts, seen = np.zeros(len(images), np.int64), [np.zeros(shape, np.int64) for _ in range(3)], ({}, {})
    for i, m in enumerate(images):
        units = m.units()
        n[i] = len(units)
        for k, (c, *ids) in enumerate(units):
            parts[0][i, k] = c
            for kind, t in enumerate(ids):
                parts[1 + kind][i, k] = seen[kind].setdefault(m.tables[kind, t], len(seen[kind]))
    return Layout(n, *parts, *(np.concatenate([lookup(*t) for t in known]) for known in seen))


def _lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, blocks: np.ndarray, image: np.ndarray, layout: Layout, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """(quantised coefficients of all blocks of the lanes, one after another; which lanes are broken): 64 in zigzag order, or the first alone unless whole.
    Lanes lie between these bytes, have so many blocks each and are of these images."""
    padded = np.concatenate((data, np.full(16, 255, np.uint8))).astype(np.uint64)
    window = np.zeros(len(padded) - 7, np.uint64)
    for j in range(8):
        window |= padded[j : j + len(window)] << np.uint64(56 - 8 * j)
    n, most = len(starts), int(blocks.max())
    base = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    out = np.zeros((int(blocks.sum()), 64 if whole else 1), np.int16)
    bits, last = starts.astype(np.int64) * 8, len(window) - 1
    before, bad = np.zeros((n, 4), np.int64), np.zeros(n, bool)

    def symbol(lanes, tables, which):
        """Decodes one symbol in each lane: (what stands above the size's 4 bits, value, size); lanes without one are broken and read as 0."""
        at = bits[lanes]
        w = window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint64)
        e = tables[(which << 16) + (w >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        length = e & 255
        if not length.all():
            bad[lanes[length == 0]] = True
        size = (e >> 8) & 15
        raw = ((w << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        bits[lanes] = at + length + size
        return e >> 12, np.where((size > 0) & (raw < (1 << np.maximum(size - 1, 0))), raw - (1 << size) + 1, raw), size

    for b in range(most):
        lanes = np.flatnonzero((blocks > b) & ~bad)
        unit = b % layout.n[image[lanes]]
        c, ac = layout.component[image[lanes], unit], layout.ac[image[lanes], unit]
        _, v, _ = symbol(lanes, layout.dc_tables, layout.dc[image[lanes], unit])
        before[lanes, c] += v
        out[base[lanes] + b, 0] = before[lanes, c]
        k = np.ones(len(lanes), np.int64)
        while len(lanes):
            run, v, size = symbol(lanes, layout.ac_tables, ac)
            k += run
            zero = size == 0
            ended = zero & (run != 15)
            over = ~ended & (k > 63)
            if over.any():
                bad[lanes[over]] = True
            if whole:
                some = ~zero & ~over
                out[base[lanes[some]] + b, k[some]] = v[some]
            k += 1
            go = ~ended & (k < 64) & ~bad[lanes]
            if not go.all():
                lanes, k, ac = lanes[go], k[go], ac[go]
    return out, bad | (bits > ends * 8)


def _pieces(sizes: np.ndarray, lanes: int, blocks: int) -> Iterator[slice]:
    """Runs of lanes, no more than so many or with so many blocks, but for single ones."""
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        z = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + blocks, "right"))
        z = max(at + 1, min(z, at + lanes))
        yield slice(at, z)
        at = z


def decode(files: list[bytes], whole: bool = True, strict: bool = True) -> list[tuple[Image, np.ndarray] | None]:
    """(image, coefficients of its blocks in scan order) for each file, all of them, or DC alone unless whole; images are decoded together, whatever their
    tables. A broken one is None, or raises ValueError if strict. Nothing is allocated that the scan's length does not warrant."""
    out: list = [None] * len(files)
    kept, data, starts, counts, at = [], [], [], [], 0
    for i, f in enumerate(files):
        try:
            m = parse(f)
            units, (across, down) = m.units(), m.mcus()
            n = across * down
            each = min(m.every or n, n)
            d, s = _intervals(m)
            if not all((k, u[1 + k]) in m.tables for u in units for k in (0, 1)) or len(m.quantisers.get(m.components[m.scan[0][0]][3], ())) < UNIT:
                raise ValueError("a table is missing")
            if len(s) != -(-n // each):
                raise ValueError("restart markers are missing")
            if n * len(units) * 2 > len(d) * 8:  # a block takes two bits at least
                raise ValueError("scan cut short")
            for t in m.tables.values():
                codes_of(*t)
        except (ValueError, KeyError, IndexError, struct.error):
            if strict:
                raise
            continue
        c = np.full(len(s), each * len(units))
        c[-1] = (n - each * (len(s) - 1)) * len(units)
        kept.append((i, m, len(s), n * len(units)))
        data.append(d)
        starts.append(s + at)
        counts.append(c)
        at += len(d)
    if not kept:
        return out
    layout = _layout([m for _, m, _, _ in kept])
    image = np.repeat(np.arange(len(kept)), [lanes for _, _, lanes, _ in kept])
    data, starts, counts = map(np.concatenate, (data, starts, counts))
    ends, done, bad = np.append(starts[1:], len(data)), [], []
    for p in _pieces(counts, LANES, LANES * (16 if whole else 16 * UNIT)):
        got, broken = _lanes(data[starts[p][0] : ends[p][-1]], starts[p] - starts[p][0], ends[p] - starts[p][0], counts[p], image[p], layout, whole)
        done.append(got)
        bad.append(broken)
    blocks, broken, at = np.concatenate(done), np.bincount(image, np.concatenate(bad), len(kept)) > 0, 0
    for j, (i, m, _, n) in enumerate(kept):
        if not broken[j]:
            out[i] = m, blocks[at : at + n]
        elif strict:
            raise ValueError("no such Huffman code, too many coefficients, or the scan is cut short")
        at += n
    return out


def thumbnail(image: Image, blocks: np.ndarray) -> np.ndarray:
    """One pixel per luminance block, from its DC coefficient alone."""
    units, (across, down) = image.units(), image.mcus()
    _, h, v, q = image.components[image.scan[0][0]]
    if len(image.scan) == 1:
        h = v = 1
    dc = blocks[:, 0].reshape(down * across, len(units))[:, : h * v].astype(np.int64) * image.quantisers[q][0]
    pixels = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    pixels = pixels[: -(-image.height // 8), : -(-image.width // 8)]
    return np.clip((pixels + 4) // 8 + 128, 0, 255).astype(np.uint8)


def _resized(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means of about equal areas; repeats pixels of smaller images."""
    for axis, n in ((0, rows), (1, columns)):
        size = pixels.shape[axis]
        if size < n:
            pixels = pixels.take(np.arange(n) * size // n, axis)
            size = n
        edges = np.arange(n) * size // n
        pixels = np.add.reduceat(pixels.astype(np.float64), edges, axis) / np.expand_dims(np.diff(np.append(edges, size)), 1 - axis)
    return pixels


def feature(image: Image, pixels: np.ndarray) -> str:
    """Width x height, mean hash, difference hash and checksum of the thumbnail."""
    small = _resized(pixels, 8, 9)
    mean = np.packbits(small[:, :8] > small[:, :8].mean()).tobytes().hex()
    difference = np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()
    return f"{image.width}x{image.height}:{mean}:{difference}:{zlib.crc32(pixels.tobytes()):08x}"


def payload_of(image: Image, blocks: np.ndarray) -> bytes:
    length = int(image.comment.removeprefix(b"payload "))
    return (blocks.reshape(-1)[:length] + 128).astype(np.uint8).tobytes()


# --- columns


def describe(images: DataFrame, key: str, file: str) -> DataFrame:
    """(key, width, height, feature, thumbnail) of JPEG files in a binary column; nulls where it isn't one."""
    images = images.select(F.col(key).alias("key"), F.col(file).alias("file"))
    kind = images.schema["key"].dataType.simpleString()

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(1)
            for part in batches_of(pc.fill_null(pc.binary_length(files), 0).to_pylist(), 16 * LANES * UNIT):
                rows = []
                for found in decode([f or b"" for f in files[part.start : part.stop].to_pylist()], whole=False, strict=False):
                    if found is None:
                        rows.append((None,) * 4)
                    else:
                        t = thumbnail(*found)
                        rows.append((found[0].width, found[0].height, feature(found[0], t), t.tobytes()))
                w, h, f, t = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(f, pa.string()), pa.array(t, pa.binary())], ["key", "width", "height", "feature", "thumbnail"])

    return images.mapInArrow(lean(described), f"key {kind}, width int, height int, feature string, thumbnail binary")


def batches_of(sizes: list[int], most: int = LANES * UNIT) -> Iterator[slice]:
    """Runs of rows of about so many bytes together, longer rows alone."""
    at = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield slice(at, i)
            at, held = i, 0
        held += n
    if sizes:
        yield slice(at, len(sizes))


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT if raw else UNIT), len(raw)


def store_texts(docs: DataFrame, doc: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """Each text's payload stored as a JPEG, read back and described; keep: with the file in ``media``."""
    docs = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * keep

    def rows_of(texts: list[str | None]) -> list[tuple]:
        made = [payload(t) for t in texts]
        files = payloads_to_jpeg([p for p, _ in made])
        rows = []
        for (_, n), file, (m, blocks) in zip(made, files, decode(files), strict=True):
            back = payload_of(m, blocks)
            row = n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), feature(m, thumbnail(m, blocks))
            rows.append(row + (file,) * keep)
        return rows

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for part in batches_of(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):  # as many texts at once as fill the lanes
                rows = rows_of(texts[part.start : part.stop].to_pylist())
                yield pa.RecordBatch.from_arrays([ids[part.start : part.stop], *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    return docs.mapInArrow(lean(stored), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents"))
