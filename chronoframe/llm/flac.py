"""FLAC in columns: lossless 8-bit mono audio, many streams at a time.

The writer cuts samples into blocks, takes for each the fixed predictor (or the given
linear one) that costs least, and codes residuals with a Rice parameter for each of four
partitions.  Streams carry a seek table.  The reader finds frames by sync code and header
checksum, verifies every frame's CRC-16, and decodes Rice residuals of all frames of a
batch side by side: one step takes the next residual of every frame, so numpy works on
long vectors although each frame is a chain.  Predictors are then undone, fixed ones by
running sums.  A bad checksum raises an error; nothing is guessed.

Samples are bytes minus 128.  Constant, verbatim, fixed and linear-prediction subframes
are read; escaped partitions and other sample sizes or channel counts are not written here
and raise an error.

Defined results: a null or empty text is 64 zero bytes of payload with 0 bytes of text;
equal texts give equal streams, whatever batch they come in; a null ``doc_id`` is kept;
repeated rows give repeated results; an empty table gives no rows.  Input columns beyond
those named are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
RATE = 16_000
#: Rice partitions of a block: two to this power.
PARTITIONS = 2
#: Frames between seek points.
SEEK = 16
PAD = 64
#: Bytes of payload coded at a time.
GROUP = 4 << 20


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        top = table >> (bits - 1) & 1
        table = (table << 1 ^ top * poly) & ((1 << bits) - 1)
    return table


CRC8 = _crc_table(0x07, 8).tolist()
_CRC16 = _crc_table(0x8005, 16).astype(np.uint16)
_FAR = [_CRC16]


def crc8(head: bytes) -> int:
    crc = 0
    for byte in head:
        crc = CRC8[crc ^ byte]
    return crc


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each slice of ``data``; slices follow each other without overlap.

    The checksum is linear: it is the exclusive or of what each byte gives at its distance
    from the end.
    """
    lengths = ends - starts
    longest = int(lengths.max()) if len(lengths) else 0
    while len(_FAR) < longest:
        t = _FAR[-1]
        _FAR.append((t << 8) ^ _CRC16[t >> 8])
    far = np.stack(_FAR[:longest]).reshape(-1) if longest else np.zeros(0, np.uint16)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    index = np.arange(lengths.sum()) - np.repeat(first, lengths)
    distance = np.repeat(lengths, lengths) - 1 - index
    bytes_ = data[np.repeat(starts, lengths) + index]
    return np.bitwise_xor.reduceat(far[distance * 256 + bytes_], first)


def _utf8(number: int) -> bytes:
    """A frame's number, coded as UTF-8 codes characters, up to 36 bits."""
    if number < 0x80:
        return bytes([number])
    n = next(k for k in range(2, 8) if number < 1 << (5 * k + 1))
    tail = [0x80 | number >> 6 * i & 0x3F for i in range(n - 2, -1, -1)]
    return bytes([(0xFF00 >> n & 0xFF) | number >> 6 * (n - 1), *tail])


def _header(number: int, block: int) -> bytes:
    head = b"\xff\xf8\x75\x02" + _utf8(number) + struct.pack(">H", block - 1)
    return head + bytes([crc8(head)])


def _rice(res: np.ndarray, order: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Best parameter of each partition of each row, and the rows' bits for it."""
    rows, n = res.shape
    zig = ((res << 1) ^ (res >> 31)).astype(np.uint32)
    zig[:, :order] = 0
    zig = zig.reshape(rows, parts, n // parts)
    counts = np.full(parts, n // parts)
    counts[0] -= order
    # a quotient of over 40 would not fit the reader's window at once
    least = np.maximum(0, np.ceil(np.log2(np.maximum(zig.max(2), 1) / 40))).astype(int)
    mean = zig.sum(2) / np.maximum(counts, 1)
    guess = np.clip(np.log2(mean * 0.7 + 1).astype(int), 0, 13)
    best, cost = guess, np.full(guess.shape, 1 << 40)
    for d in (-1, 0, 1):
        k = np.clip(np.maximum(guess + d, least), 0, 14)
        bits = (zig >> k[..., None].astype(np.uint32)).sum(2, dtype=np.int64) + counts * (k + 1)
        better = bits < cost
        best, cost = np.where(better, k, best), np.where(better, bits, cost)
    return best, cost.sum(1) + 4 * parts


def _residual(x: np.ndarray, order: int) -> np.ndarray:
    res = x.astype(np.int32)
    for k in range(order):
        res[:, k + 1 :] = res[:, k + 1 :] - res[:, k:-1]
    return res


def _predicted(x: np.ndarray, coefs: list[int], shift: int) -> np.ndarray:
    res, n = x.astype(np.int32), len(coefs)
    past = sum(c * x[:, n - 1 - j : x.shape[1] - 1 - j].astype(np.int64) for j, c in enumerate(coefs))
    res[:, n:] -= (past >> shift).astype(np.int32)
    return res


def _frames(x: np.ndarray, lpc: tuple[list[int], int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fields of the subframes of blocks of one size: values, bits, and bits of each row."""
    rows, n = x.shape
    parts = 1 << PARTITIONS
    tries: list[tuple[int, int, np.ndarray]] = [(8 + o, o, _residual(x, o)) for o in range(3)]
    if lpc:
        tries.append((31 + len(lpc[0]), len(lpc[0]), _predicted(x, *lpc)))
    priced = [_rice(res, order, parts) for _, order, res in tries]
    extra = [8 * order + 6 + (9 + 8 * order if kind >= 32 else 0) for kind, order, _ in tries]
    total = np.stack([cost + e for (_, cost), e in zip(priced, extra, strict=True)])
    choice = total.argmin(0)
    verbatim = total.min(0) >= 8 * n
    constant = (x == x[:, :1]).all(1)
    width = 1 + 9 + n + parts + 40
    values = np.zeros((rows, width), np.uint32)
    bits = np.zeros((rows, width), np.uint32)
    raw = (x & 0xFF).astype(np.uint32)
    for t, (kind, order, res) in enumerate(tries):
        r = np.flatnonzero((choice == t) & ~verbatim & ~constant)
        if not len(r):
            continue
        k = priced[t][0][r]
        values[r, 0], bits[r, 0] = kind << 1, 8
        at = 1
        values[r, at : at + order], bits[r, at : at + order] = raw[r, :order], 8
        at += order
        if kind >= 32:
            coefs, shift = lpc
            for v, b in ((13, 4), (shift, 5), *((c & 0x3FFF, 14) for c in coefs)):
                values[r, at], bits[r, at] = v, b
                at += 1
        values[r, at], bits[r, at] = PARTITIONS, 6
        at += 1
        zig = ((res[r] << 1) ^ (res[r] >> 31)).astype(np.uint32)
        for p in range(parts):
            low, high = p * n // parts, (p + 1) * n // parts
            low = max(low, order)
            kp = k[:, p : p + 1].astype(np.uint32)
            values[r, at], bits[r, at] = kp[:, 0], 4
            at += 1
            z = zig[:, low:high]
            values[r, at : at + high - low] = (np.uint32(1) << kp) | (z & ((np.uint32(1) << kp) - 1))
            bits[r, at : at + high - low] = (z >> kp) + 1 + kp
            at += high - low
    v = verbatim & ~constant
    values[v, 0], bits[v, 0] = 1 << 1, 8
    values[v, 1 : n + 1], bits[v, 1 : n + 1] = raw[v], 8
    values[constant, 0], bits[constant, 0] = 0, 8
    values[constant, 1], bits[constant, 1] = raw[constant, 0], 8
    return values, bits, bits.sum(1, dtype=np.int64)


def encode(payloads: list[bytes], lpc: tuple[list[int], int] | None = None) -> list[bytes]:
    """A FLAC stream for each payload of at least PAD bytes, a multiple of PAD.

    ``lpc``: coefficients (below 2^13 in size) and shift of a linear predictor to try too.
    """
    sizes = [len(p) for p in payloads]
    data = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).astype(np.int16)
    starts, lengths, owner, number = [], [], [], []
    at = 0
    for i, n in enumerate(sizes):
        for f, low in enumerate(range(0, n, BLOCK)):
            starts.append(at + low)
            lengths.append(min(BLOCK, n - low))
            owner.append(i)
            number.append(f)
        at += n
    starts_, lengths_ = np.array(starts), np.array(lengths)
    frames: list[bytes] = [b""] * len(starts)
    for n in np.unique(lengths_):
        rows = np.flatnonzero(lengths_ == n)
        x = data[starts_[rows][:, None] + np.arange(n)]
        values, bits, total = _frames(x, lpc)
        padded = -(-total // 8) * 8
        heads = [_header(number[r], int(n)) for r in rows]
        # codes end at these bits of one long string; zeros before their ones need no writing
        ends = np.cumsum(bits, 1, dtype=np.int64) + (np.cumsum(padded) - padded)[:, None]
        stream = np.zeros(int(padded.sum()), np.uint8)
        used = bits > 0
        v, e = values[used], ends[used]
        for j in range(int(v.max()).bit_length()):
            on = (v >> np.uint32(j) & 1).astype(bool)
            stream[e[on] - 1 - j] = 1
        body = np.packbits(stream).tobytes()
        low = 0
        for r, head, size in zip(rows.tolist(), heads, (padded // 8).tolist(), strict=True):
            frames[r] = head + body[low : low + size]
            low += size
    whole = np.frombuffer(b"".join(frames), np.uint8)
    ends_ = np.cumsum([len(f) for f in frames])
    sums = crc16(whole, np.concatenate([[0], ends_[:-1]]), ends_)
    out: list[list[bytes]] = [[] for _ in payloads]
    for i, frame, s in zip(owner, frames, sums.tolist(), strict=True):
        out[i].append(frame + struct.pack(">H", s))
    return [_stream(p, f) for p, f in zip(payloads, out, strict=True)]


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    n, sizes = len(payload), [len(f) for f in frames]
    signed = bytes(payload).translate(_SIGNED)
    info = struct.pack(">HH", max(16, min(BLOCK, n)), max(16, min(BLOCK, n)))
    info += min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5(signed).digest()
    points, at = [], 0
    for i, size in enumerate(sizes):
        if i % SEEK == 0:
            points.append(struct.pack(">QQH", i * BLOCK, at, min(BLOCK, n - i * BLOCK)))
        at += size
    table = b"".join(points)
    return b"".join(
        [b"fLaC", b"\x00", len(info).to_bytes(3, "big"), info, b"\x83", len(table).to_bytes(3, "big"), table, *frames]
    )


_SIGNED = bytes((b - 128) & 0xFF for b in range(256))


@dataclass
class Info:
    """What a stream's metadata says; ``first`` is where its frames begin."""

    samples: int
    md5: bytes
    seek: list[tuple[int, int, int]]
    first: int


def info(stream: bytes) -> Info:
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, samples, md5, seek = 4, False, 0, b"", []
    while not last:
        last, kind = bool(stream[at] & 0x80), stream[at] & 0x7F
        size = int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            samples, md5 = packed & (1 << 36) - 1, block[18:34]
            if (packed >> 41 & 7, packed >> 36 & 31) != (0, 7):
                raise ValueError("only 8-bit mono is read")
        elif kind == 3:
            seek = [struct.unpack_from(">QQH", block, i) for i in range(0, size, 18)]
        at += 4 + size
    return Info(samples, md5, seek, at)


def _number(data: bytes, at: int) -> tuple[int, int]:
    lead = data[at]
    if lead < 0x80:
        return lead, 1
    n = 8 - (lead ^ 0xFF).bit_length()
    value = lead & (0x7F >> n)
    for b in data[at + 1 : at + n]:
        value = value << 6 | b & 0x3F
    return value, n


def _parse(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Number, block size and header bytes of a frame at ``at``; None if there is none."""
    if at + 6 > len(data) or data[at + 2] >> 4 not in (6, 7) or data[at + 3] != 2:
        return None
    number, n = _number(data, at + 4)
    end = at + 4 + n
    if data[at + 2] >> 4 == 6:
        block, end = data[end] + 1, end + 1
    else:
        block, end = int.from_bytes(data[end : end + 2], "big") + 1, end + 2
    if end >= len(data) or crc8(data[at:end]) != data[end]:
        return None
    return number, block, end + 1 - at


def _split(data: bytes, first: int, samples: int, number: int = 0) -> list[tuple[int, int, int, int]]:
    """(start, body, end, block) of the frames from ``first`` on.

    A frame ends where the next number's header stands, or at the stream's end.  A header
    inside a frame's data that looks like it would make the checksum fail; it is passed over.
    """
    out, at, left = [], first, samples
    while left > 0:
        head = _parse(data, at)
        if head is None or head[0] != number:
            raise ValueError(f"no frame {number} at byte {at}")
        _, block, size = head
        end = len(data)
        if left > block:
            end = data.find(b"\xff\xf8", at + size)
            while end >= 0:
                following = _parse(data, end)
                if following and following[0] == number + 1:
                    frame = np.frombuffer(data, np.uint8)
                    if int(crc16(frame, np.array([at]), np.array([end]))[0]) == 0:
                        break
                end = data.find(b"\xff\xf8", end + 1)
            if end < 0:
                raise ValueError(f"frame {number} has a bad checksum")
        out.append((at, at + size, end, block))
        at, left, number = end, left - block, number + 1
    return out


class _Bits:
    """Reads of a few bits at any bit of a string of bytes, for many places at once."""

    def __init__(self, data: np.ndarray):
        self.data = data
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        n = len(data) + 8
        self.words = np.zeros(n, np.uint64)
        for k in range(8):
            self.words = self.words << np.uint64(8) | padded[k : k + n]

    def window(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from each place, highest first."""
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.zeros(len(at), np.int64)
        return (self.window(at) >> np.uint64(64 - n)).astype(np.int64)

    def signed(self, at: np.ndarray, n: int) -> np.ndarray:
        v = self.take(at, n)
        return np.where(v >> (n - 1), v - (1 << n), v)

    def unary(self, at: np.ndarray) -> np.ndarray:
        """Zeros before the next one."""
        q = np.zeros(len(at), np.int64)
        todo = np.arange(len(at))
        while len(todo):
            w = self.window(at[todo] + q[todo]) >> np.uint64(11)
            exponent = np.frexp(w.astype(float))[1]
            empty = w == 0
            q[todo] += np.where(empty, 50, 53 - exponent)
            todo = todo[empty]
        return q


def _undo(order: int, x: np.ndarray) -> np.ndarray:
    """Samples from warm-up samples and residuals of a fixed predictor."""
    for k in range(order, 0, -1):
        # k-th differences stand from place k on; the sum starts at the lower one before
        lead = x[:, :k].copy()
        for j in range(k - 1):
            lead[:, j + 1 :] = lead[:, j + 1 :] - lead[:, j:-1]
        x[:, k - 1] = lead[:, k - 1]
        x[:, k - 1 :] = np.cumsum(x[:, k - 1 :], axis=1)
    return x


def _decode(bits: _Bits, bodies: np.ndarray, block: int) -> np.ndarray:
    """Samples of the subframes that begin at bytes ``bodies``, all of ``block`` samples."""
    at = bodies.astype(np.int64) * 8
    head = bits.take(at, 8)
    if (head & 0x81).any():
        raise ValueError("wasted bits or a bad subframe header")
    kind = head >> 1
    at += 8
    x = np.zeros((len(at), block), np.int64)
    r = np.flatnonzero(kind == 0)
    x[r] = bits.signed(at[r], 8)[:, None]
    r = np.flatnonzero(kind == 1)
    if len(r):
        raw = bits.data[(at[r] >> 3)[:, None] + np.arange(block)]
        x[r] = raw.astype(np.int8)
    fixed = (kind >= 8) & (kind <= 12)
    linear = kind >= 32
    if (~fixed & ~linear & (kind > 1)).any():
        raise ValueError("a reserved subframe type")
    rows = np.flatnonzero(fixed | linear)
    order = np.where(fixed, kind - 8, kind - 31)
    for k in range(int(order[rows].max()) if len(rows) else 0):
        r = rows[order[rows] > k]
        x[r, k] = bits.signed(at[r], 8)
        at[r] += 8
    models: dict[int, tuple[list[int], int]] = {}
    for r in np.flatnonzero(linear).tolist():
        p = at[r : r + 1]
        precision, shift = int(bits.take(p, 4)[0]) + 1, int(bits.signed(p + 4, 5)[0])
        p = p + 9
        coefs = []
        for _ in range(int(order[r])):
            coefs.append(int(bits.signed(p, precision)[0]))
            p = p + precision
        models[r] = coefs, shift
        at[r] = p[0]
    coding = bits.take(at[rows], 6) if len(rows) else np.zeros(0, np.int64)
    if (coding >> 4).any():
        raise ValueError("only 4-bit Rice parameters are read")
    at[rows] += 6
    for power in np.unique(coding):
        _residuals(bits, at, x, rows[coding == power], order, block, int(power))
    for o in np.unique(order[fixed]):
        r = np.flatnonzero(fixed & (order == o))
        x[r] = _undo(int(o), x[r])
    for r, (coefs, shift) in models.items():
        row, n = x[r].tolist(), len(coefs)
        for i in range(n, block):
            row[i] += sum(c * row[i - 1 - j] for j, c in enumerate(coefs)) >> shift
        x[r] = row
    return x


def _residuals(bits: _Bits, at, x, rows, order, block: int, power: int) -> None:
    """Rice-coded residuals of ``rows``, one step for all of them at a time."""
    part = block >> power
    place, begin = at[rows], order[rows]
    k = np.zeros(len(rows), np.int64)
    out = np.zeros((block, len(rows)), np.int64)
    for i in range(block):
        if i % part == 0:
            k = bits.take(place, 4)
            if (k == 15).any():
                raise ValueError("escaped partitions are not read")
            place = place + 4
        if i < 32 and (begin > i).any():  # warm-up samples of some rows
            go = begin <= i
            q = np.where(go, bits.unary(place), 0)
            rest = place + q + 1
            low = (bits.window(rest) >> np.uint64(1) >> (63 - k).astype(np.uint64)).astype(np.int64)
            z = np.where(go, q << k | low, 0)
            place = np.where(go, rest + k, place)
        else:
            q = bits.unary(place)
            place = place + q + 1
            low = (bits.window(place) >> np.uint64(1) >> (63 - k).astype(np.uint64)).astype(np.int64)
            z = q << k | low
            place = place + k
        out[i] = (z >> 1) ^ -(z & 1)
    res = out.T
    for o in np.unique(begin):
        own = begin == o
        x[rows[own], o:] = res[own, o:]


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream; every frame's checksum and the MD5 sum are verified."""
    whole = np.frombuffer(b"".join(streams), np.uint8)
    base, frames = 0, []
    infos = [info(s) for s in streams]
    for i, (s, meta) in enumerate(zip(streams, infos, strict=True)):
        for start, body, end, block in _split_fast(s, meta):
            frames.append((i, base + start, base + body, base + end, block))
        base += len(s)
    table = np.array(frames, np.int64).reshape(-1, 5)
    if (crc16(whole, table[:, 1], table[:, 3]) != 0).any():
        # a header that only looks like one: find the frames by their checksums
        table, base = [], 0
        for i, (s, meta) in enumerate(zip(streams, infos, strict=True)):
            for start, body, end, block in _split(s, meta.first, meta.samples):
                table.append((i, base + start, base + body, base + end, block))
            base += len(s)
        table = np.array(table, np.int64).reshape(-1, 5)
        if (crc16(whole, table[:, 1], table[:, 3]) != 0).any():
            raise ValueError("a frame has a bad checksum")
    places = np.cumsum(table[:, 4]) - table[:, 4]
    samples = np.zeros(int(table[:, 4].sum()), np.uint8)
    bits = _Bits(whole)
    for block in np.unique(table[:, 4]):
        rows = np.flatnonzero(table[:, 4] == block)
        x = _decode(bits, table[rows, 2], int(block))
        samples[places[rows][:, None] + np.arange(block)] = (x + 128).astype(np.uint8)
    out, low = [], 0
    for meta in infos:
        payload = samples[low : low + meta.samples].tobytes()
        low += meta.samples
        if hashlib.md5(payload.translate(_SIGNED)).digest() != meta.md5:
            raise ValueError("the stream's MD5 sum doesn't match")
        out.append(payload)
    return out


def _split_fast(data: bytes, meta: Info) -> list[tuple[int, int, int, int]]:
    """As ``_split``, trusting header checksums; frame checksums are verified later."""
    out, at, left, number = [], meta.first, meta.samples, 0
    head = _parse(data, at)
    while left > 0:
        if head is None or head[0] != number:
            raise ValueError(f"no frame {number} at byte {at}")
        _, block, size = head
        end, head = len(data), None
        if left > block:
            end = data.find(b"\xff\xf8", at + size)
            while end >= 0 and not ((head := _parse(data, end)) and head[0] == number + 1):
                end = data.find(b"\xff\xf8", end + 1)
            if end < 0:
                raise ValueError(f"frame {number + 1} is missing")
        out.append((at, at + size, end, block))
        at, left, number = end, left - block, number + 1
    return out


def read_samples(stream: bytes, offset: int, count: int) -> bytes:
    """``count`` bytes of payload from ``offset``, decoding only from the seek point before."""
    meta = info(stream)
    offset, stop = min(offset, meta.samples), min(offset + count, meta.samples)
    if offset >= stop:
        return b""
    sample, at, _ = max((p for p in meta.seek if p[0] <= offset), default=(0, 0, 0))
    parts, low = [], sample
    for start, body, end, block in _split(stream, meta.first + at, meta.samples - sample, sample // BLOCK):
        if low >= stop:
            break
        data = np.frombuffer(stream[start:end], np.uint8)
        if int(crc16(data, np.array([0]), np.array([len(data)]))[0]):
            raise ValueError("a frame has a bad checksum")
        x = _decode(_Bits(data), np.array([body - start]), block)[0]
        parts.append((x + 128).astype(np.uint8).tobytes())
        low += block
    return b"".join(parts)[offset - sample : stop - sample]


def payload(text: str | None) -> tuple[bytes, int]:
    """The text's bytes, zero bytes up to a positive multiple of PAD, and its own length."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (-len(data) % PAD if data else PAD), len(data)


def feature(samples: bytes) -> str:
    """Level, mean and zero crossings of the samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(x >= 0)))
    return f"rms={np.sqrt((x * x).mean()):.4f};mean={x.mean():.4f};crossings={crossings};peak={int(np.abs(x).max())}"


def _groups(texts: list[str | None]) -> Iterator[list[tuple[bytes, int]]]:
    group, size = [], 0
    for text in texts:
        group.append(payload(text))
        size += len(group[-1][0])
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def write(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): each text stored as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in _groups(batch.column(1).to_pylist()):
                media = encode([p for p, _ in group])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(group)),
                        pa.array([n for _, n in group], pa.int64()),
                        pa.array(media, pa.binary()),
                    ],
                    names=["key", "n_bytes", "media"],
                )
                at += len(group)

    rows = docs.select(F.col(key).cast("long").alias("key"), text)
    return rows.mapInArrow(run, "key long, n_bytes long, media binary").withColumnRenamed("key", key)


def pcm_blocks(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sample_offset, samples, pcm): the decoded blocks of each stream, in any order.

    ``media`` is as ``write`` gives it.  A block is found by its offset; blocks of a stream
    are BLOCK samples apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, stream in zip(batch.column(0), batch.column(1), strict=True):
                if not stream.is_valid:
                    continue
                pcm = decode([stream.as_py()])[0]
                cuts = range(0, len(pcm), BLOCK)
                blocks = [pcm[c : c + BLOCK] for c in cuts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k.as_py()] * len(blocks), pa.int64()),
                        pa.array(list(cuts), pa.int64()),
                        pa.array([len(b) for b in blocks], pa.int64()),
                        pa.array(blocks, pa.binary()),
                    ],
                    names=["key", "sample_offset", "samples", "pcm"],
                )

    rows = media.select(F.col(key).cast("long").alias("key"), "media")
    out = rows.mapInArrow(run, "key long, sample_offset long, samples long, pcm binary")
    return out.withColumnRenamed("key", key)


DIGESTS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Sizes, digests and features of what is stored and what is read back from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = batch.column(0).to_pylist(), 0
            for group in _groups(batch.column(1).to_pylist()):
                media = encode([p for p, _ in group])
                rows = []
                for k, (_, n), m, p in zip(keys[at : at + len(group)], group, media, decode(media), strict=True):
                    rows.append(
                        (k, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-PAD:]), len(m), hashlib.sha256(m).hexdigest(), feature(p))
                    )
                at += len(group)
                kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = [f.split()[0] for f in DIGESTS.split(", ")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
                )

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(run, DIGESTS)


def op3_flac(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
