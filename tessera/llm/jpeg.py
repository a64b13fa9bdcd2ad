"""Media columns: baseline JPEG written, parsed, Huffman-decoded and summarised with numpy.

``encode`` stores a payload losslessly as quantised coefficients: 64 bytes fill one block, every
coefficient is of category 8 (magnitude 128 to 255), quantisation steps are 1, and a restart marker
follows each block. ``decode`` reads any baseline JPEG: it parses the markers and decodes the
entropy-coded segments between restart markers side by side, one numpy lane for each segment, with
the file's own Huffman tables. The thumbnail takes the luminance blocks' DC values only.

Edge cases: a null or empty text is 64 bytes 0; what is not a baseline JPEG, or lacks a table that its
thumbnail needs, gives null features and a reason in ``error``, and never fails the others of its task;
a comment that only looks like a stored payload's is none; equal texts give equal stored bytes. Restart
segments are decoded ``LANES`` at a time, so a very long text needs a few times its own size at most.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The zigzag order of the format, as row-major places.
ZIGZAG = np.array([r * 8 + c for s in range(15) for r, c in (lambda d: d if s % 2 else d[::-1])([(r, s - r) for r in range(max(0, s - 7), min(7, s) + 1)])])
#: Blocks decoded side by side at most; bounds the memory of a task.
LANES = 20_000
#: The largest number of so many bits.
ONES = (1 << np.arange(16)) - 1


class NotBaseline(ValueError):
    """The bytes are not a JPEG of the baseline kind."""


#: What broken bytes can raise; each becomes a reason in ``error``.
BROKEN = (ValueError, IndexError, StopIteration, KeyError, ZeroDivisionError, OverflowError)


@dataclass
class Component:
    ident: int
    across: int
    down: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Picture:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    huffman: dict[int, tuple[bytes, bytes]]
    restart: int
    comment: bytes
    scan: np.ndarray

    @property
    def mcus(self) -> tuple[int, int]:
        a, d = max(c.across for c in self.components), max(c.down for c in self.components)
        return -(-self.width // (8 * a)), -(-self.height // (8 * d))

    def tables(self) -> tuple:
        return (tuple((c.across, c.down, c.dc, c.ac) for c in self.components), tuple(sorted(self.huffman.items())))


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def encode(payload: bytes) -> bytes:
    """A grey baseline JPEG whose coefficients are the payload, a positive multiple of 64 bytes."""
    n = len(payload) // 64
    wide = max(int(np.ceil(np.sqrt(n))), -(-n // 8191))
    high = -(-n // wide)
    data = np.zeros((wide * high, 64), dtype=np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    head = b"\xff\xd8" + segment(0xFE, b"payload %d" % len(payload)) + segment(0xDB, b"\0" + bytes([1] * 64))
    head += segment(0xC0, b"\x08" + (high * 8).to_bytes(2, "big") + (wide * 8).to_bytes(2, "big") + b"\x01\x01\x11\0")
    one = b"\x01" + bytes(15)
    head += segment(0xC4, b"\0" + one + b"\x08" + b"\x10" + one + b"\x08")  # category 8, as code 0, in either table
    head += segment(0xDD, b"\0\x01") + segment(0xDA, b"\x01\x01\0\0\x3f\0")
    # Bytes below 128 are the values 128 to 255, the others -128 to -255.
    magnitude = np.where(data < 128, data + np.uint8(128), np.uint8(255) - data)
    bits = np.zeros((len(data), 64, 9), dtype=np.uint8)
    bits[:, :, 1:] = np.unpackbits(magnitude.reshape(len(data), 64, 1), axis=2)
    out = np.empty((len(data), 74), dtype=np.uint8)
    out[:, :72] = np.packbits(bits.reshape(len(data), 576), axis=1)
    out[:, 72] = 0xFF
    out[:, 73] = 0xD0 + np.arange(len(data)) % 8
    stuffed = out == 0xFF
    stuffed[:, 72] = False
    flat, again = out.reshape(-1)[:-2], stuffed.reshape(-1)[:-2]
    scan = np.repeat(flat, 1 + again)
    scan[(np.cumsum(1 + again) - 1)[again]] = 0
    return head + scan.tobytes() + b"\xff\xd9"


def parse(data: bytes) -> Picture:
    """Markers and tables up to the first scan, and that scan's bytes."""
    if data[:2] != b"\xff\xd8":
        raise NotBaseline("no start marker")
    at, quant, huffman, restart, comment, frame = 2, {}, {}, 0, b"", None
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise NotBaseline("markers broken off")
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], dtype=">u1" if wide == 1 else ">u2").astype(np.int32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise NotBaseline("samples are not of 8 bits")
            parts = [body[6 + 3 * k : 9 + 3 * k] for k in range(body[5])]
            frame = (int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), [Component(p[0], p[1] >> 4, p[1] & 15, p[2]) for p in parts])
            if not frame[0] or not frame[1] or not parts or not all(1 <= x <= 4 for c in frame[2] for x in (c.across, c.down)):
                raise NotBaseline("sizes or sampling factors out of range")
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise NotBaseline("not a sequential Huffman frame")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            if frame is None or body[0] != len(frame[2]):
                raise NotBaseline("the scan does not hold all components")
            for k in range(body[0]):
                c = next(c for c in frame[2] if c.ident == body[1 + 2 * k])
                c.dc, c.ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
            return Picture(*frame, quant, huffman, restart, comment, np.frombuffer(data, dtype=np.uint8, offset=at))


def lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """For every 16 bits: length of the code they start with times 256, plus its symbol; 0 where there is none."""
    out, code, k = np.zeros(1 << 16, dtype=np.int64), 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | table[1][k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lanes(pic: Picture) -> tuple[np.ndarray, np.ndarray]:
    """The scan without stuffing and markers, and where each restart segment starts in it."""
    scan = pic.scan
    mark = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[mark + 1]
    ends = mark[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
    stop = int(ends[0]) if len(ends) else len(scan)
    mark, after = mark[mark < stop], after[mark < stop]
    restarts = mark[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(stop, dtype=bool)
    keep[mark[after == 0] + 1] = False
    keep[restarts] = keep[restarts + 1] = False
    place = np.cumsum(keep)
    starts = np.concatenate([[0], place[restarts]]).astype(np.int64)
    return scan[:stop][keep], starts


def decode_all(pics: list[Picture]) -> list[list[np.ndarray]]:
    """Coefficients (blocks, 64) in zigzag order for each component of pictures that share their tables."""
    comps, huffman = pics[0].components, pics[0].huffman
    luts = {k: lookup(t) for k, t in huffman.items()}
    pieces, starts, todo, owner, first, base = [], [], [], [], [], 0
    for i, pic in enumerate(pics):
        body, at = lanes(pic)
        whole = pic.mcus[0] * pic.mcus[1]
        each = pic.restart or whole
        need = -(-whole // each)
        if len(at) < need:
            raise NotBaseline("restart segments are missing")
        at = at[:need]
        left = np.full(need, each, dtype=np.int64)
        left[-1] = whole - each * (need - 1)
        pieces += [body, np.full(8, 0xFF, dtype=np.uint8)]
        starts.append((at + base) * 8)
        todo.append(left)
        owner.append(np.full(need, i))
        first.append(np.arange(need) * each)
        base += len(body) + 8
    data = np.concatenate(pieces)
    pos, left, owner, first = (np.concatenate(x) for x in (starts, todo, owner, first))
    units = [c.across * c.down if len(comps) > 1 else 1 for c in comps]
    sizes = [pic.mcus[0] * pic.mcus[1] if len(comps) > 1 else -(-pic.width // 8) * -(-pic.height // 8) for pic in pics]
    shift = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out = [np.zeros((shift[-1] * u, 64), dtype=np.int16) for u in units]
    for a in range(0, len(pos), LANES):
        z = min(a + LANES, len(pos))
        low, high = int(pos[a]) >> 3, (int(pos[z]) >> 3) + 8 if z < len(pos) else len(data)
        run_lanes(data[low:high], pos[a:z] - low * 8, left[a:z], shift[owner[a:z]] + first[a:z], comps, units, luts, out)
    return [[out[c][shift[i] * units[c] : shift[i + 1] * units[c]] for c in range(len(comps))] for i in range(len(pics))]


def run_lanes(data: np.ndarray, pos: np.ndarray, left: np.ndarray, first: np.ndarray, comps: list[Component], units: list[int], luts: dict[int, np.ndarray], out: list[np.ndarray]) -> None:
    """Decode restart segments side by side: pos, where each starts in bits; left, its number of units; first, the first of them in the picture; into out."""
    limit = len(data) - 5
    win = np.zeros(limit, dtype=np.uint64)
    for k in range(5):  # 40 bits from every byte on
        win |= data[k : limit + k].astype(np.uint64) << np.uint64(32 - 8 * k)
    win = win.astype(np.int64)
    pred = [np.zeros(len(pos), dtype=np.int64) for _ in comps]

    def read(pos, lut):
        w = win.take(pos >> 3)
        sh = pos & 7
        found = lut.take((w >> (24 - sh)) & 0xFFFF)
        length, s = found >> 8, found & 15
        if not length.all():
            raise NotBaseline("a code is not in its table")
        length += s
        full = ONES.take(s)
        value = (w >> (40 - sh - length)) & full
        value -= full * (value <= full >> 1)
        return pos + length, found, s, value

    for mcu in range(int(left.max())):
        live = np.flatnonzero(left > mcu)
        for c, comp in enumerate(comps):
            dc, ac = luts[comp.dc], luts[0x10 | comp.ac]
            for u in range(units[c]):
                row = (first[live] + mcu) * units[c] + u
                at, _, _, diff = read(pos[live], dc)
                pred[c][live] += diff
                block = np.zeros((64, len(live)), dtype=np.int16)
                block[0] = pred[c][live]
                same = 1
                while same < 64:  # as long as all lanes are at the same coefficient
                    new, found, s, value = read(at, ac)
                    if not s.all() or (found & 0xF0).any():
                        break
                    block[same], at, same = value, new, same + 1
                act, k = np.arange(len(live) if same < 64 else 0), np.full(len(live), same)
                while len(act):
                    at[act], found, s, value = read(at[act], ac)
                    run = (found >> 4) & 15
                    k[act] += run
                    hit = s > 0
                    if (k[act[hit]] > 63).any():
                        raise NotBaseline("a block has too many coefficients")
                    block[k[act[hit]], act[hit]] = value[hit]
                    k[act] += 1
                    act = act[~((s == 0) & (run < 15) | (k[act] > 63))]
                pos[live] = at
                out[c][row] = block.T


def thumbnail(pic: Picture, luma: np.ndarray) -> np.ndarray:
    """Mean grey level of each luminance block, from DC values only, as rows of the picture."""
    c = pic.components[0]
    grey = np.clip(np.rint(luma[:, 0].astype(np.float64) * int(pic.quant[c.quant][0]) / 8 + 128), 0, 255).astype(np.uint8)
    if len(pic.components) == 1:
        return grey.reshape(-(-pic.height // 8), -(-pic.width // 8))
    x, y = pic.mcus
    return grey.reshape(y, x, c.down, c.across).transpose(0, 2, 1, 3).reshape(y * c.down, x * c.across)[: -(-pic.height // 8), : -(-pic.width // 8)]


def thumb_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8 by 8 reduction are brighter than its mean."""
    sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    sums[1:, 1:] = thumb.astype(np.float64).cumsum(0).cumsum(1)
    edge = lambda n: (np.arange(8) * n // 8, np.maximum((np.arange(8) + 1) * n // 8, np.arange(8) * n // 8 + 1))
    (y0, y1), (x0, x1) = edge(thumb.shape[0]), edge(thumb.shape[1])
    cell = (sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]) / np.outer(y1 - y0, x1 - x0)
    return np.packbits(cell.reshape(-1) > cell.mean()).tobytes().hex()


def decode(blobs: list[bytes | None]) -> list[tuple[Picture, list[np.ndarray]] | str]:
    """(picture, coefficients by component) for each JPEG, or what is wrong with it; those with equal tables side by side."""
    out: list = [None] * len(blobs)
    groups: dict[tuple, list[tuple[int, Picture]]] = {}
    for i, b in enumerate(blobs):
        try:
            pic = parse(bytes(b or b""))
        except BROKEN as e:
            out[i] = str(e) or "broken header"
        else:
            groups.setdefault(pic.tables(), []).append((i, pic))
    for some in groups.values():
        try:
            for (i, pic), coefs in zip(some, decode_all([p for _, p in some]), strict=True):
                out[i] = (pic, coefs)
        except BROKEN as e:
            if len(some) == 1:
                out[some[0][0]] = str(e) or "broken scan"
            else:
                for i, _ in some:
                    out[i] = decode([blobs[i]])[0]
    return out


def stored(pic: Picture, coefs: np.ndarray) -> bytes:
    """The payload that encode() has put into the coefficients."""
    if not 0 < int(pic.comment.split()[-1]) <= coefs.size:
        raise NotBaseline("the comment does not name the payload's size")
    v = coefs.reshape(-1)
    data = np.where(v >= 0, v - 128, -v).astype(np.uint8)
    return data.tobytes()[: int(pic.comment.split()[-1])]


def batches(sizes: list[int]):
    """Ranges of rows of at most LANES * 64 bytes together, or one row."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > LANES * 64:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def media_column(text: Column) -> Column:
    """The stored form, a JPEG, of a whole text's UTF-8 bytes padded with bytes 0 to a positive multiple of 64."""

    @F.pandas_udf("binary")
    def media(texts: pd.Series) -> pd.Series:
        def one(t):
            b = t.encode("utf-8", "surrogatepass")
            return encode(b + bytes(-len(b) % 64 or (0 if b else 64)))

        return pd.Series([one(t) for t in texts], dtype="object")

    return media(F.coalesce(text, F.lit("")))


def features_column(media: Column) -> Column:
    """struct of what a JPEG column holds: dimensions, thumbnail and its hash, and the digests of a stored payload."""

    @F.pandas_udf("width int, height int, thumb_width int, thumb binary, thumb_hash string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, error string")
    def found(blobs: pd.Series) -> pd.DataFrame:
        rows, blobs = [], list(blobs)
        for a, z in batches([len(b or b"") for b in blobs]):
            for b, got in zip(blobs[a:z], decode(blobs[a:z]), strict=True):
                if isinstance(got, str):
                    rows.append((None,) * 10 + (got,))
                    continue
                pic, coefs = got
                try:
                    thumb = thumbnail(pic, coefs[0])
                    own = stored(pic, coefs[0]) if re.fullmatch(rb"payload [0-9]{1,18}", pic.comment) else None
                except BROKEN as e:
                    rows.append((None,) * 10 + (str(e) or "broken tables",))
                    continue
                digest = (None, None, None) if own is None else (len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-64:]))
                rows.append((pic.width, pic.height, thumb.shape[1], thumb.tobytes(), thumb_hash(thumb), *digest, len(b), hashlib.sha256(b).hexdigest(), None))
        names = ["width", "height", "thumb_width", "thumb", "thumb_hash", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "error"]
        return pd.DataFrame(rows, columns=names, dtype="object")

    return found(media)
