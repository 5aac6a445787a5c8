"""Media columns: TIFF files in and out of binary columns, by TIFF revision 6.0.

`pages` walks a file's image directories and gives one row per page: its size, compression, layout and
samples. Strips and tiles, either byte order, no compression, PackBits, LZW (MSB first, early change)
and deflate are read, and the horizontal differencing predictor is undone. `encode` writes such files;
it is what the round trip stores.

Defined cases: null media is no page; a file that is cut short, forged or not TIFF gives the pages before the
fault and then one row with `error` set and no samples, instead of failing the job; a directory that points back ends
the walk; rows that repeat a key give their pages one after the other; an empty table gives no rows; columns that are
neither named nor kept are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import exchange as X

# Tags, types and compression numbers of the format.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
TYPE_FORMAT = {1: "B", 3: "H", 4: "I"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
CLEAR, END = 256, 257
#: Samples that a byte can stand for at most, by compression; a whole file is never larger unpacked.
EXPANDS = {NONE: 1, PACKBITS: 128, LZW: 4096, DEFLATE: 1100, OLD_DEFLATE: 1100}

PAGE_SCHEMA = pa.schema([("key", pa.int64()), ("page", pa.int32()), ("width", pa.int32()), ("length", pa.int32()), ("samples", pa.int32()), ("compression", pa.int32()), ("tiled", pa.bool_()), ("predictor", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])
PAGES = "key long, page int, width int, length int, samples int, compression int, tiled boolean, predictor int, pixels binary, error string"


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += 2 + c
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three and more as repeats, the rest as literals of at most 128."""
    a = np.frombuffer(data, np.uint8)
    n = len(a)
    cut = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(cut, n))
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        nonlocal at
        while at < end:
            k = min(128, end - at)
            out.append(k - 1)
            out.extend(data[at : at + k])
            at += k

    for s, k in zip(cut[size >= 3].tolist(), size[size >= 3].tolist(), strict=True):
        literal(s)
        while k >= 2:
            m = min(128, k)
            out.append(257 - m)
            out.append(data[s])
            s, k = s + m, k - m
        at = s
    literal(n)
    return bytes(out)


#: Codes up to which each width reaches after a clear, and where each of them begins, in bits.
_CODES = np.arange(1, 4096)
_WIDTHS = np.select([_CODES < 255, _CODES < 767, _CODES < 1791], [9, 10, 11], 12)
_PLACES = np.concatenate(([0], np.cumsum(_WIDTHS)))
_LETTERS = [bytes((i,)) for i in range(256)] + [b"", b""]


def lzw_decode(data: bytes, size: int) -> bytes:
    """The codes from one clear to the next are cut out at once, as their widths follow from their number."""
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(4, np.uint8))).astype(np.int64)
    end, at, made = 8 * len(data), 0, 0
    out: list[bytes] = []
    while made < size:
        n = int(np.searchsorted(_PLACES, end - at, "right")) - 1
        if n <= 0:
            break
        place = at + _PLACES[:n]
        k = place >> 3
        word = (raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) >> (24 - (place & 7) - _WIDTHS[:n])
        codes = word & ((1 << _WIDTHS[:n]) - 1)
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        n = int(stop[0]) if len(stop) else n
        table = _LETTERS.copy()
        add, put = table.append, out.append
        last = b""
        for code in codes[:n].tolist():
            if code < len(table):
                piece = table[code]
                if last:
                    add(last + piece[:1])
            elif code == len(table) and last:
                piece = last + last[:1]
                add(piece)
            else:
                raise ValueError("LZW code out of range")
            put(piece)
            last = piece
        made += sum(map(len, out[len(out) - n :] if n else ()))
        if not len(stop) or codes[n] == END:
            break
        at += int(_PLACES[n + 1])
    return b"".join(out)[:size]


def lzw_encode(data: bytes) -> bytes:
    """Codes by one pass over the bytes, then all their bits at once: a code's width follows from how many were
    written since the last clear."""
    codes, clears = [CLEAR], [0]
    table: dict[int, int] = {}
    top, find, put = 258, table.get, codes.append
    w = data[0] if data else None
    for c in data[1:]:
        code = find(w << 8 | c)
        if code is None:
            put(w)
            table[w << 8 | c] = top
            top += 1
            w = c
            if top == 4095:
                clears.append(len(codes))
                put(CLEAR)
                table.clear()
                top = 258
        else:
            w = code
    if w is not None:
        put(w)
    put(END)
    code = np.array(codes, np.int64)
    since = np.arange(len(code)) - np.repeat(clears, np.diff([*clears, len(code)]))
    # the n-th code after a clear may be up to 256 + n, and the width grows one code early; a later clear comes at 12 bits
    made = 257 + since
    made[clears[1:]] = 4095
    width = np.select([made < 512, made < 1024, made < 2048], [9, 10, 11], 12)
    width[0] = 9
    at = np.cumsum(width) - width
    bits = np.zeros(int(at[-1] + width[-1]), np.uint8)
    for k in range(12):  # bit k from the top of each code
        has = width > k
        bits[at[has] + k] = code[has] >> (width[has] - 1 - k) & 1
    return np.packbits(bits).tobytes()


PACK = {NONE: bytes, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1)}


def unpack(kind: int, data: bytes, size: int) -> bytes:
    if kind == NONE:
        return data[:size]
    if kind == PACKBITS:
        return unpack_bits(data, size)
    if kind == LZW:
        return lzw_decode(data, size)
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise ValueError(f"compression {kind} isn't supported")


def encode(images: list[dict]) -> bytes:
    """A little-endian file of one page per image: pixels (rows x columns of uint8), compression, and
    either rows_per_strip or tile (a multiple of 16), predictor 1 or 2."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image in images:
        px, kind, predictor = image["pixels"], image["compression"], image.get("predictor", 1)
        h, w = px.shape
        side = image.get("tile")
        if side:
            grid = np.zeros((-(-h // side) * side, -(-w // side) * side), np.uint8)
            grid[:h, :w] = px
            blocks = [grid[y : y + side, x : x + side] for y in range(0, h, side) for x in range(0, w, side)]
        else:
            rows = image.get("rows_per_strip", h)
            blocks = [px[y : y + rows] for y in range(0, h, rows)]
        offsets, counts = [], []
        for b in blocks:
            if predictor == 2:
                d = b.copy()
                d[:, 1:] -= b[:, :-1]
                b = d
            packed = PACK[kind](b.tobytes())
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed
        out += b"\0" * (len(out) % 2)
        tags = [(WIDTH, 4, [w]), (LENGTH, 4, [h]), (BITS, 3, [8]), (COMPRESSION, 3, [kind]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [side]), (TILE_LENGTH, 4, [side]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if side else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [image.get("rows_per_strip", h)]), (STRIP_COUNTS, 4, counts)]
        entries = b""
        for tag, kind_, values in sorted(tags):
            raw = struct.pack(f"<{len(values)}{TYPE_FORMAT[kind_]}", *values)
            if len(raw) > 4:
                raw, at = struct.pack("<I", len(out)), raw
                out += at
            entries += struct.pack("<HHI", tag, kind_, len(values)) + raw.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"
    return bytes(out)


def pages(media: bytes) -> Iterator[dict]:
    """One dict per image directory, in the order of the links."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(media[:2]))
    if order is None or len(media) < 8 or struct.unpack_from(order + "H", media, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", media, 4)[0], set()
    while at and at not in seen:  # each directory once, so the file's size bounds the walk
        seen.add(at)
        tags: dict[int, tuple] = {}
        n = struct.unpack_from(order + "H", media, at)[0]
        for k in range(n):
            p = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", media, p)
            if f := TYPE_FORMAT.get(kind):
                f = f"{order}{count}{f}"
                where = p + 8 if struct.calcsize(f) <= 4 else struct.unpack_from(order + "I", media, p + 8)[0]
                tags[tag] = struct.unpack_from(f, media, where)
        one = lambda tag, default=None: tags[tag][0] if tag in tags else default  # noqa: B023, E731
        w, h, spp, kind, predictor = one(WIDTH), one(LENGTH), one(SAMPLES, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
        if set(tags.get(BITS, (8,))) != {8} or one(PLANAR, 1) != 1 or predictor not in (1, 2) or not w or not h or not spp:
            raise ValueError("only chunky 8-bit samples are supported")
        tiled = TILE_OFFSETS in tags
        # a forged size must not take memory: what a byte can stand for is bounded for each compression
        if w * h * spp > len(media) * EXPANDS.get(kind, 1):
            raise ValueError("more samples than the file can hold")
        if tiled:
            tw, th = one(TILE_WIDTH), one(TILE_LENGTH)
            if not tw or not th or tw * th * spp > len(media) * EXPANDS.get(kind, 1):
                raise ValueError("tiles without a size, or larger than the file can hold")
            places = [(y, x, th, tw) for y in range(0, h, th) for x in range(0, w, tw)]
            where, sizes = tags[TILE_OFFSETS], tags[TILE_COUNTS]
        else:
            rows = min(one(ROWS_PER_STRIP, h), h)
            if not rows:
                raise ValueError("strips without rows")
            places = [(y, 0, min(rows, h - y), w) for y in range(0, h, rows)]
            where, sizes = tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
        grid = np.zeros((h, w, spp), np.uint8)
        for (y, x, bh, bw), o, c in zip(places, where, sizes, strict=True):
            if o + c > len(media):
                raise ValueError("cut short")
            raw = unpack(kind, media[o : o + c], bh * bw * spp)
            if len(raw) != bh * bw * spp:
                raise ValueError("cut short")
            block = np.frombuffer(raw, np.uint8).reshape(bh, bw, spp)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            grid[y : y + bh, x : x + bw] = block[: h - y, : w - x]
        yield {"page": len(seen) - 1, "width": w, "length": h, "samples": spp, "compression": kind, "tiled": tiled, "predictor": predictor, "pixels": grid}
        at = struct.unpack_from(order + "I", media, at + 2 + 12 * n)[0]


def read_pages(df: DataFrame, media: str = "media", key: str = "key", keep: tuple[str, ...] = ()) -> DataFrame:
    """PAGES: one row per page of each file, in the files' order; the columns `keep` come beside them."""
    page = PAGE_SCHEMA
    names = [f.name for f in page]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = [batch.column(2 + i) for i in range(len(keep))]
            for i, (k, m) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                m = m.as_py()
                if m is None:
                    continue
                found = []
                try:
                    for p in pages(m):
                        found.append(p | {"key": k, "pixels": p["pixels"].tobytes(), "error": None})
                except (ValueError, KeyError, TypeError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as e:
                    found.append(dict.fromkeys(names) | {"key": k, "error": str(e) or type(e).__name__})
                got = pa.RecordBatch.from_pylist(found, schema=page)
                if found:
                    yield pa.RecordBatch.from_arrays([*got.columns, *(pa.concat_arrays([c[i : i + 1]] * len(found)) for c in more)], names=[*names, *keep])

    extra = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(F.col(key).cast("long").alias("key"), F.col(media).alias("media"), *(F.col(c) for c in keep)).mapInArrow(X.trimmed(rows), PAGES + extra)
