"""Media columns in baseline JPEG.

``jpeg_from_bytes`` stores any bytes without loss: each byte is the DC coefficient of one 8 x 8 block of a grey image 64
blocks wide. With a DC quantiser of 8 a block whose quantised DC is v - 128 is flat at v, so the DC-only thumbnail of the
image is the stored data. Every row of blocks is a restart interval, which byte-aligns it, lets a lost row be skipped and
lets many rows be decoded side by side. More than 8191 rows become further images after the first (strips). The length
before padding is kept in a comment segment.

``dc_thumbnail`` reads any baseline JPEG (one to four components, any sampling, with or without restart intervals): it
parses the markers, Huffman-decodes the scan, in which AC symbols are read only to be skipped, and reconstructs the
luminance from the DC coefficients. All restart intervals of a batch of images are decoded in step, as lanes of numpy
arrays, so Python runs once per block position and not once per symbol.

Cases: a null or empty text is stored as 64 zero bytes; equal texts give equal media and features; repeated rows are
independent; a file that is no baseline JPEG raises ValueError. Only the id and the text are read from the table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, ship_package, slices

#: Blocks in a row of the images that hold bytes, and rows that one image may have (65,535 pixels high at most).
WIDTH, MAX_ROWS = 64, 8191
#: Rows of blocks that are coded at once, bytes of text taken together, and bytes of media decoded together.
ROWS_AT_ONCE, BYTES_AT_ONCE, MEDIA_AT_ONCE = 8192, 1 << 20, 3 << 19
#: The luminance DC code lengths and categories of the JPEG standard (ITU T.81, table K.3).
DC_LENGTHS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = list(range(12))
#: The only AC symbol written is end of block, coded in one bit.
AC_LENGTHS = [1] + [0] * 15
AC_SYMBOLS = [0]
DC_QUANTISER = 8


def huffman_codes(lengths: Sequence[int], symbols: Sequence[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, bits) by the standard's rule: codes count up and shift left at each length."""
    found, code, at = [], 0, 0
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            found.append((symbols[at], code, bits))
            code, at = code + 1, at + 1
        code <<= 1
    return found


def _coder() -> tuple[np.ndarray, np.ndarray]:
    """For a DC difference from -255 to 255 (index 255 is 0): the bits of its code, its extra bits and the end of block, and how many."""
    codes = {symbol: (code, bits) for symbol, code, bits in huffman_codes(DC_LENGTHS, DC_SYMBOLS)}
    _, eob, eob_bits = huffman_codes(AC_LENGTHS, AC_SYMBOLS)[0]
    bits, sizes = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, n = codes[category]
        extra = d if d >= 0 else d + (1 << category) - 1
        bits[d + 255] = (((code << category) | extra) << eob_bits) | eob
        sizes[d + 255] = n + category + eob_bits
    return bits, sizes


_BITS, _SIZES = _coder()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int, comment: bytes) -> bytes:
    """Everything before the scan's data."""
    tables = bytes([0x00, *DC_LENGTHS, *DC_SYMBOLS]) + bytes([0x10, *AC_LENGTHS, *AC_SYMBOLS])
    return b"".join((
        b"\xff\xd8", _segment(0xFE, comment), _segment(0xDB, bytes([0, DC_QUANTISER] + [1] * 63)), _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, WIDTH * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, tables), _segment(0xDD, struct.pack(">H", WIDTH)), _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


def _scan_rows(samples: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code rows of samples as restart intervals; ``ends`` has the marker byte after each. The bytes, and where each row stops."""
    level = samples.astype(np.int64) - 128
    level[:, 1:] -= level[:, :-1].copy()
    at = (level + 255).ravel()
    size = _SIZES[at]
    n = len(samples)
    per_row = size.reshape(n, WIDTH).sum(1)
    row_bytes = (per_row + 7) >> 3
    starts = np.concatenate(([0], np.cumsum(row_bytes)))
    after = np.cumsum(size.reshape(n, WIDTH), axis=1)
    offset = (after - size.reshape(n, WIDTH) + (starts[:-1] * 8)[:, None]).ravel()
    word = _BITS[at] << (24 - size - (offset & 7))
    first = offset >> 3
    total = int(starts[-1])
    out = np.bincount(first, (word >> 16) & 255, total + 2) + np.bincount(first + 1, (word >> 8) & 255, total + 2) + np.bincount(first + 2, word & 255, total + 2)
    data = out[:total].astype(np.uint8)
    data[starts[1:] - 1] |= ((1 << (row_bytes * 8 - per_row)) - 1).astype(np.uint8)  # the last byte of an interval is filled with ones
    stuffed = data == 0xFF
    row_of = np.repeat(np.arange(n), row_bytes)
    place = np.arange(total) + np.cumsum(stuffed) - stuffed + 2 * row_of
    stops = starts[1:] + np.cumsum(stuffed)[starts[1:] - 1] + 2 * np.arange(1, n + 1)
    coded = np.zeros(int(stops[-1]), np.uint8)
    coded[place] = data
    coded[stops - 2], coded[stops - 1] = 0xFF, ends
    return coded, stops


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % WIDTH or (0 if payload else WIDTH))


def jpegs_from_bytes(payloads: Sequence[bytes]) -> list[bytes]:
    """One media value for each payload, padded with zero bytes to a positive multiple of 64."""
    full = [padded(p) for p in payloads]
    rows = [len(p) // WIDTH for p in full]
    samples = np.frombuffer(b"".join(full), np.uint8).reshape(-1, WIDTH)
    within = np.concatenate([np.arange(n) for n in rows]) if rows else np.zeros(0, np.int64)
    last = np.zeros(len(samples), bool)
    last[np.cumsum(rows) - 1] = True
    last |= within % MAX_ROWS == MAX_ROWS - 1
    ends = np.where(last, 0xD9, 0xD0 + within % MAX_ROWS % 8).astype(np.uint8)
    coded, stops, base = [], [], 0
    for i in range(0, len(samples), ROWS_AT_ONCE):
        part, stop = _scan_rows(samples[i : i + ROWS_AT_ONCE], ends[i : i + ROWS_AT_ONCE])
        coded.append(part)
        stops.append(stop + base)
        base += len(part)
    data, stop = b"".join(x.tobytes() for x in coded), np.concatenate([[0], *stops]) if stops else np.zeros(1, np.int64)
    media, row = [], 0
    for payload, n in zip(payloads, rows, strict=True):
        strips = []
        for first in range(0, n, MAX_ROWS):
            many = min(MAX_ROWS, n - first)
            strips.append(_header(many, b"bytes=%d" % len(payload)) + data[stop[row + first] : stop[row + first + many]])
        media.append(b"".join(strips))
        row += n
    return media


def jpeg_from_bytes(payload: bytes) -> bytes:
    return jpegs_from_bytes([payload])[0]


@dataclass(frozen=True)
class Component:
    number: int
    across: int
    down: int
    quantiser: int
    dc: int = 0
    ac: int = 0


@dataclass
class Image:
    """What the markers of one image say, and where its scan is."""

    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, int] = field(default_factory=dict)
    tables: dict[tuple[int, int], bytes] = field(default_factory=dict)
    restart: int = 0
    comment: bytes = b""
    scan: int = 0
    end: int = 0


def parse_markers(data: bytes, at: int = 0) -> Image:
    """Read the segments of the image that starts at ``at``, up to its end marker."""
    image, frame = Image(), False
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("broken segment")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                image.quantisers[number] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                image.tables[body[0] >> 4, body[0] & 15] = body[1:n]
                body = body[n:]
        elif marker in (0xC0, 0xC1):
            depth, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8:
                raise ValueError("not 8-bit samples")
            image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            frame = True
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            image.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            if not frame or body[0] != len(image.components):
                raise ValueError("not one interleaved scan")
            used = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            image.components = [Component(c.number, c.across, c.down, c.quantiser, used[c.number] >> 4, used[c.number] & 15) for c in image.components]
            image.scan = at
            break
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("no end of image")
        if data[at + 1] == 0xD9:
            image.end = at + 2
            return image
        if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
            raise ValueError("more than one scan")
        at += 2


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits: the length of the code they begin with times 256, plus its symbol; 0 where there is none."""
    found = np.zeros(1 << 16, np.int64)
    for symbol, code, bits in huffman_codes(table[:16], table[16:]):
        found[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | symbol
    return found


_TABLES: dict[bytes, np.ndarray] = {}


def _table(table: bytes) -> np.ndarray:
    if table not in _TABLES:
        if len(_TABLES) > 64:
            _TABLES.clear()
        _TABLES[table] = _lookup(table)
    return _TABLES[table]


def _signed(extra: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)


def _decode_intervals(data: np.ndarray, starts: np.ndarray, blocks: np.ndarray, plan: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """DC values, lanes by blocks, of restart intervals that begin at ``starts`` and have so many blocks; ``plan`` has the component and tables of each block of an MCU."""
    words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    most = int(blocks.max(initial=0))
    out = np.zeros((len(starts), most), np.int64)
    at, previous = starts * 8, np.zeros((len(starts), 1 + max(c for c, _, _ in plan)), np.int64)
    lanes = np.arange(len(starts))
    for block in range(most):
        component, dc, ac = plan[block % len(plan)]
        if block and (blocks[lanes] <= block).any():
            lanes = lanes[blocks[lanes] > block]
        here = at[lanes]
        word = words[here >> 3].astype(np.uint64) << (here & 7).astype(np.uint64)
        code = dc[(word >> np.uint64(48)).astype(np.int64)]
        bits, size = code >> 8, code & 255
        if not bits.all():
            raise ValueError("a code that no table has")
        word <<= bits.astype(np.uint64)
        extra = ((word >> np.uint64(1)) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = previous[lanes, component] + _signed(extra, size)
        previous[lanes, component] = value
        out[lanes, block] = value
        word <<= size.astype(np.uint64)
        code = ac[(word >> np.uint64(48)).astype(np.int64)]
        at[lanes] = here + bits + size + (code >> 8)
        if not code.all():
            raise ValueError("a code that no table has")
        more = (code & 255) != 0
        if more.any():
            _skip_ac(words, at, lanes[more], code[more], ac)
    return out


def _skip_ac(words: np.ndarray, at: np.ndarray, lanes: np.ndarray, code: np.ndarray, ac: np.ndarray) -> None:
    """Move lanes past the AC symbols of their block; ``code`` is the first, already read but for its extra bits."""
    place = np.ones(len(lanes), np.int64)
    while len(lanes):
        symbol = code & 255
        at[lanes] += symbol & 15
        place += (symbol >> 4) + 1
        going = (symbol != 0) & (place < 64)
        lanes, place = lanes[going], place[going]
        if not len(lanes):
            return
        here = at[lanes]
        code = ac[((words[here >> 3].astype(np.uint64) << (here & 7).astype(np.uint64)) >> np.uint64(48)).astype(np.int64)]
        if not code.all():
            raise ValueError("a code that no table has")
        at[lanes] += code >> 8


def _destuffed(data: bytes, images: list[Image]) -> tuple[np.ndarray, np.ndarray]:
    """The scans' data without stuffing and markers, and where the restart intervals begin in it."""
    raw = np.frombuffer(b"".join(data[i.scan : i.end] for i in images), np.uint8)
    ff = raw[:-1] == 0xFF
    zero = np.flatnonzero(ff & (raw[1:] == 0))
    marks = np.flatnonzero(ff & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD9))
    keep = np.ones(len(raw), bool)
    keep[zero + 1] = keep[marks] = keep[marks + 1] = False
    stops = np.cumsum(keep)[marks]
    starts = np.concatenate(([0], stops[:-1]))
    return np.concatenate((raw[keep], np.zeros(16, np.uint8))), starts


def dc_thumbnails(media: Sequence[bytes]) -> list[list[tuple[Image, np.ndarray]]]:
    """For each media value its images, each with the luminance of its blocks (rows by columns, 8-bit)."""
    joined = b"".join(media)
    found: list[list[Image]] = []
    base = 0
    for value in media:
        own, at, end = [], base, base + len(value)
        while at < end or not own:
            own.append(parse_markers(joined, at))
            at = own[-1].end
        found.append(own)
        base = end
    alike: dict[tuple, list[Image]] = {}
    for image in (i for own in found for i in own):
        key = (tuple(image.components), tuple(sorted(image.tables.items())), tuple(sorted(image.quantisers.items())))
        alike.setdefault(key, []).append(image)
    planes: dict[int, np.ndarray] = {}
    for same in alike.values():
        for some in _some_at_once(same):
            _decode_alike(joined, some, planes)
    return [[(i, planes[id(i)]) for i in own] for own in found]


def _some_at_once(images: list[Image], most: int = MEDIA_AT_ONCE) -> Iterator[list[Image]]:
    """Runs of images with at most ``most`` bytes in their scans, or of one image: the strips of a long value aren't all decoded in step."""
    some, held = [], 0
    for image in images:
        size = image.end - image.scan
        if some and held + size > most:
            yield some
            some, held = [], 0
        some.append(image)
        held += size
    if some:
        yield some


def _decode_alike(data: bytes, images: list[Image], planes: dict[int, np.ndarray]) -> None:
    """Decode images that share components and tables, all their restart intervals in step."""
    parts = images[0].components
    single = len(parts) == 1
    wide, high = (1, 1) if single else (max(c.across for c in parts), max(c.down for c in parts))
    plan, lum = [], []
    for n, c in enumerate(parts):
        for y in range(1 if single else c.down):
            for x in range(1 if single else c.across):
                if n == 0:
                    lum.append((len(plan), y, x))
                plan.append((n, _table(images[0].tables[0, c.dc]), _table(images[0].tables[1, c.ac])))
    shapes = [(-(-i.height // (8 * high)), -(-i.width // (8 * wide))) for i in images]
    counts, owners = [], []
    for i, (rows, columns) in zip(images, shapes, strict=True):
        total = rows * columns
        each = i.restart or total
        n = -(-total // each)
        counts += [each] * (n - 1) + [total - each * (n - 1)]
        owners.append(n)
    stream, starts = _destuffed(data, images)
    if len(starts) != len(counts):
        raise ValueError("restart markers don't fit the image's size")
    blocks = np.array(counts, np.int64) * len(plan)
    values = _decode_intervals(stream, starts, blocks, plan)
    q, lane = images[0].quantisers[parts[0].quantiser], 0
    for i, (rows, columns), n in zip(images, shapes, owners, strict=True):
        own = values[lane : lane + n]
        flat = own.reshape(-1)[: n * own.shape[1]] if len(set(blocks[lane : lane + n])) == 1 and own.shape[1] == blocks[lane] else np.concatenate([own[k, : blocks[lane + k]] for k in range(n)])
        lane += n
        mcus = flat.reshape(rows, columns, len(plan))
        down, across = (1, 1) if single else (parts[0].down, parts[0].across)
        plane = np.empty((rows * down, columns * across), np.int64)
        for k, y, x in lum:
            plane[y::down, x::across] = mcus[:, :, k]
        planes[id(i)] = np.clip((plane * q + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(plane: np.ndarray) -> int:
    """64 bits: which cells of an 8 x 8 grid of means are above the mean of the grid."""
    rows, columns = plane.shape
    cuts = [(np.arange(8) * n // 8, np.maximum(np.diff(np.append(np.arange(8) * n // 8, n)), 1)) for n in (rows, columns)]
    grid = np.add.reduceat(np.add.reduceat(plane, cuts[0][0], axis=0, dtype=np.int64), cuts[1][0], axis=1) / cuts[0][1][:, None] / cuts[1][1][None, :]
    return int.from_bytes(np.packbits(grid > grid.mean()).tobytes(), "big")


def bytes_from_jpegs(media: Sequence[bytes]) -> list[tuple[bytes, int, str]]:
    """Read back what jpegs_from_bytes stored: the padded payload, its length before padding, and the feature (size and thumbnail hash)."""
    found = []
    for images in dc_thumbnails(media):
        plane = np.concatenate([p for _, p in images]) if len(images) > 1 else images[0][1]
        width, height = images[0][0].width, sum(i.height for i, _ in images)
        found.append((plane.tobytes(), int(images[0][0].comment.removeprefix(b"bytes=")), f"{width}x{height}:{thumbnail_hash(plane):016x}"))
    return found


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media: the text's bytes as a JPEG column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_q_text", most=BYTES_AT_ONCE):
                media = jpegs_from_bytes([x or b"" for x in part.column("_q_text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("_q_text")).mapInArrow(run, "doc_id long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Read the media column back: sizes and digests of the stored data, dimensions and thumbnail hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", most=MEDIA_AT_ONCE):
                stored = part.column("media").to_pylist()
                read = bytes_from_jpegs(stored)
                columns = [
                    part.column("doc_id"), pa.array([n for _, n, _ in read], pa.int64()), pa.array([len(p) for p, _, _ in read], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p, _, _ in read]), pa.array([zlib.crc32(p[-64:]) for p, _, _ in read], pa.int64()),
                    pa.array([len(m) for m in stored], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in stored]), pa.array([f for _, _, f in read]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [c.split()[0] for c in schema.split(", ")]
    ship_package(media.sparkSession)
    return media.mapInArrow(run, schema)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(encode_media(read_table(spark, sf_dir, "documents")))
