"""Media columns: Netpbm and BMP images as binary columns, decoded to numpy arrays, resized by
area with integral images, cut into NPY tiles, and hashed by differences of neighbours."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkfolio.llm.textnum import ddl, slices

UNIT = 576  # bytes: 24 grey samples wide and 24 high, or 24 by 8 in colour
WIDTH = 24
TILE_ROWS = 512


class MediaError(ValueError):
    """The bytes are no image of a known form."""


def _header(data: bytes, n: int) -> tuple[list[int], int]:
    """``n`` numbers of a Netpbm header after the magic, comments skipped, and where the samples start."""
    out, i = [], 2
    while len(out) < n:
        while data[i:i + 1].isspace() or data[i:i + 1] == b"#":
            i = data.find(b"\n", i) + 1 if data[i:i + 1] == b"#" else i + 1
            if i <= 0:
                raise MediaError("unended comment")
        j = i
        while data[j:j + 1].isdigit():
            j += 1
        if i == j:
            raise MediaError("bad header")
        out.append(int(data[i:j]))
        i = j
    return out, i + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6: (height, width) for bits and grey, (height, width, 3) for colour; 8 or 16 bits."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise MediaError("no Netpbm image")
    bits, colour, plain = kind in (b"P1", b"P4"), kind in (b"P3", b"P6"), kind < b"P4"
    head, at = _header(data, 2 if bits else 3)
    w, h = head[:2]
    top = 1 if bits else head[2]
    if not w or not h or not 0 < top < 65536:
        raise MediaError("bad size")
    n = w * h * (3 if colour else 1)
    if plain:
        body = b"\n".join(x.split(b"#")[0] for x in data[at - 1:].split(b"\n"))
        v = np.array([c - 48 for c in body if c in b"01"] if bits else [int(x) for x in body.split()])
    elif bits:
        line = -(-w // 8)
        raw = np.frombuffer(data, np.uint8, offset=at)[:line * h]
        v = np.unpackbits(raw).reshape(-1, line * 8)[:, :w].ravel()
    else:
        v = np.frombuffer(data[at:at + n * (2 if top > 255 else 1)], np.uint8 if top < 256 else ">u2")
    if len(v) < n:
        raise MediaError("too few samples")
    v = v[:n].astype(np.uint8 if top < 256 else np.uint16)
    return v.reshape((h, w, 3) if colour else (h, w))


def encode_netpbm(a: np.ndarray) -> bytes:
    """P5 for two dimensions, P6 for three."""
    h, w = a.shape[:2]
    return b"P%d\n%d %d\n255\n" % (5 if a.ndim == 2 else 6, w, h) + np.ascontiguousarray(a, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8, 24 and 32 bits: (height, width) for a grey palette, else RGB."""
    if data[:2] != b"BM" or len(data) < 54:
        raise MediaError("no BMP image")
    at, size, w, h, _, depth, packed = struct.unpack_from("<I I i i H H I", data, 10)
    if packed or depth not in (8, 24, 32) or w <= 0 or not h:
        raise MediaError("unknown kind of BMP")
    line = (w * depth // 8 + 3) // 4 * 4
    rows = abs(h)
    if len(data) < at + line * rows:
        raise MediaError("too few samples")
    a = np.frombuffer(data, np.uint8, line * rows, at).reshape(rows, line)[:, :w * depth // 8]
    a = a[::-1] if h > 0 else a
    if depth == 8:
        n = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, n * 4, 14 + size).reshape(n, 4)[:, 2::-1]
        if int(a.max()) >= n:
            raise MediaError("sample outside the palette")
        a = palette[a]
        return a[..., 0] if (palette == palette[:, :1]).all() else a
    return a.reshape(rows, w, depth // 8)[..., 2::-1]


def encode_bmp(a: np.ndarray) -> bytes:
    """24 bits, rows from the bottom up; grey is written as three equal samples."""
    a = np.repeat(a[..., None], 3, 2) if a.ndim == 2 else a
    h, w = a.shape[:2]
    line = (w * 3 + 3) // 4 * 4
    body = np.zeros((h, line), np.uint8)
    body[:, :w * 3] = a[::-1, :, ::-1].reshape(h, w * 3)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + body.size, 0, 0, 54, 40, w, h, 1, 24, 0, body.size, 2835, 2835, 0, 0)
    return head + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def resize_area(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area below each target sample. The integral image is read at fractional
    places by linear interpolation, so areas may start and end inside samples."""
    a = a.astype(np.float64)

    def along(x: np.ndarray, n: int) -> np.ndarray:
        total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0)])
        cut = np.arange(n + 1) * (len(x) / n)
        lo = np.minimum(cut.astype(np.int64), len(x) - 1)
        part = (cut - lo).reshape(-1, *[1] * (x.ndim - 1))
        at = total[lo] * (1 - part) + total[lo + 1] * part
        return (at[1:] - at[:-1]) * (n / len(x))

    return np.swapaxes(along(np.swapaxes(along(a, height), 0, 1), width), 0, 1)


def grey(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 2 else a @ np.array([0.299, 0.587, 0.114])


def difference_hash(a: np.ndarray, side: int = 8) -> str:
    """side * side bits as hex: is each sample of the small grey image darker than its right neighbour?"""
    small = np.round(grey(resize_area(a, side, side + 1)), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tiles(a: np.ndarray, rows: int = TILE_ROWS) -> list[bytes]:
    """The image cut into bands of ``rows`` rows, each a whole NPY file."""
    out = []
    for i in range(0, len(a), rows):
        f = io.BytesIO()
        np.save(f, np.ascontiguousarray(a[i:i + rows]), allow_pickle=False)
        out.append(f.getvalue())
    return out


def from_tiles(tiles: list[bytes]) -> np.ndarray:
    return np.concatenate([np.load(io.BytesIO(t), allow_pickle=False) for t in tiles])


def payload_image(text: str | None) -> np.ndarray:
    """UTF-8 bytes, filled up with 255 to a positive multiple of 576, as rows of 24 RGB samples."""
    b = (text or "").encode()
    b += b"\xff" * (max(UNIT, -(-len(b) // UNIT) * UNIT) - len(b))
    return np.frombuffer(b, np.uint8).reshape(-1, WIDTH, 3)


def media_from_text(docs: DataFrame, text: str = "text", media: str = "media", form: str = "netpbm") -> DataFrame:
    """``docs`` with a binary image column that holds the text's bytes as samples without loss.

    Null and empty text: an image of 24 x 8 samples of 255. Other columns, repeated rows and an
    empty table pass through. ``form``: netpbm (P6) or bmp.
    """
    encode = {"netpbm": encode_netpbm, "bmp": encode_bmp}[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            images = pa.array([encode(payload_image(t)) for t in b.column(text).to_pylist()], pa.binary())
            kept = [(n, c) for n, c in zip(b.schema.names, b.columns, strict=True) if n != media]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [images], [n for n, _ in kept] + [media])

    return docs.mapInArrow(run, ", ".join([*ddl(docs, (n for n in docs.columns if n != media)), f"`{media}` binary"]))


DIGESTS = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
TILE_FIELDS = ("shape array<int>, dhash string, tiles array<binary>, media_bytes bigint, media_sha256 string, "
               "error string")


def decode_media(df: DataFrame, media: str = "media", keep: tuple[str, ...] = (), rows: int = TILE_ROWS,
                 side: int = 8) -> DataFrame:
    """Columns ``keep`` of each row with the decoded image as NPY tiles, its shape and difference hash.

    Null, empty or broken media: null shape, hash and tiles, and the reason in ``error``. Equal
    bytes give equal values. Names in ``keep`` must differ from the added ones.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = []
            for data in b.column(media):
                data = data.as_py()
                row = {"shape": None, "dhash": None, "tiles": None, "media_bytes": None if data is None else len(data),
                       "media_sha256": None if data is None else hashlib.sha256(data).hexdigest(), "error": None}
                try:
                    a = decode(data or b"")
                    row |= {"shape": list(a.shape), "dhash": difference_hash(a, side), "tiles": npy_tiles(a, rows)}
                except (MediaError, IndexError, ValueError, struct.error) as e:
                    row["error"] = str(e)
                found.append(row)
            own = pa.Table.from_pylist(found, pa.schema([
                ("shape", pa.list_(pa.int32())), ("dhash", pa.string()), ("tiles", pa.list_(pa.binary())),
                ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("error", pa.string())]))
            own = own.combine_chunks().to_batches(max_chunksize=max(1, len(found)))
            if own:
                yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + own[0].columns, [*keep, *own[0].schema.names])

    return df.mapInArrow(run, ", ".join([*ddl(df, keep), TILE_FIELDS]))


def payload_digests(df: DataFrame, media: str = "media", keep: tuple[str, ...] = (), rows: int = TILE_ROWS) -> DataFrame:
    """What text media hold: ``keep``, payload_bytes, payload_sha256 and tail_crc32 of the payload as its NPY tiles give it back,
    media_bytes and media_sha256 of the stored image, and its difference hash as feature. Made where the images are, so
    neither image nor tiles move."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found: list[list] = [[] for _ in range(6)]
            for data in b.column(media):
                data = data.as_py()
                image = decode(data)
                back = from_tiles(npy_tiles(image, rows)).tobytes()
                for out, v in zip(found, (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data),
                                          hashlib.sha256(data).hexdigest(), difference_hash(image)), strict=True):
                    out.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + [pa.array(v, t) for v, t in zip(found, kinds, strict=True)],
                                             [*keep, *DIGESTS])

    types = ("bigint", "string", "bigint", "bigint", "string", "string")
    return df.mapInArrow(run, ", ".join([*ddl(df, keep), *(f"{n} {t}" for n, t in zip(DIGESTS, types, strict=True))]))
