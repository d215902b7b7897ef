"""TIFF pages: walks the image directories of a file, decodes strips or tiles, undoes predictors, gives a row per page.

Read: classic and big files of either byte order; compression none (1), LZW (5), deflate (8, 32946) and PackBits (32773);
predictors none (1), horizontal (2) and floating point (3); 1, 2, 4, 8, 16, 32 and 64 bits a sample; any number of samples,
interleaved or planar; strips and tiles. A file is decoded whole, whatever its size.

Results for odd input: null bytes give no row; bytes that are no TIFF, are cut short or use something else give one row
with a null page and the reason in ``error``; a page that can't be decoded has its number and the reason, and the pages
after it come out, unless its directory itself is broken; a directory chain that loops ends where
it does; an image without pixels has null statistics; repeated rows give repeated pages; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits"}
_TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


class TiffError(ValueError):
    pass


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def _codes(data: bytes):
    """Codes of 9 to 12 bits, high bit first, one code early at each width; 256 begins a table, 257 ends. Yields the codes of each table."""
    bits, at = np.unpackbits(np.frombuffer(data, np.uint8)), 0
    while True:
        own, width, left = [], 9, 254
        while True:
            n = min((len(bits) - at) // width, left)
            codes = (bits[at : at + n * width].reshape(n, width) @ _PLACES[width]).astype(np.int32).tolist()
            at += n * width
            stop = next((i for i, c in enumerate(codes) if c == 256 or c == 257), -1)
            if stop >= 0:
                at -= (n - stop - 1) * width
                yield own + codes[:stop]
                if codes[stop] == 257:
                    return
                break
            own += codes
            if n < left:
                yield own
                return
            width, left = min(12, width + 1), {9: 512, 10: 1024}.get(width, 2048)


_PLACES = {w: (1 << np.arange(w - 1, -1, -1)).astype(np.float32) for w in range(9, 13)}


def unlzw(data: bytes) -> bytes:
    """A code's string stands in the output already: it is that of the code which made it, and the byte after."""
    out = bytearray()
    for codes in _codes(data):
        place, length = [], []
        end = len(out)
        for i, code in enumerate(codes):
            place.append(end)
            if code < 256:
                out.append(code)
                n = 1
            else:
                k = code - 258
                if not 0 <= k < i:
                    raise TiffError("a bad LZW code")
                n = length[k] + 1
                part = out[place[k] : place[k] + n]
                out += part if len(part) == n else part + part[:1]
            length.append(n)
            end += n
    return bytes(out)


def _inflate(data: bytes) -> bytes:
    try:
        return zlib.decompressobj().decompress(data)
    except zlib.error as e:
        raise TiffError(f"bad deflate data: {e}") from e


DECODE = {1: bytes, 5: unlzw, 8: _inflate, 32946: _inflate, 32773: unpack_bits}


def _directory(data: bytes, at: int, order: str, big: bool) -> tuple[dict[int, tuple], int]:
    count, entry, head = ("Q", 20, 8) if big else ("H", 12, 2)
    (n,) = struct.unpack_from(order + count, data, at)
    if at + head + n * entry > len(data):
        raise TiffError("a directory is cut short")
    tags: dict[int, tuple] = {}
    for i in range(n):
        p = at + head + i * entry
        tag, kind, values = struct.unpack_from(order + ("HHQ" if big else "HHI"), data, p)
        if kind not in _TYPES:
            continue
        code = _TYPES[kind]
        size = struct.calcsize(code) * values
        q = p + (12 if big else 8)
        if size > (8 if big else 4):
            (q,) = struct.unpack_from(order + ("Q" if big else "I"), data, q)
        if q + size > len(data):
            raise TiffError(f"the values of tag {tag} are cut short")
        tags[tag] = struct.unpack_from(f"{order}{values}{code}", data, q)
    (after,) = struct.unpack_from(order + ("Q" if big else "I"), data, at + head + n * entry)
    return tags, after


def _samples(raw: bytes, rows: int, width: int, spp: int, bits: int, fmt: int, predictor: int, order: str) -> np.ndarray:
    """One strip or tile as (rows, width, spp)."""
    per_row = -(-width * spp * bits // 8)
    raw = raw[: rows * per_row]
    if len(raw) < rows * per_row:
        raise TiffError("a strip or tile is cut short")
    b = np.frombuffer(raw, np.uint8).reshape(rows, per_row)
    if bits < 8:
        if predictor != 1:
            raise TiffError(f"predictor {predictor} with {bits} bits")
        x = np.unpackbits(b, axis=1)[:, : width * spp * bits].reshape(rows, width * spp, bits)
        return (x * (1 << np.arange(bits - 1, -1, -1))).sum(2).astype(np.uint8).reshape(rows, width, spp)
    size = bits // 8
    kind = {1: "u", 2: "i", 3: "f", 4: "u"}.get(fmt)
    if kind is None or (kind == "f" and size == 1) or bits not in (8, 16, 32, 64):
        raise TiffError(f"{bits} bits of sample format {fmt}")
    if predictor == 3:
        if kind != "f":
            raise TiffError("the floating-point predictor on integers")
        x = b.reshape(rows, width * size, spp).cumsum(1, dtype=np.uint8).reshape(rows, size, width * spp)
        return np.ascontiguousarray(x.transpose(0, 2, 1)).view(f">f{size}")[:, :, 0].reshape(rows, width, spp).astype(f"<f{size}")
    x = np.ascontiguousarray(b).view(f"{order}{'u' if predictor == 2 else kind}{size}").reshape(rows, width, spp)
    if predictor == 2:
        x = x.astype(f"<u{size}").cumsum(1, dtype=f"u{size}").view(f"<{kind}{size}")
    elif predictor != 1:
        raise TiffError(f"predictor {predictor}")
    return x.astype(f"<{kind}{size}")


_COUNTS = {256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339}


def _page(data: bytes, tags: dict[int, tuple], order: str) -> dict:
    for t in _COUNTS & tags.keys():
        if not (tags[t] or t in (273, 279, 324, 325)) or float in map(type, tags[t]) or min(tags[t], default=0) < 0:
            raise TiffError(f"the values of tag {t} aren't counts")
    one = lambda t, default: tags.get(t, (default,))[0]
    if 256 not in tags or 257 not in tags:
        raise TiffError("a directory without a size")
    width, height, spp = one(256, 0), one(257, 0), one(277, 1)
    bits, fmt, packing, predictor, planar = one(258, 1), one(339, 1), one(259, 1), one(317, 1), one(284, 1)
    if packing not in DECODE:
        raise TiffError(f"compression {packing}")
    if len(set(tags.get(258, (1,)))) > 1 or bits not in (1, 2, 4, 8, 16, 32, 64):
        raise TiffError(f"bits {tags.get(258)}")
    tiled = 322 in tags
    w, h = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height), height))
    offsets, counts = (tags.get(324, ()), tags.get(325, ())) if tiled else (tags.get(273, ()), tags.get(279, ()))
    if not tiled and not counts and len(offsets) == 1 and packing == 1:
        counts = (len(data) - offsets[0],)
    across, down = (-(-width // w), -(-height // h)) if w and h else (0, 0)
    planes = spp if planar == 2 else 1
    if len(offsets) < across * down * planes or len(counts) < len(offsets):
        raise TiffError("strips or tiles are missing")
    kind = "u1" if bits < 8 else f"<{ {1: 'u', 2: 'i', 3: 'f', 4: 'u'}.get(fmt, 'u')}{bits // 8}"
    if width * height * spp * max(1, bits // 8) > 4 * max(1, len(data)) * 1100 + (1 << 20):
        raise TiffError("the size doesn't fit the data")
    out = np.zeros((height, width, spp), kind)
    for n in range(across * down * planes):
        plane, k = divmod(n, across * down)
        y, x = k // across * h, k % across * w
        if offsets[n] + counts[n] > len(data):
            raise TiffError("a strip or tile is cut short")
        rows = h if tiled else min(h, height - y)
        part = _samples(DECODE[packing](data[offsets[n] : offsets[n] + counts[n]]), rows, w, spp // planes, bits, fmt, predictor, order)
        part = part[: height - y, : width - x]
        if planes > 1:
            out[y : y + part.shape[0], x : x + part.shape[1], plane] = part[:, :, 0]
        else:
            out[y : y + part.shape[0], x : x + part.shape[1]] = part
    return {"width": width, "height": height, "samples": spp, "bits": bits, "compression": NAMES[packing], "predictor": predictor, "layout": "tiles" if tiled else "strips", "chunks": across * down * planes, "pixels": out}


def read_tiff(data: bytes) -> tuple[list[dict], str | None]:
    """The pages in order, those that can't be decoded with an error only, and what ended the walk, if it didn't end well."""
    pages: list[dict] = []
    try:
        order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
        if order is None or len(data) < 8:
            raise TiffError("no TIFF")
        (magic,) = struct.unpack_from(order + "H", data, 2)
        if magic not in (42, 43):
            raise TiffError("no TIFF")
        big = magic == 43
        (at,) = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)
        seen = set()
        while at and at not in seen:
            seen.add(at)
            tags, at = _directory(data, at, order, big)
            try:
                pages.append(_page(data, tags, order))
            except Exception as e:  # whatever a page holds, the others come out
                pages.append({"error": str(e) or type(e).__name__})
    except Exception as e:
        return pages, str(e) or type(e).__name__
    return pages, None


# Writing, for round trips and for tables that hold no media.


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        j = i + 1
        while j < len(data) and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), data[i]))
        else:
            while j < len(data) and j - i < 128 and (j + 1 == len(data) or data[j] != data[j + 1]):
                j += 1
            out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def lzw(data: bytes) -> bytes:
    codes, table, prefix = [(256, 9)], {}, b""
    width = 9
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if len(longer) == 1 or longer in table:
            prefix = longer
            continue
        codes.append((prefix[0] if len(prefix) == 1 else table[prefix], width))
        table[longer] = 258 + len(table)
        size = len(table) + 258
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
        if size >= 4094:
            codes.append((256, 12))
            table, width = {}, 9
        prefix = data[i : i + 1]
    if prefix:
        codes.append((prefix[0] if len(prefix) == 1 else table[prefix], width))
        size = len(table) + 259
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    codes.append((257, width))
    text = "".join(format(c, f"0{w}b") for c, w in codes)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


ENCODE = {"none": (1, bytes), "lzw": (5, lzw), "deflate": (8, zlib.compress), "packbits": (32773, pack_bits)}


def _predicted(x: np.ndarray, predictor: int, order: str) -> bytes:
    rows, width, spp = x.shape
    size = x.dtype.itemsize
    if predictor == 3:
        b = x.reshape(rows, width * spp).astype(f">f{size}").view(np.uint8).reshape(rows, width * spp, size).transpose(0, 2, 1).reshape(rows, width * size, spp)
        return np.diff(b, axis=1, prepend=np.zeros((rows, 1, spp), np.uint8)).astype(np.uint8).tobytes()
    if predictor == 2:
        u = x.view(f"u{size}")
        x = np.diff(u, axis=1, prepend=np.zeros((rows, 1, spp), u.dtype))
    return x.astype(x.dtype.newbyteorder(order)).tobytes()


def write_tiff(pages: list[dict], order: str = "<", big: bool = False) -> bytes:
    """pages: pixels (height, width, samples), compression, predictor, tile (width, height) or rows (a strip's), planar."""
    offset, head, code = ("Q", 16, 16) if big else ("I", 8, 4)
    out = bytearray({"<": b"II", ">": b"MM"}[order] + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = head - (8 if big else 4)
    for page in pages:
        x = page["pixels"]
        height, width, spp = x.shape
        predictor, planar = page.get("predictor", 1), page.get("planar", 1)
        number, pack = ENCODE[page.get("compression", "none")]
        w, h = page.get("tile") or (width, page.get("rows", height))
        places, counts = [], []
        for plane in range(spp if planar == 2 else 1):
            part = x[:, :, plane : plane + 1] if planar == 2 else x
            for y in range(0, height, h):
                for at in range(0, width, w):
                    tile = part[y : y + h, at : at + w]
                    if "tile" in page:
                        tile = np.pad(tile, ((0, h - tile.shape[0]), (0, w - tile.shape[1]), (0, 0)))
                    data = pack(_predicted(np.ascontiguousarray(tile), predictor, order))
                    places.append(len(out))
                    counts.append(len(data))
                    out += data + b"\0" * (len(data) % 2)
        tags = {256: (width,), 257: (height,), 258: (x.dtype.itemsize * 8,) * spp, 259: (number,), 262: (1,), 277: (spp,), 284: (planar,), 317: (predictor,), 339: ({"u": 1, "i": 2, "f": 3}[x.dtype.kind],) * spp}
        tags |= {322: (w,), 323: (h,), 324: tuple(places), 325: tuple(counts)} if "tile" in page else {273: tuple(places), 278: (h,), 279: tuple(counts)}
        entries = []
        for tag, values in sorted(tags.items()):
            wide = tag in (273, 279, 324, 325)
            data = struct.pack(f"{order}{len(values)}{offset if wide else 'I'}", *values)
            if len(data) > (8 if big else 4):
                data, where = struct.pack(order + offset, len(out)), data
                out += where
            entries.append(struct.pack(order + ("HHQ" if big else "HHI"), tag, code if wide else 4, len(values)) + data.ljust(8 if big else 4, b"\0"))
        struct.pack_into(order + offset, out, link, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0" * (8 if big else 4)
    return bytes(out)


PAGES = "width int, height int, samples int, bits int, compression string, predictor int, layout string, chunks int, pixel_sum double, pixel_min double, pixel_max double, pixel_check double, error string"
_PAGES = pa.schema([("id", pa.int64()), ("page", pa.int32()), *((c, {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}[t]) for c, t in (x.split(" ") for x in PAGES.split(", "))), ("pixels", pa.binary())])


def _reader(pixels: bool):
    def run(batches):
        for b in batches:
            rows, size = [], 0
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if data is None:
                    continue
                found, error = read_tiff(data)
                for n, p in enumerate(found):
                    if "error" in p:
                        rows.append({"id": key, "page": n, **p})
                        continue
                    x = p.pop("pixels")
                    f = x.astype(float)
                    stats = {"pixel_sum": round(float(f.sum()), 6), "pixel_min": float(f.min()), "pixel_max": float(f.max()), "pixel_check": round(float(f.ravel() @ np.arange(1, f.size + 1)), 4)} if x.size else {}
                    rows.append({"id": key, "page": n, **p, **stats, "pixels": x.tobytes() if pixels else None})
                    size += x.nbytes if pixels else 100
                if error:
                    rows.append({"id": key, "error": error})
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=_PAGES)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=_PAGES)

    return run


def pages(media: DataFrame, id_col: str = "id", data_col: str = "data", pixels: bool = True) -> DataFrame:
    """One row per page: id, page, its form, statistics, error and (with ``pixels``) the samples by row, little-endian.

    ``pixel_check`` is the sum of the samples times their places from 1 on, so it tells their order.
    """
    out = media.select(F.col(id_col).cast("long").alias("id"), F.col(data_col).alias("data")).mapInArrow(_reader(pixels), f"id long, page int, {PAGES}, pixels binary")
    return out if pixels else out.drop("pixels")


def render(vector: np.ndarray, key: int) -> bytes:
    """A vector as a file of four pages that take turns in byte order, compression, predictor and layout."""
    n = len(vector)
    x = vector.astype(np.float32).reshape((8, 8, 1) if n == 64 else (1, n, 1))
    q = np.clip(vector.astype(float), -1, 1) + 1
    q8, q16 = (np.floor(q * m).astype(t).reshape(x.shape) for m, t in ((127.5, np.uint8), (32767.5, np.uint16)))
    strip = min(3, x.shape[0])
    made = [
        {"pixels": x, "compression": "deflate", "predictor": 3, "tile": (16, 16)},
        {"pixels": q8, "compression": "packbits", "rows": strip},
        {"pixels": q16, "compression": "lzw", "predictor": 2, "rows": strip},
        {"pixels": np.concatenate((q8, 255 - q8), 2), "compression": "none", "predictor": 2, "planar": 2, "rows": strip},
    ]
    return write_tiff(made, order="<>"[key % 2], big=key % 3 == 2)


def _render(batches):
    for b in batches:
        keys, data = b.column(0).to_pylist(), b.column(1)
        blobs = [None if v is None or len(v) == 0 or None in v else render(np.array(v, np.float32), k or 0) for k, v in zip(keys, data.to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blobs, pa.binary())], ["id", "data"])


def rendered(embeddings: DataFrame) -> DataFrame:
    """id and TIFF bytes of each vector; none for null or empty ones and those with a null in them."""
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_render, "id long, data binary")


SQL = """
WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL), true)),
q AS (SELECT id, v, CASE WHEN len(v) = 64 THEN 8 ELSE len(v) END AS width, CASE WHEN len(v) = 64 THEN 8 ELSE 1 END AS height,
 list_transform(v, lambda x: floor((greatest(least(x, 1.0), -1.0) + 1) * 127.5)) AS q8, list_transform(v, lambda x: floor((greatest(least(x, 1.0), -1.0) + 1) * 32767.5)) AS q16 FROM e),
p AS (SELECT id, width, height, 0 AS page, 1 AS samples, 32 AS bits, 'deflate' AS compression, 3 AS predictor, 'tiles' AS layout, ((width + 15) // 16) AS chunks, v FROM q
 UNION ALL SELECT id, width, height, 1, 1, 8, 'packbits', 1, 'strips', (height + 2) // 3, q8 FROM q
 UNION ALL SELECT id, width, height, 2, 1, 16, 'lzw', 2, 'strips', (height + 2) // 3, q16 FROM q
 UNION ALL SELECT id, width, height, 3, 2, 8, 'none', 2, 'strips', 2 * ((height + 2) // 3), flatten(list_transform(q8, lambda x: [x, 255 - x])) FROM q)
SELECT id, page::INT AS page, width::INT AS width, height::INT AS height, samples::INT AS samples, bits::INT AS bits, compression, predictor::INT AS predictor, layout, chunks::INT AS chunks,
 round(list_sum(v), 6) AS pixel_sum, list_min(v) AS pixel_min, list_max(v) AS pixel_max, round(list_sum(list_transform(v, lambda x, i: x * i)), 4) AS pixel_check, NULL::VARCHAR AS error FROM p
"""
