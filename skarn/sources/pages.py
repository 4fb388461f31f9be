"""Pages of Parquet column chunks: their headers and dictionaries, read without decoding any value.

A header is a record in Thrift's compact protocol. Only the few fields that tell kind, size and encoding are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Fixed values of the format: kinds of pages, encodings that refer to a dictionary, codecs by pyarrow's names.
DATA_PAGE, DICTIONARY_PAGE, DATA_PAGE_V2 = 0, 2, 3
PLAIN, PLAIN_DICTIONARY, RLE_DICTIONARY = 0, 2, 8
CODECS = {"SNAPPY": "snappy", "GZIP": "gzip", "ZSTD": "zstd", "BROTLI": "brotli", "LZ4_RAW": "lz4_raw"}
#: Bytes that are read for a header at first; doubled while the header doesn't end within them.
HEADER = 512


class Insufficient(Exception):
    """The chunk has to be decoded."""


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        b = self.data[self.at]
        self.at += 1
        return b

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.byte()
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int):
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            return self.byte()
        if kind in (4, 5, 6):
            return self.zigzag()
        if kind == 7:
            self.at += 8
            return None
        if kind == 8:
            n = self.varint()
            self.at += n
            if self.at > len(self.data):
                raise IndexError
            return None
        if kind in (9, 10):
            head = self.byte()
            n = head >> 4 if head >> 4 < 15 else self.varint()
            return [self.byte() if head & 15 in (1, 2) else self.value(head & 15) for _ in range(n)]
        if kind == 11:
            n = self.varint()
            if n:
                kinds = self.byte()
                for _ in range(n):
                    self.value(kinds >> 4)
                    self.value(kinds & 15)
            return None
        if kind == 12:
            return self.record()
        raise Insufficient(f"type {kind} in a page header")

    def record(self) -> dict:
        out, field = {}, 0
        while head := self.byte():
            field = field + (head >> 4) if head >> 4 else self.zigzag()
            out[field] = self.value(head & 15)
        return out


@dataclass(frozen=True)
class Page:
    kind: int
    body: int  # offset of the page's bytes
    packed: int
    unpacked: int
    values: int
    encoding: int


def header(file, at: int, end: int) -> Page:
    size = HEADER
    while True:
        file.seek(at)
        r = _Reader(file.read(min(size, end - at)))
        try:
            f = r.record()
            break
        except IndexError:
            if size >= end - at:
                raise Insufficient("a page header doesn't end") from None
            size *= 2
    own = f.get({DATA_PAGE: 5, DICTIONARY_PAGE: 7, DATA_PAGE_V2: 8}.get(f[1], 0), {})
    return Page(f[1], at + r.at, f[3], f[2], own.get(1, 0), own.get(4 if f[1] == DATA_PAGE_V2 else 2, -1))


def dictionary(file, chunk, arrow: pa.DataType) -> tuple[pa.Array, int]:
    """All values of a flat column chunk, each once, from its dictionary page, and the number of bytes that were read.

    Raises Insufficient when any data page is encoded otherwise (writers fall back to plain values when a dictionary
    grows too large), when the type's values can't be told from their bytes, or when the dictionary may hold values that
    no row has (columns written from dictionary arrays).
    """
    if not chunk.has_dictionary_page or pa.types.is_dictionary(arrow):
        raise Insufficient("no dictionary")
    starts = [o for o in (chunk.dictionary_page_offset, chunk.data_page_offset) if o]
    at, read, found, seen = min(starts), 0, None, 0
    end = at + chunk.total_compressed_size
    while at < end and seen < chunk.num_values:
        p = header(file, at, end)
        read += p.body - at
        if p.kind == DICTIONARY_PAGE:
            if p.encoding not in (PLAIN, PLAIN_DICTIONARY):
                raise Insufficient("encoded dictionary")
            found = p
        elif p.kind in (DATA_PAGE, DATA_PAGE_V2):
            if p.encoding not in (PLAIN_DICTIONARY, RLE_DICTIONARY):
                raise Insufficient("a data page with values of its own")
            seen += p.values
        at = p.body + p.packed
    if found is None or seen < chunk.num_values:
        raise Insufficient("pages are missing")
    file.seek(found.body)
    raw = file.read(found.packed)
    if chunk.compression != "UNCOMPRESSED":
        if chunk.compression not in CODECS:
            raise Insufficient("codec")
        raw = pa.decompress(raw, found.unpacked, CODECS[chunk.compression], asbytes=True)
    return plain(raw, found.values, chunk.physical_type, arrow), read + found.packed


def plain(raw: bytes, n: int, physical: str, arrow: pa.DataType) -> pa.Array:
    """``n`` plainly encoded values as an array of the column's type."""
    if physical == "BYTE_ARRAY":
        if not (pa.types.is_string(arrow) or pa.types.is_large_string(arrow) or pa.types.is_binary(arrow) or pa.types.is_large_binary(arrow)):
            raise Insufficient("type")
        # Lengths and bytes alternate: find the starts one by one, then cut the lengths out.
        starts, at, unpack = np.empty(n, np.int64), 0, int.from_bytes
        for i in range(n):
            starts[i] = at
            at += 4 + unpack(raw[at : at + 4], "little")
        ends = np.append(starts[1:], at)
        offsets = np.zeros(n + 1, np.int32)
        np.cumsum(ends - starts - 4, out=offsets[1:])
        keep = np.ones(at, bool)
        if n:
            keep[(starts[:, None] + np.arange(4)).ravel()] = False
        body = np.frombuffer(raw, np.uint8, at)[keep]
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(body.tobytes())]).cast(arrow)
    width = {"INT32": pa.int32(), "INT64": pa.int64(), "FLOAT": pa.float32(), "DOUBLE": pa.float64()}.get(physical)
    if width is None or pa.types.is_decimal(arrow):
        raise Insufficient("type")
    out = pa.Array.from_buffers(width, n, [None, pa.py_buffer(raw[: n * width.bit_width // 8])])
    if pa.types.is_integer(arrow) and arrow.bit_width < width.bit_width:
        return out.cast(arrow, safe=False)
    if arrow.bit_width != width.bit_width:
        raise Insufficient("type")
    return out.view(arrow)
