"""Media columns by signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a value. Wherever one occurs, that
format's validator walks the structure that must follow and says how long the file is, or that it is none. A valid file
at the start gives the value's true type, whatever was declared; valid files further on are carved out.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import free_name, kind_of, table

#: Fixed by the contract: padding byte and unit of the payload. The sampling rate is ours.
PAD, UNIT, RATE = b" ", 192, 8000


def wav(payload: bytes) -> bytes:
    """payload as the samples of a mono 8-bit PCM WAV file."""
    pad = len(payload) % 2
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    body = b"WAVE" + fmt + struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * pad
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def wav_samples(data: bytes, at: int = 0) -> bytes | None:
    """The bytes of the data chunk of the WAV file at `at`."""
    end, i = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little"), at + 12
    while i + 8 <= end:
        n = int.from_bytes(data[i + 4 : i + 8], "little")
        if data[i : i + 4] == b"data":
            return data[i + 8 : i + 8 + n]
        i += 8 + n + n % 2
    return None


def _wav_length(d: bytes, at: int, memo: dict) -> int | None:
    end = at + 8 + int.from_bytes(d[at + 4 : at + 8], "little")
    if d[at + 8 : at + 12] != b"WAVE" or end > len(d):
        return None
    i, seen = at + 12, []
    while i + 8 <= end:
        seen.append(d[i : i + 4])
        n = int.from_bytes(d[i + 4 : i + 8], "little")
        i += 8 + n + n % 2
    return end - at if i == end and seen[:1] == [b"fmt "] and b"data" in seen else None


def _png_length(d: bytes, at: int, memo: dict) -> int | None:
    i, first = at + 8, True
    while i + 12 <= len(d):
        n, kind = int.from_bytes(d[i : i + 4], "big"), d[i + 4 : i + 8]
        if i + 12 + n > len(d) or first != (kind == b"IHDR") or zlib.crc32(d[i + 4 : i + 8 + n]) != int.from_bytes(d[i + 8 + n : i + 12 + n], "big"):
            return None
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return i - at
    return None


def _jpeg_length(d: bytes, at: int, memo: dict) -> int | None:
    i = at + 2
    while i + 4 <= len(d):
        if d[i] != 0xFF:
            return None
        kind, n = d[i + 1], int.from_bytes(d[i + 2 : i + 4], "big")
        if kind in (0, 0xFF, 0xD8) or n < 2:
            return None
        i += 2 + n
        if kind == 0xDA:  # entropy-coded data until a marker that isn't a restart or a stuffed byte
            while (i := d.find(b"\xff", i)) >= 0:
                nxt = d[i + 1 : i + 2]
                if nxt == b"\xd9":
                    return i + 2 - at
                if nxt and (nxt == b"\0" or 0xD0 <= nxt[0] <= 0xD7):
                    i += 2
                    continue
                break
            if i < 0:
                return None
    return None


def _gif_length(d: bytes, at: int, memo: dict) -> int | None:
    if len(d) < at + 14:
        return None
    i = at + 13 + (3 << (d[at + 10] & 7) + 1 if d[at + 10] & 0x80 else 0)

    def blocks(i: int) -> int:
        while i < len(d) and d[i]:
            i += 1 + d[i]
        return i + 1

    while i < len(d):
        if d[i] == 0x3B:
            return i + 1 - at
        if d[i] == 0x21:
            i = blocks(i + 2)
        elif d[i] == 0x2C and i + 10 < len(d):
            i = blocks(i + 11 + (3 << (d[i + 9] & 7) + 1 if d[i + 9] & 0x80 else 0))
        else:
            return None
    return None


def _bmp_length(d: bytes, at: int, memo: dict) -> int | None:
    if len(d) < at + 30:
        return None
    size, reserved, start, header = struct.unpack_from("<IIII", d, at + 2)
    planes, depth = struct.unpack_from("<HH", d, at + 26)
    good = reserved == 0 and header in (40, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32)
    return size if good and 14 + header <= start <= size <= len(d) - at else None


def _pdf_length(d: bytes, at: int, memo: dict) -> int | None:
    """Up to the last %%EOF before the next file whose startxref leads to a cross-reference section: updates that were
    appended belong to the file. Without one, the last whose startxref is 0, as the first part of a linearised file has."""
    if "pdf" not in memo:
        memo["pdf"] = [m.start() for m in re.finditer(rb"%PDF-\d", d)], [(m.end(), int(m[1])) for m in re.finditer(rb"startxref\s{1,4}(\d{1,15})\s{1,4}%%EOF", d)]
    starts, ends = memo["pdf"]
    here = bisect.bisect_left(starts, at)
    if here == len(starts) or starts[here] != at:
        return None
    limit = starts[here + 1] if here + 1 < len(starts) else len(d)
    zero = None
    for k in range(bisect.bisect_right(ends, (limit, 1 << 63)) - 1, -1, -1):
        end, xref = ends[k]
        if end <= at:
            break
        if xref and at + xref < end and (d.startswith(b"xref", at + xref) or re.match(rb"\d{1,10} \d{1,5} obj", d[at + xref : at + xref + 24])):
            return end - at
        zero = zero or (end - at if xref == 0 else None)
    return zero


def _zip_length(d: bytes, at: int, memo: dict) -> int | None:
    """Ends of archives tell where theirs began."""
    if "zip" not in memo:
        memo["zip"], end = {}, -1
        while (end := d.find(b"PK\5\6", end + 1)) >= 0:
            if end + 22 <= len(d):
                size, start, note = struct.unpack_from("<IIH", d, end + 12)
                began = end - size - start
                if began >= 0 and end + 22 + note <= len(d) and (not size or d[began + start : began + start + 4] == b"PK\1\2"):
                    memo["zip"].setdefault(began, end + 22 + note - began)
    return memo["zip"].get(at)


def _ogg_length(d: bytes, at: int, memo: dict) -> int | None:
    i = at
    while d[i : i + 5] == b"OggS\0" and i + 27 <= len(d):
        n = d[i + 26]
        last, i = d[i + 5] & 4, i + 27 + n + sum(d[i + 27 : i + 27 + n])
        if i > len(d):
            return None
        if last:
            return i - at
    return None


#: Magic bytes, the type they stand for, and its validator (length of the file at an offset, or None; what it
#: finds out about the whole value is kept in a dict, so that many signatures cost one search).
FORMATS: list[tuple[bytes, str, Callable[[bytes, int, dict], int | None]]] = [
    (b"RIFF", "audio/wav", _wav_length),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png_length),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg_length),
    (b"GIF87a", "image/gif", _gif_length),
    (b"GIF89a", "image/gif", _gif_length),
    (b"BM", "image/bmp", _bmp_length),
    (b"%PDF-", "application/pdf", _pdf_length),
    (b"PK\3\4", "application/zip", _zip_length),
    (b"OggS", "audio/ogg", _ogg_length),
]


@functools.cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, (magic, _, _) in enumerate(FORMATS):
        found.add_word(magic.decode("latin-1"), i)
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of the valid files in data, by offset; what lies inside one is part of it."""
    text, out, at, memo = data.decode("latin-1"), [], 0, {}
    automaton = _automaton()
    while at < len(data):
        for last, i in automaton.iter(text, at):
            magic, kind, length_at = FORMATS[i]
            start = last + 1 - len(magic)
            if n := length_at(data, start, memo):
                out.append((start, n, kind))
                at = start + n
                break
        else:
            break
    return out


_FOUND = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))


def _sniff_rows(n_before: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [[{"offset": o, "length": n, "type": k} for o, n, k in sniff(b or b"")] for b in batch.column(n_before - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(files, _FOUND)], [*batch.schema.names, name])

    return run


def sniff_media(df: DataFrame, media: str, declared: str | None = None) -> DataFrame:
    """df with media_type (of the file the value starts with, else null), corrected (the declared type is another) and
    embedded (offset, length, type of the valid files in the value).

    Null and empty values have no type and nothing embedded; repeated rows stay. Columns of those three names in df are
    replaced; others stay.
    """
    keep = [c for c in df.columns if c.lower() not in ("media_type", "corrected", "embedded") or c in (media, declared)]
    found = free_name(df, "found")
    moved = df.select(*[c for c in keep if c != media], media)
    kind = moved.schema.simpleString().removeprefix("struct<").removesuffix(">")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moved.schema.fields) if kind else ""
    out = moved.mapInArrow(_sniff_rows(len(moved.columns), found), f"{fields}, `{found}` array<struct<offset: bigint, length: bigint, type: string>>")
    at_start = F.filter(found, lambda x: x["offset"] == 0)
    kind = F.when(F.size(at_start) > 0, at_start[0]["type"])
    wrong = (kind.isNotNull() & ~kind.eqNullSafe(F.col(declared))) if declared else F.lit(False)
    return out.select(*keep, kind.alias("media_type"), wrong.alias("corrected"), F.col(found).alias("embedded"))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column(1).to_pylist()
        files = [wav(b + PAD * (-len(b) % UNIT if b else UNIT)) for b in raw]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text in UTF-8, padded to a positive multiple of UNIT, as the samples of a WAV file.

    Null texts are empty; repeated rows stay; ids may be of any type. Other columns are not read.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), raw.alias("raw"))
    return rows.mapInArrow(_store, f"doc_id {kind_of(rows, 'doc_id')}, n_bytes long, media binary")


def _describe(data: bytes, embedded: list[dict]) -> tuple[bytes, str]:
    """The payload carved from the file that data starts with, and its features: type, samples, mean, range, sign changes around the mean."""
    first = embedded[0]
    payload = wav_samples(data[first["offset"] : first["offset"] + first["length"]]) or b""
    x = np.frombuffer(payload, np.uint8)
    mean = int(x.sum(dtype=np.int64)) // max(1, len(x))
    crossings = int(np.count_nonzero(np.diff(x > mean))) if len(x) else 0
    return payload, f"{first['type']};8bit;1ch;{RATE}Hz;n={len(x)};mean={mean};min={x.min() if len(x) else 0};max={x.max() if len(x) else 0};crossings={crossings}"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for n_bytes, data, embedded in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            payload, feature = _describe(data, embedded)
            rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])


def read_back(stored: DataFrame) -> DataFrame:
    """stored_texts' rows sniffed (their declared type is wrong), carved and described."""
    sniffed = sniff_media(stored.withColumn("declared", F.lit("application/octet-stream")), "media", "declared")
    out = f"doc_id {kind_of(stored, 'doc_id')}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return sniffed.select("doc_id", "n_bytes", "media", "embedded").mapInArrow(_read_back, out)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(stored_texts(table(spark, sf_dir, "documents")))
