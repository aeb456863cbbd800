import io
import struct
import zipfile
import zlib

from pyspark.sql import functions as F

from tessera.llm import media as M


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello" * 50)
    return out.getvalue()


SAMPLES = {
    "image/png": png(),
    "application/zip": zipped(),
    "audio/wav": M.wav(b"abc"),
    "image/gif": b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;",
    "image/bmp": b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + b"\0" * 24 + b"\0\0\0\0",
    "image/jpeg": b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\4ab\1\2\xff\0\3\xff\xd9",
    "application/pdf": b"%PDF-1.4\nstartxref\n0\n%%EOF",
    "audio/ogg": b"OggS\0\4" + b"\0" * 20 + b"\1\3abc",
}


def test_each_format_is_found_with_its_length():
    for kind, data in SAMPLES.items():
        assert M.sniff(data) == [(0, len(data), kind)], kind
        assert M.sniff(b"junk" + data + b"tail") == [(4, len(data), kind)], kind


def test_broken_files_are_not():
    for kind, data in SAMPLES.items():
        assert all(n <= len(data) - 2 for _, n, _ in M.sniff(data[:-2])), kind
    bad = bytearray(SAMPLES["image/png"])
    bad[-20] ^= 1
    assert M.sniff(bytes(bad)) == []
    assert M.sniff(b"RIFF BM PK\3\4 %PDF- GIF89a \xff\xd8\xff OggS") == [] and M.sniff(b"") == []


def test_several_files_in_one_value():
    data, at, want = b"", 0, []
    for kind, d in SAMPLES.items():
        data += b"--" + d
        want.append((at + 2, len(d), kind))
        at = len(data)
    assert M.sniff(data) == want


def test_columns(spark):
    rows = [(i, bytearray(d), k if i % 2 else "text/plain", "x") for i, (k, d) in enumerate(SAMPLES.items())] + [(98, None, "image/png", "y"), (99, bytearray(b""), None, "z")]
    df = spark.createDataFrame(rows, "id long, data binary, declared string, found string")
    got = {r.id: r for r in M.sniff_media(df, "data", "declared").collect()}
    assert {r.found for r in got.values()} == {"x", "y", "z"}
    for i, kind in enumerate(SAMPLES):
        assert got[i].media_type == kind and got[i].corrected == (i % 2 == 0) and got[i].embedded[0]["length"] == len(SAMPLES[kind])
    assert got[98].media_type is None and got[99].embedded == [] and not got[98].corrected


def test_round_trip(spark, messy, nothing):
    stored = M.stored_texts(messy)
    out = M.sniff_media(stored.withColumn("declared", F.lit("?")), "media", "declared").collect()
    want = sorted((t or "").encode() for (t,) in messy.select("text").collect())
    got = []
    for r in out:
        assert r.media_type == "audio/wav" and r.corrected
        payload = M.wav_samples(bytes(r.media))
        assert len(payload) % 192 == 0 and len(payload) - r.n_bytes in range(0, 193) and payload[r.n_bytes :].strip(b" ") == b""
        got.append(payload[: r.n_bytes])
    assert sorted(got) == want
    assert M.stored_texts(nothing).count() == 0


def test_pdf_ends_after_its_last_update():
    first = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\n"
    one = first + b"xref\n0 1\ntrailer\n<<>>\nstartxref\n" + str(len(first)).encode() + b"\n%%EOF\n"
    body = one + b"2 0 obj\n<<>>\nendobj\n"
    two = body + b"xref\n2 1\ntrailer\n<<>>\nstartxref\n" + str(len(body)).encode() + b"\n%%EOF"
    assert M.sniff(b"ab" + two + b"\nstartxref\n999999\n%%EOF " + two) == [(2, len(two), "application/pdf"), (2 + len(two) + 24, len(two), "application/pdf")]


def test_many_signatures_take_linear_time():
    import time

    for data in (b"%PDF-1 " * 60_000, b"PK\3\4 " * 60_000, b"%PDF-1 startxref 5 %%EOF" * 20_000):
        began = time.perf_counter()
        assert M.sniff(data) == []
        assert time.perf_counter() - began < 5


def test_op7_against_a_plain_version(spark, messy):
    import hashlib

    def plain(doc_id, text):
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        wav = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
        mean = sum(payload) // len(payload)
        crossings = sum((a > mean) != (b > mean) for a, b in zip(payload, payload[1:]))
        feature = f"audio/wav;8bit;1ch;8000Hz;n={len(payload)};mean={mean};min={min(payload)};max={max(payload)};crossings={crossings}"
        return (doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(wav), hashlib.sha256(wav).hexdigest(), feature)

    assert sorted(map(tuple, M.read_back(M.stored_texts(messy)).collect()), key=repr) == sorted((plain(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()), key=repr)
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, M.op7_media(spark, "/root/testdata/sf0.001").collect())) == sorted(plain(r.doc_id, r.text) for r in small)
