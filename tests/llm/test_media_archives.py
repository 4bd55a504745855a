import hashlib
import io
import math
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tessella.llm import audio, warc


def brute_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(audio.INDEX_CHANGE[code & 7])))
            out.append(value)
    return out


def test_codecs():
    mu, a = audio.mulaw_table().astype(int), audio.alaw_table().astype(int)
    assert (mu[0xFF], mu[0x80], mu[0x00], mu[0x7F]) == (0, 32124, -32124, 0) and (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    blocks = np.random.default_rng(1).integers(0, 256, (20, 36)).astype(np.uint8)
    assert audio.decode_adpcm(blocks).tolist() == [brute_adpcm(bytes(b)) for b in blocks]


@pytest.mark.parametrize("codec", audio.CODECS)
def test_containers_give_back_every_byte(codec):
    payload = np.random.default_rng(2).integers(0, 256, 576 * 2).astype(np.uint8).tobytes()
    how = audio.Telephony()
    name, rate, _, data = audio.unwrap(audio.wrap(payload, codec, how))
    assert (name, rate, data) == (codec, 8000, payload)


def brute_resample(pcm, rate, target):
    """A windowed sinc at each output's place, sample by sample; taps are rounded as documented."""
    out = []
    cut = min(1, target / rate)
    reach = math.ceil(audio.LOBES / cut)
    for i in range(math.ceil(len(pcm) * target / rate)):
        at = Fraction(i * rate, target)
        first = math.floor(at) - reach + 1
        taps = []
        for k in range(first, first + 2 * reach):
            x = float(k - at)
            y = math.pi * cut * x
            taps.append(cut * (math.sin(y) / y if y else 1) * (math.cos(math.pi * x / (2 * reach)) ** 2 if abs(x) < reach else 0))
        whole = [round(t / sum(taps) * 2**14) for t in taps]
        whole[reach - 1] += 2**14 - sum(whole)
        total = sum(t * int(pcm[k]) for t, k in zip(whole, range(first, first + 2 * reach)) if 0 <= k < len(pcm))
        out.append(max(-32768, min(32767, (total + 2**13) // 2**14)))
    return out


def test_resampling():
    rng = np.random.default_rng(4)
    for n, rate, target in ((200, 8000, 16000), (7, 8000, 16000), (1, 8000, 16000), (300, 8000, 4000), (150, 8000, 11025), (150, 16000, 6000)):
        pcm = rng.integers(-32768, 32768, n).astype(np.int16)
        got = audio.resample(pcm, rate, target).tolist()
        want = brute_resample(pcm, rate, target)
        assert len(got) == len(want) and max(abs(a - b) for a, b in zip(got, want, strict=True)) <= (0 if target == 16000 else 8)  # a tap at .5 may round either way
    x = (10000 * np.sin(np.arange(8000) * 0.01)).astype(np.int16)
    assert audio.resample(x, 8000, 8000) is x and len(audio.resample(x[:0], 8000, 4000)) == 0
    assert abs(int(audio.resample(x, 8000, 4000)[100]) - int(x[200])) < 50 and (audio.resample(x, 8000, 16000)[::2] == x).all()
    tone = (10000 * np.sin(np.arange(8000) * 2 * np.pi * 3000 / 8000)).astype(np.int16)
    assert np.abs(audio.resample(tone, 8000, 4000)[100:-100]).max() < 500  # 3 kHz does not fold into 2 kHz


def brute_feature(payload):
    codec = ("mulaw", "alaw", "adpcm")[zlib.crc32(payload) % 3]
    if codec == "mulaw":
        pcm = []
        for byte in payload:
            c = ~byte & 255
            size = (((c & 15) * 2 + 33) << (c >> 4 & 7)) - 33
            pcm.append(4 * (-size if c & 128 else size))
    elif codec == "alaw":
        pcm = []
        for byte in payload:
            c = byte ^ 0x55
            e, m = c >> 4 & 7, (c & 15) * 16
            size = m + 8 if e == 0 else (m + 264) << (e - 1)
            pcm.append(size if c & 128 else -size)
    else:
        pcm = [x for at in range(0, len(payload), 64) for x in brute_adpcm(payload[at : at + 64])]
    x = brute_resample(pcm, 8000, 16000)
    level = int((sum(v * v for v in x) / len(x)) ** 0.5)
    crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:]))
    digest = hashlib.sha256(b"".join(v.to_bytes(2, "little", signed=True) for v in x)).hexdigest()[:16]
    return f"{codec}:{len(x)}:{level}:{max(map(abs, x))}:{crossings}:{digest}"


def test_media_features(odd, odd_rows, none):
    got = audio.media_features(odd).collect()
    assert len(got) == len(odd_rows)
    texts = {r[0]: r[1] for r in odd_rows}
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_bytes"] > r["payload_bytes"] and len(r["media_sha256"]) == 64 and r["feature"].count(":") == 5
    by = {r["doc_id"]: tuple(r)[1:] for r in got}
    assert by[6] == by[7] and by[1] == by[2]
    assert sum(r["doc_id"] is None for r in got) == 1
    for r in got:
        if r["n_bytes"] < 2000:
            data = (texts[r["doc_id"]] or "").encode()
            assert r["feature"] == brute_feature(data + b"\xff" * (-len(data) % 576 if data else 576))
    assert audio.media_features(none).collect() == []


def test_ids_beside_nulls_stay_whole(spark):
    docs = spark.createDataFrame([(2**60 + 1, "a"), (None, "b"), (5, "c")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in audio.media_features(docs, audio.Telephony(slices=1)).collect()} == {2**60 + 1, None, 5}


def test_arc_versions_and_broken_records():
    for version, names in warc.ARC_FIELDS.items():
        block = f"{version} 0 test\n{names}\n"
        more = "200 - - 0 - " if version == 2 else ""
        data = f"filedesc://x 0.0.0.0 20240101000000 text/plain {more}{len(block)}\n{block}\nhttp://a/ b 0.0.0.0 20240102030405 text/html {more}5\na\nb\nc\n\nhttp://c/ 0.0.0.0 20240102030405 text/html {more}0\n\n".encode()
        got = list(warc.arc_records(io.BytesIO(data)))
        assert [(f["URL"], f["Archive-date"], d) for f, d in got] == [("http://a/ b", "20240102030405", b"a\nb\nc"), ("http://c/", "20240102030405", b"")]
    with pytest.raises(ValueError):
        list(warc.arc_records(io.BytesIO(data[:-3])))


PAGES = "page_id long, url string, html string, digest string, n long, first long"


def brute_archive(rows):
    first = {}
    for i, h in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    return sorted((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if first.get(h, i) != i else "response", first[h] if first.get(h, i) != i else None) for i, h in rows)


def test_archives_match_brute_force(spark, sf):
    long = "<p>é😀\r\n\r\nWARC/1.0\n</p>" * 20
    rows = [(5, long), (3, long), (9, long), (1, "short"), (2, "short"), (4, None), (6, ""), (7, "x" * 99), (8, "x" * 99), (10, "y" * 100), (11, "y" * 100), (12, "\n\n" * 60), (11, "y" * 100), (13, "z" * 300_000)]
    frame = spark.createDataFrame([(i, None if i == 4 else f"http://h/{i} \n", h, "d", 1, 1) for i, h in rows], PAGES).repartition(3)
    got = warc.archive_pages(frame, warc.Archive(bytes=300, at_once=1000))
    assert sorted(map(tuple, got.collect())) == brute_archive(rows)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert sorted(map(tuple, warc.archive_pages(pages).collect())) == brute_archive([(r["page_id"], r["html"]) for r in pages.collect()])
    assert warc.archive_pages(frame.limit(0)).collect() == []
    null = warc.archive_pages(spark.createDataFrame([(None, "u", "q" * 200, "d", 1, 1), (3, "u", "q" * 200, "d", 1, 1)], PAGES)).collect()
    assert {r["page_id"]: r["record_type"] for r in null} == {None: "revisit", 3: "response"}


def test_archives_are_standard_gzip_of_one_member_a_record(spark, tmp_path):
    rows = [(2**60 + i, f"http://h/{i}", f"<p>{i % 3}</p>" * 30) for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = warc.archive_pages(pages, warc.Archive(bytes=1500), keep=f"file://{tmp_path}/kept")
    assert sorted(map(tuple, got.collect())) == brute_archive([(i, h) for i, _, h in rows])
    kinds, ids = [], []
    for path in (tmp_path / "kept").iterdir():
        if path.name.startswith("."):
            continue
        data, members = path.read_bytes(), 0
        while data:
            one = zlib.decompressobj(31)
            record = one.decompress(data)
            data, members = one.unused_data, members + 1
            fields, block = next(warc.warc_records(io.BytesIO(record)))
            assert record.startswith(b"WARC/1.0\r\n") and record.endswith(b"\r\n\r\n") and len(block) == int(fields["content-length"])
            kinds.append(fields["warc-type"])
            ids.append(fields["warc-record-id"])
            assert (members == 1) == (kinds[-1] == "warcinfo")
    assert kinds.count("response") == 3 and kinds.count("revisit") == 6 and len(set(ids)) == 10


def test_stored_pcm(spark):
    how = audio.Telephony(target_rate=8000)
    docs = spark.createDataFrame([(i, chr(97 + i) * 700) for i in range(6)], "doc_id long, text string")
    media = audio.store(docs, how).persist()
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.collect()}
    for r in audio.resampled(media, how).collect():
        codec, _, align, data = audio.unwrap(stored[r["doc_id"]])
        want = [x for at in range(0, len(data), 64) for x in brute_adpcm(data[at : at + 64])] if codec == "adpcm" else audio.decode([(codec, align, data)])[0].tolist()
        assert r["codec"] == codec and np.frombuffer(r["pcm"], "<i2").tolist() == want and r["payload_sha256"] == hashlib.sha256(data).hexdigest()
