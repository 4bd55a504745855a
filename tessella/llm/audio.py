"""Telephony audio in table columns: companded and ADPCM samples, their containers, decoding and resampling."""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import discard, map_frames, materialize, type_of

#: Format tags of the RIFF container.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
CODECS = ("mulaw", "alaw", "adpcm")

# Fixed values of the IMA ADPCM format: quantizer steps, and index changes by the three lower bits of a code.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


@dataclass(frozen=True)
class Telephony:
    """rate: of the stored samples, target_rate: of the PCM, in Hz. pad: bytes of which a payload is a multiple. block: bytes of an ADPCM block.

    slices: parts of the documents whose PCM media_features() has stored at a time: at 16 kHz it takes some five times
    the payload's bytes.
    """

    rate: int = 8000
    target_rate: int = 16000
    slices: int = 16
    pad: int = 576
    block: int = 64
    #: Bytes of ADPCM blocks that are decoded at once.
    at_once: int = 4_000_000


def mulaw_table() -> np.ndarray:
    """PCM of the 256 mu-law codes: inverted bits, a sign, three bits of exponent and four of mantissa over a bias of 33."""
    code = ~np.arange(256) & 255
    size = ((((code & 15) << 1) + 33) << (code >> 4 & 7)) - 33
    return np.where(code & 128, -size, size).astype(np.int16) * np.int16(4)


def alaw_table() -> np.ndarray:
    """PCM of the 256 A-law codes: every second bit inverted, a sign, three bits of exponent and four of mantissa."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks, uint8 of (blocks, bytes): a step decodes one code of every block.

    A block has its first sample, its step index (taken as 88 at most) and a spare byte, then two codes a byte, the
    lower one first.
    """
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    codes = blocks[:, 4:]
    out = np.empty((len(blocks), 1 + 2 * codes.shape[1]), np.int16)
    out[:, 0] = value
    for i in range(2 * codes.shape[1]):
        code = (codes[:, i // 2] >> (4 * (i % 2))) & 15
        step = STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code & 7], 0, 88)
        out[:, 1 + i] = value
    return out


#: Sines on either side of a resampling filter's middle, and bits of its taps' fractions.
LOBES, TAP_BITS = 8, 14


def filter_phases(rate: int, target: int) -> tuple[list[np.ndarray], int, int]:
    """The taps of each phase of a windowed-sinc low-pass at half the lower rate, up and down the steps between the rates.

    Output i is at input place i * down / up; its phase is i * down modulo up, whose taps reach from LOBES * wide before
    that place to as many after it. Taps are whole numbers that add up to 2 ** TAP_BITS.
    """
    common = math.gcd(rate, target)
    up, down = target // common, rate // common
    cut = min(1.0, up / down)
    reach = math.ceil(LOBES / cut)
    phases = []
    for phase in range(up):
        x = np.arange(1 - reach, reach + 1) - phase / up
        taps = cut * np.sinc(cut * x) * np.where(np.abs(x) < reach, np.cos(np.pi * x / (2 * reach)) ** 2, 0)
        whole = np.round(taps / taps.sum() * 2**TAP_BITS)
        whole[reach - 1] += 2**TAP_BITS - whole.sum()
        phases.append(whole)
    return phases, up, down


def resample(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """PCM at another rate by a polyphase windowed-sinc filter; sums are of whole numbers, so that they are the same everywhere.

    There are ceil(n * target / rate) samples; silence stands before the first and after the last.
    """
    if rate == target or not len(pcm):
        return pcm
    phases, up, down = filter_phases(rate, target)
    reach = len(phases[0]) // 2
    n = -(-len(pcm) * up // down)
    padded = np.concatenate([np.zeros(reach - 1), pcm, np.zeros(reach + 1)])
    out = np.empty(n)
    for first in range(min(up, n)):  # outputs first, first + up, ... are of one phase, `down` inputs apart
        start, phase = divmod(first * down, up)
        m = len(range(first, n, up))
        part = padded[start : start + (m - 1) * down + 2 * reach]
        out[first::up] = np.correlate(part, phases[phase], "valid")[::down]
    return np.clip(np.floor((out + 2 ** (TAP_BITS - 1)) / 2**TAP_BITS), -32768, 32767).astype(np.int16)


def payload_of(text: str | None, pad: int) -> tuple[bytes, int]:
    """UTF-8 of text with bytes 255 up to a positive multiple of pad, and its length without them."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % pad if data else pad), len(data)


def wrap(payload: bytes, codec: str, how: Telephony) -> bytes:
    """A RIFF WAVE file whose samples are the payload's bytes."""
    if codec == "adpcm":
        samples = 1 + 2 * (how.block - 4)
        extra, align, bits = struct.pack("<H", samples), how.block, 4
        count, speed = len(payload) // how.block * samples, how.rate * how.block // samples
    else:
        extra, align, bits, count, speed = b"", 1, 8, len(payload), how.rate
    fmt = struct.pack("<HHIIHHH", TAGS[codec], 1, how.rate, speed, align, bits, len(extra)) + extra
    chunks = b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2) for name, x in ((b"fmt ", fmt), (b"fact", struct.pack("<I", count)), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def unwrap(media: bytes) -> tuple[str, int, int, bytes]:
    """Codec, rate, bytes of a block and samples' bytes of a RIFF WAVE file, by the lengths that its chunks declare."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, found = 12, {}
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        found[name] = media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    tag, _, rate, _, align = struct.unpack_from("<HHIIH", found[b"fmt "])
    return {v: k for k, v in TAGS.items()}[tag], rate, align, found[b"data"]


def decode(items: list[tuple[str, int, bytes]], at_once: int = 4_000_000) -> list[np.ndarray]:
    """PCM of each (codec, bytes of a block, samples' bytes): tables for companded bytes, all ADPCM blocks of a size together."""
    tables = {"mulaw": mulaw_table(), "alaw": alaw_table()}
    out: list = [None] * len(items)
    waiting: dict[int, list[int]] = {}
    for i, (codec, align, data) in enumerate(items):
        if codec in tables:
            out[i] = tables[codec][np.frombuffer(data, np.uint8)]
        else:
            waiting.setdefault(align, []).append(i)
    for align, which in waiting.items():
        while which:
            group, n = [], 0
            while which and (not group or n + len(items[which[0]][2]) <= at_once):
                group.append(which.pop(0))
                n += len(items[group[-1]][2])
            pcm = decode_adpcm(np.frombuffer(b"".join(items[i][2] for i in group), np.uint8).reshape(-1, align))
            cuts = np.cumsum([len(items[i][2]) // align for i in group])[:-1]
            for i, part in zip(group, np.split(pcm, cuts), strict=True):
                out[i] = part.ravel()
    return out


def store(docs: DataFrame, how: Telephony) -> DataFrame:
    """(doc_id, slice, n_bytes, media) of docs(doc_id, text): each text's bytes as one of three codecs' samples, by their CRC-32."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                payload, n = payload_of(text, how.pad)
                crc = zlib.crc32(payload)
                out.append((n, wrap(payload, CODECS[crc % 3], how)))
            yield pd.concat([pdf[["doc_id", "slice"]], pd.DataFrame(out, columns=["n_bytes", "media"], index=pdf.index)], axis=1)

    dealt = docs.select("doc_id", F.expr(f"cast(pmod(xxhash64(doc_id, text), {how.slices}) as int)").alias("slice"), "text")
    return map_frames(dealt, run, f"doc_id {type_of(docs, 'doc_id')}, slice int, n_bytes long, media binary")


def _opened(batches: Iterator[pd.DataFrame], how: Telephony) -> Iterator[tuple[pd.DataFrame, list[tuple[str, int, int, bytes]], list[np.ndarray]]]:
    """Rows of media with their containers' contents and resampled PCM, as many rows at once as memory should hold decoded."""
    for whole in batches:
        at = 0
        sizes = whole["media"].map(len).cumsum()
        while at < len(whole):
            end = max(at + 1, int(sizes.searchsorted((sizes.iloc[at - 1] if at else 0) + how.at_once, "right")))
            pdf = whole.iloc[at:end]
            read = [unwrap(x) for x in pdf["media"]]
            pcm = decode([(codec, align, data) for codec, _, align, data in read], how.at_once)
            yield pdf, read, [resample(x, r[1], how.target_rate) for x, r in zip(pcm, read, strict=True)]
            at = end


def resampled(media: DataFrame, how: Telephony) -> DataFrame:
    """media(doc_id, n_bytes, media) opened and decoded: codec, digests of container and samples, and pcm, 16-bit little-endian at the target rate."""
    columns = ["codec", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "pcm"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, read, pcm in _opened(batches, how):
            out = []
            for stored, (codec, _, _, data), x in zip(pdf["media"], read, pcm, strict=True):
                out.append((codec, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), x.astype("<i2").tobytes()))
            yield pd.concat([pdf[["doc_id", "n_bytes"]], pd.DataFrame(out, columns=columns, index=pdf.index)], axis=1)

    schema = f"doc_id {type_of(media, 'doc_id')}, n_bytes long, codec string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pcm binary"
    return map_frames(media.select("doc_id", "n_bytes", "media"), run, schema)


def feature_of(codec: str, pcm: bytes) -> str:
    """Codec, number of samples, root mean square, peak, zero crossings and SHA-256 (16 digits) of PCM."""
    x = np.frombuffer(pcm, "<i2").astype(np.int64)
    level = int(np.sqrt((x * x).mean())) if len(x) else 0
    crossings = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    return f"{codec}:{len(x)}:{level}:{int(np.abs(x).max(initial=0))}:{crossings}:{hashlib.sha256(pcm).hexdigest()[:16]}"


def features(stored: DataFrame) -> DataFrame:
    """The rows of a stored table of resampled(), with `feature` of the PCM that is read back in place of it."""
    columns = [c for c in stored.columns if c not in ("codec", "pcm")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[columns].assign(feature=[feature_of(codec, pcm) for codec, pcm in zip(pdf["codec"], pdf["pcm"], strict=True)])

    return map_frames(stored, run, ", ".join(f"{c} {type_of(stored, c)}" for c in columns) + ", feature string")


def media_features(docs: DataFrame, how: Telephony | None = None) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of docs(doc_id, text).

    Each text's UTF-8, with bytes 255 up to a positive multiple of 576, is stored as telephony samples in a table of
    the shared folder; the table is read, its containers are opened, and digests are of the bytes that come back. The
    PCM, resampled to `how.target_rate`, is stored in a table as well and read back for `feature`: the codec, and the
    number, root mean square, peak, zero crossings and SHA-256 (16 digits) of its samples. Documents are taken in
    `how.slices` slices, and a slice's PCM is deleted when its features are written, which bounds the disk that it
    needs; store() and resampled() give the tables to who wants to keep them.

    Null and empty texts are 576 bytes of padding. Equal texts give equal values; rows are independent, so repeated
    ids are repeated rows, and a null id stays null. An empty table gives an empty result. Other columns are ignored.
    """
    how = how or Telephony()
    media, out = materialize(store(docs, how), "media", "slice"), None
    for x in range(how.slices):
        pcm = materialize(resampled(media.where(F.col("slice") == x), how), "pcm")
        part = materialize(features(pcm), "features")
        discard(pcm)
        out = part if out is None else out.unionByName(part)
    discard(media)
    return out
