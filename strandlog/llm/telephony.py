"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAVE form, decoded and resampled."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm._common import released, spare

MULAW, ALAW, ADPCM = 7, 6, 17  # WAVE format tags
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm"}
#: Bytes of an ADPCM block; payloads are padded to a multiple of it.
BLOCK = 64
RATE, TO_RATE = 8000, 16000
#: Samples that are decoded at once.
SPAN = 4 << 20
#: Bytes of media that are read at once, as many rows as they are.
TOGETHER = 1 << 20
#: So many squares of 16-bit samples add up to less than 2**53.
EXACT = 1 << 22
ADPCM_SAMPLES = (BLOCK - 4) * 2 + 1

# Fixed values of the IMA ADPCM format: index adjustment of each code's magnitude.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
# Fixed values of the IMA ADPCM format: the 89 step sizes.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
        118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
        1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
        6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
        32767,
    ],
    np.int32,
)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """What a code adds to the value and the index it leads to, by index * 16 + code."""
    index, code = np.divmod(np.arange(89 * 16, dtype=np.int32), 16)
    size = STEPS[index]
    change = (size >> 3) + (size >> 2) * (code & 1) + (size >> 1) * (code >> 1 & 1) + size * (code >> 2 & 1)
    return np.where(code & 8, -change, change).astype(np.int32), np.clip(index + INDEX_STEP[code & 7], 0, 88).astype(np.int32)


CHANGE, NEXT = _adpcm_tables()


def mulaw_table() -> np.ndarray:
    """ITU-T G.711 mu-law: the 16-bit sample of each of the 256 codes."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """ITU-T G.711 A-law: the 16-bit sample of each of the 256 codes."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, size = code >> 4 & 7, ((code & 15) << 4) + 8
    size = np.where(exponent > 0, size + 0x100 << np.maximum(exponent - 1, 0), size)
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def adpcm_decode(data: np.ndarray) -> np.ndarray:
    """int16 samples of whole IMA ADPCM blocks (uint8): the loop goes over the samples of a block, numpy over the blocks."""
    blocks = data.reshape(-1, BLOCK)
    head = np.ascontiguousarray(blocks[:, :4])
    value = head[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(head[:, 2], 88).astype(np.int32)
    codes = np.empty((len(blocks), ADPCM_SAMPLES - 1), np.uint8)
    codes[:, 0::2], codes[:, 1::2] = blocks[:, 4:] & 15, blocks[:, 4:] >> 4
    codes = np.ascontiguousarray(codes.T)
    out = np.empty((ADPCM_SAMPLES, len(blocks)), np.int16)
    out[0] = value
    for k, code in enumerate(codes, 1):
        at = index * 16 + code
        value = np.clip(value + CHANGE[at], -32768, 32767)
        index = NEXT[at]
        out[k] = value
    return out.T.reshape(-1)


def decode(tag: int, data: np.ndarray) -> np.ndarray:
    """int16 samples of stored codes."""
    return adpcm_decode(data) if tag == ADPCM else TABLES[tag][data]


def resample(pcm: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """8 to 16 kHz: the given samples, and between two of them a 4-point cubic (-1 9 9 -1)/16; ends are held.

    Of a span of longer audio, before has the sample before it and after the two after it (fewer at its end).
    """
    if not len(pcm):
        return pcm
    ahead = pcm[:1] if before is None or not len(before) else before[-1:]
    rest = pcm[:0] if after is None else after[:2]
    end = rest if len(rest) else pcm
    x = np.concatenate([ahead, pcm, rest, *[end[-1:]] * (2 - len(rest))]).astype(np.int32)
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip((9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4, -32768, 32767)
    return out


def wave(tag: int, payload: bytes, rate: int = RATE) -> bytes:
    """A WAVE file whose data chunk is payload, of format tag."""
    if tag == ADPCM:
        fmt = struct.pack("<HHIIHHHH", tag, 1, rate, rate * BLOCK // ADPCM_SAMPLES, BLOCK, 4, 2, ADPCM_SAMPLES)
        n = len(payload) // BLOCK * ADPCM_SAMPLES
    else:
        fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
        n = len(payload)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, n)
    body += b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwave(data: bytes) -> tuple[int, bytes]:
    """(format tag, data chunk) of a WAVE file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag = 12, None
    while at + 8 <= len(data):
        kind, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"fmt ":
            tag = struct.unpack_from("<H", data, at + 8)[0]
        elif kind == b"data":
            return tag, data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("WAVE file without data")


def pick(payload: bytes) -> int:
    """The format a payload is stored in: by its checksum, so that equal payloads are stored alike and all three are used."""
    return (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def store(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs.text as audio: the columns named in keep, n_bytes (of the text) and media (a WAVE file), one row a row.

    The text's UTF-8 (of a null text: nothing), with zero bytes up to a positive multiple of
    64, is the stored code sequence: nothing is lost, whatever the text's length. Equal texts
    give equal media. Other columns are dropped, whatever their names. No shuffle.
    """
    kept = docs.select(*keep, docs["text"].cast("string").alias(spare(keep)))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[:-1])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part, sizes, media = b.slice(at, 512), [], []
                for text in part.column(len(keep)):
                    n, payload = payload_of(text.as_py())
                    sizes.append(n)
                    media.append(wave(pick(payload), payload))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])

    return kept.mapInArrow(released(run), fields + "n_bytes long, media binary")


def _measured(tag: int, spans) -> tuple[str, int, list[np.ndarray]]:
    """(feature, samples, resampled parts) of spans of decoded samples, neighbours of which are carried over their bounds."""
    spans = iter(spans)
    n = peak = crossings = 0
    power, parts, last = 0, [], False
    before, now = None, next(spans, None)
    while now is not None:
        after = next(spans, None)
        pcm = resample(now, before, after)
        before, now = now, after
        for at in range(0, len(pcm), EXACT):  # sums below 2**53, so that they are exact
            wide = pcm[at : at + EXACT].astype(np.float64)
            power += int(np.dot(wide, wide))
        peak = max(peak, int(pcm.max()), -int(pcm.min()))
        below = pcm < 0
        crossings += int(np.count_nonzero(below[1:] != below[:-1])) + int(below[0] != last)
        last = bool(below[-1])
        n += len(pcm)
        parts.append(pcm)
    return f"{NAMES[tag]};rate={TO_RATE};n={n};peak={peak};power={power};crossings={crossings}", n, parts


def describe(tag: int, data: bytes) -> tuple[str, int, list[np.ndarray]]:
    """(feature, samples, resampled parts): level and zero crossings of the decoded, resampled audio, span by span.

    Neighbouring samples are carried over the spans' bounds, so the result is that of the whole, whatever SPAN (two codes at least) is.
    """
    codes = np.frombuffer(data, np.uint8)
    return _measured(tag, (decode(tag, codes[at : at + SPAN]) for at in range(0, len(codes), SPAN)))


def describe_all(waves: list[tuple[int, bytes]]) -> list[tuple[str, int, list[np.ndarray]]]:
    """describe() of each of some (tag, data) of SPAN codes in all: the ADPCM blocks of all are decoded in one go."""
    blocks = [np.frombuffer(d, np.uint8) for t, d in waves if t == ADPCM]
    pcm = adpcm_decode(np.concatenate(blocks)) if blocks else None
    out, at = [], 0
    for tag, data in waves:
        if tag == ADPCM:
            n = len(data) // BLOCK * ADPCM_SAMPLES
            out.append(_measured(tag, [pcm[at : at + n]]))
            at += n
        else:
            out.append(_measured(tag, [TABLES[tag][np.frombuffer(data, np.uint8)]]))
    return out


def read_back(media: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes"), pcm: bool = False) -> DataFrame:
    """media (see store) read, decoded and resampled: the columns named in keep, payload_bytes, payload_sha256,
    tail_crc32 (of the last 64 stored bytes), media_bytes, media_sha256, feature and, with pcm, the 16 kHz
    little-endian 16-bit samples. A null media gives nulls; anything but a WAVE file of the three formats fails.
    Rows are decoded in groups of TOGETHER codes at most, a longer one by itself in spans of SPAN codes. No rows
    give no rows. No shuffle.
    """
    kept = media.select(*keep, "media")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[:-1])
    out = fields + "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", pcm binary" * pcm
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * pcm]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["pcm"] * pcm]

    def rows(column):
        waves = [None if x is None else (*unwave(x), x) for x in column.to_pylist()]
        told = iter(describe_all([w[:2] for w in waves if w]) if sum(len(w[1]) for w in waves if w) <= SPAN else [describe(*w[:2]) for w in waves if w])
        for w in waves:
            if w is None:
                yield (None,) * len(kinds)
                continue
            (_, data, whole), (feature, _, parts) = w, next(told)
            row = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(whole), hashlib.sha256(whole).hexdigest(), feature)
            yield row + ((np.concatenate(parts).astype("<i2").tobytes(),) if pcm else ())

    def run(batches):
        for b in batches:
            size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(b.column("media")), 0).to_numpy().astype(np.int64))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TOGETHER, "right")))
                part = b.slice(at, to - at)
                cols = list(zip(*rows(part.column("media")), strict=True))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*keep, *names])
                at = to

    return kept.mapInArrow(released(run), out)
