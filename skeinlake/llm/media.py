"""Telephony audio: mu-law, A-law and IMA ADPCM to PCM, resampling and WAV storage, in numpy."""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, pieces, text_buffers

#: WAV format codes.
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, size = a >> 4 & 7, ((a & 15) << 4) + 8
    size = np.where(exponent, size + 256 << np.maximum(exponent - 1, 0), size)
    return np.where(a & 128, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()
#: Fixed values of the IMA standard.
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw(codes: np.ndarray) -> np.ndarray:
    return MULAW_TABLE[codes]


def alaw(codes: np.ndarray) -> np.ndarray:
    return ALAW_TABLE[codes]


#: By index << 4 | code: what a code adds to the sample, and the index after it.
_AT, _CODE = np.arange(89 * 16) >> 4, np.arange(89 * 16) & 15
_STEP = IMA_STEPS[_AT]
_SIZE = (_STEP >> 3) + np.where(_CODE & 4, _STEP, 0) + np.where(_CODE & 2, _STEP >> 1, 0) + np.where(_CODE & 1, _STEP >> 2, 0)
IMA_ADDS, IMA_AFTER = np.where(_CODE & 8, -_SIZE, _SIZE).astype(np.int32), np.clip(_AT + IMA_MOVES[_CODE & 7], 0, 88).astype(np.int32)


def _ima_step(code: np.ndarray, value: np.ndarray, index: np.ndarray) -> None:
    at = (index << 4) | code
    value += IMA_ADDS[at]
    np.clip(value, -32768, 32767, out=value)
    index[...] = IMA_AFTER[at]


def ima_decode(data: np.ndarray, block: int = 256, channels: int = 1) -> np.ndarray:
    """IMA ADPCM blocks to PCM: samples, or frames x channels where there are several.

    A block has a 4-byte head a channel (first sample, index of the step), then in turn four bytes
    a channel of two codes each, low first. One step of the loop decodes one place of all blocks at
    once. A last block that is not whole gives the frames that it has of all channels."""
    whole = len(data) // block * block
    parts = [_ima_blocks(data[:whole].reshape(-1, block), channels), _ima_blocks(data[whole:].reshape(1, -1), channels)]
    out = np.concatenate(parts)
    return out.ravel() if channels == 1 else out


def _ima_blocks(blocks: np.ndarray, channels: int) -> np.ndarray:
    n, head = len(blocks), 4 * channels
    if n == 0 or blocks.shape[1] < head:
        return np.zeros((0, channels), np.int16)
    heads = blocks[:, :head].reshape(n, channels, 4)
    value = heads[:, :, :2].copy().view("<i2")[:, :, 0].astype(np.int32)
    index = np.clip(heads[:, :, 2].astype(np.int32), 0, 88)
    body = np.ascontiguousarray(blocks[:, head:].T)
    full, rest = divmod(len(body), head)
    each = 4 * full + max(0, rest - head + 4)  # bytes that every channel has
    out = np.empty((2 * each + 1, n, channels), np.int16)
    out[0] = value
    for i in range(each):
        at = i // 4 * head + i % 4 + 4 * np.arange(channels)
        code = body[at].T.astype(np.int32)
        for half in (0, 1):
            _ima_step(code >> 4 * half & 15, value, index)
            out[1 + 2 * i + half] = value
    return out.transpose(1, 0, 2).reshape(-1, channels)


def ima_encode(samples: np.ndarray, block: int = 256) -> np.ndarray:
    """The blocks that ima_decode reads; the last is filled up with silence."""
    each = 2 * (block - 4) + 1
    n = max(1, -(-len(samples) // each))
    pcm = np.zeros(n * each, np.int32)
    pcm[: len(samples)] = samples
    pcm = pcm.reshape(n, each)
    value = pcm[:, 0].copy()
    index = np.clip(np.searchsorted(IMA_STEPS, np.abs(pcm[:, 1] - value)), 0, 88).astype(np.int32)
    out = np.zeros((n, block), np.uint8)
    out[:, 2] = index
    out[:, :2] = value.astype("<i2")[:, None].view(np.uint8)
    for i in range(1, each):
        gap, step = pcm[:, i] - value, IMA_STEPS[index]
        size = np.abs(gap)
        code = np.where(gap < 0, 8, 0).astype(np.int32)
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            has = size >= part
            code |= np.where(has, bit, 0)
            size = size - np.where(has, part, 0)
        _ima_step(code, value, index)
        out[:, 4 + (i - 1) // 2] |= (code << 4 * ((i - 1) % 2)).astype(np.uint8)
    return out.ravel()


def resample(pcm: np.ndarray, up: int, down: int) -> np.ndarray:
    """PCM (samples, or frames x channels) at up / down times its rate, linear between samples;
    whole numbers only, so that every machine gets the same."""
    n = len(pcm)
    if n == 0:
        return pcm.astype(np.int16)
    place = np.arange(n * up // down, dtype=np.int64) * down
    at, part = place // up, place % up
    x = pcm.astype(np.int32)
    part = part.reshape(-1, *[1] * (x.ndim - 1))
    after = x[np.minimum(at + 1, n - 1)]
    return ((x[at] * (up - part) + after * part) // up).astype(np.int16)


def wav(data: bytes, rate: int, kind: int = PCM, channels: int = 1, block: int = 256) -> bytes:
    """A WAV file of 16-bit PCM, of 8-bit mu-law or A-law codes or of IMA ADPCM blocks."""
    if kind == IMA:
        each = 2 * (block - 4 * channels) // channels + 1
        last = len(data) % block
        left = max(0, last - 4 * channels)
        frames = len(data) // block * each + (last >= 4 * channels) * (1 + 2 * (left // (4 * channels) * 4 + max(0, left % (4 * channels) - 4 * channels + 4)))
        form = struct.pack("<HHIIHHHH", kind, channels, rate, rate * block // each, block, 4, 2, each)
    else:
        width = (2 if kind == PCM else 1) * channels
        frames = len(data) // width
        form = struct.pack("<HHIIHH", kind, channels, rate, rate * width, width, 8 * width // channels) + (b"" if kind == PCM else b"\0\0")
    fact = b"" if kind == PCM else struct.pack("<4sII", b"fact", 4, frames)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(form)) + form + fact + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


class Wav(NamedTuple):
    kind: int
    rate: int
    data: bytes
    channels: int
    align: int
    bits: int
    frames: int | None


def read_wav(media: bytes) -> Wav:
    """Format, rate, data, channels, bytes of a block, bits and the frames that the file tells, of a
    WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, frames = 12, None, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt " and size >= 16 and at + 24 <= len(media):
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"fact" and size >= 4 and at + 12 <= len(media):
            frames = struct.unpack_from("<I", media, at + 8)[0]
        elif name == b"data":
            if form is None:
                raise ValueError("no format")
            kind, channels, rate, _, align, bits = form
            return Wav(kind, rate, media[at + 8 : at + 8 + size], channels, align, bits, frames)
        at += 8 + size + size % 2
    raise ValueError("no samples")


def expand(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, PCM) of a WAV file of 16-bit PCM, mu-law, A-law or IMA ADPCM: samples, or frames x
    channels where there are several."""
    f = read_wav(media)
    width = {PCM: 2, MULAW: 1, ALAW: 1, IMA: 0}.get(f.kind)
    if width is None or f.channels < 1 or f.kind == PCM and f.bits != 16 or f.kind == IMA and (f.align < 4 * f.channels or f.bits != 4):
        raise ValueError(f"format {f.kind} of {f.channels} channels, {f.bits} bits and blocks of {f.align} bytes")
    if f.kind == IMA:
        pcm = ima_decode(np.frombuffer(f.data, np.uint8), f.align, f.channels)
        # the last block may be filled up
        return f.rate, pcm[: f.frames] if f.frames else pcm
    data = f.data[: len(f.data) // (width * f.channels) * width * f.channels]
    pcm = np.frombuffer(data, "<i2") if f.kind == PCM else (mulaw if f.kind == MULAW else alaw)(np.frombuffer(data, np.uint8))
    return f.rate, pcm if f.channels == 1 else pcm.reshape(-1, f.channels)


def _features(pcm: np.ndarray) -> str:
    """Frames, peak, mean square, zero crossings and a checksum of PCM."""
    x = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};peak={int(np.abs(x).max(initial=0))};power={int((x * x).sum()) // max(1, x.size)};crossings={crossings};crc={zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


#: Bytes of the IMA ADPCM blocks of a payload; payloads have whole ones.
BLOCK = 64
_NAMES = {MULAW: "mulaw", ALAW: "alaw", IMA: "adpcm"}


def media_columns(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: int = 8000, up: int = 2, down: int = 1, keep: bool = True, codec: int = MULAW
) -> DataFrame:
    """Store every row's text as telephony audio, read it back and describe it.

    The UTF-8 bytes (null: empty), filled up with zeros to a positive multiple of 64, are the
    data of a mono WAV file (`media`) of `codec`: mu-law or A-law samples, or IMA ADPCM blocks of
    64 bytes. That file is read again: its data are the payload, and expanded and resampled by
    up / down they are stored as 16-bit PCM (`pcm`, a WAV file). Returned: doc_id, n_bytes, lengths
    and SHA-256 of payload and media, the CRC-32 of the payload's last 64 bytes, feature (frames,
    peak, power, crossings and checksum of the PCM, then, each after its name, those of the
    payload expanded by the other two codecs) and, with keep, rate, media and pcm themselves. Equal
    texts give equal values; repeated rows are all kept; extra columns are ignored; an empty table
    gives an empty one. Audio that is there already: media_features.
    """
    if codec not in _NAMES:
        raise ValueError(f"codec {codec}")

    def rows(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in pieces(offsets, 1 << 21):
                n_bytes = np.diff(offsets[lo : hi + 1])
                starts = np.zeros(hi - lo + 1, np.int64)
                np.cumsum(np.maximum(BLOCK, -(-n_bytes // BLOCK) * BLOCK), out=starts[1:])
                held = np.zeros(starts[-1], np.uint8)
                for i, n in enumerate(n_bytes):
                    held[starts[i] : starts[i] + n] = data[offsets[lo + i] : offsets[lo + i + 1]]
                # the blocks of all rows at once: one row has too few to fill a step of the loop
                adpcm, each = ima_decode(held, BLOCK), 2 * (BLOCK - 4) + 1
                out = [[] for _ in range(9)]
                for i, n in enumerate(n_bytes.tolist()):
                    media = wav(held[starts[i] : starts[i + 1]].tobytes(), rate, codec, block=BLOCK)
                    payload = read_wav(media).data
                    codes = np.frombuffer(payload, np.uint8)
                    pcms = {MULAW: mulaw(codes), ALAW: alaw(codes), IMA: adpcm[starts[i] // BLOCK * each : starts[i + 1] // BLOCK * each]}
                    pcms = {k: resample(x, up, down) for k, x in pcms.items()}
                    pcm = pcms.pop(codec)
                    feature = "|".join([_features(pcm), *(f"{_NAMES[k]}:{_features(x)}" for k, x in pcms.items())])
                    found = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                    for x, y in zip(out, (*found, *((media, wav(pcm.astype("<i2").tobytes(), rate * up // down)) if keep else ()))):
                        x.append(y)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary(), pa.binary()] * keep
                columns = [batch.column(0).slice(lo, hi - lo), *map(pa.array, out, kinds)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    schema = _DIGEST + ", media binary, pcm binary" * keep
    found = only(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, schema)
    return found.withColumn("rate", F.lit(rate * up // down)) if keep else found


def media_features(rows: DataFrame, doc_id: str = "doc_id", media: str = "media", up: int = 2, down: int = 1) -> DataFrame:
    """doc_id, rate, channels, feature, pcm of every row's WAV file of PCM, mu-law, A-law or IMA ADPCM.
    Repeated rows and those without an id are rows of their own, equal files give equal values; extra
    columns are ignored; an empty table gives an empty one.

    Expanded and resampled by up / down with all its channels: rate and channels of that, its
    features and a WAV file of 16-bit PCM. All four are null where media is null or no such file."""

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py()
                try:
                    at, pcm = expand(raw or b"")
                    pcm = resample(pcm, up, down)
                    channels = 1 if pcm.ndim == 1 else pcm.shape[1]
                    found = (at * up // down, channels, _features(pcm), wav(pcm.astype("<i2").tobytes(), at * up // down, channels=channels))
                except ValueError:
                    found = (None,) * 4
                columns = [batch.column(0).slice(i, 1), *(pa.array([x], t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.string(), pa.binary())))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "rate", "channels", "feature", "pcm"])

    picked = only(rows, doc_id, media).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(media).cast("binary").alias("media"))
    return picked.mapInArrow(read, "doc_id long, rate long, channels long, feature string, pcm binary")
