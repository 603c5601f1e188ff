"""Media columns: telephony audio (G.711 mu-law and A-law, IMA ADPCM) and resampled PCM.

`text_media` makes a media column of a text column, `described` reads one. `store` puts bytes into an 8 kHz mono WAV of 8-bit samples without loss, `load` reads them back, and `decode`
expands a stored file to 16-bit PCM at twice its rate. Work is done for each Arrow batch in numpy; ADPCM blocks, which
are serial inside, are decoded side by side. Nothing is shuffled.

Null and empty texts give the shortest payload (192 spaces); equal texts give equal values; a row without an id keeps a
null id; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.llm._shared import map_arrow, taken
from fernglass.sources.tables import spread

BLOCK = 192
RATE = 8000
FORMATS = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 17}

# The step sizes and index changes of IMA ADPCM.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157,
     173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707,
     1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635,
     13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, size = (code >> 4) & 7, ((code & 0x0F) << 4) + 8
    size = np.where(exponent == 0, size, (size + 0x100) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Difference and next index for index * 16 + nibble."""
    index, nibble = np.divmod(np.arange(len(STEPS) * 16), 16)
    step = STEPS[index]
    size = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    return np.where(nibble & 8, -size, size).astype(np.int32), (np.clip(index + CHANGES[nibble & 7], 0, len(STEPS) - 1) * 16).astype(np.int32)


DIFFERENCE, NEXT = _adpcm_tables()


def expand(codes: bytes, law: str = "mulaw") -> np.ndarray:
    """16-bit PCM of G.711 codes, by table."""
    return (MULAW if law == "mulaw" else ALAW)[np.frombuffer(codes, np.uint8)]


def adpcm(blocks: bytes, block: int = BLOCK) -> np.ndarray:
    """16-bit PCM of mono IMA ADPCM blocks: a row for each block; the bytes' length is a multiple of `block`, at least 5.

    A block starts with a sample (little-endian), a step index (cut to 0-88) and an unused byte; low nibbles come first."""
    data = np.frombuffer(blocks, np.uint8).reshape(-1, block)
    held = np.clip(data[:, 2], 0, len(STEPS) - 1).astype(np.int32) * 16
    nibbles = np.empty((2 * (block - 4), len(data)), np.int32)
    nibbles[0::2], nibbles[1::2] = (data[:, 4:] & 15).T, (data[:, 4:] >> 4).T
    out = np.empty((len(nibbles) + 1, len(data)), np.int16)
    value = np.ascontiguousarray(data[:, :2]).view("<i2")[:, 0].astype(np.int32)
    out[0] = value
    for i, nibble in enumerate(nibbles, 1):
        nibble += held
        value = np.clip(value + DIFFERENCE[nibble], -32768, 32767, out=value)
        held = NEXT[nibble]
        out[i] = value
    return out.T


def resample(pcm: np.ndarray) -> np.ndarray:
    """PCM at twice the rate: the samples, and between two of them the cubic through the four around (ends repeated)."""
    if not len(pcm):
        return pcm
    x = np.empty(len(pcm) + 3, np.int32)
    x[1:-2], x[0], x[-2:] = pcm, pcm[0], pcm[-1]
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip((9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4, -32768, 32767)
    return out


def store(payload: bytes, kind: str = "mulaw", rate: int = RATE, block: int = BLOCK) -> bytes:
    """A mono WAV file whose data are the payload (kinds: mulaw, alaw, adpcm with blocks of `block` bytes, pcm of 16 bits)."""
    tag = FORMATS[kind]
    if kind == "pcm":
        head = struct.pack("<HHIIHH", tag, 1, rate, 2 * rate, 2, 16)
    elif kind == "adpcm":
        per = 2 * (block - 4) + 1
        head = struct.pack("<HHIIHHHH", tag, 1, rate, rate * block // per, block, 4, 2, per)
    else:
        head = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def load(media: bytes) -> tuple[str, int, int, bytes]:
    """Kind, rate, block size and data of a WAV file; ValueError if it is none of the four kinds."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, head = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            head = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data" and head:
            kind = next((k for k, v in FORMATS.items() if v == head[0]), None)
            if kind and head[1] == 1:
                return kind, head[2], head[4], media[at + 8 : at + 8 + size]
            break
        at += 8 + size + (size & 1)
    raise ValueError("not a mono WAV file of a known kind")


def pcm_of(media: bytes) -> tuple[int, np.ndarray]:
    """Rate and 16-bit samples of a stored file."""
    kind, rate, block, data = load(media)
    if kind == "pcm":
        return rate, np.frombuffer(data, "<i2")
    if kind == "adpcm":
        return rate, adpcm(data[: len(data) // block * block], block).ravel()
    return rate, expand(data, kind)


def decode(df: DataFrame, media: str = "media") -> DataFrame:
    """The rows with columns `rate` int, `pcm` binary (WAV of 16-bit PCM at twice the stored rate) and `fault` string.

    Media that cannot be read, or null ones, have null rate and pcm and say why in `fault`. Columns of these names in the
    input are replaced."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(batch.num_rows):
            row = batch.slice(start, 1)
            rate = pcm = fault = None
            try:
                if (held := row.column(media)[0].as_py()) is None:
                    raise ValueError("null")
                rate, samples = pcm_of(held)
                rate, pcm = 2 * rate, store(resample(samples).tobytes(), "pcm", 2 * rate)
            except ValueError as e:
                fault = str(e)
            yield pa.RecordBatch.from_arrays([*(row.column(c) for c in kept), pa.array([rate], pa.int32()), pa.array([pcm], pa.binary()), pa.array([fault], pa.string())], [*kept, "rate", "pcm", "fault"])

    kept = [c for c in df.columns if c not in ("rate", "pcm", "fault")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept)
    return map_arrow(df.select(*(f"`{c}`" for c in kept)), run, fields + ", rate int, pcm binary, fault string")


def _levels(pcm: np.ndarray) -> str:
    """Peak, zero crossings and mean of squares (whole part)."""
    x = pcm.astype(np.float64)
    return f"{int(np.abs(x).max())},{int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))},{int(x @ x) // len(x)}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fault string"


def text_media(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and `media`: each whole text's bytes, with spaces up to a multiple of 192, as the mu-law samples of a WAV file."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, stop, texts in taken(batch.column(1)):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            media = [store(r + b" " * (-len(r) % BLOCK if r else BLOCK)) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0)[start:stop].cast(pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_arrow(df.select(F.col(doc_id).cast("long"), F.col(text).cast("string")), run, "doc_id long, n_bytes long, media binary")


def described(df: DataFrame, media: str = "media") -> DataFrame:
    """What stored files (doc_id, n_bytes, media) hold and play as, read from their bytes.

    `feature` is `mu:peak,crossings,power;al:...;ad:...;pcm:crc32`: of the payload as mu-law, as A-law and as ADPCM
    blocks of 192 bytes, and the CRC-32 of the mu-law samples resampled to 16 kHz. A null or broken file, or one whose payload is no whole blocks, has a `fault` and null features;
    else `fault` is null. Equal files have equal values."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, stop, files in taken(batch.column(2)):
            loaded, faults = zip(*map(_payload, files), strict=True)
            held = b"".join(p for p in loaded if p)
            decoded, at, features = adpcm(held) if held else None, 0, []
            for payload in loaded:
                if payload is None:
                    features.append(None)
                    continue
                n = len(payload) // BLOCK
                mu = expand(payload)
                features.append(f"mu:{_levels(mu)};al:{_levels(expand(payload, 'alaw'))};ad:{_levels(decoded[at : at + n].ravel())};pcm:{zlib.crc32(resample(mu).tobytes())}")
                at += n
            whole = lambda some, f, kind: pa.array([None if x is None else f(x) for x in some], kind)
            sha = lambda some: whole(some, lambda x: hashlib.sha256(x).hexdigest(), pa.string())
            size = lambda some: whole(some, len, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[start:stop], batch.column(1)[start:stop], size(loaded), sha(loaded), whole(loaded, lambda p: zlib.crc32(p[-16:]), pa.int64()), size(files), sha(files), pa.array(features, pa.string()), pa.array(faults, pa.string())],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "fault"],
            )

    return map_arrow(df.select(F.col("doc_id").cast("long"), F.col("n_bytes").cast("long"), F.col(media).cast("binary")), run, SCHEMA)


def _payload(media: bytes | None) -> tuple[bytes | None, str | None]:
    """A file's payload, or why there is none."""
    if media is None:
        return None, "null"
    try:
        payload = load(media)[3]
    except (ValueError, IndexError, struct.error) as e:
        return None, str(e) or "broken"
    return (payload, None) if payload and len(payload) % BLOCK == 0 else (None, f"{len(payload)} bytes are no whole blocks")


def text_audio(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Texts stored as media and read back: a media column in between."""
    return described(text_media(df, text, doc_id))


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_audio(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
