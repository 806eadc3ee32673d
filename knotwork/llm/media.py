"""Telephony audio as media columns: mu-law, A-law and IMA ADPCM in WAV files, decoded to PCM and resampled.

``store_bytes`` wraps bytes as 8-bit companded samples, or as ADPCM nibble pairs, of a WAV file; nothing is
lost, because a code byte is stored as it is. ``decode_audio`` reads such files back: companded bytes
are expanded by lookup tables of 256 entries, ADPCM blocks of a whole batch advance together, one
nibble a step, in numpy, and the 8 kHz result is resampled to 16 kHz PCM by a half-band filter. ``store_pcm`` writes that to a table.

Cases. Null payload: treated as empty. Empty payload: a file without samples, feature of zeros. A null or
damaged file: null payload, null pcm and the feature ``unreadable``. Very long payloads are batches
of their own. Extra columns pass through as they are; the operators' output columns win over columns of
the same name. Ids of ``text_as_audio`` are cast to long; one that can't be is null. Repeated rows give equal values. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.storage import Table
from .common import cut, map_batches, own_name, whole_id, with_fields

RATE, OUT_RATE = 8000, 16000
#: WAV format tags (fixed values).
ALAW, MULAW, ADPCM = 6, 7, 17
NAMES = {ALAW: "alaw", MULAW: "mulaw", ADPCM: "ima_adpcm"}
#: Data bytes of an ADPCM block after its header of four bytes; payloads are padded to a multiple of it.
BLOCK = 192
#: Bytes of files decoded at once; their samples take sixteen times as much.
BATCH = 1 << 20
#: Step sizes and index changes of IMA ADPCM (fixed values).
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(segment > 0, low + 264 << np.maximum(segment - 1, 0), low + 8)
    return np.where(code & 128, size, -size).astype(np.int16)


def adpcm_moves() -> tuple[np.ndarray, np.ndarray]:
    """By (index, nibble): the change of the predictor, and the next index."""
    nibble = np.arange(16, dtype=np.int32)[None, :]
    step = STEPS[:, None]
    size = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
    index = np.clip(np.arange(len(STEPS), dtype=np.int32)[:, None] + INDEX_CHANGE[None, :], 0, len(STEPS) - 1)
    return np.where(nibble & 8, -size, size).astype(np.int32), index


EXPAND = {MULAW: mulaw_table(), ALAW: alaw_table()}
MOVE, NEXT = adpcm_moves()


def wav(codec: int, payload: bytes) -> bytes:
    """A mono 8 kHz WAV file. ADPCM blocks start at predictor 0, index 0; their payload is a multiple of 192 bytes."""
    if codec == ADPCM:
        if len(payload) % BLOCK:
            raise ValueError(f"an ADPCM payload must be a multiple of {BLOCK} bytes")
        blocks = np.zeros((len(payload) // BLOCK, BLOCK + 4), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
        per_block = 2 * BLOCK + 1
        data, samples = blocks.tobytes(), len(blocks) * per_block
        fmt = struct.pack("<HHIIHHHH", codec, 1, RATE, RATE * (BLOCK + 4) // per_block, BLOCK + 4, 4, 2, per_block)
    else:
        data, samples = payload, len(payload)
        fmt = struct.pack("<HHIIHHH", codec, 1, RATE, RATE, 1, 8, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, bytes]:
    """(codec, data) of a file that ``wav`` can have written; ValueError on any other."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, codec = 12, None
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        body = media[at + 8 : at + 8 + n]
        if len(body) < n:
            break
        if name == b"fmt " and n >= 16:
            codec = struct.unpack_from("<H", body)[0]
            if codec == ADPCM and struct.unpack_from("<H", body, 12)[0] != BLOCK + 4:
                raise ValueError("another block size")
        elif name == b"data":
            if codec not in NAMES or codec == ADPCM and n % (BLOCK + 4):
                raise ValueError("another codec, or a broken block")
            return codec, body
        at += 8 + n + n % 2
    raise ValueError("no data")


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 samples (blocks x 385) of uint8 blocks (blocks x 196); all blocks take each step together."""
    samples = np.empty((2 * BLOCK + 1, len(blocks)), np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    samples[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(BLOCK):
        for half, nibble in enumerate((codes[k] & 15, codes[k] >> 4)):
            at = index * 16 + nibble
            value = np.clip(value + MOVE.ravel()[at], -32768, 32767)
            index = NEXT.ravel()[at]
            samples[1 + 2 * k + half] = value
    return samples.T


def resample(pcm: np.ndarray) -> np.ndarray:
    """8 kHz int16 to 16 kHz int16: each sample, then the half-band value between it and the next."""
    x = np.concatenate([np.zeros(2, np.int32), pcm, np.zeros(3, np.int32)])
    n = len(pcm)
    mid = 150 * (x[2 : 2 + n] + x[3 : 3 + n]) - 25 * (x[1 : 1 + n] + x[4 : 4 + n]) + 3 * (x[:n] + x[5 : 5 + n])
    out = np.empty(2 * n, "<i2")
    out[::2] = pcm
    out[1::2] = np.clip(mid + 128 >> 8, -32768, 32767)
    return out


def feature(codec: int, pcm: np.ndarray, up: np.ndarray) -> str:
    """Samples, peak, mean square, sign changes and a checksum of the resampled samples."""
    wide = pcm.astype(np.int64)
    square = int((wide * wide).sum()) // max(1, len(pcm))
    turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{NAMES[codec]};n={len(pcm)};peak={int(np.abs(wide).max(initial=0))};ms={square};zc={turns};up={zlib.crc32(up.tobytes()):08x}"


def decode_files(files: list[bytes | None]) -> list[tuple[bytes | None, bytes | None, str]]:
    """(payload, 16 kHz PCM, feature) of each file; ADPCM blocks of all files are decoded at once."""
    read: list[tuple[int, bytes] | None] = []
    for media in files:
        try:
            read.append(read_wav(media) if media is not None else None)
        except (ValueError, struct.error):
            read.append(None)
    blocks = [np.frombuffer(r[1], np.uint8).reshape(-1, BLOCK + 4) for r in read if r and r[0] == ADPCM]
    decoded = decode_adpcm(np.concatenate(blocks)) if blocks else None
    out, at = [], 0
    for r in read:
        if r is None:
            out.append((None, None, "unreadable"))
            continue
        codec, data = r
        codes = np.frombuffer(data, np.uint8)
        if codec == ADPCM:
            own = codes.reshape(-1, BLOCK + 4)
            pcm, payload = decoded[at : at + len(own)].ravel(), own[:, 4:].tobytes()
            at += len(own)
        else:
            pcm, payload = EXPAND[codec][codes], data
        up = resample(pcm)
        out.append((payload, up.tobytes(), feature(codec, pcm, up)))
    return out


def pad(payload: bytes) -> bytes:
    """Spaces up to a positive multiple of 192 bytes."""
    return payload + b" " * (-len(payload) % BLOCK if payload else BLOCK)


def choose_codec(payload: bytes) -> int:
    """One of the three formats, by the content alone."""
    return (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]


def store(payload: bytes | None, codec: int | None = None) -> bytes:
    """The padded payload as a file, in the given format or the one chosen by the content."""
    padded = pad(payload or b"")
    return wav(choose_codec(padded) if codec is None else codec, padded)


def _with(df: DataFrame, sized: str, made: dict[str, str], step: Callable[[list], list[tuple]]) -> DataFrame:
    """``df`` with columns, by name and type, that ``step`` makes of lists of values of a column; others of these names give way."""
    keep = [c for c in df.columns if c.lower() not in made]
    source, schema = own_name(df, "source"), with_fields(df.select(*[df[f"`{c}`"] for c in keep]), **made)
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in cut(batches, source, BATCH):
            new = list(zip(*step(part.column(source).to_pylist()), strict=True))
            columns = [part.column(i) for i in range(len(keep))] + [pa.array(x, f.type) for x, f in zip(new, list(kinds)[len(keep) :], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_batches(df.select(*[df[f"`{c}`"] for c in keep], df[f"`{sized}`"].cast("binary").alias(source)), run, schema)


def store_bytes(df: DataFrame, payload_col: str, codec: int | None = None) -> DataFrame:
    """``df`` with ``media``: a WAV file of the column's bytes (or of a string's UTF-8), padded with spaces."""
    return _with(df, payload_col, {"media": "binary"}, lambda values: [(store(x, codec),) for x in values])


def decode_audio(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with ``payload`` (the stored code bytes), ``pcm`` (16-bit, 16 kHz, mono) and ``feature``."""
    return _with(df, media_col, {"payload": "binary", "pcm": "binary", "feature": "string"}, decode_files)


def store_pcm(df: DataFrame, path: str, media_col: str = "media") -> DataFrame:
    """The decoded and resampled audio of ``df`` as a table in the folder ``path``, compressed; what is returned reads it."""
    decode_audio(df, media_col).drop("payload").write.parquet(path, compression="zstd")
    return df.sparkSession.read.parquet(path)


DIGESTS = {
    "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string",
    "feature": "string", "pcm_bytes": "long", "pcm_sha256": "string",
}


def _digests(files: list[bytes | None]) -> list[tuple]:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    out = []
    for media, (payload, pcm, said) in zip(files, decode_files(files), strict=True):
        media, payload, pcm = media or b"", payload or b"", pcm or b""
        out.append((len(payload), sha(payload), zlib.crc32(payload[-16:]), len(media), sha(media), said, len(pcm), sha(pcm)))
    return out


def audio_digests(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with sizes and digests of its files, of the payloads read from them and of the resampled PCM, and the feature, but without the files."""
    return _with(df, media_col, DIGESTS, _digests).drop(media_col)


def text_as_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each text that is stored as audio and read back: the columns of query ``op1_media``.

    The files are written to a table in the shared folder; all digests are of what is read from there.
    """
    raw = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    slim = docs.select(whole_id(docs, id_col).alias("doc_id"), F.octet_length(raw).cast("long").alias("n_bytes"), raw.alias("raw"))
    stored = Table(store_bytes(slim, "raw").drop("raw"), "media", codec="zstd")
    return audio_digests(stored.df)
