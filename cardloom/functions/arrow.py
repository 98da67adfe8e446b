"""Functions that no built-in expresses, as Arrow batches: entities, word error rate, WAV."""

from __future__ import annotations

import html
import io
import re
import struct
import wave
import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

_DASH, _PUNCTUATION = re.compile("[-–—]"), re.compile(r"[^\w\s]|_")


@arrow_udf(StringType())
def html_unescape(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) for t in text.to_pylist()], pa.string())


@arrow_udf(StringType())
def html_escape(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.escape(t) for t in text.to_pylist()], pa.string())


def spoken_words(text: str) -> list[str]:
    """Lower case, dashes as spaces, no punctuation."""
    return _PUNCTUATION.sub("", _DASH.sub(" ", text.lower())).split()


def word_error_rate(reference: str, heard: str) -> float:
    """Word edits from the reference over its words; an empty reference has 0 if nothing was heard, else 1 a word."""
    ref, hyp = spoken_words(reference), spoken_words(heard)
    row = list(range(len(hyp) + 1))
    for i, r in enumerate(ref, 1):
        diagonal, row[0] = row[0], i
        for j, h in enumerate(hyp, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (r != h))
    return row[-1] / len(ref) if ref else float(len(hyp))


@arrow_udf(DoubleType())
def wer(reference: pa.Array, heard: pa.Array) -> pa.Array:
    pairs = zip(reference.to_pylist(), heard.to_pylist(), strict=True)
    return pa.array([None if r is None or h is None else round(word_error_rate(r, h), 4) for r, h in pairs], pa.float64())


def pcm_of(data: bytes) -> tuple[int, int, int, bytes]:
    """Rate, channels, sample bytes and samples of a WAV whose sizes may be wrong: a data chunk that claims more than there is
    ends with the file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no WAVE file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        start = at + 8
        if name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            return form[2], form[1], form[5] // 8, data[start : start + size]
        if size == 0xFFFFFFFF:
            raise ValueError(f"chunk {name!r} has no size")
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", data, start)
        at = start + size + size % 2
    raise ValueError("no samples")


def wav_of(rate: int, channels: int, width: int, pcm: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(pcm[: len(pcm) - len(pcm) % (channels * width)])
    return out.getvalue()


_INFO = StructType([StructField(n, t) for n, t in (("rate", IntegerType()), ("channels", IntegerType()), ("width", IntegerType()), ("seconds", DoubleType()), ("error", StringType()))])


@arrow_udf(_INFO)
def wav_info(data: pa.Array) -> pa.Array:
    """Format and length of a WAV; the reason where it can't be read."""
    rows = []
    for d in data.to_pylist():
        try:
            rate, channels, width, pcm = pcm_of(d or b"")
            rows.append({"rate": rate, "channels": channels, "width": width, "seconds": len(pcm) / (rate * channels * width), "error": None})
        except (ValueError, struct.error, ZeroDivisionError) as e:
            rows.append({"rate": None, "channels": None, "width": None, "seconds": None, "error": str(e)})
    return pa.array(rows, pa.struct([("rate", pa.int32()), ("channels", pa.int32()), ("width", pa.int32()), ("seconds", pa.float64()), ("error", pa.string())]))


@arrow_udf(BinaryType())
def wav_repaired(data: pa.Array) -> pa.Array:
    """The same samples with a right header; null where they can't be read."""
    out = []
    for d in data.to_pylist():
        try:
            out.append(wav_of(*pcm_of(d or b"")))
        except (ValueError, struct.error):
            out.append(None)
    return pa.array(out, pa.binary())


@arrow_udf(ArrayType(FloatType()))
def wav_samples(data: pa.Array) -> pa.Array:
    """Samples of 16 kHz mono 16-bit audio in [-1, 1]; null for anything else."""
    import numpy as np

    out = []
    for d in data.to_pylist():
        try:
            rate, channels, width, pcm = pcm_of(d or b"")
        except (ValueError, struct.error):
            rate = channels = width = 0
        out.append((np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2") / np.float32(32768)).tolist() if (rate, channels, width) == (16000, 1, 2) else None)
    return pa.array(out, pa.list_(pa.float32()))


TAPS = 32  # zero crossings of the resampling kernel on either side


def resampled(samples, rate: int, to: int):
    """Samples at another rate, by a windowed sinc of the lower of the two bandwidths."""
    import numpy as np

    if rate == to or not len(samples):
        return samples
    band = min(1.0, to / rate)
    reach = int(np.ceil(TAPS / band))
    padded = np.concatenate([np.zeros(reach), samples, np.zeros(reach + 1)])
    out = np.empty(-(-len(samples) * to // rate))
    for low in range(0, len(out), 1 << 14):
        at = np.arange(low, min(low + (1 << 14), len(out))) * (rate / to)
        first = np.floor(at).astype(np.int64)
        steps = np.arange(-reach + 1, reach + 1)
        apart = steps[None] - (at - first)[:, None]
        kernel = band * np.sinc(band * apart) * np.cos(np.clip(apart / reach, -1, 1) * (np.pi / 2)) ** 2
        kernel /= kernel.sum(1, keepdims=True)
        out[low : low + len(at)] = (padded[first[:, None] + steps[None] + reach] * kernel).sum(1)
    return out


def wav_16k_of(data: bytes) -> bytes:
    """A WAV of 8 to 32 bits, any rate and channels, as 16 kHz mono of 16 bits."""
    import numpy as np

    rate, channels, width, pcm = pcm_of(data)
    if not (rate and channels and width in (1, 2, 3, 4)):
        raise ValueError("no samples")
    pcm = pcm[: len(pcm) - len(pcm) % (channels * width)]
    if width == 1:
        x = (np.frombuffer(pcm, np.uint8).astype(np.float64) - 128) / 128
    else:
        raw = np.frombuffer(pcm, np.uint8).reshape(-1, width)
        wide = np.zeros((len(raw), 4), np.uint8)
        wide[:, 4 - width :] = raw
        x = wide.view("<i4")[:, 0] / 2.0**31
    mono = resampled(x.reshape(-1, channels).mean(1), rate, 16000)
    return wav_of(16000, 1, 2, (np.clip(mono, -1, 1) * 32767).astype("<i2").tobytes())


@arrow_udf(BinaryType())
def wav_16k_mono(data: pa.Array) -> pa.Array:
    """Audio as 16 kHz mono of 16 bits; null where it can't be read."""
    out = []
    for d in data.to_pylist():
        try:
            out.append(wav_16k_of(d or b""))
        except (ValueError, struct.error):
            out.append(None)
    return pa.array(out, pa.binary())


def _png_fault(data: bytes) -> str | None:
    at, names, packed, size = 8, [], zlib.decompressobj(), 0
    while at + 12 <= len(data):
        n, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(data) or zlib.crc32(name + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            return f"chunk {name!r} is broken"
        if not names:
            if name != b"IHDR" or n != 13:
                return "no header"
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        if name == b"IDAT":
            try:
                size += len(packed.decompress(body))
            except zlib.error as e:
                return str(e)
        names.append(name)
        at += 12 + n
        if name == b"IEND":
            break
    if names[-1:] != [b"IEND"] or not packed.eof:
        return "cut off"
    bits = depth * {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour, 0)
    return None if width and height and bits and (interlaced or size == height * (1 + -(-width * bits // 8))) else "wrong size"


def _jpeg_fault(data: bytes) -> str | None:
    at, framed = 2, False
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return "no marker where one must be"
        code = data[at + 1]
        if code == 0xFF:
            at += 1
            continue
        n = struct.unpack_from(">H", data, at + 2)[0]
        if n < 2 or at + 2 + n > len(data):
            return "cut off"
        framed |= 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC)
        at += 2 + n
        if code == 0xDA:
            return (None if framed else "no frame") if data.rstrip(b"\0").endswith(b"\xff\xd9") and data.rfind(b"\xff\xd9") >= at else "cut off"
    return "cut off"


def image_fault(data: bytes) -> str | None:
    """Why an image can't be read; null if its structure is whole. PNG data are unpacked and checked by their sums, JPEG by its segments
    and end, GIF and WebP by their lengths and ends."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png_fault(data)
    if data[:3] == b"\xff\xd8\xff":
        return _jpeg_fault(data)
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return None if len(data) > 13 and data.rstrip(b"\0").endswith(b";") else "cut off"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return None if len(data) >= 8 + struct.unpack_from("<I", data, 4)[0] else "cut off"
    return "unknown kind"


@arrow_udf(StringType())
def image_problem(data: pa.Array) -> pa.Array:
    return pa.array([None if d is None else image_fault(d) for d in data.to_pylist()], pa.string())


def media_type(data: Column) -> Column:
    """Kind of media by its first bytes."""
    head = F.hex(F.substring(data, F.lit(1), F.lit(12)))
    return (
        F.when(head.startswith("89504E47"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("47494638"), "image/gif")
        .when(head.startswith("52494646") & head.endswith("57415645"), "audio/wav").when(head.startswith("52494646") & head.endswith("57454250"), "image/webp")
        .when(head.startswith("4F676753"), "audio/ogg").otherwise("application/octet-stream")
    )


#: Measured token costs of a model input.
TURN_TOKENS, IMAGE_TOKENS, AUDIO_TOKENS_A_SECOND, DELIMITERS = 6, 266, 25, 2


def token_cost(text_tokens: Column, images: Column, seconds: Column) -> Column:
    """Tokens of one turn with text, images and audio; seconds 0: no audio."""
    audio = F.when(seconds > 0, F.ceil(seconds * AUDIO_TOKENS_A_SECOND) + DELIMITERS).otherwise(0)
    return (text_tokens + images * (IMAGE_TOKENS + DELIMITERS) + audio + TURN_TOKENS).cast("long")
