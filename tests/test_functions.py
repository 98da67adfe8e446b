import hashlib
import html
import io
import json
import re
import struct
import wave

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardloom.functions import arrow as A
from cardloom.functions import text as T
from cardloom.functions import vectors as V
from cardloom.operators import sampling as S

TRICKY = ["a\xa0b", "\x85x\x85", "a\x1cb \x1f", " y ", "ΑΣ end Σ", "İstanbul", "  ", "", "x᠎y", "tab\tnl\nvt\x0b", "ǅ Ǆ"]


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", expression.alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_white_space_and_hashes_as_in_unicode(spark):
    want = [" ".join(x.split()) for x in TRICKY]
    assert column(spark, TRICKY, T.collapse("x")) == want
    assert column(spark, TRICKY, T.dedup_hash("x")) == [hashlib.sha256(re.sub(r"\s+", " ", x.strip().lower()).encode()).hexdigest() for x in TRICKY]


def test_clean_at_its_bounds(spark):
    low, high = 5, 20
    values = ["abcd", "abcde", "x" * 20, "x" * 21, "a" * 14 + " " + "b" * 10, "a" * 15 + " " + "b" * 10, "a" * 13 + " " + "b" * 10, "words " * 9, None]

    def by_rule(s):
        if s is None:
            return None
        s = " ".join(s.split())
        if len(s) < low:
            return None
        if len(s) <= high:
            return s
        cut = s[:high]
        at = cut.rfind(" ")
        return cut[:at] if at > 0.7 * high else cut

    assert column(spark, values, T.clean("x", low, high)) == [by_rule(v) for v in values]


def test_small_parsers(spark):
    assert column(spark, ["a: b : c", "none", ": ", None], T.after("x", ": ")) == ["b : c", None, "", None]
    assert column(spark, ["hELLO wORLD", "", "é"], T.capitalized("x")) == ["Hello world", "", "É"]
    assert column(spark, ["Is it?\nAnswer in one word", "Is it?\nAnswer it\nnow", "respond"], T.without_boilerplate("x")) == ["Is it?", "Is it?\nAnswer it\nnow", "respond"]
    answers = ['Sure: ["first query here", 5, "short", " spaced   out query "] ok', "nothing", "[broken", '["one two three", "four five six", "seven eight"]', None]
    assert column(spark, answers, T.json_queries("x", 2)) == [["first query here", "spaced out query"], [], [], ["one two three", "four five six"], []]
    assert column(spark, ["x/by-nc/3", "", None], T.rights_tier("x")["tier"]) == ["research_only", "source_audit_required", "source_audit_required"]
    assert column(spark, ["a"], T.item_id(F.lit("text"), F.col("x"), F.lit(None).cast("string"))) == [hashlib.sha256(b"text||a").hexdigest()[:32]]


def test_first_letters_as_in_sql(spark):
    """Letters that the full mapping makes several of, such as sharp s, stay one letter."""
    import duckdb

    letters = [c for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x10000)]) if len(c.upper()) > 1]
    values = ["ßheit und", "ﬁsch", *[c + "X" for c in letters], None]
    want = duckdb.execute("SELECT upper(left(x, 1)) || lower(substr(x, 2)) FROM (SELECT unnest(?) AS x)", [values]).fetchall()
    assert column(spark, values, T.capitalized("x")) == [r[0] for r in want] and want[0][0] == "ẞheit und"


def test_numbers_of_hashes(spark):
    keys = [f"k{i}" for i in range(200)]
    for modulus in (100, 10_000, 1_000_000):
        assert column(spark, keys, S.sha1_modulo(F.col("x"), modulus)) == [int(hashlib.sha1(k.encode()).hexdigest(), 16) % modulus for k in keys]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 5, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist()) for i in range(5)], "i int, a array<float>, b array<float>")
    got = sorted(df.select("i", V.dot("a", "b").alias("d"), V.cosine("a", "b").alias("c"), V.prefix("a", 4).alias("p"), V.normalized("a", 1e-8).alias("u"), V.mean_pool(F.array("a", "b")).alias("m"), V.last_token(F.array("a", "b", "a"), F.array(F.lit(0), F.lit(1), F.lit(0))).alias("l")).collect())
    for r in got:
        x, y = a[r.i].astype(float), b[r.i].astype(float)
        assert r.d == pytest.approx(x @ y) and r.c == pytest.approx(x @ y / np.linalg.norm(x) / np.linalg.norm(y))
        assert np.allclose(r.p, x[:4] / np.linalg.norm(x[:4])) and np.allclose(r.u, x / np.linalg.norm(x)) and np.allclose(r.m, (x + y) / 2) and np.allclose(r.l, y)


@given(st.lists(st.sampled_from("a b c d".split()), max_size=7), st.lists(st.sampled_from("a b c d".split()), max_size=7))
def test_word_errors(ref, heard):
    def distance(x, y):
        if not x or not y:
            return len(x) + len(y)
        return min(distance(x[1:], y) + 1, distance(x, y[1:]) + 1, distance(x[1:], y[1:]) + (x[0] != y[0]))

    if ref:
        assert A.word_error_rate(" ".join(ref), " ".join(heard)) == distance(ref[:5], heard[:5]) / len(ref) or len(ref) > 5 or len(heard) > 5


def test_word_error_rate_of_columns(spark):
    rows = [("The cat, sat.", "the cat sat"), ("well-known fact", "well known fact"), ("one two", "one"), (None, "x"), ("", "x y")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    assert [r.w for r in df.select("i", A.wer("a", "b").alias("w")).sort("i").collect()] == [0.0, 0.0, 0.5, None, 2.0]


def wav(rate=16000, seconds=0.01, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.arange(int(rate * seconds) * channels, dtype="<i2").tobytes())
    return out.getvalue()


def test_wav(spark):
    good = wav()
    huge = good[:4] + b"\xff" * 4 + good[8:40] + b"\xff" * 4 + good[44:]
    extra = good[:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + good[12:]
    rows = [("good", good), ("huge", huge), ("extra", extra), ("slow", wav(8000)), ("two", wav(channels=2)), ("none", b"RIFF"), ("null", None), ("cut", good[:30])]
    df = spark.createDataFrame(rows, "name string, data binary")
    got = {r.name: r for r in df.select("name", A.wav_info("data").alias("i"), A.wav_repaired("data").alias("fixed"), A.wav_samples("data").alias("s"), A.media_type(F.col("data")).alias("t")).collect()}
    for n in ("good", "huge", "extra"):
        assert bytes(got[n].fixed) == good and got[n].i.seconds == pytest.approx(0.01) and got[n].s[:3] == pytest.approx([0, 1 / 32768, 2 / 32768])
    assert got["slow"].i.rate == 8000 and got["slow"].s is None and got["two"].i.channels == 2 and got["two"].s is None
    assert all(got[n].fixed is None and got[n].i.error for n in ("none", "null", "cut")) and got["good"].t == "audio/wav"


def test_entities(spark):
    values = ["&amp;&eacute;&#39;&nbsp;x", "a<b>&", None, ""]
    assert column(spark, values, A.html_unescape("x")) == [None if v is None else html.unescape(v) for v in values]
    assert column(spark, values, A.html_escape("x")) == [None if v is None else html.escape(v) for v in values]
    assert json.dumps(column(spark, ["x"], A.token_cost(F.lit(10), F.lit(1), F.lit(1.5)))) == "[324]"


def tone_file(rate, samples, channels=1, width=2):
    scaled = np.repeat(np.round(samples * (2 ** (8 * width - 1) - 1)).astype(np.int64), channels)
    raw = (scaled + 128).astype(np.uint8).tobytes() if width == 1 else b"".join(int(x).to_bytes(width, "little", signed=True) for x in scaled)
    return A.wav_of(rate, channels, width, raw)


@pytest.mark.parametrize(("rate", "channels", "width"), [(16000, 1, 2), (8000, 2, 2), (44100, 2, 3), (48000, 1, 4), (22050, 1, 1)])
def test_audio_at_16k(rate, channels, width):
    """A tone keeps its pitch and height; one above half the new rate goes."""
    t = np.arange(rate // 2) / rate
    tone, high = 0.5 * np.sin(2 * np.pi * 440 * t), 0.3 * np.sin(2 * np.pi * 10000 * t) * (rate > 32000)
    got_rate, got_channels, got_width, pcm = A.pcm_of(A.wav_16k_of(tone_file(rate, tone + high, channels, width)))
    got = np.frombuffer(pcm, "<i2") / 32767
    want = 0.5 * np.sin(2 * np.pi * 440 * np.arange(len(got)) / 16000)
    assert (got_rate, got_channels, got_width, len(got)) == (16000, 1, 2, 8000)
    assert np.abs(got - want)[300:-300].max() < 0.02


def test_broken_images():
    import struct
    import zlib

    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    head, body, end = chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)), chunk(b"IDAT", zlib.compress(bytes(20))), chunk(b"IEND", b"")
    png = b"\x89PNG\r\n\x1a\n" + head + body + end
    assert A.image_fault(png) is None and A.image_fault(png[:-1]) and A.image_fault(png[:8] + head + end) and A.image_fault(png[:50] + b"x" + png[51:])
    assert A.image_fault(png[:8] + head + chunk(b"IDAT", zlib.compress(bytes(19))) + end) == "wrong size"
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\4cd\xff\xda\0\4ef" + b"scan" + b"\xff\xd9"
    assert A.image_fault(jpeg) is None and A.image_fault(jpeg[:-1]) and A.image_fault(jpeg[:12]) and A.image_fault(jpeg.replace(b"\xff\xc0", b"\xff\xc4")) == "no frame"
    webp = b"RIFF" + struct.pack("<I", 8) + b"WEBPVP8 "
    assert A.image_fault(webp) is None and A.image_fault(webp[:-1]) and A.image_fault(b"GIF89a" + bytes(10) + b";") is None and A.image_fault(b"GIF89a") and A.image_fault(b"text")
