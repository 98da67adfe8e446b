import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from cardloom.llm import bpe as B

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ALPHABET = "abc dEé'sn’t\t\n\r\x1c\x85\xa0　½²Ⅷ漢字🙂👩‍👩‍👧 123_-.!?ßhtienr"


@pytest.fixture(scope="module")
def ranks():
    return B.load_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_is_the_librarys(ranks, library):
    encoder, rng = B.Encoder(ranks, PATTERN), random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60)))
        assert encoder.ids(t).tolist() == library.encode_ordinary(t)


def test_every_code_point_beside_others(ranks, library):
    """Letters and digits are the library's: each code point before and behind a letter, a digit, a mark and a space."""
    encoder = B.Encoder(ranks, PATTERN)
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    for low in range(0, len(every), 512):
        for frame in ("\u97b8{0}\u8d65 {0}a{0}7{0}!{0} ",):
            t = "".join(frame.format(c) for c in every[low : low + 512])
            assert encoder.ids(t).tolist() == library.encode_ordinary(t)


def test_random_strings_of_all_planes(ranks, library):
    encoder, rng = B.Encoder(ranks, PATTERN), random.Random(5)
    near = [0x10EDA, 0x97B8, 0x1E6C8, 0x8D65, *map(ord, ALPHABET)]
    for _ in range(100_000):
        t = "".join(chr(c) for c in (rng.choice(near) if rng.random() < 0.7 else rng.randrange(0xE000, 0x20000) for _ in range(rng.randrange(9))))
        assert encoder.ids(t).tolist() == library.encode_ordinary(t)


def test_transducer_is_merging(ranks):
    fst, rng = B.Transducer(ranks, most_states=200, most_pairs=200), random.Random(2)
    for _ in range(600):
        piece = bytes(rng.choice(b"aehinorst \xc3\xa9") for _ in range(rng.randrange(1, 120)))
        assert [t for part in fst.stream(piece) for t in part] == [ranks[p] for p in B.merged(piece, ranks)]


def test_tokens_come_out_early(ranks):
    fst, data, before = B.Transducer(ranks), b"thequickbrownfox" * 200, 0
    it = iter(data)
    most = max(map(len, ranks))

    class Watched(bytes):
        def __iter__(self):
            for n, b in enumerate(it, 1):
                self.n = n
                yield b

    w = Watched(data)
    for part in fst.stream(w):
        before += sum(len(fst.token[t]) for t in part)
        assert w.n - before <= 2 * most or w.n >= len(data) - B.TAIL


@pytest.mark.parametrize("seed", range(3))
def test_decoding_in_portions(ranks, library, seed):
    decoder, rng = B.Decoder(ranks), random.Random(seed)
    for _ in range(300):
        t = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(50)))
        ids, out, at = library.encode_ordinary(t), "", 0
        while at < len(ids):
            n = rng.randrange(1, 4)
            out += decoder.feed(np.array(ids[at : at + n], np.int64))
            at += n
        assert out + decoder.finish() == t


def test_broken_bytes_are_replaced(ranks):
    decoder = B.Decoder(ranks)
    for raw in (b"\xe6\xbc", b"a\xffb", b"\xf0\x9f\x99", b"\xc3(", b"\xed\xa0\x80", b"\xe6\xbcx\xe6"):
        ids = np.array([ranks[bytes([b])] for b in raw])
        assert decoder.feed(ids) + decoder.finish() == raw.decode("utf-8", "replace")


def test_table(awkward, empty, library):
    rows = B.round_trip(awkward, PATH, PATTERN, keep_ids=True).collect()
    assert not B.round_trip(empty, PATH, PATTERN).count()
    want = sorted((str(library.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in awkward.collect())
    assert sorted((str(r.ids), r.decoded_sha256) for r in rows) == want
    assert all(r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() and r.n_tokens == len(r.ids) for r in rows)
