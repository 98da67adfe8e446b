import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cardloom.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_those_of_the_library():
    own, ours = Tokenizer.from_file(PATH), P.Encoder(PATH)
    rng = random.Random(1)
    texts = ["", "It's <|endoftext|> here", "a" * 3000] + ["".join(rng.choice("aé'sT 漢🙂\n\t 12½_-") for _ in range(rng.randrange(60))) for _ in range(300)]
    for t in texts:
        assert ours.ids(t).tolist() == own.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("most_open", [1, 4, 32])
def test_windows_keep_every_id(most_open):
    rng, bins, done = random.Random(2), P.Windows(64, most_open, 4), []
    docs = {i: np.arange(rng.randrange(1, 300), dtype=np.uint32) + 1000 * i for i in range(200)}
    for i, ids in docs.items():
        done += bins.put((i, 0, ids, len(ids)))
        assert len(bins.open) <= most_open
    left = bins.close()
    done += P.merge([p for w in left for p in w], 64)
    got = {}
    for w in done:
        assert 0 < sum(len(p[2]) for p in w) <= 64
        for i, start, ids, _ in w:
            got.setdefault(i, []).append((start, ids))
    for i, ids in docs.items():
        parts = sorted(got[i], key=lambda p: p[0])
        assert np.array_equal(np.concatenate([p[1] for p in parts]), ids)
        assert [p[0] for p in parts] == np.cumsum([0] + [len(p[1]) for p in parts[:-1]]).tolist()
    assert sum(64 - sum(len(p[2]) for p in w) for w in done) <= 3 * len(done) + 64


def test_table(awkward, empty):
    rows = P.pack(awkward, PATH, keep_ids=True).collect()
    assert not P.pack(empty, PATH).count()
    own = Tokenizer.from_file(PATH)
    want = sorted([*own.encode(r.text or "", add_special_tokens=False).ids, 1] for r in awkward.collect())
    windows, docs = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == np.cumsum([0] + [n for _, n in w[:-1]]).tolist() and sum(n for _, n in w) <= 2048
    assert sum(r.length for r in rows) == sum(map(len, want))
    for r in awkward.where("doc_id <> 5 or doc_id is null").collect():
        parts = sorted(docs[r.doc_id], key=lambda p: p.start)
        ids = np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist()
        assert ids in want and len(ids) == parts[0].doc_tokens
