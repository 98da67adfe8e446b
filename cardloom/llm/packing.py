"""Bounded-space online packing of token sequences.

Each partition reads its documents once. It keeps a fixed number of open windows; a piece goes to the open
window that it fills best (best fit). If none has room, the fullest window is emitted: a gap worth a cut is
filled with the head of the piece, a smaller one stays as padding. Pieces longer than a window are cut into whole
windows first. At the end of a partition its open windows are its leftovers; the leftovers of FAN_IN partitions
are merged, and there every gap is filled, so at most one window of such a group is not full.

Null text counts as empty; an empty document is the end id alone. Repeated rows are packed as often as they occur.
Only doc_id and text are read. An empty table gives an empty table. Very long texts are encoded in whole but only
their ids (4 bytes each) are held; memory otherwise is the open windows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

WINDOW, OPEN, MIN_CUT, FAN_IN = 2048, 32, 16, 8
END_ID = 1


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file. The merges run in tiktoken on the same
    ranks, which is several times faster; a text that holds an added token's string goes to tokenizers itself."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        self.own = Tokenizer.from_file(path)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.same = model["type"] == "BPE" and not spec.get("normalizer") and not model.get("ignore_merges") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if self.same:
            as_byte = byte_of_char()
            ranks = {bytes(as_byte[c] for c in t): i for t, i in model["vocab"].items() if t not in self.added}
            pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value: the pre-tokenizer's split
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.same and not any(a in text for a in self.added):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.asarray(self.own.encode(text, add_special_tokens=False).ids, np.uint32)


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes: printable Latin-1 stands for itself,
    the others follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Windows:
    """Open windows of one partition or merge group. `put` and `close` return finished windows: lists of pieces
    (doc_id, start, ids, doc_tokens) in their order."""

    def __init__(self, window: int, most_open: float, min_cut: int):
        self.window, self.most_open, self.min_cut = window, most_open, min_cut
        self.open: list[tuple[int, list]] = []  # (free, pieces)

    def put(self, piece: tuple) -> Iterator[list]:
        doc_id, start, ids, total = piece
        while len(ids) >= self.window:
            yield [(doc_id, start, ids[: self.window], total)]
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            n = len(ids)
            best = min((i for i, (free, _) in enumerate(self.open) if free >= n), key=lambda i: self.open[i][0], default=None)
            if best is not None:
                free, pieces = self.open[best]
                pieces.append((doc_id, start, ids, total))
                self.open[best] = (free - n, pieces)
                if free == n:
                    yield self.open.pop(best)[1]
                return
            if len(self.open) < self.most_open:
                self.open.append((self.window - n, [(doc_id, start, ids, total)]))
                return
            free, pieces = self.open.pop(min(range(len(self.open)), key=lambda i: self.open[i][0]))
            if free >= self.min_cut:
                pieces.append((doc_id, start, ids[:free], total))
                start, ids = start + free, ids[free:]
            yield pieces

    def close(self) -> list[list]:
        left, self.open = [p for _, p in self.open], []
        return left


def _order(piece: tuple) -> tuple:
    return -len(piece[2]), piece[0] is None, piece[0] or 0, piece[1]


def merge(pieces: list[tuple], window: int) -> list[list]:
    """Leftovers of several partitions into few windows: longest first, best fit; a piece that fits nowhere fills
    the fullest window and goes on."""
    size = sum(len(p[2]) for p in pieces)
    bins = Windows(window, max(1, size // window), 1)
    out = []
    for p in sorted(pieces, key=_order):
        out += bins.put(p)
    rest = [p for w in bins.close() for p in w]
    tail = Windows(window, 1, 1)
    for p in sorted(rest, key=_order):
        out += tail.put(p)
    return out + tail.close()


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _rows(windows: list[tuple[int, list]], with_ids: bool) -> dict[str, list]:
    out: dict[str, list] = {c.split()[0]: [] for c in PIECES.split(", ")} | {"ids": []}
    for sequence, pieces in windows:
        at = 0
        for doc_id, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            for k, v in zip(out, (doc_id, start, len(ids), zlib.crc32(raw), total, sequence, at, raw if with_ids else None), strict=True):
                out[k].append(v)
            at += len(ids)
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, most_open: int = OPEN, min_cut: int = MIN_CUT, fan_in: int = FAN_IN, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents: PIECES, and with keep_ids the ids as little-endian 32-bit binary. A sequence_id is
    (partition, window) for windows packed in one go, and has bit 62 set for merged ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, bins, made = Encoder(tokenizer), Windows(window, most_open, min_cut), 0

        def batch_of(windows: list[list], left: bool) -> pa.RecordBatch:
            nonlocal made
            numbered = [((part << 32) + made + i, w) for i, w in enumerate(windows)]
            made += len(windows)
            cols = _rows(numbered, keep_ids or left)
            n = len(cols["doc_id"])
            arrays = [pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in cols.items()]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([part // fan_in if left else None] * n, pa.int64())], [*cols, "merge_group"])

        for batch in batches:
            for some in slices(batch):
                done: list[list] = []
                for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    ids = np.append(encoder.ids(text or ""), np.uint32(end_id)).astype(np.uint32)
                    done += bins.put((doc_id, 0, ids, len(ids)))
                yield batch_of(done, False)
        yield batch_of(bins.close(), True)

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        pieces = [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]) for r in table.to_pylist()]
        base = (1 << 62) + (key[0].as_py() << 32)
        cols = _rows([(base + i, w) for i, w in enumerate(merge(pieces, window))], keep_ids)
        return pa.table({k: pa.array(cols[k], pa.binary() if k == "ids" else pa.int64()) for k in names})

    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * keep_ids
    schema = PIECES + ", ids binary"
    local = written(docs.select("doc_id", "text").mapInArrow(run, schema + ", merge_group long"), "packing")
    left = local.where(F.col("merge_group").isNotNull()).groupBy("merge_group").applyInArrow(merged, PIECES + ", ids binary" * keep_ids)
    return local.where(F.col("merge_group").isNull()).select(*names).unionByName(left)
