"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

The encoding of a byte string is the only chain of tokens in which every two neighbours are stable (merging the
bytes of both gives the two back) and every token is its own encoding. A transducer that guesses the next token
reads its bytes along a trie; determinising it keeps, for a prefix read so far, every guess that is still open:
a path of tokens from the last settled boundary and a trie node. One of them always stands at a boundary: the
encoding of the prefix itself. What all open guesses share is settled and is emitted, so a token is out once its
rivals have died, at most the longest token's length later. States and transitions are made when first met and
kept in a table of bounded size; when it is full, transitions that are missing are made anew each time.

A piece that is a token as a whole is emitted as such, as rank-based encoders do. Texts are split into pieces by the letters and digits
of the tiktoken library, asked of it at the start. Most pieces are met again, so pieces of up to TAIL bytes are remembered with their
ids; one that is met for the first time, or leaves the states made so far, follows all open guesses without making states for them:
a state that no other piece comes through costs more than it saves. Ids are the same both ways.
Null and empty texts have no ids. Rows are handled one by one; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

ROOT = 0
UNRANKED = 1 << 62
TAIL = 64  # bytes that may be read without settling tokens


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """BPE by definition: join the neighbours of least rank, leftmost first, until none can be joined."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    rank = [ranks.get(a + b, UNRANKED) for a, b in zip(parts, parts[1:], strict=False)]
    while rank:
        best = min(rank)
        if best == UNRANKED:
            break
        i = rank.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del rank[i]
        if i:
            rank[i - 1] = ranks.get(parts[i - 1] + parts[i], UNRANKED)
        if i < len(rank):
            rank[i] = ranks.get(parts[i] + parts[i + 1], UNRANKED)
    return parts


def stands(left: bytes, right: bytes, ranks: dict[bytes, int]) -> bool:
    """merged(left + right) == [left, right], given up at the first merge that crosses the boundary."""
    parts = [left[i : i + 1] for i in range(len(left))] + [right[i : i + 1] for i in range(len(right))]
    rank = [ranks.get(a + b, UNRANKED) for a, b in zip(parts, parts[1:], strict=False)]
    border = len(left) - 1
    while True:
        best = min(rank)
        i = rank.index(best)
        if best == UNRANKED or i == border:
            return best == UNRANKED and len(parts) == 2
        if i < border:
            border -= 1
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del rank[i]
        if i:
            rank[i - 1] = ranks.get(parts[i - 1] + parts[i], UNRANKED)
        if i < len(rank):
            rank[i] = ranks.get(parts[i] + parts[i + 1], UNRANKED)


class State:
    __slots__ = ("guesses", "moves", "rest", "root")

    def __init__(self, root: int, guesses: tuple):
        self.root, self.guesses = root, guesses  # the last settled token, (path, trie node) of each open guess
        self.moves: dict[int, tuple[tuple, State]] = {}
        self.rest = guesses[-1][0]  # tokens to emit if the input ends here


class Transducer:
    def __init__(self, ranks: dict[bytes, int], most_states: int = 200_000, most_pairs: int = 600_000):
        self.ranks, self.most_states, self.most_pairs = ranks, most_states, most_pairs
        self.token = {i: t for t, i in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for t, i in ranks.items():
            node = ROOT
            for b in t:
                nxt = self.child[node].get(b)
                if nxt is None:
                    nxt = self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = i
        self.pairs: dict[int, bool] = {}
        self.states: dict[tuple, State] = {}
        self.start = self._state(-1, (((), ROOT),))

    def _state(self, root: int, guesses: tuple) -> State:
        key = (root, guesses)
        s = self.states.get(key)
        if s is None:
            s = State(root, guesses)
            if len(self.states) < self.most_states:
                self.states[key] = s
        return s

    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens come out again when their bytes are encoded together; left -1: whether right does."""
        known = self.pairs.get(left << 20 | right)
        if known is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            if left < 0:
                known = merged(self.token[right], self.ranks) == [self.token[right]]
            else:
                known = stands(self.token[left], self.token[right], self.ranks)
            self.pairs[left << 20 | right] = known
        return known

    def move(self, state: State, byte: int) -> tuple[tuple, State]:
        """The transition: tokens that it settles, and the next state."""
        child, ends, pairs, root = self.child, self.ends, self.pairs, state.root
        guesses, here = [], None
        for path, node in state.guesses:
            node = child[node].get(byte)
            if node is None:
                continue
            left = path[-1] if path else root
            if here is None and (token := ends[node]) >= 0:
                known = pairs.get(left << 20 | token)
                if known or known is None and self.stable(left, token):
                    here = (*path, token)
            if child[node]:
                guesses.append((path, node))
        if here is None:
            raise ValueError(f"byte {byte} is no token")
        guesses.append((here, ROOT))
        first = guesses[0][0]  # guesses stand in the order of their starts, so the first path is the shortest
        for path, _ in guesses:
            if not first:
                break
            while path[: len(first)] != first:
                first = first[:-1]
        if first:
            n = len(first)
            nxt = self._state(first[-1], tuple([(path[n:], node) for path, node in guesses]))
        else:
            nxt = self._state(root, tuple(guesses))
        if len(self.states) < self.most_states:
            state.moves[byte] = (first, nxt)
        return first, nxt

    def stream(self, data: bytes) -> Iterator[tuple | list]:
        """Tokens of one piece, some at a time, as they are settled. Where a transition is missing, it is made; the rest of
        a short piece is then read without making more, so that states are made only on ways that are used."""
        state, full = self.start, len(self.states) >= self.most_states
        for i, b in enumerate(data):
            step = state.moves.get(b)
            if step:
                out, state = step
                if out:
                    yield out
                continue
            if len(data) - i > TAIL:
                out, state = self.move(state, b)
                if out:
                    yield out
                continue
            if not full:
                out, state = self.move(state, b)
                if out:
                    yield out
                i += 1  # noqa: PLW2901
            yield self.tail(state, data[i:])
            return
        yield state.rest

    def tail(self, state: State, data: bytes) -> list[int]:
        """What is left to emit after the state, if these are the last bytes: all guesses are followed to the end."""
        child, ends, pairs = self.child, self.ends, self.pairs
        guesses = []
        for path, node in state.guesses:
            chain, last = None, state.root
            for token in path:
                chain, last = (chain, token), token
            guesses.append((chain, last, node))
        for b in data:
            open_, here = [], None
            for chain, last, node in guesses:
                node = child[node].get(b)
                if node is None:
                    continue
                if here is None and (token := ends[node]) >= 0:
                    known = pairs.get(last << 20 | token)
                    if known or known is None and self.stable(last, token):
                        here = ((chain, token), token, ROOT)
                if child[node]:
                    open_.append((chain, last, node))
            if here is None:
                raise ValueError(f"byte {b} is no token")
            open_.append(here)
            guesses = open_
        chain, out = guesses[-1][0], []
        while chain:
            chain, token = chain
            out.append(token)
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        for settled in self.stream(piece):
            out += settled
        return out


def letter_class(name: str) -> list[tuple[int, int]]:
    """Ranges of code points that the tiktoken library takes for a class such as \\p{L}: its Unicode tables are not those of other
    libraries. Told by its own splitter, whose unmatched text has no ids."""
    import tiktoken

    probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    return _ranges(sorted(set(map(ord, bytes(probe.encode_ordinary(every)).decode()))))


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for p in points:
        if out and out[-1][1] + 1 == p:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(a, b) for a, b in out]


def _written(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@lru_cache(2)
def splitters(pattern: str) -> tuple[Callable, Callable, Callable]:
    """Pieces of a text, as the library splits it: of an ASCII text, of another, and whether that other holds a code point of which the
    libraries' tables differ; then the pieces come from the class written out."""
    import regex

    exact, plain, odd = pattern, pattern, set()
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for name in ("\\p{L}", "\\p{N}", "\\s"):
        ranges = letter_class(name)
        said = _written(ranges)
        odd ^= {p for a, b in ranges for p in range(a, b + 1)} ^ set(map(ord, regex.findall(name, every)))
        inside = re.compile(r"(\[[^\]]*)" + re.escape(name))
        while inside.search(exact):
            exact = inside.sub(lambda m, said=said: m[1] + said, exact, count=1)
        exact = exact.replace(name, f"[{said}]")
        if name == "\\s":
            exact = exact.replace("\\S", f"[^{said}]")
            plain = plain.replace("[^\\s", "[^" + said).replace("\\S", f"[^{said}]").replace("\\s", f"[{said}]")
    slow, fast = re.compile(exact).findall, regex.compile(plain).findall
    strange = re.compile(f"[{_written(_ranges(sorted(odd)))}]").search if odd else lambda text: None
    simple = pattern.replace("[^\\s", "[^\\t-\\r ").replace("\\S", "[^\\t-\\r ]").replace("\\s", "[\\t-\\r ]").replace("[^\\t-\\r \\p{L}\\p{N}]", "[^\\t-\\r A-Za-z0-9]").replace("\\p{L}", "[A-Za-z]").replace("\\p{N}", "[0-9]")
    return fast if "\\p" in simple else re.compile(simple).findall, lambda text: (slow if strange(text) else fast)(text), strange


class Encoder:
    """Texts to ids. Words are kept with their ids; the memory is emptied when it is full."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_words: int = 1_500_000):
        self.fst, self.most_words = Transducer(ranks), most_words
        self.split_ascii, self.split, _ = splitters(pattern)
        self.words: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        pieces = (self.split_ascii if text.isascii() else self.split)(text)
        known = self.words.get
        found = list(map(known, pieces))
        if None in found:
            if len(self.words) > self.most_words:
                self.words.clear()
            for at in [i for i, f in enumerate(found) if f is None]:
                found[at] = known(pieces[at]) or self._learn(pieces[at])
        return np.frombuffer(b"".join(found), "<u4")

    def _learn(self, word: str) -> bytes:
        raw = word.encode()
        got = np.array(self.fst.encode_piece(raw), "<u4").tobytes()
        if len(raw) <= 64:
            self.words[word] = got
        return got


def utf8_machine() -> list[list[int]]:
    """next[state][byte] of the well-formed UTF-8 sequences; 0: between characters, -1: error. States: 1 to 3 more
    plain continuation bytes; 4 to 7 restrict the byte after E0, ED, F0, F4."""
    table = [[-1] * 256 for _ in range(8)]

    def put(state: int, low: int, high: int, to: int) -> None:
        for b in range(low, high + 1):
            table[state][b] = to

    for spec in ((0, 0, 0x7F, 0), (0, 0xC2, 0xDF, 1), (0, 0xE0, 0xE0, 4), (0, 0xE1, 0xEC, 2), (0, 0xED, 0xED, 5), (0, 0xEE, 0xEF, 2), (0, 0xF0, 0xF0, 6), (0, 0xF1, 0xF3, 3), (0, 0xF4, 0xF4, 7), (1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        put(*spec)
    return table


UTF8 = utf8_machine()


class Decoder:
    """Ids to text, in any portions: `feed` returns the characters that are whole, `finish` what is left.
    Bytes that begin no character come out as U+FFFD, one for each sequence that breaks off."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.token[i] = t
        self.whole = np.array([self._run(0, t) == 0 for t in self.token])
        self.reset()

    @staticmethod
    def _run(state: int, data: bytes) -> int:
        for b in data:
            state = UTF8[state][b]
            if state < 0:
                return -1
        return state

    def reset(self) -> None:
        self.state, self.held = 0, b""

    def feed(self, ids: np.ndarray) -> str:
        out: list[str] = []
        hard = np.flatnonzero(~self.whole[ids]).tolist()
        tokens = list(map(self.token.__getitem__, ids.tolist()))
        at = 0
        for i in hard:
            if i > at or self.held:
                out.append(self._take(b"".join(tokens[at:i])))
            out.append(self._bytes(tokens[i]))
            at = i + 1
        out.append(self._take(b"".join(tokens[at:])))
        return "".join(out)

    def _take(self, plain: bytes) -> str:
        if not plain:
            return ""
        lost = "�" if self.state else ""
        self.state, self.held = 0, b""
        return lost + plain.decode()

    def _bytes(self, data: bytes) -> str:
        out = []
        for i in range(len(data)):
            b = data[i : i + 1]
            state = UTF8[self.state][b[0]]
            if state < 0:
                out.append("�" * bool(self.held))
                self.held, state = b"", UTF8[0][b[0]]
                if state < 0:
                    out.append("�")
                    self.held, self.state = b"", 0
                    continue
            else:
                self.held += b
            if state == 0:
                out.append(self.held.decode())
                self.held = b""
            self.state = state
        return "".join(out)

    def finish(self) -> str:
        lost = "�" * bool(self.held)
        self.reset()
        return lost


@lru_cache(2)
def coders(ranks_path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """One pair for each Python worker, which keeps its tables from task to task."""
    ranks = load_ranks(ranks_path)
    return Encoder(ranks, pattern), Decoder(ranks)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Each text's number of ids, the SHA-256 of the decimal ids and that of the decoded bytes; with keep_ids the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coders(ranks_path, pattern)
        decoder.reset()
        decimal = [b"%d " % i for i in range(len(decoder.token))].__getitem__
        for batch in batches:
            for some in slices(batch):
                rows = []
                for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    ids = encoder.ids(text or "")
                    said = b"".join(map(decimal, ids.tolist()))[:-1]
                    back = decoder.feed(ids) + decoder.finish()
                    row = (doc_id, len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
                    rows.append((*row, ids.tolist()) if keep_ids else row)
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
