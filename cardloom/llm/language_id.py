"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1 bits. For each bit a binary n-gram classifier (naive Bayes over byte
2-grams and hashed byte 3-grams of the lower-cased text, digits and punctuation as spaces) tells the languages with
+1 from those with -1; its margin is the mean log odds over the whole text, in units of how far the classifier
holds the two sides apart. Decoding adds up a loss for each bit, weighted by that separation, and takes the
codeword with the least; the softmax of the losses is the score, and a document whose best two are close is
flagged ambiguous. A text of EVIDENCE characters or more, fewer than LEAST_KNOWN of whose 3-grams occur in any of the languages as
learned, is in none of them: of such n-grams the classifiers know nothing, so the nearest codeword is as good as any.

Learning reads labelled rows only: about SAMPLE documents of each language, drawn by a hash of doc_id and text
(a fraction for each language, so it is one pass without a sort). Counts are summed by Spark; the driver gets at
most N_FEATURES counts a language.

Null texts and texts without a letter are `und` with score 0. A text that is very long is read in blocks. Ties
between codewords go to the language that sorts first. Rows with null lang teach nothing; null doc_ids count as
held in. Only doc_id, text and lang are read; an empty table gives an empty table, and if nothing can be learned
all rows are `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

SAMPLE = 2000
HASH_BITS = 16
N_FEATURES = 2 << HASH_BITS
MOST_EXHAUSTIVE = 5
BLOCK = 1 << 18
SHARPNESS = 4.0
CLOSE = 0.2  # score of the best over the second best below which a document is ambiguous
SMOOTH = 0.5
LEAST_KNOWN, EVIDENCE, LEARNED = 0.6, 100, 100_000  # share of 3-grams, characters, 3-grams learned below which none is unknown
RARE = 5e-6  # share of all 3-grams learned below which one is unknown, so that one document alone teaches nothing
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all splits into two sides for few languages, else a fixed dense random code in which
    every column splits the languages and every two rows differ in many bits."""
    if n <= MOST_EXHAUSTIVE:
        columns = [(1, *rest) for rest in product((1, -1), repeat=max(n - 1, 0)) if -1 in rest]
        return np.array(columns, np.int8).T.reshape(n, -1)
    rng, bits, best, apart = np.random.default_rng(n), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice(np.array([1, -1], np.int8), (n, bits))
        if (abs(code.sum(0)) == n).any():
            continue
        least = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
        if least > apart:
            best, apart = code, least
    return best


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of the 2-gram and the 3-gram that begin at each byte but the last two."""
    x = _FOLD[data].astype(np.uint32)
    two = (x[:-1] << np.uint32(8)) | x[1:]
    three = ((two[:-1] << np.uint32(8)) | x[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - HASH_BITS)
    return two[:-1], three + np.uint32(1 << HASH_BITS)


def framed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, each behind two spaces, so that its n-grams see no other text, and where each begins (at its spaces)."""
    data = np.frombuffer(b"  " + b"  ".join(texts) + b"  ", np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])]).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # N_FEATURES x bits, in units of the bit's separation; and a column of the 3-grams that are known
    trust: np.ndarray
    learned: float = LEARNED  # 3-grams read

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text: mean weight of its n-grams, and the share of 3-grams that are known."""
        out = np.zeros((len(texts), self.weights.shape[1]))
        data, starts = framed(texts)
        lengths = np.diff(starts)
        for low in range(0, int(starts[-1]), BLOCK):
            high = min(low + BLOCK, int(starts[-1]))
            two, three = grams(data[low : high + 2])
            each = self.weights[two]
            each += self.weights[three]
            first = int(np.searchsorted(starts, low, "right")) - 1
            last = int(np.searchsorted(starts, high, "left"))
            out[first:last] += np.add.reduceat(each, np.maximum(starts[first:last] - low, 0), axis=0)
        return out / lengths[:, None]

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score, the second best's, and the share of known 3-grams."""
        z = np.clip(margins[:, None, :-1] * self.code[None], -4, 4)
        loss = (np.log1p(np.exp(-2 * z)) * self.trust).sum(2) / self.trust.sum()
        p = np.exp(-SHARPNESS * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        at = np.arange(len(p))
        top = p[at, best]
        p[at, best] = 0
        return best, top, p.max(1), margins[:, -1]


def fitted(counts: dict[str, np.ndarray]) -> Model | None:
    """counts: of each feature, by language."""
    langs = sorted(k for k, v in counts.items() if v.sum())
    if not langs:
        return None
    halves = (slice(0, 1 << HASH_BITS), slice(1 << HASH_BITS, N_FEATURES))
    p = np.zeros((len(langs), N_FEATURES))
    for i, k in enumerate(langs):
        for h in halves:
            c = counts[k][h] + SMOOTH
            p[i, h] = c / c.sum()
    code = codewords(len(langs))
    if not code.size:
        code = np.ones((1, 1), np.int8)
    weights, trust = np.zeros((N_FEATURES, code.shape[1] + 1)), np.ones(code.shape[1])
    read = sum(counts[k][halves[1]] for k in langs)
    weights[halves[1], -1] = read > RARE * read.sum()
    if len(langs) == 1:
        return Model(langs, code, weights.astype(np.float32), trust, read.sum())
    for b, bits in enumerate(code.T):
        w = np.log(p[bits > 0].mean(0)) - np.log(p[bits < 0].mean(0))
        means = p @ w
        low, high = means[bits > 0].min(), means[bits < 0].max()
        w -= (low + high) / 4  # both n-gram orders share the threshold
        trust[b] = max(low - high, 1e-6)
        weights[:, b] = w / (trust[b] / 2)
    return Model(langs, code, weights.astype(np.float32), trust, read.sum())


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """docs: labelled rows (doc_id, text, lang) to learn from."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not totals:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sorted(totals.items()) for x in (k, min(1.0, sample / n))])
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for some in slices(batch):
                langs, texts = some.column("lang").to_pylist(), some.column("text").to_pylist()
                for k in set(langs):
                    data, starts = framed([t.encode() for t, x in zip(texts, langs, strict=True) if x == k])
                    got = seen.setdefault(k, np.zeros(N_FEATURES, np.int64))
                    for low in range(0, int(starts[-1]), BLOCK):
                        for ids in grams(data[low : min(low + BLOCK, int(starts[-1])) + 2]):
                            got += np.bincount(ids, minlength=N_FEATURES)
        for k, got in seen.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at)), pa.array(at, pa.int32()), pa.array(got[at])], ["lang", "feature", "n"])

    summed = drawn.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, np.ndarray] = {}
    for k in totals:
        at = summed.filter(pa.compute.equal(summed.column("lang"), k))
        counts[k] = np.zeros(N_FEATURES)
        counts[k][at.column("feature").to_numpy()] = at.column("n").to_numpy()
    return fitted(counts)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


PREDICTED = ("lang_pred", "score", "ambiguous", "known")


def predict(docs: DataFrame, model: Model | None, names: tuple[str, str, str, str] = PREDICTED) -> DataFrame:
    """The columns of docs with language, score, ambiguity and share of known 3-grams (null for `und`) under the names; columns of docs with these names are replaced."""
    keep = [c for c in docs.columns if c not in names]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # N_FEATURES x bits numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for some in slices(batch):
                texts = some.column("text").to_pylist()
                known = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
                lang, score, close = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts), bool)
                apart = np.full(len(texts), np.nan)
                if known:
                    best, top, second, apart[known] = m.decide(m.margins([texts[i].encode() for i in known]))
                    lang[known], score[known], close[known] = np.array(m.langs, object)[best], top, top - second < CLOSE
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score), pa.array(close), pa.array(apart, from_pandas=True)], [*keep, *names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    made = ", ".join(f"`{n}` {t}" for n, t in zip(names, ("string", "double", "boolean", "double"), strict=True))
    return docs.mapInArrow(run, f"{own}, {made}")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: learned from the rows that aren't held out."""
    held_out = F.coalesce(remainder() == 1, F.lit(False))
    model = learn(docs.where(~held_out), sample)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous", "known")


def accepted(docs: DataFrame, sample: int = SAMPLE, languages: tuple[str, ...] | None = None, least_known: float = LEAST_KNOWN, evidence: int = EVIDENCE) -> DataFrame:
    """The documents in one of the languages (None: all that are learned), with their own columns only. Those without a letter, those
    in another language and those in none that was learned go (the last only if LEARNED 3-grams or more were read); an ambiguous or a short one stays, as mixed or short texts are no
    fault. If nothing can be learned, all documents with a letter stay."""
    model = learn(docs.where(F.coalesce(remainder() != 1, F.lit(True))), sample)
    names = tuple(f"__{n}" for n in PREDICTED)
    lang, _, _, known = map(F.col, names)
    said = predict(docs, model, names)
    stays = lang != UNKNOWN
    if model is not None and model.learned >= LEARNED:
        stays &= ~((F.length("text") >= evidence) & (known < least_known))
    if languages is not None:
        stays &= lang.isin(list(languages))
    if model is None:
        stays = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return said.where(stays).select(*[F.col(f"`{c}`") for c in docs.columns])
