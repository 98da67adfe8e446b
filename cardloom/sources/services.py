"""Vectors from an embedding service, as batches with bounded retries. Tests use a function instead of a service."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH, TRIES, PAUSE = 64, 6, 2.0


def over_http(url: str, timeout: float = 120.0) -> Callable[[list[str]], list[list[float]]]:
    """Posts {"input": texts} and takes data[i].embedding; waits longer after each failure, then gives up, so that Spark's own task
    retries decide."""

    def call(texts: list[str]) -> list[list[float]]:
        body = json.dumps({"input": texts}).encode()
        for i in range(TRIES):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as r:
                    return [row["embedding"] for row in json.load(r)["data"]]
            except (urllib.error.URLError, TimeoutError):
                if i + 1 == TRIES:
                    raise
                time.sleep(PAUSE * 2**i)
        return []

    return call


def embedded_or_parked(texts: DataFrame, call: Callable[[list[str]], list[list[float]]], batch: int = BATCH, tries: int = 2) -> DataFrame:
    """The same, but a text that fails is parked and the others go on: id, vec, tries, problem. A batch that fails is asked again text by
    text, each as often as `tries`; parked texts have a problem and no vec, and can be asked again later."""
    import numpy as np

    def asked(part: list[str]) -> tuple[list[list[float]] | None, str | None]:
        try:
            v = np.asarray(call(part), np.float32)
            return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)).tolist(), None
        except Exception as e:  # whatever a service says parks the text
            return None, f"{type(e).__name__}: {e}"[:300]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                said = [t or "" for t in part.column("text").to_pylist()]
                got, _ = asked(said)
                rows = [(v, 1, None) for v in got] if got is not None else []
                for text in said if got is None else ():
                    for n in range(1, tries + 1):
                        one, problem = asked([text])
                        if one is not None or n == tries:
                            rows.append((one[0] if one is not None else None, n + 1, problem))
                            break
                vec, count, problem = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(vec, pa.list_(pa.float32())), pa.array(count, pa.int32()), pa.array(problem, pa.string())], ["id", "vec", "tries", "problem"])

    kind = dict(texts.dtypes)["id"]
    return texts.select("id", "text").mapInArrow(run, f"id {kind}, vec array<float>, tries int, problem string")


def embedded(texts: DataFrame, call: Callable[[list[str]], list[list[float]]], batch: int = BATCH) -> DataFrame:
    """texts (id, text): id, vec of unit length."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                v = np.asarray(call([t or "" for t in part.column("text").to_pylist()]), np.float32)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(v.tolist(), pa.list_(pa.float32()))], ["id", "vec"])

    kind = dict(texts.dtypes)["id"]
    return texts.select("id", "text").mapInArrow(run, f"id {kind}, vec array<float>")
