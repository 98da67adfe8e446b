import gzip
import io
import json
import os
import tarfile
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cardloom.operators import views
from cardloom.sources import archives, services, tables
from cardloom.streaming import incremental


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    archives.register(spark)


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "a.jsonl")
    with open(path, "w") as f:
        f.write('{"id": 1, "t": "ü"}\n\n{"id": 2, "t": "b"}\n{"id": 3, "t"')
    good, broken = tables.tolerant_json_lines(spark, path, "id int, t string")
    assert sorted((r.id, r.t) for r in good.collect()) == [(1, "ü"), (2, "b")] and [r.line for r in broken.collect()] == ['{"id": 3, "t"']
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        tables.strict_json_lines(spark, path, "id int, t string").collect()
    out = str(tmp_path / "out")
    tables.write_json_lines(good, out)
    assert "ü" in "".join(r.value for r in spark.read.text(out).collect())


def test_text_and_csv(spark, tmp_path):
    (tmp_path / "t.txt").write_text("id1 some words here\n\nid2\nid3 a  b\n")
    assert [(r.id, r.text) for r in tables.transcripts(spark, str(tmp_path / "t.txt")).collect()] == [("id1", "some words here"), ("id2", ""), ("id3", "a  b")]
    (tmp_path / "l.csv").write_text('fname,labels\n1,"a,b"\n2,c\n')
    assert [r.labels for r in tables.csv_with_header(spark, str(tmp_path / "l.csv"), "fname int, labels string").collect()] == ["a,b", "c"]
    (tmp_path / "s" / "sp1" / "ch2").mkdir(parents=True)
    (tmp_path / "s" / "sp1" / "ch2" / "x.flac").write_bytes(b"1")
    (tmp_path / "s" / "sp1" / "ch2" / "x.txt").write_bytes(b"1")
    assert [tuple(r)[:3] for r in tables.speaker_files(spark, str(tmp_path / "s"), ".flac").collect()] == [("sp1", "ch2", "x.flac")]


def test_content_store(spark, tmp_path):
    store = str(tmp_path / "store")
    df = spark.createDataFrame([(b"a",), (b"b",), (b"a",)], "data binary")
    assert tables.put_by_content(df, "data", store).count() == 2
    assert tables.put_by_content(spark.createDataFrame([(b"a",), (b"c",)], "data binary"), "data", store).count() == 1
    assert spark.read.parquet(store).count() == 3


def test_tar_round_trip(spark, tmp_path):
    folder = str(tmp_path / "shards")
    rows = [(f"s{i % 3}", f"k{i:03d}", x, json.dumps({"lane": "l" + str(i % 2)}).encode() if x == "json" else bytes([i]) * i) for i in range(20) for x in ("json", "bin")]
    df = spark.createDataFrame(rows, "shard string, key string, suffix string, data binary")
    for _ in range(2):  # writing again changes nothing
        df.repartition(3, "shard").sortWithinPartitions("shard", "key", "suffix").write.format("tar_samples").mode("append").option("path", folder).save()
    back = spark.read.format("tar_samples").option("path", folder + "/*.tar").load()
    assert sorted((r.key, r.suffix, bytes(r.data)) for r in back.collect()) == sorted((k, x, d) for _, k, x, d in rows)
    only = spark.read.format("tar_samples").option("path", folder + "/*.tar").option("suffixes", "bin").load()
    assert only.count() == 20 and views.paired(back, "json", "bin").count() == 20
    with open(folder + "/s0.tar.idx.json") as f:
        index = json.load(f)
    assert sum(index["counts"].values()) == 7 and not list((tmp_path / "shards").glob("*.tmp"))
    flat = archives.tar_index(spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(folder))
    assert flat.count() == 40 and flat.where("lane is null").count() == 0
    picked = flat.where("key in ('k003', 'k010')").groupBy(F.regexp_replace("shard", "^file:", "").alias("shard"), "key").agg(F.map_from_entries(F.collect_list(F.struct("suffix", F.array("offset", "size")))).alias("members"))
    got = {r.key: r.data for r in archives.read_samples(spark, picked).collect()}
    assert bytes(got["k003"]["bin"]) == bytes([3]) * 3 and bytes(got["k010"]["bin"]) == bytes([10]) * 10


def test_gzipped_tar(spark, tmp_path):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for name, data in (("d/u1.txt", b"words"), ("d/u1.flac", b"\1\2")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    (tmp_path / "a.tar.gz").write_bytes(gzip.compress(raw.getvalue()))
    got = spark.read.format("tar_samples").option("path", str(tmp_path / "*.tar.gz")).load()
    assert {(r.key, r.suffix) for r in got.collect()} == {("u1", "txt"), ("u1", "flac")}


def test_zip_and_row_groups_and_vectors(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for i in range(9):
            z.writestr(f"m{i}", bytes([i]))
    got = spark.read.format("zip_members").option("path", str(tmp_path / "*.zip")).option("parts", 4).load()
    assert sorted((r.member, bytes(r.data)) for r in got.collect()) == [(f"m{i}", bytes([i])) for i in range(9)]
    pq.write_table(pa.table({"q": [f"q{i}" for i in range(10)], "other": list(range(10))}), tmp_path / "p.parquet", row_group_size=3)
    read = lambda step: spark.read.format("row_groups").option("path", str(tmp_path / "p.parquet")).option("columns", "q").option("ddl", "q string").option("step", step).load()
    assert sorted((r.row_number, r.q) for r in read(2).collect()) == [(1, "q0"), (2, "q1"), (3, "q2"), (7, "q6"), (8, "q7"), (9, "q8")]
    assert read(1).count() == 10 == tables.footer_rows(spark, str(tmp_path / "p.parquet"))
    np.save(tmp_path / "v.npy", np.arange(12, dtype=np.float16).reshape(4, 3))
    got = spark.read.format("npy_vectors").option("path", str(tmp_path / "*.npy")).load().sort("row").collect()
    assert [r.vec for r in got] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]]


def test_service(spark):
    def call(texts):
        return [[float(len(t)), 0.0] for t in texts]

    got = services.embedded(spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "id long, text string"), call, 2).sort("id").collect()
    assert [r.vec for r in got] == [[1.0, 0.0], [0.0, 0.0], [0.0, 0.0]]


def test_drain_goes_on_where_it_stopped(spark, tmp_path):
    src, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    spark.range(5).withColumn("v", F.lit("a")).write.parquet(src)
    drain = lambda: incremental.drain(spark, src, "id long, v string", state, out)
    assert drain().count() == 5 and drain().count() == 5
    spark.range(5, 8).withColumn("v", F.lit("b")).write.mode("append").parquet(src)
    assert sorted(r.id for r in drain().collect()) == list(range(8))


def test_streams_with_a_watermark(spark, tmp_path):
    rows = [(1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:04:00"), (1, "2024-01-01 00:02:00"), (3, "2024-01-01 00:11:00")]
    df = spark.createDataFrame(rows, "id long, at string").select("id", F.to_timestamp("at").alias("ts"))
    src = str(tmp_path / "events")
    df.coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(df.schema).parquet(src)
    for name, frame, mode in (("counts", incremental.windowed_counts(stream(), "ts", "1 minute", "5 minutes"), "complete"), ("once", incremental.once(stream(), "id", "ts", "1 hour"), "append")):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 3] and spark.table("once").count() == 3


def test_log_with_corrections(spark):
    log = spark.createDataFrame([("a", 1, "error"), ("a", 2, "done"), ("b", 1, "error"), ("c", 1, "overlength"), ("d", 1, "done"), ("d", 2, "error")], "id string, at int, state string")
    work = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    assert sorted(r.id for r in incremental.pending(work, log, "id").collect()) == ["b", "d", "e"]


def test_parked_texts(spark):
    def call(texts):
        if any("bad" in t for t in texts):
            raise ValueError("can't read this")
        return [[float(len(t)), 0.0] for t in texts]

    got = {r.id: r for r in services.embedded_or_parked(spark.createDataFrame([(1, "ab"), (2, "bad"), (3, "c"), (4, None)], "id long, text string").coalesce(1), call, 3).collect()}
    assert got[1].vec == [1.0, 0.0] and got[2].vec is None and "can't read" in got[2].problem and got[2].tries == 3 and got[3].problem is None and got[4].vec == [0.0, 0.0]


def test_tar_content_order_and_failed_writes(spark, tmp_path):
    folder = str(tmp_path / "shards")
    sample = lambda *kinds: json.dumps({"lane": "a", "anchor": {"content": [{"type": k} for k in kinds]}, "positive": {"content": []}}).encode()
    write = lambda rows: spark.createDataFrame(rows, "shard string, key string, suffix string, data binary").coalesce(1).write.format("tar_samples").mode("append").option("path", folder).save()
    write([("s0", "k0", "json", sample("image", "text")), ("s0", "k0", "bin", b"x" * 700), ("s0", "k1", "json", sample("text"))])
    with open(folder + "/s0.tar.idx.json") as f:
        index = json.load(f)
    assert archives.sample_at(folder + "/s0.tar", index["samples"]["k0"]["members"])["bin"] == b"x" * 700 and index["lanes"] == {"a": ["k0", "k1"]}
    with pytest.raises(Exception, match="images before text"):
        write([("s1", "k2", "json", sample("text", "image"))])
    assert sorted(os.listdir(folder)) == ["s0.tar", "s0.tar.idx.json"]


def test_no_machine_local_folder_on_a_cluster():
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})()
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077"})()  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_folder(Session())
