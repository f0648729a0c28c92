"""Published tables, resumable streams and verified folders: killed batches, tampered files, tree hashes."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from lodequery.sources import bundles, sinks

SCHEMA = "id bigint, word string, kinds map<string,int>"


def rows_of(spark, ids):
    return spark.createDataFrame([(i, None if i % 5 == 0 else f"w{i % 7}", {"a": i}) for i in ids], SCHEMA)


def test_publish(spark, tmp_path):
    path = f"{tmp_path}/out/table"
    os.makedirs(f"{tmp_path}/out")
    told = sinks.publish(rows_of(spark, [*range(50), 3, 3]), path)
    assert told["n"] == 52 and spark.read.parquet(path).count() == 52 and os.listdir(f"{tmp_path}/out") == ["table"]
    assert told == spark.read.parquet(path).repartition(5).agg(*sinks.fingerprint(rows_of(spark, [1]))).first().asDict()
    with pytest.raises(FileExistsError):
        sinks.publish(rows_of(spark, [1]), path)
    with pytest.raises(Exception, match="too many"):
        sinks.publish(rows_of(spark, range(9)).withColumn("word", F.when(F.col("id") == 8, F.raise_error(F.lit("too many"))).otherwise(F.col("word"))), f"{tmp_path}/out/other")
    assert os.listdir(f"{tmp_path}/out") == ["table"]
    assert sinks.publish(rows_of(spark, [1]).limit(0), f"{tmp_path}/out/empty")["n"] == 0


def test_publish_refuses_what_reads_back_otherwise(spark, tmp_path, monkeypatch):
    real = sinks.fingerprint
    calls = []

    def other(df):
        calls.append(df)
        return real(df) if len(calls) == 1 else [F.lit(0).alias("n"), *real(df)[1:]]

    monkeypatch.setattr(sinks, "fingerprint", other)
    with pytest.raises(ValueError, match="read back"):
        sinks.publish(rows_of(spark, range(4)), f"{tmp_path}/table")
    assert os.listdir(tmp_path) == []


def test_a_killed_batch_is_repaired(spark, tmp_path):
    source, folder, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    for k in range(4):
        rows_of(spark, range(10 * k, 10 * k + 10)).coalesce(1).write.mode("append").parquet(source)
    died = []

    def dies_once(rows, batch):
        if batch == 2 and not died:
            died.append(batch)
            rows.write.parquet(f"{folder}/batch=2")  # a tail that was never entered
            raise RuntimeError("killed")
        return rows

    def run(before):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = sinks.append_batches(stream, folder, checkpoint, before).trigger(availableNow=True).start()
        query.awaitTermination()

    with pytest.raises(Exception, match="killed"):
        run(dies_once)
    schema = rows_of(spark, [1]).schema
    assert sinks.committed(spark, folder, schema).count() == 20
    assert [tuple(r) for r in sinks.ledger_faults(spark, folder, schema).collect()] == [(2, "not_entered")]
    run(dies_once)
    got = sinks.committed(spark, folder, schema)
    assert sorted(r.id for r in got.collect()) == list(range(40)) and got.select("batch").distinct().count() == 4
    assert sinks.ledger_faults(spark, folder, schema).count() == 0 and sinks.ledger(spark, folder).count() == 4
    assert sinks.append_batch(rows_of(spark, [99]), 1, folder) is False and sinks.committed(spark, folder, schema).count() == 40
    part = next(f for f in os.listdir(f"{folder}/batch=3") if f.startswith("part"))
    os.remove(f"{folder}/batch=3/{part}")
    rows_of(spark, [7]).write.mode("append").parquet(f"{folder}/batch=1")
    assert {tuple(r) for r in sinks.ledger_faults(spark, folder, schema).collect()} == {(3, "missing"), (1, "changed")}


def test_bundles(spark, tmp_path):
    rng = random.Random(2)
    told = []
    for name in ("a.txt", "deep/er/b.bin", "deep/c.txt", "deep/er/d d.txt", "z/empty"):
        data = b"" if name.endswith("empty") else rng.randbytes(300)
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(data)
        told.append((name, len(data), hashlib.sha256(data).hexdigest().upper()))
    listed = spark.createDataFrame(told, "name string, size bigint, sha256 string")
    found = bundles.files(spark, str(tmp_path))
    assert bundles.file_faults(listed, found).count() == 0

    def tree(folder):
        lines, below = [], []
        for entry in sorted(os.listdir(folder)):
            path = f"{folder}/{entry}"
            if entry == "z":
                continue  # it holds an empty file only
            if os.path.isdir(path):
                digest, more = tree(path)
                below += more
                lines.append(f"folder {digest} {entry}")
            else:
                lines.append(f"file {hashlib.sha256(open(path, 'rb').read()).hexdigest()} {entry}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        return digest, [*below, (os.path.relpath(folder, tmp_path).removeprefix("."), len(lines), digest)]

    assert {(r.folder, r.entries, r.sha256) for r in bundles.tree_hashes(found).collect()} == set(tree(str(tmp_path))[1])
    with open(f"{tmp_path}/a.txt", "r+b") as f:
        f.write(b"?")
    with open(f"{tmp_path}/deep/c.txt", "ab") as f:
        f.write(b"?")
    os.remove(f"{tmp_path}/deep/er/b.bin")
    with open(f"{tmp_path}/new", "wb") as f:
        f.write(b"1")
    more = listed.unionByName(spark.createDataFrame([("z/empty", 0, told[-1][2]), (None, 1, "x")], listed.schema))
    faults = {(r.name, r.fault) for r in bundles.file_faults(more, bundles.files(spark, str(tmp_path))).collect()}
    assert faults == {("a.txt", "content"), ("deep/c.txt", "size"), ("deep/er/b.bin", "missing"), ("new", "extra"), ("z/empty", "listed_twice"), (None, "unusable_entry")}
