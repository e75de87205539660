import glob
import os
import random

import pytest

from seqloom.streaming import ingest


def test_generations_hold_every_batch_once():
    for fan in (2, 3, 8):
        held = {}  # the batches of each table
        for n in range(200):
            live = ingest.generations(n, fan)
            assert [b for t in live for b in held[t]] == list(range(n)) and len(live) <= (fan - 1) * 9
            held[0, n] = [n]
            for level, first in ingest.merged_after(n, fan):
                held[level, first] = [b for k in range(fan) for b in held[level - 1, first + k * fan ** (level - 1)]]


def feed(spark, path, files):
    schema = "k string, g int, v long, key string"
    for n, rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/tmp-{n}")
        os.makedirs(f"{path}/in", exist_ok=True)
        os.rename(glob.glob(f"{path}/tmp-{n}/part-*")[0], f"{path}/in/{n:04d}.parquet")
        os.utime(f"{path}/in/{n:04d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    return schema


def drain(spark, path, schema):
    stream = ingest.file_stream(spark, f"{path}/in", schema, files_per_trigger=1)
    ingest.ingest(stream, f"{path}/out", ["k", "g"], order="v", fan=2).awaitTermination()
    return sorted(map(tuple, ingest.ingested(spark, f"{path}/out", schema).collect()), key=str)


def test_first_of_each_key_over_restarts_and_repeated_batches(spark, tmp_path):
    rng = random.Random(1)
    files = [(n, [(rng.choice([None, "a", "b", "c", "d"]), rng.choice([None, 1, 2]), 100 * n + k, "x") for k in range(6)]) for n in range(9)]
    schema = feed(spark, tmp_path, files[:5])
    seen, want = set(), []
    for n, rows in files:
        for r in sorted(rows, key=lambda r: r[2]):
            if r[:2] not in seen:
                seen.add(r[:2])
                want.append((n, r))
    expected = lambda n: sorted((r for k, r in want if k < n), key=str)
    assert drain(spark, tmp_path, schema) == expected(5)
    # The last batch is forgotten, as if the program had been lost before it was committed: it is run again.
    for p in glob.glob(f"{tmp_path}/out/checkpoint/commits/*4*") + glob.glob(f"{tmp_path}/out/checkpoint/commits/.*4*"):
        os.remove(p)
    assert drain(spark, tmp_path, schema) == expected(5)
    feed(spark, tmp_path, files[5:])
    assert drain(spark, tmp_path, schema) == expected(9)
    assert drain(spark, tmp_path, schema) == expected(9)
    # Merged tables are gone but for those of the last batch.
    assert len(glob.glob(f"{tmp_path}/out/keys/level-*/from-*")) <= 8


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)] * 3])
def test_empty_and_null(spark, tmp_path, rows):
    schema = feed(spark, tmp_path, [(0, rows)])
    assert drain(spark, tmp_path, schema) == rows[:1]
