import math
import zlib

import pytest
import xxhash

from stayscope.llm import rendezvous as r


def brute(key, weights):
    def score(shard):
        h = 42 if key is None else xxhash.xxh64(key.to_bytes(8, "little", signed=True), seed=42).intdigest()
        h = xxhash.xxh64(shard.to_bytes(4, "little"), seed=h).intdigest()
        return -math.log(((h >> 11) + 0.5) * 2.0**-53) / weights[shard]

    return min(weights, key=lambda s: (score(s), s))


def test_against_brute_force(texts, odd):
    rows = odd + [(i, f"text {i}") for i in range(100, 3000)] + [(99, "same")] * 400
    got = r.assign_shards(texts(rows), 16, rows_per_piece=20).collect()
    assert len(got) == len(rows)
    equal = dict.fromkeys(range(16), 1.0)
    texts_of = {}
    for key, text in rows:
        texts_of.setdefault(key, set()).add((len((text or "").encode()) + 1, zlib.crc32((text or "").encode())))
    slots = {}
    for row in got:
        assert row["shard"] == brute(row["doc_id"], equal)
        assert row["grown_shard"] == brute(row["doc_id"], {**equal, 16: 1.0})
        assert row["grown_shard"] in (row["shard"], 16)
        assert (row["size"], row["text_crc32"]) in texts_of[row["doc_id"]]
        slots.setdefault(row["shard"], []).append(row["slot"])
    for taken in slots.values():
        assert sorted(taken) == list(range(len(taken)))


def test_weights_share_the_keys(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "'x' as text")
    counts = {x["shard"]: x["n_rows"] for x in r.shard_balance(r.assign_shards(df, {0: 1.0, 5: 3.0})).collect()}
    assert abs(counts[5] / counts[0] - 3) < 0.3
    with pytest.raises(ValueError):
        r.assign_shards(df, {0: 0.0})


def test_empty_table(texts):
    assert r.assign_shards(texts([])).count() == 0
