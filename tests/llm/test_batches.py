"""What a task holds at once while texts are encoded and packed, and how many tasks few pieces take."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm.common import BATCH, batches_of, shared_dir, staged
from tidemark.llm.packing import pack, token_pieces
from tidemark.llm.token_files import read_tokens, write_tokens
from tidemark.llm.tokens import TOGETHER, tokenizer_path

from .test_tokens import sound


def long_texts(spark, n: int):
    return spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("amber "), F.col("id").cast("string"), F.lit(" ")), 600).alias("text"))


def test_packing_is_handed_small_batches(spark):
    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([0] * b.num_rows, pa.int32()), pa.array([100] * b.num_rows, pa.int64()), pa.array([b.nbytes] * b.num_rows, pa.int64())], ["doc_id", "piece", "length", "held"])

    before = spark.conf.get(BATCH, None)
    rows = pack(long_texts(spark, 3000).mapInArrow(held, "doc_id long, piece int, length long, held long")).collect()
    assert len(rows) == 3000 and max(r.held for r in rows) < 1.1 * TOGETHER  # about 18 MB in one batch of 3,000 rows otherwise
    assert sound(rows, 4096) == 75 and spark.conf.get(BATCH, None) == before


def test_token_files_are_written_from_small_batches(spark, monkeypatch):
    asked = []
    monkeypatch.setattr("tidemark.llm.token_files.staged", lambda df, kind, batch=None: asked.append(batch) or staged(df, kind, batch))
    folder = shared_dir(spark, "tokens")
    write_tokens(long_texts(spark, 20), folder, tokenizer_path("byte_bpe_50k.json"), 0)
    assert asked == [TOGETHER] and read_tokens(spark, folder).count() == 20


def test_the_bound_is_put_back(spark):
    before = spark.conf.get(BATCH, None)
    with pytest.raises(ValueError), batches_of(spark, 1000):
        assert spark.conf.get(BATCH) == "1000"
        raise ValueError
    assert spark.conf.get(BATCH, None) == before
    spark.conf.set(BATCH, "7000000")
    try:
        with batches_of(spark, 1000):
            pass
        assert spark.conf.get(BATCH) == "7000000"
    finally:
        spark.conf.unset(BATCH)


def test_few_pieces_take_few_tasks(spark, docs, texts):
    coalesce, shuffle = "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"
    before = spark.conf.get(shuffle)
    spark.conf.set(coalesce, "false")
    spark.conf.set(shuffle, "37")
    try:
        packed = pack(token_pieces(docs, tokenizer_path("word_bpe_49k.json"), 256), 256)
        assert packed.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism  # 37 otherwise
        rows = packed.collect()
    finally:
        spark.conf.set(shuffle, before)
        spark.conf.unset(coalesce)
    assert {r.doc_id for r in rows} == {i for i, _ in texts}
    sound(rows, 256)
