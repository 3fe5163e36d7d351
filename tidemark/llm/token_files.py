"""Token-id output: flat files of unsigned integers with 64-bit document offsets, read back by memory map.

Documents are dealt to parts by ranges of doc_id and sorted inside them. A part is three flat files:
`.ids` (unsigned 16- or 32-bit ids, as the vocabulary needs), `.off` (64-bit offsets of its documents, one more
than there are documents) and `.doc` (64-bit doc ids). The first id of a part in the whole output is the prefix sum
of the parts before it, kept in the table `index` beside the files. A part's files carry the number of the task attempt that
wrote them and nothing is renamed; the index names the attempt that was kept, so a task that runs again after a lost executor does no harm.

Defined results: a null or empty text has only the end id; rows that repeat a doc_id each have
their own place; a row without doc_id sorts first and comes back with a null doc_id; an empty table gives no documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, partitions, read, shared_dir, slices, staged
from tidemark.llm.tokens import TOGETHER, encoder, tokenizer_path

_NO_ID = -(2**63)


def _write(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        dtype = "<u2" if enc.tokenizer.get_vocab_size() <= 2**16 else "<u4"
        files, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        end = np.array([end_id], dtype).tobytes()
        lengths, docs = [np.zeros(1, np.int64)], []
        with files.open_output_stream(f"{root}/{part}.ids") as out:
            for batch in slices(batches):
                own = np.zeros(batch.num_rows, np.int64)
                for i, text_ids in enumerate(enc.encode_all(batch.column(1))):
                    ids = np.frombuffer(text_ids, "<u4").astype(dtype)
                    out.write(ids.tobytes() + end)
                    own[i] = len(ids) + 1
                lengths.append(own)
                docs.append(np.asarray(batch.column(0).fill_null(_NO_ID)))
        offsets = np.cumsum(np.concatenate(lengths), dtype="<i8")
        for kind, data in (("off", offsets), ("doc", np.concatenate(docs) if docs else np.zeros(0, "<i8"))):
            with files.open_output_stream(f"{root}/{part}.{kind}") as out:
                out.write(data.astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "name": pa.array([part]), "docs": pa.array([len(offsets) - 1]), "ids": pa.array([int(offsets[-1])]), "width": pa.array([int(dtype[-1])], pa.int32())})

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write the token files of docs to folder (which all executors see); returns the index, also kept as folder/index: part, name, docs, ids, width, base."""
    spark = docs.sparkSession
    files, root = pafs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    rows = id_text(docs).withColumn("tie", F.xxhash64("text"))  # so that many rows of one doc_id, or of none, are dealt to several parts
    ordered = rows.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    sums = staged(ordered.mapInArrow(_write(folder, tokenizer, end_id), "part int, name string, docs long, ids long, width int"), "token-parts", TOGETHER)
    rows, base = [], 0
    for r in sorted(sums.collect()):  # one row for each part
        rows.append((r.part, r.name, r.docs, r.ids, r.width, base))
        base += r.ids
    index = spark.createDataFrame(rows, "part int, name string, docs long, ids long, width int, base long")
    index.coalesce(1).write.parquet(f"{folder}/index")
    return index


def _open(files: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    if isinstance(files, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if files.get_file_info(path).size else np.zeros(0, dtype)
    with files.open_input_file(path) as f:  # a store that cannot be mapped
        return np.frombuffer(f.read_buffer(), dtype)


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                name = f"{root}/{r['name']}"
                ids, off, docs = _open(files, f"{name}.ids", f"<u{r['width']}"), _open(files, f"{name}.off", "<i8"), _open(files, f"{name}.doc", "<i8")
                for a in range(0, len(docs), 5000):
                    b = min(a + 5000, len(docs))
                    crc = [zlib.crc32(ids[off[i] : off[i + 1]].astype("<u4").tobytes()) for i in range(a, b)]
                    own = np.array(docs[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == _NO_ID), pa.array(off[a:b] + r["base"]), pa.array(np.diff(off[a : b + 1])), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(spark: SparkSession, folder: str, index: DataFrame | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files, one task for each part."""
    index = spark.read.parquet(f"{folder}/index") if index is None else index
    parts = max(1, index.count())
    return index.where("docs > 0").repartition(parts, "part").mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "tokens")
    write_tokens(read(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"), 0)
    return read_tokens(spark, folder)
