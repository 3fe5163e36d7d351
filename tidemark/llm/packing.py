"""Best-fit packing by linear grouping: documents' token pieces into as few fixed-length sequences as possible.

Everything is decided on the histogram of piece lengths, which has at most `capacity` rows whatever the input:
 1. large lengths, from the longest down, are cut into groups of equal cardinality and rounded up to the group's longest;
 2. configurations of those few sizes are chosen, largest size first, each as full as a subset-sum table allows, and
    used as often as the counts permit;
 3. the groups' actual pieces are substituted for the rounded ones;
 4. small pieces go, longest first, to the sequence with the least room that still fits (best fit), in bulk by equal room.
The plan is a table of rank ranges by length; pieces take their place by their rank among the pieces
of their length. Ranks come from salted counts, so one length may hold a third of all rows.

Defined results: a null or empty text is the end id alone; only texts longer than the capacity are cut; rows that repeat a doc_id
are packed each; a row without doc_id is packed too; an empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, partitions, read, slices, staged
from tidemark.llm.tokens import TOGETHER, encoder, tokenizer_path

CAPACITY, END_ID = 4096, 1
#: Groups of the large lengths, and the share of the capacity from which a length is large.
GROUPS, LARGE = 256, 1 / 16
#: Pieces for which a task of its own places them and writes a file.
PLACED = 50_000


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            docs, piece, start, length, crc = [], [], [], [], []
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1))):
                ids += end
                for i, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    docs.append(doc), piece.append(i), start.append(a // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece of at most capacity ids: doc_id, piece, start, length, ids_crc32."""
    return id_text(docs).mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _groups(large: list[tuple[int, int]], k: int) -> list[tuple[int, list[list[int]]]]:
    """Equal-cardinality groups from the longest down: (rounded size, [[length, first rank, count], ...])."""
    each = max(1, -(-sum(c for _, c in large) // k))
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for length, count in large:
        rank = 0
        while rank < count:
            if not room:
                out.append((length, []))
                room = each
            take = min(room, count - rank)
            out[-1][1].append([length, rank, take])
            rank, room = rank + take, room - take
    merged: list[tuple[int, list[list[int]]]] = []
    for size, segments in out:  # one length may fill several groups
        if merged and merged[-1][0] == size:
            merged[-1][1].extend(segments)
        else:
            merged.append((size, segments))
    return merged


def _fullest(sizes: list[int], counts: list[int], first: int, capacity: int) -> dict[int, int]:
    """The fullest configuration that holds size number `first`, by a subset-sum table over the sizes still there."""
    room = capacity - sizes[first]
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for i in range(first, len(sizes)):
        for _ in range(min(counts[i] - (i == first), room // sizes[i])):
            more = (reach | reach << sizes[i]) & mask
            if more == reach:
                break
            steps.append((i, reach))
            reach = more
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {first: 1}
    for i, before in reversed(steps):
        if not before >> at & 1:
            used[i] = used.get(i, 0) + 1
            at -= sizes[i]
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Runs of like sequences: (how many, room left, [(length, first rank of that length), ...])."""
    runs = [[histogram[capacity], 0, [(capacity, 0)]]] if histogram.get(capacity) else []
    big = sorted(((n, c) for n, c in histogram.items() if large * capacity < n < capacity and c), reverse=True)
    grouped = _groups(big, groups)
    sizes, counts = [s for s, _ in grouped], [sum(x[2] for x in segments) for _, segments in grouped]
    first = 0
    while first < len(sizes):
        if not counts[first]:
            first += 1
            continue
        used = _fullest(sizes, counts, first, capacity)
        times = min(counts[i] // n for i, n in used.items())
        slots = []
        for i, n in used.items():
            counts[i] -= n * times
            for _ in range(n):  # the next `times` pieces of the group
                need, own = times, []
                while need:
                    segment = grouped[i][1][0]
                    take = min(need, segment[2])
                    own.append((segment[0], segment[1], take))
                    segment[1], segment[2], need = segment[1] + take, segment[2] - take, need - take
                    if not segment[2]:
                        grouped[i][1].pop(0)
                slots.append(own)
        at = [[0, 0] for _ in slots]  # segment and place in it, for each slot
        while times:
            n = min([times, *(own[p[0]][2] - p[1] for own, p in zip(slots, at))])
            held = [(own[p[0]][0], own[p[0]][1] + p[1]) for own, p in zip(slots, at)]
            runs.append([n, capacity - sum(x for x, _ in held), held])
            times -= n
            for own, p in zip(slots, at):
                p[1] += n
                if p[1] == own[p[0]][2]:
                    p[0], p[1] = p[0] + 1, 0
    by_room: dict[int, list] = {}
    for r in runs:
        by_room.setdefault(r[1], []).append(r)
    rooms = sorted(by_room)
    done = []

    def keep(run: list) -> None:
        if run[1] not in by_room:
            by_room[run[1]] = []
            bisect.insort(rooms, run[1])
        by_room[run[1]].append(run)

    for length in sorted((n for n in histogram if n <= large * capacity and n < capacity), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                keep([-(-left // (capacity // length)), capacity, []])
                continue
            room = rooms[i]
            run = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[i]
            fits = min(room // length, left)
            n = min(run[0], left // fits)
            if n < run[0]:
                keep([run[0] - n, room, [(x, r + n) for x, r in run[2]]])
            keep([n, room - fits * length, run[2] + [(length, rank + j * n) for j in range(fits)]])
            rank, left = rank + fits * n, left - fits * n
    for room in rooms:
        done.extend((n, room, slots) for n, room, slots in by_room[room] if slots)
    return done


def _table(runs: list[tuple[int, int, list[tuple[int, int]]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By length and first rank: key, first rank, first sequence, offset."""
    rows, sequence = [], 0
    for n, _, slots in runs:
        offset = 0
        for length, rank in slots:
            rows.append((length, rank, sequence, offset))
            offset += length
        sequence += n
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return (a[:, 0] << 44) + a[:, 1], a[:, 1], a[:, 2], a[:, 3]


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> DataFrame:
    """pieces (doc_id, piece, length, ...) plus sequence_id and offset (long); offsets leave no gap."""
    spark = pieces.sparkSession
    salts = max(64, 4 * partitions(spark))
    salted = staged(pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")), "pieces", TOGETHER)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(_table(plan(histogram, capacity, groups, large)))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # every column orders the ranks: rows that tie in all of them are the same, so a stage that is computed again gives the same places
    order = ["doc_id", "piece", *(f.name for f in pieces.schema if f.name not in ("doc_id", "piece") and f.dataType.typeName() not in ("map", "variant"))]
    own = F.row_number().over(W.partitionBy("length", "salt").orderBy(*order))
    ranked = salted.withColumn("rank", own - 1).join(bases, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, sequence, offset = table.value
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            yield batch.drop_columns(["rank"]).append_column("sequence_id", pa.array(sequence[at] + rank - first[at])).append_column("offset", pa.array(offset[at]))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(histogram.values()) // PLACED))  # few pieces are not spread over a file for each shuffle partition
    return ranked.select(*pieces.columns, "rank").coalesce(tasks).mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))
