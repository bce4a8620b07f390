"""Best-fit packing of token sequences through a configuration linear program.

Documents are tokenised, closed with an end id, and cut only where longer than a sequence.
The pieces' lengths form a histogram of at most CAPACITY classes, whatever the input's size.
Over it the driver solves the configuration program (a variable for each multiset of lengths
that fits a sequence; every class must be covered) by multiplicative weights: each round
prices the best configuration by a knapsack dynamic program over the class weights, takes a
step of it, and lowers the weights of the classes that it covers. The fractional solution is
rounded down; what is left goes, longest first, into the fullest sequence that has room.

The plan is a list of intervals: the pieces of one length with ranks lo to hi go to so many
sequences at one offset. Ranks come from counts of bounded slices of each length, so a length
that a third of all rows share is ranked by many tasks.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyforge.llm.common import running_offsets, staged, table

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k"
ROUNDS = 1200
STEP = 0.2
#: Pieces of one length that one task ranks.
SLICE_ROWS = 1000


@functools.lru_cache(maxsize=2)
def _encoder(name: str):
    """text -> ids, as the tokenizers library gives them for <name>.json without special tokens added.

    The same vocabulary as ranks is several times faster; texts that hold the string of an
    added token, which the tokenizers library takes for that token, go to that library.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    full = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    added = [token.content for token in full.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(token in text for token in added):
            return full.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def piece_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """The pieces of a document of n ids: only longer ones are cut, and the first piece has the rest."""
    if n <= capacity:
        return [n]
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def tokenized_pieces(
    documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each document's pieces; a null text is empty."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                    start = 0
                    for i, n in enumerate(piece_lengths(len(ids), capacity)):
                        own = ids[start : start + n]
                        rows.append((doc_id, i, start, n, zlib.crc32(own.tobytes()), own if with_ids else None))
                        start += n
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(columns[j], kind) for j, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([own.astype(np.int32) for own in columns[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return documents.select("doc_id", "text").mapInArrow(made, schema)


def best_configuration(worth: np.ndarray) -> dict[int, int]:
    """The multiset of lengths, at most len(worth) - 1 in all, with the largest total worth (knapsack by dynamic programming)."""
    capacity = len(worth) - 1
    most, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        totals = worth[1 : c + 1] + most[c - 1 :: -1][:c]
        pick[c] = totals.argmax() + 1
        most[c] = totals[pick[c] - 1]
        if most[c] <= most[c - 1]:
            most[c], pick[c] = most[c - 1], 0
    chosen: dict[int, int] = defaultdict(int)
    c = capacity
    while c > 0:
        if pick[c]:
            chosen[int(pick[c])] += 1
        c -= max(1, int(pick[c]))
    return dict(chosen)


def fractional_cover(histogram: np.ndarray, rounds: int = ROUNDS, step: float = STEP) -> dict[tuple[tuple[int, int], ...], float]:
    """Configurations and amounts that cover the histogram about once, by multiplicative weights."""
    demand = histogram.astype(np.float64)
    present = demand > 0
    weights = np.where(present, np.arange(len(demand)) / (len(demand) - 1), 0.0)
    amounts: dict[tuple[tuple[int, int], ...], float] = defaultdict(float)
    for _ in range(rounds):
        worth = np.where(present, weights, 0.0)
        chosen = {n: min(k, int(histogram[n])) for n, k in best_configuration(worth).items()}
        lengths = np.array(list(chosen))
        counts = np.array(list(chosen.values()), dtype=np.float64)
        limit = (demand[lengths] / counts).min()
        amounts[tuple(sorted(chosen.items(), reverse=True))] += limit
        weights[lengths] *= np.exp(-step * limit * counts / demand[lengths])
        weights /= weights.max()
    covered = sum(amount * n * k for config, amount in amounts.items() for n, k in config)
    scale = float((demand * np.arange(len(demand))).sum()) / covered
    return {config: amount * scale for config, amount in amounts.items()}


def plan_sequences(histogram: np.ndarray, rounds: int = ROUNDS, step: float = STEP) -> list[tuple[tuple[int, ...], int]]:
    """Groups (lengths, count): so many sequences hold pieces of these lengths each. Every piece is placed once."""
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    groups: dict[tuple[int, ...], int] = defaultdict(int)
    groups[(capacity,)] = int(left[capacity])
    left[capacity] = 0
    if left.sum() > 2:
        for config, amount in sorted(fractional_cover(left, rounds, step).items(), key=lambda x: (-x[1], x[0])):
            times = min([int(amount), *(int(left[n]) // k for n, k in config)])
            if times > 0:
                groups[tuple(n for n, k in config for _ in range(k))] += times
                for n, k in config:
                    left[n] -= k * times
    gaps: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for lengths, times in groups.items():
        if times:
            gaps[capacity - sum(lengths)][lengths] = times

    def put(lengths: tuple[int, ...], times: int) -> None:
        room = gaps[capacity - sum(lengths)]
        room[lengths] = room.get(lengths, 0) + times

    for n in range(capacity - 1, 0, -1):
        while left[n]:
            gap = next((g for g in range(n, capacity) if gaps.get(g)), None)
            if gap is None:
                each = min(capacity // n, int(left[n]))
                times = int(left[n]) // each
                put((n,) * each, times)
                left[n] -= each * times
                continue
            lengths = min(gaps[gap])
            times = min(gaps[gap][lengths], int(left[n]))
            gaps[gap][lengths] -= times
            if not gaps[gap][lengths]:
                del gaps[gap][lengths]
            put((*lengths, n), times)
            left[n] -= times
    return [(lengths, times) for room in gaps.values() for lengths, times in room.items()]


def intervals(groups: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """The plan as columns length, lo, sequence, offset, in the order of (length, lo).

    The piece of that length with rank r, lo being the last one not above r, goes to sequence
    sequence + r - lo at the offset.
    """
    rows, used, base = [], defaultdict(int), 0
    for lengths, times in groups:
        offset = 0
        for n in lengths:
            rows.append((n, used[n], base, offset))
            used[n] += times
            offset += n
        base += times
    columns = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return tuple(columns.T)


def _ranked(pieces: DataFrame) -> DataFrame:
    """pieces with rank, from 0 within their length."""
    sizes = pieces.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias("slices"))
    # A row for each length: at most the capacity, whatever the input.
    sliced = pieces.join(F.broadcast(sizes), "length").withColumn(
        "slice", F.pmod(F.xxhash64("doc_id", "piece"), F.col("slices")).cast("int")
    )
    counts = sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("rows"))
    offsets = running_offsets(counts, "length", "slice", "rows")
    within = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    return (
        sliced.withColumn("nth", F.row_number().over(within) - 1)
        .join(offsets, ["length", "slice"])
        .withColumn("rank", F.col("offset") + F.col("nth"))
        .drop("slices", "slice", "nth", "offset")
    )


def pack_documents(
    documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """For each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and its ids).

    Null and empty texts are a piece of the end id alone. Repeated rows are packed each. An
    empty table gives no rows.
    """
    pieces = staged(tokenized_pieces(documents, tokenizer, capacity, end_id, with_ids), "pieces")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # a row for each length, capacity at most
        histogram[row["length"]] = row["count"]
    length, lo, sequence, offset = intervals(plan_sequences(histogram))
    keys = (length << 48) + lo
    ranked = _ranked(pieces)
    columns = [c for c in ranked.columns if c != "rank"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (batch.column("length").to_numpy() << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(sequence[at] + rank - lo[at]), pa.array(offset[at])],
                names=[*columns, "sequence_id", "offset"],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(placed, f"{fields}, sequence_id long, offset long")


NAME = "op7_packing"
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
