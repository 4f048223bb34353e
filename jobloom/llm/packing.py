"""Best-fit packing of token pieces with dominance reduction.

Lengths are whole numbers up to the capacity, so an instance is a histogram of at most ``capacity``
counts however many documents there are. The plan is made on the histogram: first sets of up to three
lengths that provably dominate every alternative for their longest member are fixed (Martello and Toth),
which shrinks the instance; the remainder is packed best-fit decreasing, whole runs of equal lengths at a
time. The plan names ranges of ranks within a length. Pieces are numbered where they are cut, by task and
length, so that a rank is that number plus the count of pieces in the tasks before, and only the ids
themselves are shuffled, once. The sequences are written with them; the digest of the query is read from them.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.llm.memory import give_back
from jobloom.llm.numbering import join_hint
from jobloom.llm.scratch import discard, materialize
from jobloom.llm.tokens import WordTokenizer, forget


class Run(NamedTuple):
    """Pieces of ``length`` with ranks ``lo`` to ``hi`` lie at ``offset`` of ``sequence``, ``sequence + 1``, ..."""

    length: int
    lo: int
    hi: int
    sequence: int
    offset: int


def _dominating(w: int, capacity: int, have: list[int], count: dict[int, int]) -> tuple[int, ...] | None:
    """A set of up to three lengths, ``w`` the longest, that dominates every feasible set with ``w``.

    ``have`` are the available lengths, ascending. A set dominates another if the other's members can be
    dealt to members of the first that are at least as long as their sum.
    """
    room = capacity - w

    def left(x: int, *used: int) -> int:
        return count[x] - (w == x) - used.count(x)

    def fit(most: int, *used: int) -> int | None:
        k = bisect_left(have, most + 1) - 1
        while k >= 0 and left(have[k], *used) < 1:
            k -= 1
        return have[k] if k >= 0 else None

    def smallest(n: int, over: int) -> list[int]:
        out: list[int] = []
        for x in have[bisect_left(have, over + 1) :]:
            out += [x] * min(n - len(out), left(x))
            if len(out) == n:
                break
        return out

    best = fit(room)
    if best is None:
        return (w,)
    two = smallest(2, 0)
    if best == room or len(two) < 2 or sum(two) > room:
        return (w, best)  # no other member, or no pair, is longer
    three = smallest(3, 0)
    if len(three) < 3 or sum(three) > room:  # at most two fit beside w
        second = fit(room - best, best)
        if second is not None:
            above = smallest(2, second)
            if len(above) < 2 or sum(above) > room:
                return (w, best, second)
    return None


def reduce_by_dominance(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets and take them out of ``count``; returns (lengths, times)."""
    fixed: list[tuple[tuple[int, ...], int]] = []
    again = True
    while again:
        again = False
        for w in sorted(count, reverse=True):
            while count.get(w):
                have = sorted(count)
                chosen = _dominating(w, capacity, have, count)
                if chosen is None:
                    break
                times = min(count[x] // chosen.count(x) for x in chosen)
                fixed.append((chosen, times))
                for x in chosen:
                    count[x] -= times
                for x in set(chosen):
                    if not count[x]:
                        del count[x]
                again = True
    return fixed


def best_fit_decreasing(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Pack what ``count`` holds, longest first, each into the fullest sequence that has room."""
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # room left -> contents -> sequences

    def put(room: int, content: tuple[int, ...], times: int) -> None:
        bins[room][content] = bins[room].get(content, 0) + times

    for w in sorted(count, reverse=True):
        n = count[w]
        rooms = sorted(room for room in bins if room >= w)
        k = 0
        while n and k < len(rooms):
            room = rooms[k]
            if not bins.get(room):
                bins.pop(room, None)
                k += 1
                continue
            content, times = bins[room].popitem()
            used = min(n, times)
            if used < times:
                bins[room][content] = times - used
            put(room - w, (*content, w), used)
            n -= used
            if room - w >= w:  # now the fullest with room for w
                rooms = sorted(room for room in bins if room >= w)
                k = 0
        each = capacity // w
        if n >= each:
            put(capacity - each * w, (w,) * each, n // each)
        if n % each:
            put(capacity - (n % each) * w, (w,) * (n % each), 1)
    return [(content, times) for group in bins.values() for content, times in group.items() if times]


def plan(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Places for all pieces of a histogram of lengths."""
    count = {w: n for w, n in histogram.items() if n}
    groups = reduce_by_dominance(count, capacity)
    groups += best_fit_decreasing(count, capacity)
    taken: dict[int, int] = defaultdict(int)
    runs: list[Run] = []
    sequence = 0
    for lengths, times in groups:
        offset = 0
        for w in lengths:
            runs.append(Run(w, taken[w], taken[w] + times, sequence, offset))
            taken[w] += times
            offset += w
        sequence += times
    return runs


def _cut(path: str, capacity: int, separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tokenizer, packer = WordTokenizer.at(path), zstandard.ZstdCompressor(level=3)
        task, met = TaskContext.get().partitionId(), Counter()
        names = ["doc_id", "piece", "start", "length", "task", "nth", "ids"]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        give_back()
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                rows = []
                encoded = tokenizer.encode([text or "" for text in part.column(1).to_pylist()])
                for doc_id, found in zip(part.column(0).to_pylist(), encoded, strict=True):
                    ids = np.append(found, np.uint32(separator)).astype("<u4")
                    start, piece = 0, 0
                    while start < len(ids):
                        # the first piece takes what is over, so that the others are full
                        length = (len(ids) - start) % capacity or capacity
                        own = ids[start : start + length]
                        packed = packer.compress(own.astype("<u2" if own.max() < 1 << 16 else "<u4").tobytes())
                        rows.append((doc_id, piece, start, length, task, met[length], packed))
                        met[length] += 1
                        start, piece = start + length, piece + 1
                arrays = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
            give_back()

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """Pieces ``(doc_id, piece, start, length, task, nth, ids)`` of the documents' token ids and a separator.

    ``ids`` are little-endian numbers of two bytes, or of four in a piece with an id over 65,535, compressed by
    Zstandard; ``nth`` counts the pieces of a length that ``task`` has cut. A document longer than the capacity
    is cut; its first piece may be shorter than the capacity and the others are full. A null text counts as
    empty and gives the separator alone.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _cut(tokenizer_path, capacity, separator),
        "doc_id long, piece int, start long, length long, task int, nth long, ids binary",
    )


_PIECES = "array<struct<doc_id: bigint, piece: int, start: bigint, length: bigint, offset: bigint>>"
_PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64())]


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces in the order of their places, the sequences with the ids of their pieces one after another."""
    import zstandard

    unpacker = zstandard.ZstdDecompressor()

    def whole(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        of = {name: part.column(name).combine_chunks() for name in part.column_names}
        number, length = of["sequence_id"].to_numpy(), of["length"].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        ends = np.concatenate(([0], np.cumsum(length)))
        begins = np.append(first, len(number))
        packed = map(unpacker.decompress, of["ids"].to_pylist())
        ids = [np.frombuffer(data, f"<u{len(data) // n}").astype(np.int32) for data, n in zip(packed, length.tolist(), strict=True)]
        pieces = pa.StructArray.from_arrays([of[name] for name, _ in _PIECE], names=[name for name, _ in _PIECE])
        arrays = [
            pa.array(number[first]),
            pa.ListArray.from_arrays(pa.array(ends[begins], pa.int32()), pa.array(np.concatenate(ids))),
            pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pieces),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["sequence_id", "ids", "pieces"])

    forget()  # what has cut the pieces is no longer needed
    give_back()
    held: pa.Table | None = None  # the pieces of the last sequence, which may go on in the next batch
    for batch in (full.slice(at, 500) for full in batches for at in range(0, len(full), 500)):
        part = pa.Table.from_batches([batch])
        part = part if held is None else pa.concat_tables([held, part])
        number = part.column("sequence_id").to_numpy()
        last = int(np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))[-1])
        if last:
            yield whole(part.slice(0, last))
        held = part.slice(last)
    if held is not None:
        yield whole(held)
    give_back()


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows whose last column is an array of ids, the checksum of these in its place."""
    forget()
    give_back()
    for batch in (full.slice(at, 1000) for full in batches for at in range(0, len(full), 1000)):
        own = batch.column(batch.num_columns - 1)
        tokens = own.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = np.cumsum(pc.list_value_length(own).to_numpy(zero_copy_only=False)).tolist()
        crc = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip([0, *ends], ends, strict=False)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crc, pa.int64())], names=[*batch.schema.names[:-1], "ids_crc32"])


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """Pack all documents into as few sequences of ``capacity`` tokens as the method finds.

    Returns the written table of sequences: ``sequence_id, ids, pieces``, with the token ids of the pieces
    ``(doc_id, piece, start, length, offset)`` one after another from offset 0. Null texts count as empty;
    repeated rows and a null doc_id are packed like any other row; an empty table gives no rows; other
    columns are ignored.
    """
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity, separator), "pieces")
    counts = materialize(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(histogram, capacity)
    places = docs.sparkSession.createDataFrame(
        runs or [Run(0, 0, 0, 0, 0)], "w long, lo long, hi long, sequence long, offset long"
    )
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    ranked = pieces.join(begins.hint(join_hint(counts.count())), ["length", "task"])
    ranked = ranked.withColumn("rank", F.col("begin") + F.col("nth"))
    # The plan has a few rows per length whatever the number of documents.
    placed = ranked.join(
        F.broadcast(places),
        (F.col("length") == F.col("w")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")),
    )
    sequence = (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id")
    parts = placed.select(sequence, "offset", "doc_id", "piece", "start", "length", "ids").repartition("sequence_id")
    filled = parts.sortWithinPartitions("sequence_id", "offset").mapInArrow(_filled, f"sequence_id long, ids array<int>, pieces {_PIECES}")
    filled = materialize(filled, "sequences", compression="zstd")
    discard(pieces, counts)
    return filled


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """The digest of ``sequences()``, read from the written table.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    """
    made = sequences(docs, tokenizer_path, capacity, separator)
    rows = made.select("sequence_id", "ids", F.explode("pieces").alias("piece"))
    rows = rows.select(
        "piece.doc_id", "piece.piece", "piece.start", "piece.length", "sequence_id", "piece.offset",
        F.slice("ids", (F.col("piece.offset") + 1).cast("int"), F.col("piece.length").cast("int")).alias("ids"),
    )
    return rows.mapInArrow(
        _checksums, "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids_crc32 long"
    )
