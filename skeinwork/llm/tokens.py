"""Token tables: encode whole texts, decode them back, and pack them into sequences.

encode_decode: null text is empty and has no ids; extra columns are ignored; repeated
rows come out repeated.

pack: every document is its ids and the end id. A task gathers documents until they
fill BLOCK_SEQUENCES sequences, and deals them out in descending length: each goes to
the sequence of lowest cost (a linear and a quadratic share, as attention has it) that
still has room for it; a document that fits nowhere fills up the cheapest sequence
with room and goes on with the rest. Whole sequences' worth of a long document are
cut off first. Every sequence of a block ends full; what is over goes into the next
block, and the last rest of a task into sequences whose lengths are powers of two,
which take no padding. A block is all a task holds, whatever its input, and a task
that runs again makes the same sequences. Null text is empty (the end id alone);
rows with a null id are packed like any other.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import bpe, common, ragged

CAPACITY, BLOCK_SEQUENCES = 4096, 256
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (dense layers and attention of a mid-sized model).
LINEAR, QUADRATIC = 1.0, 1.0 / 4096


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), and the ids themselves on demand; each text is encoded, then decoded from its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(path)
        for batch in batches:
            for a, b, data, at in ragged.slices(batch.column(1)):
                ids, start = encoder.encode(data, at)
                own = [ids[x:y] for x, y in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array(np.diff(start), pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own]),
                    pa.array([hashlib.sha256(encoder.v.decode(x)).hexdigest() for x in own]),
                ]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in own], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    common.small_batches(df.sparkSession)
    docs = common.only(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    return docs.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


class Block:
    """Documents of one task on their way into sequences."""

    def __init__(self, capacity: int, sequences: int):
        self.capacity, self.most = capacity, capacity * sequences
        self.pieces: list[tuple[int, int, int]] = []  # (document, start, length)
        self.held = 0

    def add(self, document: int, length: int) -> None:
        self.pieces.append((document, 0, length))
        self.held += length

    def deal(self, last: bool) -> Iterator[list[tuple[int, int, int]]]:
        """The sequences of the block, each a list of pieces in order; the rest stays, or comes out in powers of two."""
        c, rest = self.capacity, []
        for d, s, n in self.pieces:
            for k in range(n // c):
                yield [(d, s + k * c, c)]
            if n % c:
                rest.append((d, s + n - n % c, n % c))
        rest.sort(key=lambda p: -p[2])
        bins = sum(p[2] for p in rest) // c
        room, cost = np.full(bins, c), np.zeros(bins)
        filled: list[list[tuple[int, int, int]]] = [[] for _ in range(bins)]
        free, over = bins * c, []
        for d, s, n in rest:
            while n and free:
                fits = np.where(room >= n, cost, np.inf)
                k = int(fits.argmin())
                if fits[k] == np.inf:
                    k = int(np.where(room > 0, cost, np.inf).argmin())
                take = min(n, int(room[k]))
                filled[k].append((d, s, take))
                cost[k] += LINEAR * take + QUADRATIC * take * take
                room[k] -= take
                free -= take
                s, n = s + take, n - take
            if n:
                over.append((d, s, n))
        yield from filled
        self.pieces, self.held = over, sum(p[2] for p in over)
        if last:
            left = self.held
            for k in reversed(range(left.bit_length())):
                if left >> k & 1:
                    size, own = 1 << k, []
                    while size:
                        d, s, n = self.pieces[0]
                        take = min(n, size)
                        own.append((d, s, take))
                        size -= take
                        self.pieces[:1] = [(d, s + take, n - take)] if n > take else []
                    yield own
            self.held = 0


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2, capacity: int = CAPACITY, sequences: int = BLOCK_SEQUENCES, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and a piece's ids on demand; one row a piece."""
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def rows(block: Block, held: dict[int, tuple[int | None, np.ndarray]], first: int, last: bool) -> tuple[pa.RecordBatch, int]:
        out: list[tuple] = []
        for pieces in block.deal(last):
            offset = 0
            for d, s, n in pieces:
                key, ids = held[d]
                own = ids[s : s + n]
                out.append((key, s, n, zlib.crc32(own.astype("<u4").tobytes()), len(ids), first, offset, *([own.tolist()] if with_ids else [])))
                offset += n
            first += 1
        stay = {d for d, _, _ in block.pieces}
        for d in [d for d in held if d not in stay]:
            del held[d]
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns[:7]] + [pa.array(x, pa.list_(pa.int32())) for x in columns[7:]], names), first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(path)
        block, held, number = Block(capacity, sequences), {}, 0
        next_id = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, _, data, at in ragged.slices(batch.column(1)):
                ids, start = encoder.encode(data, at)
                for r, (x, y) in enumerate(zip(start[:-1].tolist(), start[1:].tolist(), strict=True)):
                    held[number] = batch.column(0)[a + r].as_py(), np.append(ids[x:y], ids.dtype.type(end_id))
                    block.add(number, y - x + 1)
                    number += 1
                    if block.held >= block.most:
                        made, next_id = rows(block, held, next_id, False)
                        yield made
        made, next_id = rows(block, held, next_id, True)
        yield made

    common.small_batches(df.sparkSession)
    docs = common.only(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    return docs.mapInArrow(run, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
