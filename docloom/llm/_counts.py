"""Counts of 64-bit keys over a whole corpus, asked for and answered block by block.

Rows are put into blocks of bounded bytes as they come, whatever their ids, and blocks are kept compressed. The table
of counts is partitioned by hash: each block sends every distinct key once, with its own count, in runs sorted by key,
one run to each part of the key space; a part adds up the counts of all blocks and is joined back to the blocks that
sent it keys. So a key that is everywhere costs one entry per block, and what moves is packed: sorted keys as
differences in as few bytes as they need, and counts compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._text import free_memory, small_batches, steps, text_bytes
from docloom.session import clean_shuffles, cut_table

#: Bytes of text of a block, at most, and keys of a part, on average.
BLOCK_BYTES, PART_KEYS = 5 << 20, 1_500_000
REPLY = "block long, part int, place binary, total binary"


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned integers as the first and differences of equal width; the first byte is the width."""
    if not len(keys):
        return b"\x01"
    steps = np.diff(keys).astype("<u8")
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if len(data) == 1:
        return np.zeros(0, dtype=np.uint64)
    width = data[0]
    raw = np.frombuffer(data, dtype=np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(raw) + 1, 8), dtype=np.uint8)
    wide[0] = np.frombuffer(data, dtype=np.uint8, count=8, offset=1)
    wide[1:, :width] = raw
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def squeeze(data: bytes) -> bytes:
    """Compressed, for streams in which few byte values are common; the first bytes are the plain length."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def expand(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def pack_counts(counts: np.ndarray) -> bytes:
    """Unsigned integers, compressed byte by byte of their width: first all lowest bytes, then all next ones."""
    width = max(1, (int(counts.max(initial=0)).bit_length() + 7) // 8)
    planes = counts.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + squeeze(np.ascontiguousarray(planes).tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(data[1:]), dtype=np.uint8).reshape(data[0], -1)
    wide = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    wide[:, : data[0]] = planes.T
    return wide.view("<u8").ravel()


def _packed(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for part in rows:
            out.write_batch(part)
    return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([sum(len(text_bytes(part.column("text"))[0]) for part in rows)], pa.int64())], names=["rows", "bytes"])


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for step in steps(batch, "text", BLOCK_BYTES):
            n = len(text_bytes(step.column("text"))[0])
            if held and size + n > BLOCK_BYTES:
                yield _packed(held)
                held, size = [], 0
            held.append(step)
            size += n
    if held:
        yield _packed(held)


def unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(rows)).read_all().combine_chunks()


class CorpusCounts:
    """Blocks of documents (``id``, ``text``) and the exchange of counts between them."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, keys_per_byte: float, key_bits: int = 64):
        small_batches(docs.sparkSession)
        clean_shuffles(docs.sparkSession)
        kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        packed = kept.mapInArrow(_pack_rows, "rows binary, bytes long")
        # a table, as blocks must be the same ones whenever they are read
        self.docs = cut_table(packed.select(F.monotonically_increasing_id().alias("block"), "rows", "bytes"))
        self._deal(self.docs.agg(F.sum("bytes")).first()[0] or 0, keys_per_byte, key_bits)
        self.whole = False

    @classmethod
    def of_blocks(cls, rows: DataFrame, total: int, keys_per_byte: float) -> CorpusCounts:
        """Over any rows with ``id`` (long) and ``text`` of ``total`` bytes or less; all rows of one id are in one block, with all their columns."""
        me = object.__new__(cls)
        me._deal(total, keys_per_byte)
        me.docs = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(41), "id"), F.lit(me.blocks)).cast("long"))
        me.whole = True
        return me

    def _deal(self, total: int, keys_per_byte: float, key_bits: int = 64) -> None:
        self.shift = np.uint64(key_bits - 32)
        self.blocks = max(1, -(-total // BLOCK_BYTES))
        self.parts = max(1, int(-(-total * keys_per_byte // PART_KEYS)))

    def part_edges(self, keys: np.ndarray) -> np.ndarray:
        """Where the keys of each part begin among ascending keys; the last is their number."""
        part = ((keys >> self.shift) * np.uint64(self.parts)) >> np.uint64(32)
        return np.searchsorted(part, np.arange(self.parts + 1, dtype=np.uint64))

    def replies(self, count: Callable[[pa.Array | pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """``count`` gives the ascending distinct keys of a column of texts (of whole rows, if made by ``of_blocks``) and their counts."""
        me, whole = self._plain(), self.whole

        def entries(block: int, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
            edges = me.part_edges(keys)
            spans = [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            rows = [k for k, (a, b) in enumerate(spans) if b > a]
            return pa.table({
                "block": pa.array([block] * len(rows), pa.int64()), "part": pa.array(rows, pa.int32()),
                "keys": pa.array([pack_sorted(keys[spans[k][0] : spans[k][1]]) for k in rows], pa.binary()),
                "counts": pa.array([pack_counts(counts[spans[k][0] : spans[k][1]]) for k in rows], pa.binary()),
            })

        def ask(table: pa.Table) -> pa.Table:
            free_memory()  # of the block before
            return entries(table.column("block")[0].as_py(), *count(table))

        def ask_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield from entries(block, *count(_texts(unpacked(rows.as_py())))).to_batches()
                    free_memory()

        def answer(table: pa.Table) -> pa.Table:
            free_memory()
            table = table.combine_chunks()
            each = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
            own = [unpack_counts(x) for x in table.column("counts").to_pylist()]
            keys, which = np.unique(np.concatenate(each), return_inverse=True)
            total = np.zeros(len(keys), dtype=np.uint64)
            np.add.at(total, which, np.concatenate(own))
            place, sums, at = [], [], 0
            for mine in own:
                got = total[which[at : at + len(mine)]]
                at += len(mine)
                other = np.flatnonzero(got != mine)
                place.append(squeeze(pack_sorted(other.astype(np.uint64))))
                sums.append(pack_counts(got[other]))
            return pa.table({"block": table.column("block"), "part": table.column("part"), "place": pa.array(place, pa.binary()), "total": pa.array(sums, pa.binary())})

        schema = "block long, part int, keys binary, counts binary"
        asked = self.docs.groupBy("block").applyInArrow(ask, schema) if whole else self.docs.select("block", "rows").mapInArrow(ask_packed, schema)
        return cut_table(asked.groupBy("part").applyInArrow(answer, REPLY))  # so that what was asked leaves the disk

    def with_totals(self, replies: DataFrame, run: Callable[[pa.Table, Callable], pa.Table], schema: str) -> DataFrame:
        """``run`` gets each block's documents and a function from the block's ascending keys and own counts to totals."""
        me, whole = self._plain(), self.whole

        def both(docs: pa.Table, answers: pa.Table) -> pa.Table:
            free_memory()
            docs = docs if whole else unpacked(docs.column("rows")[0].as_py())

            def totals(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
                out, edges = counts.astype(np.int64), me.part_edges(keys)
                for part, place, total in zip(*(answers.column(c).to_pylist() for c in ("part", "place", "total")), strict=True):
                    at = edges[part] + unpack_sorted(expand(place)).astype(np.int64)
                    out[at] = unpack_counts(total).astype(np.int64)
                return out

            return run(docs, totals)

        return self.docs.drop("bytes").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(both, schema)

    def _plain(self) -> CorpusCounts:
        """Without DataFrames, for tasks."""
        me = object.__new__(CorpusCounts)
        me.blocks, me.parts, me.shift = self.blocks, self.parts, self.shift
        return me


def _texts(table: pa.Table) -> pa.Array:
    column = table.column("text")
    return pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
