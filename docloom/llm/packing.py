"""Best-fit packing of token pieces into sequences of bounded length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._text import small_batches, steps
from docloom.llm._tokens import ENCODE_BYTES, IdEncoder, encoder
from docloom.session import cut


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of ``capacity`` ids where there are more.

    Null texts are empty texts: one piece with ``end_id`` alone. Columns: id, piece, start, length, ids_crc32
    and, if asked for, ``ids`` (array of ints).
    """
    path = tokenizer_path or default_tokenizer()
    small_batches(docs.sparkSession)
    kept = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text", ENCODE_BYTES):
                row, piece, length, crc, ids = [], [], [], [], []
                flat, offsets = encoder(IdEncoder, path).ids(step.column(1))
                for i in range(step.num_rows):
                    got = np.concatenate([flat[offsets[i] : offsets[i + 1]], end])
                    for k, at in enumerate(range(0, len(got), capacity)):
                        part = got[at : at + capacity]
                        row.append(i)
                        piece.append(k)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            ids.append(part.astype(np.int32))
                n = np.array(piece, dtype=np.int64)
                columns = [step.column(0).take(pa.array(row)), pa.array(n.astype(np.int32)), pa.array(n * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, in the order given.

    An item goes to the open bin with the least free space that holds it. The free spaces of the open bins are
    the set bits of one integer. If no bin holds the item and ``open_bins`` are open, the fullest closes and a
    new one opens. A full bin closes at once. Of bins with equal space, the one that came there last is taken.
    """
    bits, by_space, bins, offsets, made, opened = 0, [[] for _ in range(capacity + 1)], [], [], 0, 0
    for n in lengths:
        fits = bits >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                bits ^= 1 << space
        else:
            if opened >= open_bins:
                fullest = (bits & -bits).bit_length() - 1
                by_space[fullest].pop()
                if not by_space[fullest]:
                    bits ^= 1 << fullest
                opened -= 1
            space, b, made = capacity, made, made + 1
            opened += 1
        bins.append(b)
        offsets.append(capacity - space)
        left = space - n
        if left:
            by_space[left].append(b)
            bits |= 1 << left
        else:
            opened -= 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 4096, open_bins: int = 1024, rows_per_packer: int = 40_000, id_col: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to token pieces.

    Only the pieces' sizes move: they are dealt to packers by a hash of document and piece, so that each packer
    sees the same mix of sizes, and their number follows the number of pieces. Each packer keeps at most
    ``open_bins`` open sequences. A piece as long as a sequence is a sequence alone. Ties and repeated rows keep
    separate places. An empty table gives an empty result.
    """
    pieces = cut(pieces)
    packers = -(-pieces.count() // rows_per_packer) or 1
    order = F.xxhash64(F.col(id_col), "piece", "ids_crc32")
    keyed = pieces.withColumn("packer", F.pmod(order, F.lit(packers)).cast("long"))

    def run(table: pa.Table) -> pa.Table:
        packer = table.column("packer")[0].as_py() if table.num_rows else 0
        keys = [(c, "ascending") for c in ("order", id_col, "piece")]
        table = table.sort_by(keys)
        bins, offsets = best_fit(table.column("length").to_pylist(), capacity, open_bins)
        table = table.drop_columns(["packer", "order"])
        table = table.append_column("sequence_id", pa.array(np.array(bins, dtype=np.int64) + (packer << 32)))
        return table.append_column("offset", pa.array(offsets, pa.int64()))

    # what the first pass mixes is the order, so it must not be the number that chose the packer
    keyed = keyed.withColumn("order", F.xxhash64(F.lit(17), F.col(id_col), "piece"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return keyed.groupBy("packer").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = 4096, open_bins: int = 1024, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenizes and packs documents; see ``token_pieces`` and ``pack``."""
    return pack(token_pieces(docs, capacity, id_col=id_col, text_col=text_col, tokenizer_path=tokenizer_path), capacity, open_bins, id_col=id_col)
