"""Token counts: lengths only, from batches of about equal bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm._text import small_batches, steps, text_bytes
from docloom.llm._tokens import ENCODE_BYTES, LengthEncoder, encoder


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, tokenizer_path: str | None = None) -> DataFrame:
    """Bytes and tokens of every text.

    ``n_tokens`` is what the library returns for the whole text without added special tokens. Spark deals
    partitions by bytes of input; inside a task, texts are taken in steps of about equal bytes and cut at
    boundaries that the pre-tokenizer never crosses, so a long text costs no more memory than a step.
    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; an empty table gives an
    empty result; other columns, whatever their names, are not read.
    """
    path = tokenizer_path or default_tokenizer()
    small_batches(docs.sparkSession)
    kept = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text", ENCODE_BYTES):
                _, offsets = text_bytes(step.column(1))
                n = encoder(LengthEncoder, path).lengths(step.column(1))
                yield pa.RecordBatch.from_arrays([step.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
