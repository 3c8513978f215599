"""Operator 9, token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cuewright.llm.common import arrow_schema, packets, picked, prepare
from cuewright.llm.words import WordMemo, drops_white_space, library, pieces, words_of

#: Bytes of text that are encoded together, and the longest run of a text that is split in one go.
PACKET_BYTES = 8 << 20
PIECE_BYTES = 1 << 20


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Token count of every text as the library of the vocabulary file gives it.

    Returns one row per input row: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).
    No begin, end or added special tokens; special strings inside texts get the library's default
    treatment; nothing is truncated or padded. Batches are regrouped to about PACKET_BYTES of text
    before the library is called. A text longer than PIECE_BYTES is cut at ASCII white space where
    the tokenizer drops white space (a safe boundary: no token crosses it); otherwise it is encoded whole.

    Null text: counted as empty (0 bytes, 0 tokens). Null ids and repeated rows: kept, one row each.
    Empty table: empty result. Other columns are not read, whatever their names. Narrow plan, no shuffle.
    """
    prepare(docs.sparkSession)
    source = picked(docs, **{"id": id_col, "text": text_col})
    schema = T.StructType(
        [T.StructField(id_col, source.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    )
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordMemo(vocabulary, len) if vocabulary.endswith(".json") and drops_white_space(vocabulary) else None

        def counted(texts: list[bytes], owners: list[int], n: int) -> np.ndarray:
            """Tokens of runs of text, summed by owner."""
            words, chosen, sizes = words_of(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
            of_word = np.array(memo.of(words), np.int64) if words else np.empty(0, np.int64)
            return np.bincount(np.repeat(np.array(owners, np.int64), sizes), weights=of_word[chosen], minlength=n).astype(np.int64)

        for batch in batches:
            for part in packets(batch, "text", PACKET_BYTES):
                texts = [(x or "").encode("utf-8") for x in part.column("text").to_pylist()]
                if memo is not None:
                    counts, held, owners, size = np.zeros(len(texts), np.int64), [], [], 0
                    for i, data in enumerate(texts):
                        for piece in pieces(data, PIECE_BYTES):  # cut where no token crosses, so a long text is counted run by run
                            held.append(piece)
                            owners.append(i)
                            size += len(piece)
                            if size >= PACKET_BYTES:
                                counts += counted(held, owners, len(texts))
                                held, owners, size = [], [], 0
                    counts = (counts + counted(held, owners, len(texts))).tolist()
                else:
                    counts = [len(ids) for ids in library(vocabulary)([x.decode("utf-8") for x in texts])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(map(len, texts), pa.int64()), pa.array(counts, pa.int64()), pa.array((n > limit for n in counts), pa.bool_())], schema=out_schema
                )

    return source.mapInArrow(run, schema)
