"""Token counts of whole texts."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from slotcast.llm import byte_bpe, spans


def token_counts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    limit: int = 512,
    vocabulary: str = byte_bpe.VOCABULARY,
    batch_bytes: int = spans.SLICE_BYTES,
) -> DataFrame:
    """Bytes and tokens of every text, as the vocabulary's library counts them.

    An Arrow function encodes batches of about ``batch_bytes`` each, whatever the
    number of rows in them, and returns lengths only. Texts are cut where a run
    of white space begins, a boundary no token crosses, so a very long text never
    goes to the library in one call. Each distinct piece is encoded once.

    Null and empty texts have 0 bytes and 0 tokens. Rows with equal or null keys
    are counted on their own. Other columns aren't read.

    Returns ``key``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit``).
    """
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe.encoder(vocabulary)
        for batch in batches:
            data, offsets = spans.utf8(batch.column(1))
            tokens = np.zeros(len(offsets) - 1, np.int64)
            for low, high in spans.slices(offsets, batch_bytes):
                part = offsets[low : high + 1] - offsets[low]
                row, _, length = encoder.locate(data[offsets[low] : offsets[high]], part)
                tokens[low:high] = np.bincount(row, length, high - low)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(offsets)),
                    pa.array(tokens),
                    pa.array(tokens > limit),
                ],
                names=["k", "n_bytes", "n_tokens", "over_limit"],
            )

    schema = f"k {kind}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(key, text).mapInArrow(count, schema).withColumnRenamed("k", key)
