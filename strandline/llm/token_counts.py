"""Token counts of whole texts, from Arrow batches, without keeping the tokens.

The vocabulary's library encodes lists of texts that are balanced by bytes.  A
long text is split where it cannot change the count: at a single space between
characters that are not white space.  Pieces of this kind of vocabulary never
reach across such a space, and each part after it gets, as a text of its own, the
same word-start mark that the space would have been.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import find_package, slices

#: Bytes of text in one call of the library; characters of a part of a long text, about.
CALL_BYTES, PART = 1 << 18, 1 << 14
#: A space between two characters neither of which is white space or the word-start mark.
SAFE = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")


@lru_cache(2)
def load(path: str):
    """Once for each Python worker."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def split(text: str, part: int = PART) -> list[str]:
    """The text cut at safe spaces, into parts of about `part` characters or, where there is none, longer ones."""
    parts, low = [], 0
    while len(text) - low > part and (cut := SAFE.search(text, low + part)):
        parts.append(text[low : cut.start()])
        low = cut.end()
    return [*parts, text[low:]]


def count_tokens(documents: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """How many tokens the library for `path` makes of each whole text.

    documents: doc_id, text; other columns are not read.  path: a sentencepiece model
    that each executor can read.  Returns doc_id, n_bytes (UTF-8), n_tokens (no begin
    or end token), over_limit (n_tokens > limit).  A null or empty text has none.  One
    row comes out for each row that goes in, repeated ones too.
    """
    find_package(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in slices(batches):
            counts = np.zeros(batch.num_rows, np.int64)
            parts, rows, size = [], [], 0

            def flush(parts: list[str], rows: list[int], counts: np.ndarray) -> None:
                np.add.at(counts, rows, [len(ids) for ids in model.encode(parts, num_threads=1)])

            for row, text in enumerate(batch.column(1)):
                for part in split(text.as_py() or ""):
                    parts.append(part)
                    rows.append(row)
                    size += len(part)
                    if size >= CALL_BYTES:
                        flush(parts, rows, counts)
                        parts, rows, size = [], [], 0
            if parts:
                flush(parts, rows, counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    source = documents.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    counted = source.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
