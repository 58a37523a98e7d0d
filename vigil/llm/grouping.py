"""Global questions about hashes, without joining texts.

Documents are dealt into groups of about GROUP_BYTES of text. Each group sends one
row for each of its distinct keys, Spark brings the rows of a key together, and the
answers go back to the groups that need them. Groups then read their documents again
(the same exchange) beside the answers. Rows grow with the text, nothing passes the
driver, and a key in a third of all documents costs one row a group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def squeeze(sorted_hashes: np.ndarray) -> bytes:
    """Sorted distinct 64-bit hashes as fixed-width differences."""
    if not len(sorted_hashes):
        return b""
    step = np.diff(sorted_hashes, prepend=np.uint64(0))
    width = max(1, (int(step[1:].max()).bit_length() + 7) // 8) if len(step) > 1 else 1
    low = step[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(step[0]).to_bytes(8, "little") + low.tobytes()


def expand(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.uint64)
    width = packed[0]
    low = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, width)
    step = np.zeros((len(low) + 1, 8), np.uint8)
    step[1:, :width] = low
    step = step.view("<u8").reshape(-1)
    step[0] = int.from_bytes(packed[1:9], "little")
    return np.cumsum(step, dtype=np.uint64)


def numbered(docs: DataFrame, groups: int) -> DataFrame:
    """The documents with their group's number `grp`: rows of one doc_id together, rows without one by their text."""
    number = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(groups))
    return docs.withColumn("grp", number.cast("long"))


def dealt(docs: DataFrame, groups: int) -> DataFrame:
    """The same, dealt out by the number."""
    return numbered(docs, groups).repartition(groups, "grp")
