"""A bitmap of hashed ids of bounded size, to let rows by that surely are not among them before a join moves their texts.

The bitmap is a table of segments (at most ``MOST_BITS`` bits, 16 MB, whatever the number of
ids) that is broadcast; rows look up their bit in it without a shuffle and without Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.spill import settle

#: Bits for each id, and the bounds of a bitmap; with more ids than it holds well, more rows take the join, and results stay the same.
BITS_AN_ID, LEAST_BITS, MOST_BITS = 16, 1 << 15, 1 << 27
#: Bits of a segment, as Spark's bitmap functions have them.
_SEGMENT = 1 << 15


class Sieve:
    """Which ids may be among those of a column."""

    def __init__(self, ids: DataFrame, column: str):
        n = max(1, ids.count())
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_AN_ID * n - 1).bit_length()))
        at = self._place(column) + 1
        rows = ids.where(F.col(column).isNotNull()).select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p"))
        self.segments = settle(rows.groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).select((F.col("b") - 1).alias("segment_of_id"), F.col("bits").alias("bits_of_id")))

    def _place(self, key: str):
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.bits))

    def rows(self, df: DataFrame, key: str, inside: bool) -> DataFrame:
        """Rows whose id may be among those (``inside``), or surely is not; a null id is not."""
        place = F.when(F.col(key).isNotNull(), self._place(key))
        placed = df.withColumns({"place_of_id": place, "segment_of_id": F.floor(place / F.lit(_SEGMENT))})
        byte = F.conv(F.hex(F.expr(f"substring(bits_of_id, cast(shiftright(place_of_id % {_SEGMENT}, 3) as int) + 1, 1)")), 16, 10).cast("int")
        bit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.col("place_of_id") % 8)), F.lit(2)) == 1
        hit = F.coalesce(bit, F.lit(False))
        return placed.join(F.broadcast(self.segments), "segment_of_id", "left").where(hit if inside else ~hit).select(*(F.col(f"`{c}`") for c in df.columns))
