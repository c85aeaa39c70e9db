"""A bounded membership filter that runs inside the scan.

Keys set bits of a fixed bitmap (2**25 bits, so at most 1,024 rows of 4 KB each:
4 MB, whatever the data).  A row whose bit is clear is certainly not among the
keys; the others go on to an exact join.  With very many keys it lets more rows
through and stays correct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 25
_PER_ROW = 32768


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << BITS))


def bitmap_of(keys: DataFrame, key: str) -> DataFrame:
    """(slot_row, bits): at most 2**BITS / 32768 rows."""
    s = keys.select(_slot(F.col(key)).alias("s"))
    return s.groupBy(F.expr(f"s div {_PER_ROW}").alias("slot_row")).agg(F.bitmap_construct_agg(F.col("s") % _PER_ROW).alias("slot_bits"))


def flag(df: DataFrame, key: str, bitmap: DataFrame, name: str) -> DataFrame:
    """df with a boolean column: false only where the key is certainly not in the bitmap."""
    s = df.withColumn("slot_no", _slot(F.col(key))).withColumn("slot_row", F.expr(f"slot_no div {_PER_ROW}"))
    joined = s.join(F.broadcast(bitmap), "slot_row", "left")  # at most 4 MB, see above
    bit = F.expr(f"getbit(cast(conv(hex(substring(slot_bits, cast((slot_no % {_PER_ROW}) div 8 as int) + 1, 1)), 16, 10) as bigint), cast(slot_no % 8 as int)) = 1")
    return joined.withColumn(name, F.coalesce(bit, F.lit(False))).drop("slot_no", "slot_row", "slot_bits")
