"""Comparing all rows of a key with all others in blocks of bounded size."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it has at most this many 8-byte ids (16 MB).
MAX_BROADCAST_IDS = 2_000_000


def few_rows(df: DataFrame) -> bool:
    """Whether ``df`` has at most MAX_BROADCAST_IDS rows (it is counted)."""
    return df.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS


def host_guest_blocks(rows: DataFrame, sizes: DataFrame, key: list[str], block: int, salt: str) -> DataFrame:
    """``rows`` (key..., host, ...) dealt to blocks (key..., i, j) that together pair every host of a key with every guest.

    ``sizes`` (key..., hosts, guests) holds how many rows of both kinds a key
    has. A key with more than ``block`` of either is a grid: hosts are cut in
    i parts and guests in j parts by a hash of ``salt``, and each part goes to
    every block of its row or column, so a hot key is spread over tasks and a
    block holds about ``block`` rows of each kind. Rows come sorted by
    (key..., i, j) inside their partition; see ``runs``.
    """
    big = sizes.where((F.col("hosts") > block) | (F.col("guests") > block)).select(
        *[F.col(c).alias(f"__{c}") for c in key], F.ceil(F.col("hosts") / block).cast("int").alias("__hi"),
        F.ceil(F.col("guests") / block).cast("int").alias("__gj"))
    # only oversize keys are in it, and Spark sizes the join
    rows = rows.join(F.broadcast(big) if few_rows(big) else big, [F.col(c) == F.col(f"__{c}") for c in key], "left")
    part = F.xxhash64(F.lit("block"), F.col(salt))
    hi, gj = F.greatest(F.coalesce("__hi", F.lit(1)), F.lit(1)), F.greatest(F.coalesce("__gj", F.lit(1)), F.lit(1))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    own_i, own_j = F.pmod(part, hi).cast("int"), F.pmod(part, gj).cast("int")
    cell = F.when(F.col("host"), F.transform(every(gj), lambda j: F.struct(own_i.alias("i"), j.alias("j")))) \
        .otherwise(F.transform(every(hi), lambda i: F.struct(i.alias("i"), own_j.alias("j"))))
    names = [c for c in rows.columns if not c.startswith("__")]
    dealt = rows.select(*names, F.explode(cell).alias("__cell")).select(
        *key, F.col("__cell.i").alias("i"), F.col("__cell.j").alias("j"), *[c for c in names if c not in key])
    return dealt.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j")


def runs(batches, columns: int):
    """Tables of the rows that agree in the first ``columns`` columns, from sorted batches of a partition."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        change = None
        for c in b.columns[:columns]:
            differs = pa.compute.not_equal(c.slice(1), c.slice(0, b.num_rows - 1))
            change = differs if change is None else pa.compute.or_(change, differs)
        cuts = [0, *(i + 1 for i in pa.compute.indices_nonzero(change).to_pylist()), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            piece = b.slice(lo, hi - lo)
            now = tuple(c[0].as_py() for c in piece.columns[:columns])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
            last = now
    if held:
        yield pa.Table.from_batches(held)
