"""Filling containers of a fixed capacity with items, by bounded-space online best fit.

Items come in order. A bounded number of containers is open; their free spaces
stand in a bitset, in which the lowest bit at or above an item's size is the
fullest container that still takes it. If none does and all places are taken,
the fullest container is closed and a new one opened. An item is never split
unless it alone exceeds the capacity; then all its pieces but the last fill a
container each.

Plan: sizes (a key and a number) are all that is shuffled, to as many shards as
the table needs, at random and hence evenly. A shard is packed in order of the
key by one task with the state of its open containers, so the result depends on
the items alone, not on the cluster, and lost tasks repeat exactly. A shard leaves
at most ``open_bins`` containers unfilled, which the shard's size makes negligible.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
OPEN_BINS = 64
#: equal items that one task numbers
SAME = 1 << 16
#: items of a shard, about
SHARD = 50_000


class BestFit:
    """The open containers of one shard."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.free: dict[int, list[int]] = defaultdict(list)
        self.bits, self.open, self.opened = 0, 0, 0

    def _take(self, space: int) -> int:
        bins = self.free[space]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << space)
        return number

    def _put(self, number: int, space: int) -> None:
        self.free[space].append(number)
        self.bits |= 1 << space

    def place(self, size: int) -> int:
        """The container of an item of at most the capacity."""
        above = self.bits >> size
        if above:
            space = size + (above & -above).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            number, space = self.opened, self.capacity
            self.opened += 1
            self.open += 1
        if space == size and size:
            self.open -= 1  # full: closed
        else:
            self._put(number, space - size)
        return number


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, shards: int | None = None) -> DataFrame:
    """(container_id, key, piece_no, start, n_tokens): where every item, or piece of one, went.

    container_id is the shard times 2^40 plus a number in the shard. Items of a
    NULL or negative size count as empty and take no space, but have a place.
    Repeated keys are items of their own. An empty table has no containers.
    ``shards``: by default one for each ``SHARD`` rows of the table.
    """
    if capacity < 1 or open_bins < 1:
        raise ValueError("capacity and open_bins must be at least 1")
    if shards is None:
        shards = max(1, -(-sizes.count() // SHARD))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, bins = None, None
        for batch in batches:
            out = []
            for s, k, n in zip(batch["shard"].tolist(), batch["item"].tolist(), batch["size"].tolist()):
                if s != shard:
                    shard, bins = s, BestFit(capacity, open_bins)
                base, start, piece = s << 40, 0, 0
                while n - start > capacity:
                    out.append((base + bins.place(capacity), k, piece, start, capacity))
                    start += capacity
                    piece += 1
                out.append((base + bins.place(n - start), k, piece, start, n - start))
            yield pd.DataFrame(out, columns=["container_id", key, "piece_no", "start", "n_tokens"])

    kind = dict(sizes.dtypes)[key]
    rows = sizes.select(F.col(key).alias("item"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    # equal items are counted and spread again by number, else all rows of a repeated or NULL key would be one shard's
    same = rows.groupBy("item", "size").agg(F.count(F.lit(1)).alias("n"))
    same = same.select("item", "size", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SAME))).alias("part")).repartition(F.xxhash64("item", "size", "part"))
    first = F.col("part") * SAME
    rows = same.select("item", "size", F.explode(F.sequence(first, F.least(first + SAME, F.col("n")) - 1)).alias("copy"))
    shard = F.when(F.col("copy") == 0, F.xxhash64("item")).otherwise(F.xxhash64("item", "size", "copy"))
    rows = rows.select(F.pmod(shard, F.lit(shards)).alias("shard"), "item", "size")
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "item", "size")
    return rows.mapInPandas(run, f"container_id long, `{key}` {kind}, piece_no int, start long, n_tokens long")


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, items, used, unused): the level of every container."""
    return (
        packed.groupBy("container_id")
        .agg(F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("used"))
        .withColumn("unused", F.lit(capacity) - F.col("used"))
    )
