"""Problem 8: items packed into containers of fixed capacity by bounded-space online best-fit.

A packer holds at most ``open_bins`` bins. A bitset has a bit for each free space that some open bin has; the lowest bit
at or above an item's size names the best fit. If none fits, a bin is opened, and if that is one too many, the fullest
closes. Items come in the order of their ids within a hash of them, so a lost task, run again, packs alike.

What a packer has open at its end (at most ``open_bins`` bins) is packed again as items, by fewer and fewer packers,
until one is left, so the number of packers doesn't add to the space unused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.session import checkpoint

OPEN_BINS = 64
#: Packers whose open bins go to one packer of the next round.
FAN_IN = 16
#: Items that one packer of the first round gets at most, about.
ITEMS = 50_000


class BestFit:
    """``put`` takes an item and gives the bins that close with it, as lists of items."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.bits, self.held = 0, 0
        self.by_free: dict[int, list[list]] = {}

    def _take(self, free: int) -> list:
        same = self.by_free[free]
        items = same.pop()
        if not same:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.held -= 1
        return items

    def _keep(self, free: int, items: list) -> None:
        self.by_free.setdefault(free, []).append(items)
        self.bits |= 1 << free
        self.held += 1

    def put(self, size: int, item) -> list[list]:
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            items = self._take(free)
        else:
            free, items = self.capacity, []
        items.append(item)
        if free == size:  # full
            return [items]
        self._keep(free - size, items)
        return [self._take((self.bits & -self.bits).bit_length() - 1)] if self.held > self.most else []

    def rest(self) -> Iterator[tuple[int, list]]:
        """What is open, the fullest first: used space and items."""
        for free in sorted(self.by_free):
            for items in self.by_free[free]:
                yield self.capacity - free, items


_SCHEMA = "spec_id int, capacity int, packer bigint, bin_no bigint, used int, open boolean, item_id bigint, part_no int, n_tokens int"


def _pack(pdfs: Iterator[pd.DataFrame], open_bins: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by spec, packer and unit: a unit is an item (unit null) or a bin of the round before."""
    key, fit, number, out = None, None, 0, []
    unit, parts, size = None, [], 0

    def close(bins, is_open: bool):
        nonlocal number
        for used, units in bins:
            for part in (p for u in units for p in u):
                out.append((*key, number, used, is_open, *part))
            number += 1

    def put():
        if parts:
            close(((sum(p[2] for u in b for p in u), b) for b in fit.put(size, list(parts))), False)

    for pdf in pdfs:
        for spec, capacity, packer, u, item, part_no, tokens in zip(*(pdf[c].tolist() for c in ("spec_id", "capacity", "packer", "unit", "item_id", "part_no", "n_tokens"))):
            if (spec, capacity, packer) != key:
                if key:
                    put()
                    close(fit.rest(), True)
                key, fit, number, unit = (spec, capacity, packer), BestFit(capacity, open_bins), 0, None
                parts, size = [], 0
            if u is None or u != unit:
                put()
                unit, parts, size = u, [], 0
            parts.append((item, part_no, tokens))
            size += tokens
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=_COLUMNS)
                out.clear()
    if key:
        put()
        close(fit.rest(), True)
    yield pd.DataFrame(out, columns=_COLUMNS)


_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def pack_items(sizes: DataFrame, specs: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", open_bins: int = OPEN_BINS, items_per_packer: int = ITEMS) -> DataFrame:
    """``spec_id, capacity, bin_id, item_id, part_no, first_token, n_tokens``: each item of ``sizes`` in one bin of each row of ``specs`` (``spec_id, capacity_tokens``).

    An item over the capacity is divided: whole capacities fill bins of their own, the rest is an item like others.
    Items of size 0, null or below take no space; however many they are, they share one bin of each spec and go to no packer. Null ids are items of their own that share the null id;
    repeated ids are separate items. No items give no bins. Specs without a capacity of 1 or more are left out.
    """
    items = sizes.select(F.col(id_col).cast("bigint").alias("item_id"), F.greatest(F.coalesce(F.col(size_col).cast("int"), F.lit(0)), F.lit(0)).alias("size"))
    items = checkpoint(items.withColumn("row", F.monotonically_increasing_id()))  # fixed from here on, so repeated ids stay apart
    specs = specs.select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity_tokens").cast("int").alias("capacity")).where("capacity >= 1").dropDuplicates(["spec_id", "capacity"])
    packers = max(1, -(-items.count() // items_per_packer))
    all_items = items.join(F.broadcast(specs))  # a handful of capacities
    pieces = all_items.select(
        "spec_id", "capacity", "item_id", "row",
        F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / F.col("capacity")), F.lit(1)) - 1), lambda k: F.struct(
            k.cast("int").alias("part_no"), F.least(F.col("capacity"), F.col("size") - k * F.col("capacity")).cast("int").alias("n_tokens"),
        ))).alias("p"),
    ).select("spec_id", "capacity", "item_id", "row", "p.*")
    whole = F.col("n_tokens") == F.col("capacity")
    filled = pieces.where(whole).select("spec_id", "capacity", F.concat_ws("-", F.lit("full"), "row", "part_no").alias("bin_id"), "item_id", "part_no", "n_tokens")
    packer = F.pmod(F.xxhash64(F.coalesce("item_id", "row")), F.lit(packers))
    order = ["spec_id", "capacity", "packer", "unit", "item_id", "row"]
    empty = pieces.where("n_tokens = 0").select("spec_id", "capacity", F.lit("empty").alias("bin_id"), "item_id", "part_no", "n_tokens")
    todo = pieces.where(~whole & (F.col("n_tokens") > 0)).select("spec_id", "capacity", packer.alias("packer"), F.lit(None).cast("string").alias("unit"), "item_id", "row", "part_no", "n_tokens")
    sc = sizes.sparkSession.sparkContext
    level, done = 0, []
    while True:
        tasks = min(max(packers * 3, 1), 4 * sc.defaultParallelism * max(1, packers // 64))
        ordered = todo.repartition(tasks, "spec_id", "packer").sortWithinPartitions(*order)
        packed = checkpoint(ordered.select("spec_id", "capacity", "packer", "unit", "item_id", "part_no", "n_tokens").mapInPandas(lambda p: _pack(p, open_bins), _SCHEMA))
        bin_id = F.concat_ws("-", F.lit(level), "packer", "bin_no")
        if packers == 1:
            done.append(packed.select("spec_id", "capacity", bin_id.alias("bin_id"), "item_id", "part_no", "n_tokens"))
            break
        done.append(packed.where("not open").select("spec_id", "capacity", bin_id.alias("bin_id"), "item_id", "part_no", "n_tokens"))
        order = order[:4] + ["item_id", "part_no"]
        todo = packed.where("open").select("spec_id", "capacity", F.expr(f"packer div {FAN_IN}").alias("packer"), F.concat_ws("-", "packer", "bin_no").alias("unit"), "item_id", "part_no", "n_tokens")
        packers, level = -(-packers // FAN_IN), level + 1
    result = filled.unionByName(empty)
    for d in done:
        result = result.unionByName(d)
    return result.select("spec_id", "capacity", "bin_id", "item_id", "part_no", (F.col("part_no") * F.col("capacity")).alias("first_token"), "n_tokens")


def packing_report(packed: DataFrame) -> DataFrame:
    """Of each spec: bins, tokens, and the share of the bins' space that is used."""
    return packed.groupBy("spec_id", "capacity").agg(F.countDistinct("bin_id").alias("bins"), F.sum("n_tokens").alias("tokens")).withColumn("used", F.try_divide(F.col("tokens"), F.col("bins") * F.col("capacity")))
