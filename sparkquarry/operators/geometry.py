"""Spatial joins and line building on pages. Every join has the page as its equality, so pairs stay within pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions import boxes as X

SIDES = ["x0", "y0", "x1", "y1"]


def _renamed(df: DataFrame, key: str, *extra: str) -> DataFrame:
    return df.select("page_uid", F.col(key).alias("region_id"), *(F.col(c).alias(f"r_{c}") for c in (*SIDES, *extra)))


def best_region(items: DataFrame, item: str, regions: DataFrame, region: str, order: str, center_first: bool = False) -> DataFrame:
    """``item, region_id``: of the regions on its page the one that an item overlaps most, null if none; the first of equals. ``center_first``: regions with the item's centre come before others, the last of equals."""
    pairs = items.select("page_uid", item, *SIDES).join(_renamed(regions, region, order), "page_uid")
    pairs = pairs.withColumn("area", X.overlap(X.box(), X.box("r_"))).where("area > 0")
    if center_first:
        best = pairs.groupBy(item).agg(F.max(F.struct(X.center_inside(X.box(), X.box("r_")).cast("int").alias("c"), "area", F.col(f"r_{order}").alias("o"), "region_id")).alias("b"))
    else:
        best = pairs.groupBy(item).agg(F.max(F.struct("area", (-F.col(f"r_{order}")).alias("o"), (-F.col("region_id")).alias("i"), "region_id")).alias("b"))
    return items.select(item).join(best.select(item, F.col("b.region_id").alias("region_id")), item, "left")


def outside(blocks: DataFrame, block: str, tables: DataFrame, table: str) -> DataFrame:
    """Blocks that lie in no table of their page, neither by centre nor by half."""
    t = _renamed(tables, table).withColumnRenamed("page_uid", "t_page")
    return blocks.join(t, (blocks["page_uid"] == t["t_page"]) & X.inside(X.box(), X.box("r_")), "left_anti")


def table_order(tables: DataFrame, table: str, blocks: DataFrame, block: str) -> DataFrame:
    """``table, reading_order``: the first order of the blocks in a table, else the number of blocks that begin above it."""
    pairs = tables.select("page_uid", table, *(F.col(c).alias(f"r_{c}") for c in SIDES)).join(blocks.select("page_uid", block, F.col("reading_order").alias("o"), *SIDES), "page_uid", "left")
    within = F.coalesce(X.inside(X.box(), X.box("r_")), F.lit(False))
    return pairs.groupBy(table).agg(F.coalesce(F.min(F.when(within, F.col("o").cast("bigint"))), F.count_if(F.col("y0") < F.col("r_y0"))).alias("reading_order"))


def text_in_regions(texts: DataFrame, order: str, regions: DataFrame, region: str) -> DataFrame:
    """``region, text``: the texts whose centre is in a region, in order, joined by spaces."""
    r = regions.select("page_uid", region, *(F.col(c).alias(f"r_{c}") for c in SIDES))
    pairs = texts.where("text is not null").join(r, "page_uid").where(X.center_inside(X.box(), X.box("r_")))
    return pairs.groupBy(region).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ").alias("text"))


def visual_lines(glyphs: DataFrame, tolerance: float = 0.65) -> DataFrame:
    """Glyphs with ``line_no``: a glyph is on the line of the line's first glyph if their centres are within ``tolerance`` of the greater height. One page at a time: each step depends on the one before."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x0", "glyph_id"])
        line, first, out = -1, None, []
        for y, h in zip(pdf["y"], pdf["h"]):
            if first is None or abs(y - first[0]) > tolerance * max(h, first[1]):
                line, first = line + 1, (y, h)
            out.append(line)
        return pdf.assign(line_no=out)[["page_uid", "glyph_id", "line_no"]]

    g = glyphs.select("page_uid", "glyph_id", F.col("x0").cast("double").alias("x0"), ((F.col("y0") + F.col("y1")) / 2).cast("double").alias("y"), (F.col("y1") - F.col("y0")).cast("double").alias("h")).where("y is not null")
    return g.groupBy("page_uid").applyInPandas(one, "page_uid bigint, glyph_id bigint, line_no int")


def line_texts(glyphs: DataFrame) -> DataFrame:
    """``page_uid, line_no, text`` and the lines' boxes, from glyphs with line_no; a space where one is marked or the gap is over 0.75 of the height."""
    w = Window.partitionBy("page_uid", "line_no").orderBy("x0", "glyph_id")
    gap = F.coalesce(F.col("x0") - F.lag("x1").over(w) > 0.75 * (F.col("y1") - F.col("y0")), F.lit(False)) | F.coalesce(F.col("space_before"), F.lit(False))
    piece = F.concat(F.when(gap & (F.row_number().over(w) > 1), " ").otherwise(""), F.coalesce("text", F.lit("")))
    g = glyphs.withColumn("n", F.row_number().over(w)).withColumn("piece", piece)
    return g.groupBy("page_uid", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def row_clusters(cells: DataFrame, cell: str) -> DataFrame:
    """Cells with ``row_no``: from the top, a cell joins the row whose mean centre is within max(4, 0.6 of the page's median height). One page at a time."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x0", cell])
        limit = max(4.0, 0.6 * float(pdf["h"].median()))
        row, total, n, out = -1, 0.0, 0, []
        for y in pdf["y"]:
            if not n or abs(y - total / n) > limit:
                row, total, n = row + 1, 0.0, 0
            total, n = total + y, n + 1
            out.append(row)
        return pdf.assign(row_no=out)[["page_uid", cell, "row_no"]]

    c = cells.select("page_uid", cell, F.col("x0").cast("double").alias("x0"), ((F.col("y0") + F.col("y1")) / 2).cast("double").alias("y"), (F.col("y1") - F.col("y0")).cast("double").alias("h")).where("y is not null")
    return c.groupBy("page_uid").applyInPandas(one, f"page_uid bigint, {cell} bigint, row_no int")


def suppress(regions: DataFrame, region: str, score: str, share: float = 0.85) -> DataFrame:
    """Regions by descending score, without those that a kept one overlaps by ``share`` of the smaller. One page at a time."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for r in pdf.sort_values(["s", "id"], ascending=[False, True]).itertuples():
            def over(k, r=r) -> bool:
                inter = max(0.0, min(k.x1, r.x1) - max(k.x0, r.x0)) * max(0.0, min(k.y1, r.y1) - max(k.y0, r.y0))
                least = min((k.x1 - k.x0) * (k.y1 - k.y0), (r.x1 - r.x0) * (r.y1 - r.y0))
                return least > 0 and inter / least >= share

            if not any(over(k) for k in kept):
                kept.append(r)
        kept.sort(key=lambda r: (r.y0, r.x0, r.id))
        return pd.DataFrame([(r.page_uid, r.id, i) for i, r in enumerate(kept)], columns=["page_uid", "id", "position"])

    r = regions.select("page_uid", F.col(region).alias("id"), F.col(score).cast("double").alias("s"), *(F.col(c).cast("double").alias(c) for c in SIDES)).where("x0 is not null")
    return r.groupBy("page_uid").applyInPandas(one, "page_uid bigint, id bigint, position int").withColumnRenamed("id", region)


def reading_order(blocks: DataFrame, block: str) -> DataFrame:
    w = Window.partitionBy("page_uid").orderBy((F.col("y0").cast("double") + F.col("y1")) / 2, "x0", block)
    return blocks.select("page_uid", block, (F.row_number().over(w) - 1).alias("position"))


def otsl_cells(tokens: DataFrame) -> DataFrame:
    """Cells with spans from structure tokens (table_id, tokens): ``fcel ecel ched rhed srow`` begin cells, ``lcel`` and ``ucel`` and ``xcel`` widen those to the left, above or both, ``nl`` ends a row."""

    def run(pdfs):
        for pdf in pdfs:
            out = []
            for table, seq in zip(pdf["table_id"], pdf["tokens"]):
                grid: list[list[str]] = [[]]
                for t in seq if seq is not None else ():
                    if t == "nl":
                        grid.append([])
                    else:
                        grid[-1].append(t)
                at = lambda r, c, g=grid: g[r][c] if r < len(g) and c < len(g[r]) else ""
                for r, row in enumerate(grid):
                    for c, t in enumerate(row):
                        if t in ("lcel", "ucel", "xcel"):
                            continue
                        cs, rs = 1, 1
                        while at(r, c + cs) == "lcel":
                            cs += 1
                        while at(r + rs, c) == "ucel":
                            rs += 1
                        out.append((table, r, c, rs, cs, t))
            yield pd.DataFrame(out, columns=["table_id", "row", "col", "row_span", "col_span", "label"])

    return tokens.mapInPandas(run, "table_id bigint, row int, col int, row_span int, col_span int, label string")
