"""Page layout to blocks: headings with their levels and parents, tables with their rows, other text under them.

Blocks come sorted by document, page and reading order, and a task goes through them once: what it holds is the stack of
headings and the cells of one table, so documents of any length pass.
"""

from __future__ import annotations

import re
import statistics
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labels of titles and tables, patterns of numbered and listed headings, bullets, and the heading of what precedes all.
TITLES, TABLES = ("title", "section_header"), ("table",)
NUMBERED, LISTED = re.compile(r"^\s*(\d+(?:\.\d+)*)\s*[^\d.]?"), re.compile(r"^\s*(?:\d+|[A-Za-z])[）)]")
BULLETS = ("⚫", "◼", "•")
PREFACE = "Preface/Uncategorized"
DEEPEST = 6


class Outline:
    """The stack of headings of one document."""

    def __init__(self):
        self.stack: dict[int, str] = {}
        self.heading, self.level, self.parents, self.titled = PREFACE, 0, [], False

    @staticmethod
    def list_style(text: str) -> str:
        return "" if not LISTED.match(text) else "number" if text.lstrip()[0].isdigit() else "letter"

    def level_of(self, text: str) -> int:
        """The first heading 0; of a list as deep as the deepest of its style that is open, else below this one; of numbers by their depth; below this one if it ends in a colon; else 1."""
        if not self.titled:
            return 0
        below = min(DEEPEST, max(1, self.level + 1))
        if style := self.list_style(text):
            same = [k for k, v in self.stack.items() if self.list_style(v) == style]
            return max(same) if same else below
        if m := NUMBERED.match(text):
            return min(DEEPEST, m[1].count(".") + 1)
        return below if text.rstrip().endswith((":", "：")) else 1

    def add(self, text: str) -> int:
        level = self.level_of(text)
        self.stack = {k: v for k, v in self.stack.items() if k < level}
        self.parents = [self.stack[k] for k in sorted(self.stack)]
        self.stack[level] = text
        self.heading, self.level, self.titled = text, level, True
        return level


def is_heading(text: str) -> bool:
    """Neither a bullet nor a line of a table of contents."""
    return not text.startswith(BULLETS) and text.count(".") < 8


def grid(cells: list[tuple[str, float, float, float]]) -> list[list[str]]:
    """Rows of cells (text, left, top, bottom): from the top, a cell joins a row whose mean centre is near enough."""
    if not cells:
        return []
    near = max(4.0, 0.6 * statistics.median(max(1.0, b - t) for _, _, t, b in cells))
    rows: list[list[tuple[float, float, str]]] = []
    for y, x, text in sorted(((t + b) / 2, x, text) for text, x, t, b in cells):
        if rows and abs(y - sum(c[0] for c in rows[-1]) / len(rows[-1])) <= near:
            rows[-1].append((y, x, text))
        else:
            rows.append([(y, x, text)])
    return [[c[2] for c in sorted(r, key=lambda c: c[1])] for r in rows]


_SCHEMA = "document string, block_no int, page int, content string, heading string, level int, parents array<string>, is_title boolean, rows array<array<string>>"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


def page_blocks(blocks: DataFrame) -> DataFrame:
    """``document, block_no, page, content, heading, level, parents, is_title, rows`` of blocks (document, page, reading_order, block_id, label, text_source, text, x0, y0, x1, y1).

    A heading's content is the heading behind ``#`` marks; successive cells of a page make one table, whose content is its
    place holder ``{{TBL:tbN}}`` and whose cells are in ``rows``. Blocks without letters or digits, and read ones in
    figures and page margins, are left out. Null documents make one; repeated ids stay.
    """
    order = ["document", "page", "reading_order", "block_id"]
    src = blocks.select(*order, F.lower("label").alias("label"), "text_source", "text", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    seen = F.col("text").rlike(r"[\p{L}\p{N}]") & ~F.coalesce((F.lower("text_source") == "ocr") & F.col("label").isin("figure", "abandon"), F.lit(False))
    src = src.withColumn("seen", F.coalesce(seen, F.lit(False))).where(F.col("seen") | ~F.col("label").isin(*TABLES) | F.col("label").isNull())

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        document, outline, number, tables = object(), Outline(), 0, 0
        page, cells = None, []
        out: list[tuple] = []

        def put(content: str, at, is_title: bool = False, rows=None):
            nonlocal number
            out.append((document, number, at, content, outline.heading, outline.level, list(outline.parents), is_title, rows))
            number += 1

        def close():
            nonlocal tables
            if rows := grid(cells):
                tables += 1
                put(f"{{{{TBL:tb{tables}}}}}", page, rows=rows)
            cells.clear()

        for pdf in pdfs:
            for doc, at, label, text, seen, x0, y0, x1, y1 in pdf[["document", "page", "label", "text", "seen", "x0", "y0", "x1", "y1"]].itertuples(index=False):
                if doc != document or at != page:
                    close()
                if doc != document:
                    document, outline, number, tables = doc, Outline(), 0, 0
                page = None if at is None or at != at else int(at)
                if label in TABLES:
                    if seen and None not in (x0, y0, x1, y1) and x0 == x0 and y0 == y0 and y1 == y1:
                        cells.append((text.strip(), x0, y0, y1))
                    continue
                if not seen:
                    continue
                close()
                text = text.strip()
                if label in TITLES and is_heading(text):
                    first = not outline.titled
                    level = outline.add(text)
                    put(f"{'#' * max(1, level)} {text}", page, first)
                else:
                    put(text, page)
            if len(out) > 5000:
                yield _frame(out)
                out.clear()
        close()
        yield _frame(out)

    return src.repartition("document").sortWithinPartitions(*order).select("document", "page", "label", "text", "seen", "x0", "y0", "x1", "y1").mapInPandas(run, _SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_NAMES)
    out["page"] = out["page"].astype("Int32")
    return out
