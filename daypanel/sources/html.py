"""HTML tables as rows of cells."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import udtf

# Executors get this module's code with the job, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _Tables(HTMLParser):
    """Collects the cells of every table of one page; inner tables count as tables of their own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.done: list[tuple[int, int, list[str]]] = []
        self.open: list[dict] = []
        self.count = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "table":
            self.open.append({"table": self.count, "rows": [], "text": None, "cells": None})
            self.count += 1
        elif self.open and tag == "tr":
            self._end_row()
            self.open[-1]["cells"] = []
        elif self.open and tag in ("td", "th") and self.open[-1]["cells"] is not None:
            self._end_cell()
            spans = dict(attrs)
            self.open[-1]["text"] = []
            self.open[-1]["span"] = [_across(spans.get("colspan")), _down(spans.get("rowspan"))]
        elif self.open and tag == "br" and self.open[-1]["text"] is not None:
            self.open[-1]["text"].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if not self.open:
            return
        if tag in ("td", "th"):
            self._end_cell()
        elif tag == "tr":
            self._end_row()
        elif tag == "table":
            self._end_table()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["text"] is not None:
            self.open[-1]["text"].append(data)

    def close(self) -> None:
        super().close()
        while self.open:
            self._end_table()

    def _end_cell(self) -> None:
        top = self.open[-1]
        if top["text"] is not None:
            top["cells"].append((" ".join("".join(top["text"]).split()), *top["span"]))
            top["text"] = None

    def _end_row(self) -> None:
        top = self.open[-1]
        self._end_cell()
        if top["cells"] is not None:
            top["rows"].append(top["cells"])
            top["cells"] = None

    def _end_table(self) -> None:
        self._end_row()
        top = self.open.pop()
        self.done += [(top["table"], i, cells) for i, cells in enumerate(_grid(top["rows"]))]


# The largest spans that the HTML standard knows; larger ones count as these.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


def _across(text: str | None) -> int:
    """Columns of a cell; anything but a positive number is one."""
    return min(int(text[:9]), MOST_COLUMNS) or 1 if text and text.isdecimal() else 1


def _down(text: str | None) -> int:
    """Rows of a cell; zero means all that follow."""
    return min(int(text[:9]), MOST_ROWS) or MOST_ROWS if text and text.isdecimal() else 1


def _grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Cells of each row by column: a cell fills all columns and rows it spans, also beyond the cells of other rows."""
    out, hanging = [], {}
    for row in rows:
        cells: list[str] = []
        below: dict[int, tuple[str, int]] = {}

        def carried() -> None:
            while len(cells) in hanging:
                text, left = hanging[len(cells)]
                if left > 1:
                    below[len(cells)] = (text, left - 1)
                cells.append(text)

        for text, across, down in row:
            carried()
            for _ in range(across):
                if down > 1:
                    below[len(cells)] = (text, down - 1)
                cells.append(text)
        carried()
        hanging = below
        out.append(cells)
    return out


@udtf(returnType="table_idx int, row_idx int, cells array<string>", useArrow=True)
class html_tables:
    """Table function: every table of a page as (table_idx, row_idx, cells), counted from zero."""

    def eval(self, html: str) -> Iterator[tuple[int, int, list[str]]]:
        if html:
            parser = _Tables()
            parser.feed(html)
            parser.close()
            yield from parser.done


def read_html_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Tables of every page: (key, table_idx, row_idx, cells).

    Pages without a table tag are dropped by a plain text filter and never reach Python. One page is
    parsed by one call; pages are spread over the tasks as they are scanned, without a shuffle.
    """
    with_table = pages.where(F.lower(F.col(html)).contains("<table")).select(key, html)
    return with_table.lateralJoin(html_tables(F.col(html).outer())).select(key, "table_idx", "row_idx", "cells")
