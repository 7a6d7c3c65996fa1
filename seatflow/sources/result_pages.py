"""Result pages of one year to one record per school and phase.

A page has one table. Its head lists the phases; its body holds four rows per
school: name, vacancy, applied, taken. Each page is read once, from end to end,
by the parser of the standard library inside a task; what it finds becomes rows
without a shuffle, and numbers and tooltips are column expressions on these.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatflow.functions import parsing as P
from seatflow.functions.cleaning import WHITE_SPACE

ARROW = "↳"

CELL_FIELDS = (
    "school_name total_text phase vacancy_text applied_text taken_direct taken_text tip_title tip_text"
).split()


class Cell:
    """A table cell: its text nodes, the first one of its own, its strong text and its tooltip."""

    def __init__(self) -> None:
        self.nodes: list[str] = []
        self.raw: list[str] = []
        self.direct: str | None = None
        self.strong: list[str] | None = None
        self.tip: dict[str, str | None] | None = None

    @property
    def text(self) -> str:
        return "".join(self.nodes)


class PageParser(HTMLParser):
    """Cells of the first table head and of the rows of the first table body.

    Comments, scripts and styles hold no text. A missing end tag of a cell or a row is
    tolerated: the next one ends it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.heads: list[Cell] = []
        self.rows: list[list[Cell]] = []
        self.part = ""  # thead or tbody while inside the first one
        self.seen: set[str] = set()
        self.cell: Cell | None = None
        self.open: list[str] = []  # tags open inside the cell
        self.mute = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            self.mute = tag
        elif tag in ("thead", "tbody"):
            self.cell = None
            self.part = "" if tag in self.seen else tag
            self.seen.add(tag)
        elif tag == "tr" and self.part:
            self.cell = None
            if self.part == "tbody":
                self.rows.append([])
        elif tag in ("td", "th") and self.part:
            self.cell, self.open = Cell(), []
            if self.part == "thead" and tag == "th":
                self.heads.append(self.cell)
            elif self.part == "tbody" and tag == "td" and self.rows:
                self.rows[-1].append(self.cell)
        elif self.cell is not None:
            if tag == "span" and self.cell.tip is None and "tt" in (dict(attrs).get("class") or "").split():
                self.cell.tip = dict(attrs)
            if tag not in P.VOID_TAGS:
                self.open.append(tag)
                if tag == "strong" and self.cell.strong is None:
                    self.cell.strong = []

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in P.VOID_TAGS:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == self.mute:
            self.mute = ""
        elif tag in ("thead", "tbody", "table"):
            self.part, self.cell = "", None
        elif tag in ("tr", "td", "th"):
            self.cell = None
        elif tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        cell = self.cell
        if cell is None or self.mute:
            return
        node = data.strip(WHITE_SPACE)
        cell.raw.append(data)
        cell.nodes.append(node)
        if not self.open and cell.direct is None:
            cell.direct = node
        if "strong" in self.open and cell.strong is not None:
            cell.strong.append(node)


def _blocks(rows: list[list[Cell]]) -> Iterator[list[list[Cell]]]:
    """Four rows per school. A row whose first cell has no arrow opens a block and claims the
    next three rows. Other rows are skipped; a block cut short by the end stops the page."""
    at = 0
    while at < len(rows):
        if rows[at] and ARROW in rows[at][0].text:
            at += 1
        elif at + 3 < len(rows):
            yield rows[at : at + 4]
            at += 4
        else:
            return


def read_page(html: str) -> list[tuple]:
    """Texts of one page, one tuple of ``CELL_FIELDS`` per school and phase."""
    parser = PageParser()
    parser.feed(html)
    parser.close()
    phases = [h.text for h in parser.heads if h.text and h.text.lower() != "school"]
    found = []
    for head, vacancy, applied, taken in _blocks(parser.rows):
        strong = next((c.strong for c in head if c.strong is not None), None)
        name = "".join(strong) if strong is not None else head[0].text if head else ""
        total = vacancy[0].text if vacancy else None
        for place, phase in enumerate(phases, start=1):
            left, asked, cell = (row[place] if place < len(row) else None for row in (vacancy, applied, taken))
            tip = (cell.tip if cell else None) or {}
            found.append((
                name, total, phase, left and left.text, asked and asked.text, cell and cell.direct,
                cell and "".join(cell.raw), tip.get("data-tt-title") or None, tip.get("data-tt") or None,
            ))
    return found


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        years, rows = [], []
        for year, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = read_page(html.as_py() or "")
            rows += found
            years += [year] * len(found)
        columns = zip(*rows, strict=True) if rows else [[]] * len(CELL_FIELDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(years, pa.int64()), *(pa.array(c, pa.string()) for c in columns)],
            ["registration_year", *CELL_FIELDS],
        )


def first_count(direct: Column, plain: Column) -> Column:
    """Number of a cell: its direct text, else the first digits anywhere in it."""
    return F.coalesce(P.parse_int(direct), P.first_int(plain))


def parse_pages(pages: DataFrame, html: str, year: str) -> DataFrame:
    """Pages to records with the columns of the raw result table (without load time)."""
    schema = "registration_year long, " + ", ".join(f"{c} string" for c in CELL_FIELDS)
    cells = pages.select(F.col(year).cast("bigint"), F.col(html)).mapInArrow(_read, schema)
    records = cells.withColumn("_tip", P.parse_tooltip(F.col("tip_title"), F.col("tip_text")))
    return records.select(
        "school_name",
        P.paren_int(F.col("total_text")).alias("total_vacancy"),
        "phase",
        P.parse_int(F.col("vacancy_text")).alias("vacancy"),
        P.parse_int(F.col("applied_text")).alias("applied"),
        first_count(F.col("taken_direct"), F.col("taken_text")).alias("taken"),
        F.col("_tip.code").alias("ballot_scenario_code"),
        F.col("_tip.description").alias("ballot_description"),
        F.col("_tip.applicants").alias("ballot_applicants"),
        F.col("_tip.vacancies").alias("ballot_vacancies"),
        F.col("_tip.chance_pct").alias("ballot_chance_pct"),
        "registration_year",
    )
