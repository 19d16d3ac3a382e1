"""Data sources over saved files: pages of a timeline, and sheets of zipped workbooks; both in batches and as streams.

``register(spark)`` makes them known as ``saved_timeline`` and ``zipped_sheet``.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, zip_longest
from typing import Any
from xml.parsers import expat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from tidemark.functions.text import html_to_text
from tidemark.sources.files import listed, opened

ANY = (-(1 << 63), (1 << 63) - 1)


def register(spark: SparkSession) -> None:
    """Makes the sources known to the session, and lets it push filters into them."""
    for source in (SavedTimeline, ZippedSheet):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def within(filters: list[Filter], column: str) -> tuple[list[Filter], tuple[int, int]]:
    """Filters that stay, and the least and greatest number that the others let ``column`` have."""
    stay, low, high = [], *ANY
    for f in filters:
        if getattr(f, "attribute", None) != (column,):
            stay.append(f)
        elif isinstance(f, GreaterThan):
            low = max(low, f.value + 1)
        elif isinstance(f, GreaterThanOrEqual):
            low = max(low, f.value)
        elif isinstance(f, LessThan):
            high = min(high, f.value - 1)
        elif isinstance(f, LessThanOrEqual):
            high = min(high, f.value)
        elif isinstance(f, EqualTo):
            low, high = max(low, f.value), min(high, f.value)
        else:
            if isinstance(f, In) and f.value:  # narrows the pages, but rows between stay to be told apart
                low, high = max(low, min(f.value)), min(high, max(f.value))
            stay.append(f)
    return stay, (low, high)


@dataclass
class Pages(InputPartition):
    names: list[str]
    low: int
    high: int


class _Timeline:
    """Pages of a folder, with the ids that their names tell, and the posts on them."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.ids = re.compile(options.get("ids", r"(\d+)-(\d+)"))
        self.size = int(options.get("partitionbytes", 32 << 20))

    def pages(self) -> list[tuple[str, int, tuple[int, int] | None]]:
        """(name, bytes, least and greatest id); no ids where a name tells none."""
        told = ((name, size, self.ids.search(name)) for name, size in listed(self.path))
        return [(name, size, (int(m.group(1)), int(m.group(2))) if m else None) for name, size, m in told]

    def dealt(self, low: int, high: int) -> list[Pages]:
        """The pages that may hold ids of the range, in parts of about ``partitionbytes``."""
        near = [(name, size) for name, size, ids in self.pages() if ids is None or ids[0] <= high and low <= ids[1]]
        parts: dict[int, list[str]] = {}
        for (name, size), upto in zip(near, accumulate(size for _, size in near), strict=True):
            parts.setdefault((upto - size) // self.size, []).append(name)
        return [Pages(names, low, high) for names in parts.values()]

    def read(self, part: Pages) -> Iterator[tuple]:
        """A page is read whole; a post reaches to the next one."""
        for name in part.names:
            html = opened(self.path, name).read().decode("utf-8", "replace")
            found = list(re.finditer(r'data-post="[^"]*?(\d{1,18})"', html))
            for post, after in zip_longest(found, found[1:]):
                if part.low <= (post_id := int(post.group(1))) <= part.high:
                    yield post_id, html[post.start() : after.start() if after else len(html)], name


class _TimelineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.timeline, self.range = _Timeline(options), ANY

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        stay, self.range = within(filters, "post_id")
        return stay

    def partitions(self) -> list[Pages]:
        return self.timeline.dealt(*self.range)

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.timeline.read(partition)


class _TimelineStream(DataSourceStreamReader):
    """Offsets are ids: a batch has the posts above the greatest id before, up to the greatest that the names tell."""

    def __init__(self, options: dict[str, str]):
        self.timeline, self.newest = _Timeline(options), int(options.get("newest", 0))

    def initialOffset(self) -> dict:
        return {"id": self.newest}

    def latestOffset(self) -> dict:
        pages = self.timeline.pages()
        if untold := [name for name, _, ids in pages if ids is None]:
            raise ValueError(f"no ids in the names of pages: {untold[:3]}")
        return {"id": max([self.newest, *(ids[1] for _, _, ids in pages)])}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.timeline.dealt(start["id"] + 1, end["id"])

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.timeline.read(partition)


class SavedTimeline(DataSource):
    """Posts (post_id, html, page) of the saved pages below ``path``; a post on several pages comes from each.

    The pattern ``ids`` finds the least and the greatest id of a page in its name below the folder, so that filters on
    post_id leave out pages.  A stream begins above ``newest`` (say, the greatest stored id) and goes on above the
    greatest id read; its pages' names must tell their ids, and a page that comes late with lower ones is passed over.
    """

    @classmethod
    def name(cls) -> str:
        return "saved_timeline"

    def schema(self) -> str:
        return "post_id long, html string, page string"

    def reader(self, schema: Any) -> DataSourceReader:
        return _TimelineReader(self.options)

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return _TimelineStream(self.options)


def post_parts(posts: DataFrame) -> DataFrame:
    """(post_id, posted_at, text) of the source's posts; null where a post tells none."""
    at = F.regexp_extract("html", r'<time\b[^<>]*\bdatetime="([^"<>]*)"', 1)
    text = F.nullif(F.regexp_extract("html", r'(?s)<div class="text">(.*?)</div>', 1), F.lit(""))
    return posts.select("post_id", F.try_to_timestamp(at).alias("posted_at"), html_to_text(text).alias("text"))


@dataclass
class Rows(InputPartition):
    book: str
    start: int
    end: int
    low: int
    high: int


class _Book:
    """A zipped workbook; its parts are inflated as they are read."""

    def __init__(self, path: str, book: str):
        self.zip = zipfile.ZipFile(opened(path, book))

    def part(self, sheet: str) -> str:
        """The name of the part that holds the sheet."""
        sheets, targets = [], {}

        def seen(tag: str, attrs: dict) -> None:
            if tag.split(":")[-1] == "sheet":
                sheets.append((attrs["name"], next(v for k, v in attrs.items() if k.split(":")[-1] == "id" and ":" in k)))
            elif tag == "Relationship":
                targets[attrs["Id"]] = attrs["Target"]

        for name in ("xl/workbook.xml", "xl/_rels/workbook.xml.rels"):
            parser = expat.ParserCreate()
            parser.StartElementHandler = seen
            parser.Parse(self.zip.read(name), True)
        found = {name: targets[rid] for name, rid in sheets}
        if sheet and sheet not in found:
            raise ValueError(f"no sheet {sheet!r}; there are {sorted(found)}")
        target = found[sheet] if sheet else targets[sheets[0][1]]
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def strings(self) -> list[str]:
        """The texts that cells refer to by number."""
        out: list[list[str]] = []
        texts = _Texts({"si"}, lambda: out.append([]), lambda piece: out[-1].append(piece))
        if "xl/sharedStrings.xml" in self.zip.namelist():
            with self.zip.open("xl/sharedStrings.xml") as f:
                texts.parser.ParseFile(f)
        return ["".join(pieces) for pieces in out]

    def row_bytes(self, part: str, start: int, end: int) -> Iterator[bytes]:
        """The rows whose first byte lies in the range of the inflated part, as bytes; what stands before the range is only inflated."""
        with self.zip.open(part) as f:
            skip = max(0, start - 4)
            while skip > 0:
                skip -= len(f.read(min(skip, 1 << 20))) or skip
            at, held, inside = max(0, start - 4), b"", False
            while data := f.read(1 << 18):
                held += data
                if not inside:
                    m = _ROW.search(held)
                    while m and at + m.start() < start:
                        m = _ROW.search(held, m.end())
                    if not m:
                        at, held = at + max(0, len(held) - 5), held[-5:]
                        if at >= end:
                            return
                        continue
                    if at + m.start() >= end:
                        return
                    at, held, inside = at + m.start(), held[m.start() :], True
                # all but the last row are whole
                cuts = [m.start() for m in _ROW.finditer(held)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if at + a >= end:
                        return
                    yield held[a:b]
                at, held = at + cuts[-1], held[cuts[-1] :]
            if inside and at < end:
                yield held


_ROW = re.compile(rb"<row(?=[\s>/])")


class _Texts:
    """A parser that calls ``begin`` at certain tags and ``piece`` for the pieces of text in them."""

    def __init__(self, tags: set[str], begin: Any, piece: Any):
        self.parser = expat.ParserCreate()
        self.depth, self.skip = 0, 0
        self.tags, self.begin, self.piece = tags, begin, piece
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self.opened, self.closed, self.text

    def opened(self, tag: str, attrs: dict) -> None:
        if tag in self.tags:
            self.begin()
        self.depth += tag == "t"
        self.skip += tag == "rPh"  # how a text is pronounced

    def closed(self, tag: str) -> None:
        self.depth -= tag == "t"
        self.skip -= tag == "rPh"

    def text(self, data: str) -> None:
        if self.depth and not self.skip:
            self.piece(data)


def _place(name: str) -> int:
    """The column of a cell's name, from 0 on."""
    n = 0
    for c in name.rstrip("0123456789"):
        n = n * 26 + ord(c) - 64
    return n - 1


def cells_of(row: bytes, strings: list[str]) -> tuple[int | None, list[str | None]]:
    """A row's number and its cells as text, by place; numbers as they are written, blanks null."""
    number, cells, now = [None], [], {"kind": "", "tag": "", "text": []}

    def begin(tag: str, attrs: dict) -> None:
        if tag == "row":
            number[0] = int(attrs["r"]) if "r" in attrs else None
        elif tag == "c":
            at = _place(attrs["r"]) if "r" in attrs else len(cells)
            cells.extend([None] * (at + 1 - len(cells)))
            now["kind"], now["text"] = attrs.get("t", "n"), []
        now["tag"] = tag if tag in ("v", "t") else ""

    def end(tag: str) -> None:
        now["tag"] = ""
        if tag == "c" and (text := "".join(now["text"])):
            cells[-1] = strings[int(text)] if now["kind"] == "s" else {"1": "true", "0": "false"}.get(text, text) if now["kind"] == "b" else text

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = begin, end
    parser.CharacterDataHandler = lambda data: now["text"].append(data) if now["tag"] else None
    end_at = row.rfind(b"</row>")
    parser.Parse(row[: end_at + 6] if end_at >= 0 else row[: row.index(b"/>") + 2], True)
    return number[0], cells


class _Sheets:
    def __init__(self, options: dict[str, str]):
        self.path, self.sheet, self.size = options["path"], options.get("sheet", ""), int(options.get("partitionbytes", 16 << 20))

    def dealt(self, books: list[str], low: int, high: int) -> list[Rows]:
        """Ranges of the sheet's inflated bytes, of which the zip's directory tells the size."""
        out = []
        for book in books:
            opened_book = _Book(self.path, book)
            size = opened_book.zip.getinfo(opened_book.part(self.sheet)).file_size
            out += [Rows(book, k, min(size, k + self.size), low, high) for k in range(0, max(1, size), self.size)]
        return out

    def read(self, part: Rows) -> Iterator[tuple]:
        book = _Book(self.path, part.book)
        strings = book.strings()
        for row in book.row_bytes(book.part(self.sheet), part.start, part.end):
            number, cells = cells_of(row, strings)
            if number is None:
                raise ValueError(f"{part.book}: a row without a number")
            if number > part.high:
                return
            if number >= part.low:
                yield part.book, number, cells


class _SheetReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.sheets, self.range = _Sheets(options), ANY

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        stay, self.range = within(filters, "row")
        return stay

    def partitions(self) -> list[Rows]:
        return self.sheets.dealt([name for name, _ in listed(self.sheets.path)], *self.range)

    def read(self, partition: Rows) -> Iterator[tuple]:
        return self.sheets.read(partition)


class _SheetStream(DataSourceStreamReader):
    """Offsets are names: a batch has the workbooks whose names come after the last one before."""

    def __init__(self, options: dict[str, str]):
        self.sheets = _Sheets(options)

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max([name for name, _ in listed(self.sheets.path)], default="")}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        return self.sheets.dealt([name for name, _ in listed(self.sheets.path) if start["after"] < name <= end["after"]], *ANY)

    def read(self, partition: Rows) -> Iterator[tuple]:
        return self.sheets.read(partition)


class ZippedSheet(DataSource):
    """Rows (book, row, cells) of a ``sheet`` (by default the first) of one workbook or of those of a folder.

    Cells are text by place: numbers and days as the workbook writes them, blanks null, short rows short.  A task takes the
    rows that begin in its range of the sheet's inflated bytes: it inflates what stands before, but reads no cell of it.
    A task holds the workbook's shared texts and a row.  A stream takes the workbooks of a folder by name.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_sheet"

    def schema(self) -> str:
        return "book string, row int, cells array<string>"

    def reader(self, schema: Any) -> DataSourceReader:
        return _SheetReader(self.options)

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return _SheetStream(self.options)


def sheet_day(cell: Column) -> Column:
    """The day of a cell: a workbook's number of days, or a day as text."""
    days = cell.try_cast("double")
    return F.when(days.isNotNull(), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(days).cast("int"))).otherwise(F.to_date(F.try_to_timestamp(cell)))


def sheet_table(spark: SparkSession, path: str, sheet: str = "", groups: dict[str, dict[str, str]] | None = None, **options: str) -> DataFrame:
    """A sheet whose first row names its columns: ``book``, ``row``, a column for each name, and each group of repeated columns as an array.

    ``groups``: array's name -> {field: beginning of its columns' names}.  The i-th entry holds the fields of the i-th columns
    so named; entries without any value are left out.  The header of the first workbook counts for all.
    """
    rows = spark.read.format("zipped_sheet").option("sheet", sheet).options(**options).load(path)
    names = rows.where("row <= 1").orderBy("book", "row").first()["cells"]
    starts = {start for fields in (groups or {}).values() for start in fields.values()}
    cell = lambda i: F.get("cells", F.lit(i))
    single = [cell(i).alias(n) for i, n in enumerate(names) if n is not None and not any(n.startswith(s) for s in starts)]

    def repeated(fields: dict[str, str]) -> Column:
        places = [[i for i, n in enumerate(names) if n is not None and n.startswith(start)] for start in fields.values()]
        entries = [F.struct(*[cell(i).alias(f) for f, i in zip(fields, one, strict=True)]) for one in zip(*places, strict=True)]
        return F.filter(F.array(*entries), lambda e: F.coalesce(*[e[f] for f in fields]).isNotNull())

    return rows.where("row > 1").select("book", "row", *single, *[repeated(fields).alias(n) for n, fields in (groups or {}).items()])
