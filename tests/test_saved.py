"""Data sources over saved pages and zipped sheets."""

from __future__ import annotations

import datetime as dt
import random
import zipfile
from xml.sax.saxutils import escape

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.sources import saved
from tidemark.sources.saved import post_parts, register, sheet_day, sheet_table


@pytest.fixture(scope="module")
def sources(spark):
    register(spark)
    return spark


def post(i, text="text &amp; more", at="2024-01-02T03:04:05+00:00"):
    return f'<div class="m" data-post="channel/{i}"><div class="text">{text}<br>end {i}</div><time datetime="{at}"></time></div>'


def page(folder, low, high, ids=None):
    (folder / f"page-{low}-{high}.html").write_text("<html><body>" + "".join(post(i) for i in (range(low, high + 1) if ids is None else ids)))


def test_pages_in_batches(sources, tmp_path):
    for k in range(10):
        page(tmp_path, 10 * k, 10 * k + 12)  # pages overlap
    (tmp_path / "no ids here.html").write_text(post(7) + post(500, text="", at="never"))
    (tmp_path / "empty-900-999.html").write_text("")
    read = lambda **o: sources.read.format("saved_timeline").options(**o).load(str(tmp_path))
    want = sorted([i for k in range(10) for i in range(10 * k, 10 * k + 13)] + [7, 500])
    assert sorted(r.post_id for r in read().collect()) == want
    assert read(partitionBytes="1500").rdd.getNumPartitions() >= 8 and sorted(r.post_id for r in read(partitionBytes="1500").collect()) == want
    for condition in ("post_id > 42", "post_id >= 42 and post_id < 50", "post_id = 45", "post_id in (3, 44)", "post_id <= 4 or post_id = 90", "post_id > 5 and page like '%40%'"):
        found = read().where(condition)
        assert rows(found.select("post_id", "page")) == rows(read().withColumn("post_id", F.col("post_id") + 0).where(condition).select("post_id", "page"))
    # names tell which pages can be left out
    assert {r.page for r in read().where("post_id = 45").collect()} == {"page-40-52.html"}
    reader = saved._TimelineReader({"path": str(tmp_path)})
    assert reader.pushFilters([saved.GreaterThan(("post_id",), 95)]) == [] and sorted(n for p in reader.partitions() for n in p.names) == ["empty-900-999.html", "no ids here.html", "page-90-102.html"]
    got = {r.post_id: (r.posted_at, r.text) for r in post_parts(read()).collect()}
    assert got[45] == (dt.datetime(2024, 1, 2, 3, 4, 5), "text & more end 45") and got[500] == (None, "end 500")


def test_pages_as_a_stream(sources, tmp_path):
    pages, sink, kept = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "kept")
    pages.mkdir()

    def go(**options):
        stream = sources.readStream.format("saved_timeline").options(**options).load(str(pages))
        stream.select("post_id").writeStream.format("parquet").option("checkpointLocation", kept).trigger(availableNow=True).start(sink).awaitTermination()
        return sorted(r.post_id for r in sources.read.schema("post_id long").parquet(sink).collect())

    page(pages, 1, 9)
    assert go(newest="3") == [4, 5, 6, 7, 8, 9]  # above the greatest stored id
    page(pages, 8, 15)  # overlaps what has been read
    page(pages, 1, 2)  # comes late
    assert go(newest="3") == list(range(4, 16))  # restarted: goes on above 9, nothing twice
    assert go(newest="3") == list(range(4, 16))
    (pages / "new.html").write_text(post(99))
    with pytest.raises(Exception, match="no ids in the names"):
        go()


def workbook(path, cells, shared=True, sheets=("Records",), raw=""):
    """A small workbook; ``cells``: rows of values, None for blanks."""
    strings, xml = [], []
    for r, values in enumerate(cells, 1):
        out = []
        for c, v in enumerate(values):
            name = (chr(64 + c // 26) if c >= 26 else "") + chr(65 + c % 26) + str(r)
            if isinstance(v, bool):
                out.append(f'<c r="{name}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, int | float):
                out.append(f'<c r="{name}" s="1"><v>{v}</v></c>')
            elif v is not None and shared:
                strings.append(v)
                out.append(f'<c r="{name}" t="s"><v>{len(strings) - 1}</v></c>')
            elif v is not None:
                out.append(f'<c r="{name}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>')
        xml.append(f'<row r="{r}" x14ac:dyDescent="0.2">{"".join(out)}</row>' if out else f'<row r="{r}"/>')
    rich = lambda s: f"<si><r><t>{escape(s[:2])}</t></r><r><t xml:space=\"preserve\">{escape(s[2:])}</t></r><rPh><t>aloud</t></rPh></si>"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="x"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="{"/xl/" if k else ""}worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(map(rich, strings)) + "</sst>")
        for k in range(len(sheets)):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet><cols/><rowBreaks/><sheetData>{"".join(xml) if k == len(sheets) - 1 else ""}</sheetData><rowEnd/>{raw}</worksheet>')


@pytest.mark.parametrize("shared", [True, False])
def test_sheet_by_ranges(sources, tmp_path, shared):
    rnd = random.Random(4)
    data = [[rnd.choice([None, k, k / 4, True, "<row> & text", f"row {k} " + "é" * rnd.randint(0, 30)]) for _ in range(rnd.randint(0, 30))] for k in range(200)]
    workbook(tmp_path / "b.xlsx", data, shared, ("Other", "Records"))
    text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)

    def trimmed(values):
        values = [text(v) for v in values]
        while values and values[-1] is None:
            values.pop()
        return values

    for size in (400, 997, 1 << 24):
        df = sources.read.format("zipped_sheet").options(sheet="Records", partitionBytes=str(size)).load(str(tmp_path / "b.xlsx"))
        got = df.collect()
        assert [r.cells for r in sorted(got, key=lambda r: r.row)] == [trimmed(v) for v in data] and len({r.row for r in got}) == 200
        if size == 997:
            assert df.rdd.getNumPartitions() > 20
            assert sorted(r.row for r in df.where("row > 50 and row <= 60").collect()) == list(range(51, 61))
    with pytest.raises(Exception, match="no sheet"):
        sources.read.format("zipped_sheet").option("sheet", "None").load(str(tmp_path)).collect()


def test_sheet_with_repeated_groups(sources, tmp_path):
    head = ["ID", "Name", "Tag 1", "Attr name 1", "Attr value 1", "Tag 2", "Attr name 2", "Attr value 2", "Updated"]
    workbook(tmp_path / "a.xlsx", [head, [1, "One", "x", "size", 5, "y", None, "loose", 45292], [2, None, None, None, None, "z"], [], [3, "Three"]])
    out = sheet_table(sources, str(tmp_path), groups={"tags": {"tag": "Tag"}, "attrs": {"name": "Attr name", "value": "Attr value"}})
    got = [(r.row, r.ID, r.Name, [t.tag for t in r.tags], [tuple(a) for a in r.attrs], r.day) for r in out.withColumn("day", sheet_day(F.col("Updated"))).orderBy("row").collect()]
    assert got == [(2, "1", "One", ["x", "y"], [("size", "5"), (None, "loose")], dt.date(2024, 1, 1)), (3, "2", None, ["z"], [], None), (4, None, None, [], [], None), (5, "3", "Three", [], [], None)]


def test_sheets_as_a_stream(sources, tmp_path):
    books, sink, kept = tmp_path / "books", str(tmp_path / "out"), str(tmp_path / "kept")
    books.mkdir()

    def go():
        stream = sources.readStream.format("zipped_sheet").load(str(books))
        stream.select("book", "row").writeStream.format("parquet").option("checkpointLocation", kept).trigger(availableNow=True).start(sink).awaitTermination()
        return rows(sources.read.schema("book string, row int").parquet(sink))

    workbook(books / "2024-01-01.xlsx", [["ID"], [1]])
    assert go() == [("2024-01-01.xlsx", 1), ("2024-01-01.xlsx", 2)]
    workbook(books / "2024-01-02.xlsx", [["ID"]])
    assert go()[2:] == [("2024-01-02.xlsx", 1)] and len(go()) == 3
