"""Reading visits, manifests, pages and periods; writing chunks and results."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.sources.scratch import exists, release, remove, stored

VISIT = (
    "struct<`Прием`:struct<GUID:string,DATE:string>,`Пациент`:map<string,string>,`Услуги`:array<struct<`Наименование`:string>>,"
    "`Диагнозы`:array<struct<`КодМКБ`:string,`НаименованиеМКБ`:string,`Детализация`:string,`ВыявленВпервые`:boolean>>,"
    "`ДанныеОсмотра`:array<struct<`Параметр`:string,`Значение`:string>>>"
)


def appointments(payload: Column) -> Column:
    """The visits of a payload: a JSON array, or an object with the array under "appointments"; null for other texts."""
    wrapped = F.from_json(payload, f"struct<appointments:array<{VISIT}>>")["appointments"]
    bare = F.from_json(F.when(F.ltrim(payload).startswith("["), payload), f"array<{VISIT}>")
    return F.coalesce(bare, wrapped)


def split_appointments(payloads: DataFrame, key: str, column: str = "payload") -> DataFrame:
    """key, ordinal from 0 and the fields of each visit of each payload."""
    return payloads.select(key, F.posexplode(appointments(F.col(column))).alias("ordinal", "visit")).select(key, "ordinal", "visit.*")


def read_appointments(spark: SparkSession, path: str) -> DataFrame:
    """The visits of payload files, with the file's path."""
    return split_appointments(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("payload")), "file")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest CSV with a header: all columns as strings, and ``metadata``, a map of them."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return rows.withColumn("metadata", F.create_map(*[x for c in rows.columns for x in (F.lit(c), F.col(f"`{c}`"))]))


def period(records: DataFrame, date: str, first: str, last: str) -> DataFrame:
    """records of a closed range of dates given as dd.MM.yyyy; prunes partitions where date is one."""
    day = lambda x: F.to_date(F.lit(x), "dd.MM.yyyy")
    return records.where(F.col(date).between(day(first), day(last)))


def land_by_month(records: DataFrame, date: str, path: str) -> None:
    """Write records by the month of a date column; months that are written again are replaced, others stay.

    A month's rows are dealt over tasks, of which each writes a file of its own, so a hot month is no single task.
    """
    month = F.date_format(date, "yyyy-MM")
    salted = records.withColumn("month", month).repartition("month", F.pmod(F.xxhash64(*records.columns), F.lit(4)))
    salted.sortWithinPartitions("month", date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def read_period(spark: SparkSession, path: str, date: str, first: str, last: str) -> DataFrame:
    """The records of a closed range of dates, given as dd.MM.yyyy, of what land_by_month() wrote.

    Only the folders of its months are listed and read; within them row groups go by their dates.
    """
    month = lambda x: F.date_format(F.to_date(F.lit(x), "dd.MM.yyyy"), "yyyy-MM")
    landed = spark.read.option("basePath", path).schema(spark.read.parquet(path).schema).parquet(path)
    return period(landed.where(F.col("month").cast("string").between(month(first), month(last))), date, first, last).drop("month")


def land_for_lookups(rows: DataFrame, path: str, *keys: str, group_bytes: int = 4 << 20) -> None:
    """Write rows for lookups by the keys: in ranges of the first key, in small row groups, with a Bloom filter for each key.

    A lookup by the first key reads the row groups whose range has it, one by another key those
    whose filter has it; the filters stand in the files' footers and cost no pass.
    """
    writer = rows.repartitionByRange(keys[0]).sortWithinPartitions(*keys).write.option("parquet.block.size", group_bytes)
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.parquet(path)


#: Folders that chunks lie in, by a hash of their file.
BUCKETS = 4096


def _bucket(file_id: Column) -> Column:
    return F.pmod(F.xxhash64(file_id), F.lit(BUCKETS)).cast("int")


def _write_buckets(chunks: DataFrame, path: str) -> None:
    """Replace the folders of these chunks. Large buckets are split over tasks by their bytes, small ones share a task."""
    chunks.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_docs(chunks: DataFrame, path: str) -> None:
    """Write chunks (file_id, ...); a file that is written again is replaced as a whole, others stay.

    Files lie in BUCKETS folders by a hash of their id (a null id is a file like others), so
    folders do not grow in number with the files. Only the folders of the files at hand
    are read and written again: their other files' chunks go with the new ones. Spark writes a
    folder aside and swaps it in when the job commits, so a job that fails changes nothing. Columns that one
    side lacks are null there. One writer at a time.
    """
    spark = chunks.sparkSession
    new = chunks.withColumn("bucket", _bucket(F.col("file_id")))
    if not exists(spark, path):
        return _write_buckets(new, path)
    new = stored(new, "new-chunks")
    own = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
    files = new.select(F.col("file_id").alias("_file")).distinct()
    others = spark.read.parquet(path).where(F.col("bucket").isin(own))
    others = others.join(files, F.col("file_id").eqNullSafe(F.col("_file")), "left_anti")
    _write_buckets(others.unionByName(new, allowMissingColumns=True), path)
    release(new)


def read_docs(spark: SparkSession, path: str, file_id: str | None = None) -> DataFrame:
    """The chunks that write_docs() wrote; with a file's id its own, from the one folder it lies in."""
    chunks = spark.read.parquet(path)
    if file_id is not None:
        chunks = chunks.where(F.col("bucket") == _bucket_of(spark, file_id)).where(F.col("file_id") == file_id)
    return chunks.drop("bucket")


def _bucket_of(spark: SparkSession, file_id: str) -> int:
    return spark.range(1).select(_bucket(F.lit(file_id))).first()[0]


def delete_file(spark: SparkSession, path: str, file_id: str) -> int:
    """Delete the chunks of one file from those that write_docs() wrote; the number of them.

    Only the folder of the file's bucket is listed and read. It is written again without the file, or deleted if it holds
    no other, so the file goes as a whole.
    """
    folder = f"{path.rstrip('/')}/bucket={_bucket_of(spark, file_id)}"
    if not exists(spark, folder):
        return 0
    chunks, own = spark.read.option("basePath", path).parquet(folder), F.col("file_id").eqNullSafe(F.lit(file_id))
    deleted, left = chunks.agg(F.count_if(own), F.count_if(~own)).first()
    if deleted and left:
        _write_buckets(chunks.where(~own), path)
    elif deleted:
        remove(spark, folder)
    return deleted


def write_results(results: DataFrame, path: str) -> None:
    """Append results (run_date, input, flags, issues)."""
    results.write.mode("append").partitionBy("run_date").parquet(path)


class _Parser(HTMLParser):
    """A parser that does not count lines, which nothing here asks for."""

    def updatepos(self, i: int, j: int) -> int:
        return j


#: A page without anything but text and plain tags (no comment, character reference, script or bare sign), and its pieces: text, end, name, attributes.
_TAG = r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:[ \t\n\r\f]+[A-Za-z]+=\"[^\"<>&]*\")*)>"
_PLAIN, _PIECE, _ATTRIBUTE = re.compile(rf"[^<&\0]*+(?:{_TAG}[^<&\0]*+)*+"), re.compile(rf"([^<]+)|{_TAG}"), re.compile(r"([A-Za-z]+)=\"([^\"]*)\"")
#: Tags whose contents are no markup.
_RAW = re.compile(r"<(?:script|style|textarea|title|iframe|noembed|noframes|noscript|xmp|plaintext)\b", re.IGNORECASE)


def _read(parser: _Parser, html: str) -> None:
    """Feed a page to a parser. Plain pages go by one expression, which gives the same starts, ends and texts as the parser's own reading and is faster."""
    if _RAW.search(html) or not _PLAIN.fullmatch(html):
        parser.feed(html)
        parser.close()
        return
    for text, end, name, attributes in _PIECE.findall(html):
        if text:
            parser.handle_data(text)
        elif end:
            parser.handle_endtag(name.lower())
        else:
            parser.handle_starttag(name.lower(), [(k.lower(), v) for k, v in _ATTRIBUTE.findall(attributes)] if attributes else [])


class _Blocks(_Parser):
    """Text blocks of a page: (kind, tag, text). Rows and list items are table rows, headings are contents, other blocks within a table are cells."""

    HIDDEN = frozenset({"script", "style", "title", "noscript", "template"})
    BLOCK = frozenset({"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "td", "th", "ul", "ol", "table", "article", "section", "nav", "body", "br"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, str]] = []
        self.tag, self.text, self.hidden, self.depth = "body", [], 0, 0

    def close_block(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            kind = "cell" if self.depth and self.tag != "tr" else "heading" if len(self.tag) == 2 and self.tag[0] == "h" and self.tag[1].isdigit() else "row" if self.tag in ("li", "tr") else "text"
            self.found.append((kind, self.tag, text))
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag in ("td", "th"):
            self.text.append(" ")
        elif tag in self.BLOCK:
            self.close_block()
            self.tag = self.tag if tag == "br" else tag
            self.depth += tag == "table"

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.BLOCK and tag not in ("td", "th"):
            self.close_block()
            self.tag = "body"
            self.depth = max(0, self.depth - (tag == "table"))

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)


def blocks_of(html: str | None) -> list[tuple[str, str, str]]:
    parser = _Blocks()
    _read(parser, html or "")
    parser.close_block()
    return parser.found


def pages_to_blocks(pages: DataFrame) -> DataFrame:
    """page_id, pos, kind (text, row, heading), tag and text of each block of pages (page_id, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, *b) for i, html in zip(batch["page_id"], batch["html"], strict=True) for n, b in enumerate(blocks_of(html))]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "kind", "tag", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, pos int, kind string, tag string, text string")


class _Tables(_Parser):
    """The tables of a page: how many headings stand before each, and its rows of cells (text, rowspan, colspan).

    A table within a cell is a table of its own, and its text is not the cell's.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, list[list[list]]]] = []
        self.open: list[list[list[list]]] = []
        self.cells: list[list | None] = []
        self.headings, self.hidden = 0, 0

    @staticmethod
    def _span(attrs: list, name: str) -> int:
        value = dict(attrs).get(name) or ""
        return min(1000, max(1, int(value))) if value.isdigit() else 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in _Blocks.HIDDEN
        if tag == "table":
            rows: list[list[list]] = []
            self.found.append((self.headings, rows))
            self.open.append(rows)
            self.cells.append(None)
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() and not self.open:
            self.headings += 1
        elif self.open and tag == "tr":
            self.open[-1].append([])
            self.cells[-1] = None
        elif self.open and tag in ("td", "th"):
            if not self.open[-1]:
                self.open[-1].append([])
            self.cells[-1] = ["", self._span(attrs, "rowspan"), self._span(attrs, "colspan")] if attrs else ["", 1, 1]
            self.open[-1][-1].append(self.cells[-1])
        elif self.open and self.cells[-1] and tag in _Blocks.BLOCK:
            self.cells[-1][0] += " "

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in _Blocks.HIDDEN))
        if self.open and tag == "table":
            self.open.pop()
            self.cells.pop()
        elif self.open and tag in ("td", "th", "tr"):
            self.cells[-1] = None

    def handle_data(self, data: str) -> None:
        if self.open and self.cells[-1] and not self.hidden:
            self.cells[-1][0] += data


def _grid(rows: list[list[list]]) -> list[list[str]]:
    """Rows of texts: a cell that spans rows or columns fills all its places."""
    out: list[list[str]] = []
    below: dict[int, tuple[str, int]] = {}  # column: text and how many more rows it fills
    for row in rows:
        line: list[str] = []
        left = {c: (t, n) for c, (t, n) in below.items() if n}
        below = {c: (t, n - 1) for c, (t, n) in left.items()}

        def fill() -> None:
            while len(line) in left:  # noqa: B023
                line.append(left.pop(len(line))[0])  # noqa: B023

        for text, down, across in row:
            clean = " ".join(text.split())
            fill()
            for _ in range(across):
                if down > 1:
                    below[len(line)] = (clean, down - 1)
                line.append(clean)
        fill()
        for column in sorted(left):
            line += [""] * (column - len(line)) + [left[column][0]]
        out.append(line)
    return out


def tables_of(html: str | None) -> list[tuple[int, int, list[dict[str, str]]]]:
    """(table, headings before it, records) of a page's tables, by number from 0.

    A table's first row names its columns: a blank name becomes ``Unnamed: n`` by its place, a name that
    was there before gets .1, .2 and so on. Each further row is a record by these names; cells that
    a row lacks are empty. Tables without a further row have no records.
    """
    parser = _Tables()
    _read(parser, html or "")
    return _records(parser)


def _records(parser: _Tables) -> list[tuple[int, int, list[dict[str, str]]]]:
    out = []
    for number, (headings, rows) in enumerate(parser.found):
        grid = [line for line in _grid(rows) if line]
        width = max(map(len, grid), default=0)
        names: dict[str, None] = {}
        last: dict[str, int] = {}  # the numbers below are taken
        for n, name in enumerate((grid[0] + [""] * width)[:width] if grid else []):
            base = name or f"Unnamed: {n}"
            k = last.get(base, 0)
            while (f"{base}.{k}" if k else base) in names:
                k += 1
            last[base] = k + 1
            names[f"{base}.{k}" if k else base] = None
        out.append((number, headings, [dict(zip(names, line + [""] * (width - len(line)), strict=True)) for line in grid[1:]]))
    return out


class _Page(_Parser):
    """Blocks and tables of a page from one reading: each start, end and text goes to both."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks, self.tables = _Blocks(), _Tables()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.blocks.handle_starttag(tag, attrs)
        self.tables.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.blocks.handle_endtag(tag)
        self.tables.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        self.blocks.handle_data(data)
        self.tables.handle_data(data)


def blocks_and_tables(html: str | None) -> tuple[list[tuple[str, str, str]], list[tuple[int, int, list[dict[str, str]]]]]:
    """blocks_of() and tables_of() a page, which is parsed once."""
    parser = _Page()
    _read(parser, html or "")
    parser.blocks.close_block()
    return parser.blocks.found, _records(parser.tables)


def pages_to_tables(pages: DataFrame) -> DataFrame:
    """page_id, table, headings, row (from 0) and record (a JSON object) of each row of each table of pages (page_id, html); see tables_of()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (i, number, headings, n, json.dumps(record, ensure_ascii=False))
                for i, html in zip(batch["page_id"], batch["html"], strict=True) for number, headings, records in tables_of(html) for n, record in enumerate(records)
            ]
            yield pd.DataFrame(rows, columns=["page_id", "table", "headings", "row", "record"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, table int, headings int, row int, record string")
