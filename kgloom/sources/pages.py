"""Pages of scanned books as a data source: `spark.read.format("book_pages")`.

Under the path each folder is a job, with a file `page_NNN.txt` for each page that has been extracted. A partition is a range of pages of a
job, so a book is read in parallel; filters on job_id and page choose files before any is opened. Documents from which no pages
have been extracted go through a hook: a class given to book_pages(), or named "module:Class" by the option `extractor`, with

    accepts(name) -> bool            whether a file is a document of its kind
    count(file) -> int               its pages
    pages(file, first, last)         yields (page, text, source) of that range, source text, ocr, ocr_unavailable or empty

`file` is a seekable binary file. The document's job is its name without the suffix. Files are reached through pyarrow.fs.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SCHEMA = "job_id string, page int, text string, source string"
PAGE_FILE = re.compile(r"([^/]+)/page_(\d+)\.txt$")
#: Pages of a partition.
RANGE = 64


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _extractor(hook: type | str | None):
    if isinstance(hook, str):
        module, _, cls = hook.partition(":")
        hook = getattr(importlib.import_module(module), cls)
    return hook() if hook else None


class PageReader(DataSourceReader):
    def __init__(self, options: dict, hook: type | None = None) -> None:
        self.uri, self.size, self.hook = options["path"], int(options.get("pages", RANGE)), hook or options.get("extractor")
        self.first, self.last, self.only, self.jobs = 1, 1 << 30, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("page",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif column == ("page",) and isinstance(f, LessThan | LessThanOrEqual):
                self.last = min(self.last, f.value - isinstance(f, LessThan))
            elif column == ("page",) and isinstance(f, EqualTo | In):
                some = set(f.value) if isinstance(f, In) else {f.value}
                self.only = some if self.only is None else self.only & some
            elif column == ("job_id",) and isinstance(f, EqualTo | In):
                some = set(f.value) if isinstance(f, In) else {f.value}
                self.jobs = some if self.jobs is None else self.jobs & some
            elif not (isinstance(f, IsNotNull) and column in (("page",), ("job_id",))):  # neither is ever null
                yield f

    def wanted(self, page: int) -> bool:
        return self.first <= page <= self.last and (self.only is None or page in self.only)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, folder = _files(self.uri)
        hook, jobs, out = _extractor(self.hook), {}, []
        for info in files.get_file_info(fs.FileSelector(folder, recursive=True)):
            found = PAGE_FILE.search(info.path)
            name = info.path.rsplit("/", 1)[-1]
            if found and (self.jobs is None or found[1] in self.jobs) and self.wanted(int(found[2])):
                jobs.setdefault(found[1], []).append((int(found[2]), info.path))
            elif not found and hook and info.is_file and hook.accepts(name) and (self.jobs is None or name.rsplit(".", 1)[0] in self.jobs):
                with files.open_input_file(info.path) as f:
                    n = hook.count(f)
                for lo in range(self.first, min(n, self.last) + 1, self.size):
                    out.append(InputPartition(("document", name.rsplit(".", 1)[0], info.path, lo, min(lo + self.size - 1, n, self.last))))
        for job, pages in sorted(jobs.items()):
            pages.sort()
            out += [InputPartition(("pages", job, pages[i: i + self.size])) for i in range(0, len(pages), self.size)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        files, _ = _files(self.uri)
        kind, job, *rest = partition.value
        if kind == "pages":
            for page, path in rest[0]:
                with files.open_input_stream(path) as f:
                    text = f.read().decode("utf-8", "replace")
                yield job, page, text, "text" if text.strip() else "empty"
        else:
            path, first, last = rest
            with files.open_input_file(path) as f:
                for page, text, source in _extractor(self.hook).pages(f, first, last):
                    if self.wanted(page):
                        yield job, page, text, source


class BookPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "book_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


def book_pages(spark: SparkSession, path: str, extractor: type | None = None, pages: int = RANGE) -> DataFrame:
    """(job_id, page, text, source) of the books under path (a URI); filters on job_id and page are pushed down."""

    class Hooked(BookPages):
        def reader(self, schema) -> DataSourceReader:
            return PageReader(self.options, extractor)

    spark.dataSource.register(Hooked if extractor else BookPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("book_pages").option("pages", pages).load(path)
