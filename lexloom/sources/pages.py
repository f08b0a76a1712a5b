"""Pages of a listing as a stream, and files written with a commit.

``spark.readStream.format("norm_pages")`` follows a paged endpoint: an offset says how many
pages of each year have been read, a batch reads the pages between two offsets, a partition
each, so a restart goes on where the checkpoint stopped and a replay reads the same pages.
Rows come as they are listed, repeats included, with their year, page and place; a page that
cannot be read is one row that says why, and the years beside it go on.

``df.write.format("whole_files")`` writes rows (name, body) as files of a shared folder. Tasks
stage their files; the commit moves those that the successful attempts report, so a failed or
second attempt leaves nothing, and a rerun replaces files by the same ones.
"""

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from lexloom.operators.mutate import first_wins
from lexloom.sources.rest import get_json, row, store

PAGES = "year int, page int, place int, id long, tipo string, numero string, ano int, ementa string, raw string, error string"


TASKS = 64  # partitions of a batch


class Page(InputPartition):
    """A run of pages of a year: from its first page up to, not including, ``end``; one page by default."""

    def __init__(self, year: int, page: int, end: int | None = None):
        super().__init__((year, page))
        self.end = page + 1 if end is None else end


def runs(spans: list[tuple[int, int, int]]) -> list[Page]:
    """Pages of (year, first, end) in runs of a like number, at most ``TASKS`` and one a year; few pages are a partition each."""
    step = max(1, -(-sum(end - first for _, first, end in spans) // TASKS))
    return [Page(y, p, min(p + step, end)) for y, first, end in spans for p in range(first, end, step)]


class Listing:
    """Pages of years, from an address or from files ``<year>-<page>.json`` of a folder."""

    def __init__(self, options: dict, get=get_json):
        self.endpoint, self.size = options["endpoint"], int(options.get("page_size", 50))
        self.years = range(int(options["from_year"]), int(options["to_year"]) + 1)
        self.kind, self.get = options.get("tipo"), get

    def address(self, year: int, page: int) -> str:
        asked = {"limit": self.size, "offset": page * self.size, "ano": year} | ({"tipo": self.kind} if self.kind else {})
        return f"{self.endpoint}?{urlencode(asked)}"

    def page(self, year: int, page: int) -> dict:
        if os.path.isdir(self.endpoint):
            with open(os.path.join(self.endpoint, f"{year}-{page}.json"), encoding="utf-8") as f:
                return json.load(f)
        return self.get(self.address(year, page), page)

    def lengths(self) -> dict[str, int]:
        """Pages of each year that are there now; a year that does not answer counts one, whose reading will say why."""
        out: dict[str, int] = {}
        if os.path.isdir(self.endpoint):
            for name in os.listdir(self.endpoint):
                m = re.fullmatch(r"(\d+)-(\d+)\.json", name)
                if m and int(m[1]) in self.years:
                    out[m[1]] = max(out.get(m[1], 0), int(m[2]) + 1)
            return out
        for year in self.years:
            try:
                out[str(year)] = -(-int(self.get(self.address(year, 0), 0).get("count", 0)) // self.size)
            except (OSError, ValueError):
                out[str(year)] = 1
        return out

    def rows(self, year: int, page: int) -> Iterator[tuple]:
        try:
            got = self.page(year, page).get("results", [])
        except (OSError, ValueError) as e:
            yield (year, page, 0, None, None, None, None, None, None, f"{type(e).__name__}: {e}")
            return
        for i, x in enumerate(got):
            yield (year, page, i, *row(x, year)[:6], None)

    def run(self, part: Page) -> Iterator[tuple]:
        year, first = part.value
        for page in range(first, part.end):
            yield from self.rows(year, page)


class PageStream(DataSourceStreamReader):
    def __init__(self, options: dict, get=get_json):
        self.listing = Listing(options, get)
        self.most = int(options.get("pages_per_batch", 0))
        self.at: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """All that is there; with ``pages_per_batch`` so many pages beyond what was planned last, year by year."""
        there = self.listing.lengths()
        if not self.most:
            return {y: max(n, self.at.get(y, 0)) for y, n in there.items()}
        end, room = dict(self.at), self.most
        for y in sorted(there, key=int):
            more = min(room, max(0, there[y] - end.get(y, 0)))
            if more:
                end[y], room = end.get(y, 0) + more, room - more
        return end

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.at = {y: max(n, self.at.get(y, 0)) for y, n in {**start, **end}.items()}
        return runs([(int(y), start.get(y, 0), end[y]) for y in sorted(end, key=int)])

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from self.listing.run(partition)

    def commit(self, end: dict) -> None:
        """Nothing to free: the listing keeps its pages."""


class PageReader(DataSourceReader):
    def __init__(self, options: dict, get=get_json):
        self.listing = Listing(options, get)

    def partitions(self) -> list[Page]:
        return runs([(int(y), 0, n) for y, n in sorted(self.listing.lengths().items())])

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from self.listing.run(partition)


class NormPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "norm_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options)


def page_stream(spark: SparkSession, endpoint: str, first: int, last: int, page_size: int = 50, **more) -> DataFrame:
    spark.dataSource.register(NormPages)
    reader = spark.readStream.format("norm_pages").option("endpoint", endpoint).option("from_year", first).option("to_year", last).option("page_size", page_size)
    for k, v in more.items():
        reader = reader.option(k, v)
    return reader.load()


def of_years(spark: SparkSession, endpoint: str, first: int, last: int, page_size: int = 50) -> tuple[DataFrame, DataFrame]:
    """(norms, failures) of a range of years read at once: an id that several years list counts in the first; a year or page
    that cannot be read is passed over and stands among the failures (year, page, error)."""
    spark.dataSource.register(NormPages)
    x = spark.read.format("norm_pages").option("endpoint", endpoint).option("from_year", first).option("to_year", last).option("page_size", page_size).load()
    rows = first_wins(x.filter("id is not null").withColumn("asked", F.struct("year", "page", "place")).drop("year", "page", "place", "error"), "id", "asked")
    return rows.withColumn("asked", F.col("asked.year")), x.filter("error is not null").select("year", "page", "error")


def fetched(rows: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, report) of listed rows: pages of a year count until ``most`` rows were fetched, repeats included, the last page
    whole. The report has a row a year: pages, rows fetched, rows whose id an earlier one of the year had, failed pages."""
    pages = rows.groupBy("year", "page").agg(F.count("id").alias("n"), F.count("error").alias("failed"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("year").orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pages = pages.withColumn("before", before)
    if most is not None:
        pages = pages.filter(F.col("before") < most)
    taken = rows.join(pages.select("year", "page"), ["year", "page"], "left_semi")
    ids = taken.filter("id is not null").groupBy("year", "id").agg(F.count("*").alias("k")).groupBy("year").agg(F.sum(F.col("k") - 1).alias("n_repeated"))
    report = pages.groupBy("year").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_fetched"), F.sum("failed").alias("n_failed"))
    report = report.join(ids, "year", "left").fillna(0, ["n_repeated"])
    return taken.filter("error is null"), report.select("year", "n_pages", "n_fetched", "n_repeated", "n_failed")


# Files

@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: list[str]


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.suffix, self.overwrite = options["path"], options.get("suffix", ""), overwrite
        self.staging = os.path.join(self.folder, f"_staging-{uuid.uuid4().hex}")

    def write(self, iterator) -> Staged:
        """An attempt's files, in a folder of its own."""
        own, names = os.path.join(self.staging, uuid.uuid4().hex), []
        os.makedirs(own, exist_ok=True)
        for r in iterator:
            name, body = str(r["name"]) + self.suffix, r["body"]
            if "/" in name or name.startswith("_"):
                raise ValueError(f"not a name of a file: {name}")
            store(os.path.join(own, name), [body if isinstance(body, (bytes, bytearray)) else str(body or "").encode()])
            names.append(name)
        return Staged(own, names)

    def commit(self, messages: list) -> None:
        """Moves what the attempts that count have staged, then says what there is in one file; the rest goes."""
        kept = set()
        for m in messages:
            for name in m.names if m else []:
                os.replace(os.path.join(m.folder, name), os.path.join(self.folder, name))
                kept.add(name)
        if self.overwrite:
            for name in os.listdir(self.folder):
                if name not in kept and not name.startswith("_"):
                    os.remove(os.path.join(self.folder, name))
        store(os.path.join(self.folder, "_COMMITTED"), ["\n".join(sorted(kept)).encode()])
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class WholeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options, overwrite)


def write_files(rows: DataFrame, folder: str, mode: str = "append", suffix: str = "") -> None:
    """Rows (name, body: string or binary) as files ``<name><suffix>`` of a shared folder, all of them or none."""
    rows.sparkSession.dataSource.register(WholeFiles)
    os.makedirs(folder, exist_ok=True)
    rows.select("name", "body").write.format("whole_files").mode(mode).option("path", folder).option("suffix", suffix).save()
