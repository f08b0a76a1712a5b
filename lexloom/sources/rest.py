"""Paged REST endpoint as a Spark data source, and files that it links to.

``spark.read.format("rest_norms").option("endpoint", ...)`` reads JSON pages
``{"count": n, "results": [...]}``; equality on ``tipo``, ``ano`` and ``id`` reaches the
server, and a range of years becomes one partition a year. An endpoint that is a folder is
read as files ``<year>-<page>.json``, for use without a network.

A partition whose first page fails is an error; one that fails later keeps what came
before, as a page of nothing but rows already seen ends it. An id that is not there
gives no row.
"""

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from lexloom.operators.mutate import first_wins

SCHEMA = "id long, tipo string, numero string, ano int, ementa string, raw string, asked int"
AGENTS = ["lexloom/1 (a)", "lexloom/1 (b)", "lexloom/1 (c)"]
RETRY_ON = {429, 500, 502, 503, 504}
CHUNK = 8192


def get_json(url: str, turn: int = 0, tries: int = 3, wait: float = 1.0, opener=urllib.request.urlopen) -> dict:
    """A page; transient statuses are retried with growing pauses, other errors raise. Turns rotate the user agent."""
    for n in range(tries):
        try:
            request = urllib.request.Request(url, headers={"User-Agent": AGENTS[turn % len(AGENTS)], "Accept": "application/json"})
            with opener(request, timeout=30) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if e.code not in RETRY_ON or n + 1 == tries:
                raise
            time.sleep(wait * 2**n)
    raise AssertionError("unreachable")


class Part(InputPartition):
    """A year of the listing, all of it (None), or one id."""

    def __init__(self, year=None, ident=None):
        super().__init__((year, ident))


class NormReader(DataSourceReader):
    def __init__(self, options: dict, get=get_json):
        self.options, self.get, self.where = dict(options), get, {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("tipo",), ("ano",), ("id",)):
                self.where[f.attribute[0]] = f.value
            yield f  # Spark checks again: the server may ignore a parameter

    def partitions(self):
        if "id" in self.where and not os.path.isdir(self.options["endpoint"]):
            return [Part(ident=int(self.where["id"]))]
        if "ano" in self.where:
            return [Part(int(self.where["ano"]))]
        if "from_year" in self.options:
            return [Part(y) for y in range(int(self.options["from_year"]), int(self.options["to_year"]) + 1)]
        return [Part()]

    def fetch(self, year, offset: int, size: int) -> list[dict]:
        end = self.options["endpoint"]
        if os.path.isdir(end):
            path = os.path.join(end, f"{year if year is not None else 'all'}-{offset // size}.json")
            if not os.path.exists(path):
                return []
            with open(path, encoding="utf-8") as f:
                return json.load(f).get("results", [])
        asked = {"limit": size, "offset": offset} | ({"ano": year} if year is not None else {}) | ({"tipo": self.where["tipo"]} if "tipo" in self.where else {})
        return self.get(f"{end}?{urllib.parse.urlencode(asked)}", offset // size).get("results", [])

    def by_id(self, ident: int) -> list[dict]:
        try:
            got = self.get(f"{self.options['endpoint'].rstrip('/')}/{ident}/", ident)
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return []
            raise
        return [got] if got else []

    def read(self, part) -> Iterator[tuple]:
        year, ident = part.value
        if ident is not None:
            yield from (row(x, None) for x in self.by_id(ident))
            return
        size, most, seen, offset = int(self.options.get("page_size", 50)), int(self.options.get("max_rows", 0)), set(), 0
        while True:
            try:
                got = self.fetch(year, offset, size)
            except (OSError, ValueError):
                if not offset:
                    raise
                return  # what came before the failure stands
            new = {x.get("id"): x for x in reversed(got) if x.get("id") not in seen}
            if not new:
                return
            for ident, x in reversed(new.items()):
                seen.add(ident)
                yield row(x, year)
                if most and len(seen) >= most:
                    return
            offset += size


def row(x: dict, asked) -> tuple:
    """A norm as a row; the kind may be an object with a description."""
    kind, number = x.get("tipo"), x.get("numero")
    return (x.get("id"), kind.get("descricao") if isinstance(kind, dict) else kind, None if number is None else str(number), x.get("ano"), x.get("ementa"), json.dumps(x, ensure_ascii=False, sort_keys=True), asked)


class RestNorms(DataSource):
    @classmethod
    def name(cls):
        return "rest_norms"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return NormReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RestNorms)


def of_years(spark: SparkSession, endpoint: str, first: int, last: int, page_size: int = 50) -> DataFrame:
    """Norms of a range of years, a partition each; an id that several years list counts in the first."""
    register(spark)
    x = spark.read.format("rest_norms").option("endpoint", endpoint).option("from_year", first).option("to_year", last).option("page_size", page_size).load()
    return first_wins(x, "id", "asked")


def write_pages(pages: DataFrame, folder: str) -> int:
    """Writes rows (name, body) as files of a shared folder, each complete or not at all; how many."""

    def put(batches):
        for b in batches:
            for name, body in zip(b["name"], b["body"]):
                store(os.path.join(folder, name), [body.encode()])
            yield pd.DataFrame({"n": [len(b)]})

    os.makedirs(folder, exist_ok=True)
    return pages.select("name", "body").mapInPandas(put, "n long").groupBy().sum("n").first()[0] or 0


def store(path: str, chunks) -> int:
    """A file written beside its place and moved there when whole; its size."""
    part, n = f"{path}.{os.getpid()}-{time.time_ns()}.part", 0
    try:
        with open(part, "wb") as f:
            for c in chunks:
                n += f.write(c)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return n


def download(files: DataFrame, folder: str, suffix: str = ".pdf", opener=urllib.request.urlopen) -> DataFrame:
    """(id, path, n_bytes, error) of rows (id, url): each file fetched in chunks into a shared folder as ``<id><suffix>``.

    A failure leaves no file and says why; a rerun fetches again.
    """

    def one(ident, url):
        path = os.path.join(folder, f"{ident}{suffix}")
        try:
            with opener(urllib.request.Request(url, headers={"User-Agent": AGENTS[int(ident) % len(AGENTS)]}), timeout=60) as answer:
                return ident, path, store(path, iter(lambda: answer.read(CHUNK), b"")), None
        except (OSError, ValueError) as e:
            return ident, None, 0, f"{type(e).__name__}: {e}"

    def run(batches):
        for b in batches:
            yield pd.DataFrame([one(i, u) for i, u in zip(b["id"], b["url"])], columns=["id", "path", "n_bytes", "error"])

    return files.select("id", "url").mapInPandas(run, "id long, path string, n_bytes long, error string")


def first_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """A look at what a source returns: so many rows, without reading further partitions than needed."""
    return df.limit(n)
