"""A keyed table in buckets that a batch rewrites in part.

The table is a folder of Parquet files by bucket of the key's hash and a manifest a version,
which names the folder that each bucket lies in. A batch reads and writes only the buckets
that its keys fall in; its manifest, moved into place by one rename, makes all of them valid
at once. A version that is there is not written again, so a redelivered batch changes
nothing. Folders that the latest manifests do not name are removed.

Files are handled by the file system of the path, so any shared one will do.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: str, buckets: int = 64, versions: int = 2):
        """``buckets`` holds for the table's life; a version more than ``versions`` back goes."""
        self.spark, self.path, self.schema, self.key, self.order, self.buckets, self.versions = spark, path.rstrip("/"), schema, key, order, buckets, versions
        self.jvm = spark._jvm
        self.fs = self.file(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def file(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        p = self.file(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def manifests(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.names(f"{self.path}/manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Folder by bucket; of the latest version, if none is named."""
        there = self.manifests()
        if version is None and not there:
            return {}
        source = self.fs.open(self.file(f"{self.path}/manifests/{there[-1] if version is None else version}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def publish(self, version: int, where: dict[str, str]) -> None:
        final, part = f"{self.path}/manifests/{version}.json", f"{self.path}/manifests/_{uuid.uuid4().hex}"
        out = self.fs.create(self.file(part))
        out.write(bytearray(json.dumps(where, sort_keys=True).encode()))
        out.close()
        if not self.fs.rename(self.file(part), self.file(final)):
            self.fs.delete(self.file(part), False)
            raise RuntimeError(f"version {version} was published by another writer")

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: list[str] | None = None) -> DataFrame:
        where = self.manifest(version)
        paths = [f"{self.path}/{folder}/bucket={b}" for b, folder in sorted(where.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def upsert(self, batch: DataFrame, n: int) -> None:
        """Version n: of each key the row that is last by ``order``, whatever order rows arrive in (ties: the greatest row)."""
        there = self.manifests()
        if there and n <= there[-1]:
            return
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        rest = [c for c in columns if c not in (self.key, self.order)]
        new = batch.select(columns)
        touched = [str(r[0]) for r in new.select(self.bucket()).distinct().collect()]  # as many as there are buckets, at most
        old, where = self.read(only=touched), self.manifest()
        if touched:
            folder = f"data-{n}-{uuid.uuid4().hex[:12]}"
            last = F.max_by(F.struct(self.order, *rest), F.struct(self.order, *rest))
            x = old.unionByName(new).groupBy(self.key).agg(last.alias("_r")).select(self.key, "_r.*").select(*columns, self.bucket().alias("bucket"))
            x.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            where = where | {b: folder for b in touched}
        self.publish(n, where)
        self.clean()

    def clean(self) -> None:
        """Old manifests go, then the bucket folders that none names any more."""
        there = self.manifests()
        for version in there[: -self.versions]:
            self.fs.delete(self.file(f"{self.path}/manifests/{version}.json"), False)
        named = {(folder, b) for v in there[-self.versions :] for b, folder in self.manifest(v).items()}
        for folder in self.names(self.path):
            if not folder.startswith("data-"):
                continue
            own = [x for x in self.names(f"{self.path}/{folder}") if x.startswith("bucket=")]
            gone = [x for x in own if (folder, x.removeprefix("bucket=")) not in named]
            for x in [] if len(gone) == len(own) else gone:
                self.fs.delete(self.file(f"{self.path}/{folder}/{x}"), True)
            if len(gone) == len(own):
                self.fs.delete(self.file(f"{self.path}/{folder}"), True)
