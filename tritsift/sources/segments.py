"""A table of a base and deltas with a manifest, as the incremental writer leaves it.

Each append is a Parquet folder of its own and becomes visible when the manifest
that names it replaces the old one; compaction writes a new base and replaces
the manifest, so a reader sees the rows before or after, never a mixture.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Segments:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._at = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def manifest(self) -> dict:
        """{version, segments: [[folder, bytes], ...]}; the first segment is the base."""
        if not self._fs.exists(self._at("manifest.json")):
            return {"version": 0, "segments": []}
        f = self._fs.open(self._at("manifest.json"))
        try:
            return json.loads(bytes(f.readAllBytes()).decode())
        finally:
            f.close()

    def _publish(self, segments: list) -> None:
        made = {"version": self.manifest()["version"] + 1, "segments": segments}
        out = self._fs.create(self._at("manifest.tmp"), True)
        out.write(json.dumps(made).encode())
        out.close()
        self._fs.delete(self._at("manifest.json"), False)
        if not self._fs.rename(self._at("manifest.tmp"), self._at("manifest.json")):
            raise OSError("the manifest couldn't be replaced")

    def _write(self, df: DataFrame, name: str) -> list:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return [name, self._fs.getContentSummary(self._at(name)).getLength()]

    def append(self, df: DataFrame) -> None:
        """One more segment; a repeated append of a failed batch overwrites what no manifest names."""
        held = self.manifest()
        self._publish([*held["segments"], self._write(df, f"segment-{held['version'] + 1:06d}")])

    def read(self) -> DataFrame:
        names = [n for n, _ in self.manifest()["segments"]]
        if not names:
            raise FileNotFoundError(f"{self.path} has no segment")
        return self.spark.read.parquet(*(f"{self.path}/{n}" for n in names))

    def should_compact(self, ratio: float = 0.1) -> bool:
        """Whether the deltas hold more than ratio of the base's bytes."""
        sizes = [b for _, b in self.manifest()["segments"]]
        return len(sizes) > 1 and sum(sizes[1:]) > ratio * sizes[0]

    def compact(self, drop_old: bool = True) -> None:
        held = self.manifest()
        self._publish([self._write(self.read(), f"base-{held['version'] + 1:06d}")])
        for name, _ in held["segments"] if drop_old else []:
            self._fs.delete(self._at(name), True)

    def counts(self) -> DataFrame:
        """(segment, n) of what stands."""
        return self.read().groupBy(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("segment")).agg(F.count("*").alias("n"))
