"""Days of the archive that move between storage classes, and are deleted at last.

Each class has a root folder of its own. A manifest says where every day is read from; a move copies the day's files,
then switches the manifest, then deletes the old files, so readers see each row once at every moment and a move that was
broken off is finished by running it again. Older classes hold a day in a few large files, with the hour as a column.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.sinks.tables import delete_path
from loglake.sources.files import archive_schema, path_exists, tenant_folder

# Storage classes in the order of their age in days, and the age at which days are deleted.
CLASS_AFTER = {"Standard": 0, "InfrequentAccess": 30, "Cold": 90}
DELETE_AFTER = 365
DAY = ["tenant_id", "year", "month", "day"]
MANIFEST = "tenant_id string, year string, month string, day string, storage_class string, step long"


class StorageClasses:
    """An archive over several roots: ``roots`` by class, the first being the one that is written to."""

    def __init__(self, spark: SparkSession, roots: dict[str, str], manifest: str):
        if set(roots) != set(CLASS_AFTER):
            raise ValueError(f"a root for each of {', '.join(CLASS_AFTER)}")
        self.spark, self.roots, self.manifest = spark, roots, manifest

    def _moved(self) -> DataFrame:
        """The days that are not in the first class, with their class (`Deleted` for those that are gone)."""
        if not path_exists(self.spark, self.manifest):
            return self.spark.createDataFrame([], MANIFEST).select(*DAY, "storage_class")
        rows = self.spark.read.schema(MANIFEST).parquet(self.manifest)
        return rows.groupBy(*DAY).agg(F.max_by("storage_class", "step").alias("storage_class"))

    def _switch(self, days: DataFrame, to: str) -> None:
        step = F.lit(list(CLASS_AFTER).index(to) if to in CLASS_AFTER else len(CLASS_AFTER)).cast("long")
        days.select(*DAY, F.lit(to).alias("storage_class"), step.alias("step")).write.mode("append").parquet(self.manifest)

    def _files(self, name: str) -> DataFrame:
        root = self.roots[name]
        if not path_exists(self.spark, root):
            return self.spark.createDataFrame([], archive_schema())
        return self.spark.read.schema(archive_schema()).option("basePath", root).parquet(root)

    def rows(self) -> DataFrame:
        """The archive's rows with `storage_class`; each day is read from the class that the manifest names."""
        moved, out = self._moved(), None
        for name in CLASS_AFTER:
            files = self._files(name)
            if name == "Standard":
                mine = files.join(moved.select(*DAY), DAY, "left_anti")
            else:
                mine = files.join(moved.filter(F.col("storage_class") == name).select(*DAY), DAY, "left_semi")
            mine = mine.select(*archive_schema().fieldNames(), F.lit(name).alias("storage_class"))
            out = mine if out is None else out.unionByName(mine)
        return out

    def _folders(self, name: str) -> DataFrame:
        """tenant_id, year, month, day of the folders of a class. Names of folders are listed, no files."""
        pattern = f"{self.roots[name]}/" + "/".join(f"{c}=*" for c in DAY)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(pattern)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        rows = [tuple(unescape(p.partition("=")[2]) for p in s.getPath().toString().split("/")[-len(DAY) :]) for s in found or []]
        return self.spark.createDataFrame(rows, ", ".join(f"{c} string" for c in DAY))

    def _path(self, name: str, row) -> str:
        return f"{self.roots[name]}/{tenant_folder(self.spark, row.tenant_id)}/year={row.year}/month={row.month}/day={row.day}"

    def days(self) -> DataFrame:
        """tenant_id, year, month, day, storage_class of all days there are."""
        moved, first = self._moved(), "Standard"
        out = self._folders(first).join(moved, DAY, "left_anti").withColumn("storage_class", F.lit(first))
        for name in [n for n in CLASS_AFTER if n != first]:
            out = out.unionByName(self._folders(name).join(moved.filter(F.col("storage_class") == name), DAY))
        return out

    def move(self, as_of: dt.datetime) -> dict[str, int]:
        """Move and delete what is due; returns the number of days by where they went."""
        self._clean()
        day = F.to_date(F.concat_ws("-", "year", "month", "day"))
        age = F.datediff(F.lit(as_of.date()), day)
        target = F.lit("Standard")
        for name, after in CLASS_AFTER.items():
            target = F.when(age >= after, name).otherwise(target)
        target = F.when(age >= DELETE_AFTER, "Deleted").otherwise(target)
        due = self.days().withColumn("target", target).filter(F.col("target") != F.col("storage_class")).checkpoint()
        moved = {}
        for name in [*CLASS_AFTER, "Deleted"]:
            days = due.filter(F.col("target") == name)
            named = days.collect()  # folder names
            if not named:
                continue
            if name != "Deleted":
                # Copied first: the manifest still names the old class.
                for source in {r.storage_class for r in named}:
                    paths = [self._path(source, r) for r in named if r.storage_class == source]
                    rows = self.spark.read.schema(archive_schema()).option("basePath", self.roots[source]).parquet(*paths)
                    (
                        rows.hint("rebalance", *DAY)
                        .write.mode("overwrite")
                        .option("partitionOverwriteMode", "dynamic")
                        .partitionBy(*DAY)
                        .parquet(self.roots[name])
                    )
            self._switch(days, name)
            moved[name] = len(named)
        self._clean()
        return moved

    def _clean(self) -> None:
        """Delete files of days from the classes that the manifest does not name for them: what moves leave behind."""
        moved = self._moved()
        for name in CLASS_AFTER:
            left = self._folders(name).join(moved.filter(F.col("storage_class") != name), DAY)
            for row in left.collect():
                delete_path(self.spark, self._path(name, row))
