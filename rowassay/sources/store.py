"""Append-only result store: immutable table versions and the results computed from them."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowassay import constants as C
from rowassay.functions.logical_types import logical_type, physical_type
from rowassay.sources.files import file_inventory, read_table
from rowassay.sources.structure import column_names, name_violations

RESULT_TABLES = (
    "profiles", "findings", "scored_findings", "scores", "score_breakdowns", "schema_diffs", "distribution_drifts", "score_drifts",
    "recommendations", "validations", "runs", "profile_states",
)


# One commit record is a version with all its column rows.
COMMIT = (
    "version_number bigint, name string, description string, source_format string, original_name string, row_count bigint, column_count int, "
    "size_bytes bigint, file_count bigint, sha256 string, folder string, created_at timestamp, "
    "columns array<struct<ordinal_position:int,name:string,physical_type:string,logical_type:string,nullable:boolean>>, dataset_id string"
)
VERSION_TABLES = ("datasets", "dataset_versions", "dataset_columns")


@dataclass(frozen=True)
class ResultStore:
    """Parquet tables below one folder that all executors reach. Nothing is ever rewritten.

    Data versions lie in ``data/dataset_id=…/``, one folder for each attempt to write one. An attempt becomes a version by its
    commit record ``commits/dataset_id=…/<number>.json``, which is put in place whole and only where none is yet; it
    names the attempt's folder and holds the column rows, so a version and all that is known of it appear at once or not at all.
    Result rows are in one folder per table, partitioned by dataset, so that reading one dataset prunes to its folders.
    """

    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        """Whether the table holds any rows; an append of nothing leaves no partition behind."""
        table = "commits" if table in VERSION_TABLES else table
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(table)}/dataset_id=*")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return found is not None and len(found) > 0

    def read(self, table: str, dataset_id: str | None = None) -> DataFrame:
        """All rows of a table, or those of one dataset (F1, pruned to its partition).

        Partition folders would give ids like ``007`` a number's type, so the type is stated. The tables of
        datasets, versions and columns are read from the commit records.
        """
        if table in VERSION_TABLES:
            commits = self.spark.read.schema(COMMIT).json(self.path("commits"))
            commits = commits if dataset_id is None else commits.where(F.col("dataset_id") == dataset_id)
            if table == "dataset_columns":
                return commits.select(F.inline("columns"), "version_number", "dataset_id")
            if table == "dataset_versions":
                return commits.drop("columns", "name", "description")
            return commits.where("version_number = 1").select("name", "description", "created_at", "dataset_id")
        found = self.spark.read.parquet(self.path(table)).schema
        stated = T.StructType([T.StructField(f.name, T.StringType() if f.name == "dataset_id" else f.dataType) for f in found.fields])
        rows = self.spark.read.schema(stated).parquet(self.path(table))
        return rows if dataset_id is None else rows.where(F.col("dataset_id") == dataset_id)

    def append(self, table: str, rows: DataFrame, dataset_id: str, run_id: str | None = None) -> str:
        """Add result rows with their run, time and formula version (S9); returns the run id."""
        if table not in RESULT_TABLES:
            raise ValueError(f"unknown result table: {table}")
        run_id = run_id or uuid.uuid4().hex
        stamped = rows.drop("dataset_id").select(
            "*",
            F.lit(run_id).alias("run_id"),
            F.current_timestamp().alias("created_at"),
            F.lit(C.FORMULA_VERSION).alias("formula_version"),
            F.lit(dataset_id).alias("dataset_id"),
        )
        stamped.write.mode("append").partitionBy("dataset_id").parquet(self.path(table))
        return run_id

    def next_version(self, dataset_id: str) -> int:
        if not self.exists("dataset_versions"):
            return 1
        known = self.read("dataset_versions", dataset_id).agg(F.max("version_number").alias("n")).first().n
        return (known or 0) + 1

    def register(
        self, df: DataFrame, dataset_id: str, name: str, description: str | None = None, source_format: str = "parquet", original_name: str | None = None
    ) -> int:
        """Store ``df`` as the next immutable version of a dataset, with its column rows.

        The data goes to a folder of its own first, then its files are counted, measured and hashed, and last the commit record
        claims the next free number. Of several writers one gets a number, the others try the next. A failure before that leaves
        an unused folder that nothing reads. Broken column names are refused.
        """
        broken = [r.rule for r in name_violations(column_names(self.spark, df.columns)).collect()]
        if broken:
            raise ValueError(f"column names: {', '.join(sorted(set(broken)))}")
        folder = f"attempt={uuid.uuid4().hex}"
        leaf = f"{self._data(dataset_id)}/{folder}"
        df.write.mode("errorifexists").parquet(leaf)
        stored = self.spark.read.parquet(leaf)
        record = {
            "name": name.strip(),
            "description": (description or "").strip() or None,
            "source_format": source_format,
            "original_name": original_name,
            "row_count": stored.count(),
            "column_count": len(stored.columns),
            **self._fingerprint(leaf),
            "folder": folder,
            "columns": [
                {"ordinal_position": i, "name": f.name, "physical_type": physical_type(f.dataType), "logical_type": logical_type(f.dataType), "nullable": f.nullable}
                for i, f in enumerate(stored.schema.fields, start=1)
            ],
        }
        version = self.next_version(dataset_id)
        while not self._commit(dataset_id, version, record):
            version += 1
        return version

    def register_file(self, path: str, source_format: str, dataset_id: str, name: str, description: str | None = None, sha256: str | None = None, max_bytes: int | None = None) -> int:
        """Register one CSV or Parquet file under its own name; refused when empty, too large or not of the stated hash."""
        found = file_inventory(self.spark, path, max_bytes).collect()
        if len(found) != 1 or found[0].problem or sha256 not in (None, found[0].sha256):
            raise ValueError("not one file" if len(found) != 1 else found[0].problem or "wrong_sha256")
        return self.register(read_table(self.spark, path, source_format), dataset_id, name, description, source_format, found[0].file_name)

    def _commit(self, dataset_id: str, version: int, record: dict) -> bool:
        row = {"version_number": version, "created_at": datetime.now(timezone.utc).isoformat(), **record}
        return self._put_if_absent(f"{self.path('commits')}/dataset_id={quote(dataset_id, safe='')}/{version:010}.json", json.dumps(row) + "\n")

    def _put_if_absent(self, path: str, text: str) -> bool:
        """Make a file appear under ``path`` with its whole content, unless there is one; whether it did.

        The content is written under a hidden name first. A link on a local disk, and a rename that never replaces elsewhere,
        are single steps of the file system, so only one of several writers succeeds.
        """
        jvm, settings = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(settings)
        draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_draft-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if files.getScheme() == "file":
                local = [jvm.java.nio.file.Paths.get(files.makeQualified(p).toUri()) for p in (target, draft)]
                jvm.java.nio.file.Files.createLink(*local)
            else:
                never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), settings).rename(draft, target, never)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        finally:
            files.delete(draft, False)
        return True

    def _fingerprint(self, leaf: str) -> dict:
        """Bytes, number and SHA-256 of the data files: the digest of their digests in the order of names."""
        listed = file_inventory(self.spark, leaf, glob="*.parquet")
        whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_name", "sha256"))), lambda f: f["sha256"]), ""), 256)
        row = listed.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"), F.count(F.lit(1)).alias("file_count"), whole.alias("sha256")).first()
        return row.asDict()

    def intact(self, dataset_id: str, number: int) -> bool:
        """Whether the files of a version still have the size and hash they were committed with."""
        row = self.read("dataset_versions", dataset_id).where(F.col("version_number") == number).first()
        return self._fingerprint(f"{self._data(dataset_id)}/{row.folder}") == {k: row[k] for k in ("size_bytes", "file_count", "sha256")}

    def version(self, dataset_id: str, number: int) -> DataFrame:
        """The data of one version, read from its own folder and schema."""
        rows = self.read("dataset_versions", dataset_id).where(F.col("version_number") == number)
        return self.spark.read.parquet(f"{self._data(dataset_id)}/{rows.select('folder').first().folder}")

    def _data(self, dataset_id: str) -> str:
        return f"{self.root}/data/dataset_id={quote(dataset_id, safe='')}"

    def columns(self, dataset_id: str, number: int) -> DataFrame:
        return self.read("dataset_columns", dataset_id).where(F.col("version_number") == number)

    def latest_profile(self, dataset_id: str, number: int) -> DataFrame | None:
        """The newest stored profile of a version, with its typed statistics (S10); None without one."""
        if not self.exists("profiles"):
            return None
        rows = self.read("profiles", dataset_id).where(F.col("version_number") == number)
        newest = rows.agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id")).first().run_id
        return None if newest is None else rows.where(F.col("run_id") == newest)

    def last_run(self, dataset_id: str, kind: str, number: int) -> str | None:
        """The newest run of a step on a version that succeeded, also if it wrote no result rows."""
        if not self.exists("runs"):
            return None
        rows = self.read("runs", dataset_id).where((F.col("kind") == kind) & (F.col("version_number") == number) & (F.col("status") == "succeeded"))
        return rows.agg(F.max_by("step_run_id", F.struct("started_at", "step_run_id")).alias("run")).first().run


METRICS_JSON = (
    "physical_type string, sample_size bigint, non_null_count bigint, null_count bigint, null_rate double, "
    "distinct_count bigint, distinct_rate double, top_values array<struct<value:string,count:bigint,frequency:double>>, "
    "numeric struct<min:double,max:double,mean:double,median:double,std:double,sum:double>, "
    "temporal struct<min:string,max:string>, string_length struct<min:int,max:int,mean:double>"
)


def profile_from_json(rows: DataFrame, column: str = "metrics") -> DataFrame:
    """A profile whose metrics arrive as JSON text, as typed columns again."""
    return rows.withColumn("_m", F.from_json(column, METRICS_JSON)).select("*", "_m.*").drop("_m", column)


def profile_to_json(profiled: DataFrame, column: str = "metrics") -> DataFrame:
    """The metrics of a profile as one JSON text per column."""
    names = [part.split()[0] for part in METRICS_JSON.replace("array<struct<value:string,count:bigint,frequency:double>>", "x").split(", ") if " " in part]
    times = F.struct(F.col("temporal.min").cast("string").alias("min"), F.col("temporal.max").cast("string").alias("max"))
    cells = [times.alias("temporal") if n == "temporal" else F.col(n) for n in names]
    return profiled.select("ordinal_position", "name", "logical_type", F.to_json(F.struct(*cells)).alias(column))
