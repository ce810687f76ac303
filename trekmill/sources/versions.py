"""Packages of several tables that change together: versions, each named by one manifest that is written last.

A package is a folder with `data/<version>-<writer>/<table>` and `manifest/<version>.json`. A version exists once its manifest does, and that
appears as a whole or not at all. So a writer that fails leaves the version before it as it was, readers keep to the version
that they opened, and of two writers that started from one version the second one to finish is refused.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to become."""


@dataclass(frozen=True)
class Package:
    """One version of a package; what it reads doesn't change when others are committed."""

    spark: SparkSession
    root: str
    version: int
    tables: dict[str, dict]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.tables[name]["schema"]).parquet(self.tables[name]["path"])

    def rows(self, name: str) -> int:
        return self.tables[name]["rows"]


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, rising."""
    fs, at = _fs(spark, f"{root}/manifest/*.json")
    return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.globStatus(at) or [])


def open_package(spark: SparkSession, root: str, version: int | None = None) -> Package:
    """The last version, or the one that is asked for."""
    found = versions(spark, root)
    if not found or (version is not None and version not in found):
        raise FileNotFoundError(f"no version {'' if version is None else version} of {root}")
    at = max(found) if version is None else version
    text = "\n".join(r.value for r in spark.read.text(f"{root}/manifest/{at:012d}.json", wholetext=True).collect())  # one small file
    return Package(spark, root, at, json.loads(text)["tables"])


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], base: int | None = None, keep: int = 2, partitions: dict[str, list[str]] | None = None) -> Package:
    """Writes the given tables and then the manifest of the next version; tables of the version before that aren't given stay.

    base: the version that the tables were made from (None: the last). If another was committed since, Conflict is raised and nothing
    changes. partitions: columns by which a table's files are divided. Of older versions `keep` stay for their readers (this one
    counted), files of the others go, and so do those of writers that failed before.
    """
    found = versions(spark, root)
    last = max(found, default=0)
    base = last if base is None else base
    if base != last:
        raise Conflict(f"{root} is at version {last}, not {base}")
    known = open_package(spark, root, base).tables if found else {}
    number, folder = base + 1, f"{root}/data/{base + 1:012d}-{uuid.uuid4().hex}"
    new = {}
    for name, df in tables.items():
        path, by = f"{folder}/{name}", (partitions or {}).get(name, [])
        (df.repartition(*by).write.partitionBy(*by) if by else df.write).parquet(path)
        written = spark.read.schema(df.schema).parquet(path)
        new[name] = {"path": path, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "rows": written.count()}
    _publish(spark, f"{root}/manifest/{number:012d}.json", json.dumps({"version": number, "tables": known | new}, indent=1))
    _clean(spark, root, keep)
    return open_package(spark, root, number)


def _publish(spark: SparkSession, path: str, text: str) -> None:
    """The file with all of its text, or Conflict if it is there: written aside, then renamed without overwriting."""
    fs, aside = _fs(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(aside).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), options)
    except Py4JJavaError as e:
        fs.delete(aside, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise Conflict(f"{path} is there already") from e
        raise


def _clean(spark: SparkSession, root: str, keep: int) -> None:
    """Manifests but the last `keep` go, then data folders of versions up to the last that no manifest names."""
    found = versions(spark, root)
    for n in found[: -max(keep, 1)]:
        fs, at = _fs(spark, f"{root}/manifest/{n:012d}.json")
        fs.delete(at, False)
    used = {t["path"].rsplit("/", 1)[0].rsplit("/", 1)[1] for n in found[-max(keep, 1) :] for t in open_package(spark, root, n).tables.values()}
    fs, at = _fs(spark, f"{root}/data/*")
    for s in fs.globStatus(at) or []:
        name = s.getPath().getName()
        if name not in used and int(name.split("-")[0]) <= found[-1]:
            fs.delete(s.getPath(), True)
