"""Pipelines whose stages are written, and taken up again where they stopped.

A stage's output has a folder named by a fingerprint of what made it: the input files (path, length,
time), the names and parameters of this stage and of those before it.  A folder counts only with
its finish mark, which is written last; without one it is written anew.  So a second run starts at the
first stage that is not finished, and a changed input or parameter makes new folders from
the stage that it touches on.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

MARK = "_FINISHED"


@dataclass
class Stage:
    """A step ``run(df, **params) -> DataFrame``; ``params`` must be JSON."""
    name: str
    run: Callable[..., DataFrame]
    params: dict = field(default_factory=dict)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def input_print(spark: SparkSession, path: str) -> str:
    """Fingerprint of the files below a path: names, lengths and times, not their contents."""
    p, fs = _folder(spark, path)
    rows, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        rows.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return _hash([path, sorted(rows)])


def _hash(x) -> str:
    return hashlib.sha256(json.dumps(x, sort_keys=True).encode()).hexdigest()[:24]


def finished(spark: SparkSession, path: str) -> bool:
    p, fs = _folder(spark, f"{path}/{MARK}")
    return fs.exists(p)


def run_stages(spark: SparkSession, source: DataFrame, source_print: str, stages: list[Stage], root: str) -> tuple[DataFrame, list[str]]:
    """The last stage's output, and the names of the stages that ran now."""
    df, made, ran = source, source_print, []
    for stage in stages:
        made = _hash([made, stage.name, stage.params])
        path = f"{root}/{stage.name}-{made}"
        if not finished(spark, path):
            stage.run(df, **stage.params).write.mode("overwrite").parquet(path)
            p, fs = _folder(spark, f"{path}/{MARK}")
            fs.create(p, True).close()
            ran.append(stage.name)
        df = spark.read.parquet(path)
    return df, ran
