"""Documents and files written so that readers never see a part of one."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import write_files


def write_document_files(documents: DataFrame, folder: str) -> DataFrame:
    """Each document (title, document) as one file ``<title>.json``: UTF-8, four spaces for each level, letters as they are; written aside and moved.

    Rows (name, path, length). A title is a path below the folder. A document that isn't JSON fails its task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bodies = [json.dumps(json.loads(d), ensure_ascii=False, indent=4).encode() for d in frame["document"]]
            yield pd.DataFrame({"name": [f"{t}.json" for t in frame["title"]], "content": bodies})

    return write_files(documents.select("title", "document").mapInPandas(run, "name string, content binary"), folder)


def write_documents(documents: DataFrame, folder: str) -> None:
    """JSON documents (title, document), one a line, in a folder for each title; a rerun replaces the titles it holds and leaves others.

    Spark's committer moves finished files only, which is the rename that a single file would need.
    """
    spark = documents.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        documents.select("title", F.col("document").alias("value")).write.mode("overwrite").partitionBy("title").text(folder)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
