"""Papers and the mirror of their metadata, saved as one version: readers see both or neither."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.store import first_wins
from feedloom.schema import CHAT_PAPER
from feedloom.sources.papers import as_chat_papers, read_papers, write_papers
from feedloom.streaming.outbox import files_at


def saved(papers: DataFrame, path: str) -> int:
    """Save ``papers`` (with ``ref`` and ``file``) over those of the latest version at ``path``; gives the new version.

    A paper takes the place of the one of its reference, and so does its row in the mirror; rows of papers
    without an arXiv id are not mirrored, what the mirror has of them stays. Both parts are written to a folder of
    their own, then one small file makes them the latest version. A save that fails on the way, or that another
    has overtaken, changes nothing.
    """
    spark = papers.sparkSession
    at, root = files_at(path)
    at.create_dir(f"{root}/versions", recursive=True)
    known = _versions(at, root)
    new = first_wins(papers, ["ref"], [F.col("file")])
    mirror = as_chat_papers(new)
    if known:
        old, old_mirror = latest(spark, path)
        new = old.join(new.select("ref"), "ref", "left_anti").unionByName(new, allowMissingColumns=True)
        mirror = old_mirror.join(mirror.select("id"), "id", "left_anti").unionByName(mirror)
    version = (known[-1] if known else 0) + 1
    folder = f"data/{version:09d}-{uuid.uuid4().hex}"
    write_papers(new, f"{path}/{folder}/papers")
    mirror.write.parquet(f"{path}/{folder}/mirror")
    if version in _versions(at, root):
        raise FileExistsError(f"version {version} of {path} was saved meanwhile")
    hidden = f"{root}/versions/.{uuid.uuid4().hex}"
    with at.open_output_stream(hidden) as out:
        out.write(json.dumps({"folder": folder}).encode())
    at.move(hidden, f"{root}/versions/{version:09d}.json")
    return version


def latest(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(papers, mirror) of the latest version, or of the given one; empty ones before the first."""
    at, root = files_at(path)
    known = _versions(at, root)
    if not known:
        papers = spark.createDataFrame([], "ref string, file string")
        return papers, spark.createDataFrame([], CHAT_PAPER)
    with at.open_input_stream(f"{root}/versions/{version or known[-1]:09d}.json") as source:
        folder = json.loads(source.read())["folder"]
    return read_papers(spark, f"{path}/{folder}/papers", lines=True), spark.read.parquet(f"{path}/{folder}/mirror")


def _versions(at: fs.FileSystem, root: str) -> list[int]:
    found = at.get_file_info(fs.FileSelector(f"{root}/versions", allow_not_found=True))
    return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))
