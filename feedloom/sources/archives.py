"""TeX archives: tar files, gzipped or not, or a plain file, to one flat source each."""

from __future__ import annotations

import gzip
import io
import os
import re
import tarfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from feedloom.operators.aggregates import MAIN_NAMES

_INPUT = re.compile(r"(?<!\\)\\(?:input|include)\s*\{([^{}]+)\}|(?<!\\)\\input\s+([^\s{}\\]+)")


def members(data: bytes) -> dict[str, str]:
    """Path and text of each file; paths that leave the archive are refused."""
    if data[:2] == b"\x1f\x8b":
        try:
            data = gzip.decompress(data)
        except (OSError, EOFError):
            return {}
    try:
        out = {}
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            for info in tar:
                path = os.path.normpath(info.name)
                if info.isfile() and not path.startswith(("/", "..")):
                    out[path] = tar.extractfile(info).read().decode(errors="replace")
        return out
    except tarfile.TarError:
        return {"main.tex": data.decode(errors="replace")}


def main_file(files: dict[str, str]) -> str | None:
    """The main file: a common name first, then the longest that looks like one, else the longest, the first of equals."""
    tex = sorted(p for p in files if p.endswith(".tex"))
    main = [p for p in tex if "\\documentclass" in files[p] and "\\begin{document}" in files[p]]
    for name in MAIN_NAMES:
        if name in main:
            return name
    return max(main or tex, key=lambda p: len(files[p]), default=None)


def flattened(files: dict[str, str], path: str, seen: frozenset[str] = frozenset()) -> str:
    """A file with its inputs in place; a file within itself is left out."""

    def put(m: re.Match) -> str:
        name = (m[1] or m[2]).strip()
        for base in (os.path.dirname(path), ""):
            for end in ("", ".tex"):
                at = os.path.normpath(os.path.join(base, name + end))
                if at in files and at not in seen | {path}:
                    return flattened(files, at, seen | {path})
        return ""

    return _INPUT.sub(put, files[path])


def flat_tex(data: bytes) -> str | None:
    files = members(data)
    path = main_file(files)
    return flattened(files, path) if path else None


@F.pandas_udf(StringType())
def flat_tex_udf(data: pd.Series) -> pd.Series:
    return data.map(lambda b: flat_tex(bytes(b)), na_action="ignore")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``path, tex`` of each archive; tex is null where there is no TeX file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", flat_tex_udf("content").alias("tex"))
