"""Small files written by the driver: JSON side-cars and Markdown reports."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import SparkSession

MANUAL_MARK = "<!-- manual notes below -->"


def _file(path: str):
    """File system and path of a URI, as the session's readers see it; None for a plain local path."""
    if not re.match(r"\w[\w+.-]+:", path):
        return None
    spark = SparkSession.getActiveSession()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_json(path: str, value: dict) -> None:
    text = json.dumps(value, indent=2, default=str, sort_keys=True)
    if at := _file(path):
        out = at[0].create(at[1], True)
        out.write(bytearray(text.encode()))
        out.close()
    else:
        with open(path, "w") as f:
            f.write(text)


def read_json(path: str) -> dict:
    if at := _file(path):
        stream = at[0].open(at[1])
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        return json.loads(text)
    with open(path) as f:
        return json.load(f)


def markdown_table(columns: list[str], rows: list[tuple]) -> str:
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return "\n".join([line(columns), line("---" for _ in columns), *map(line, rows)])


def write_report(path: str, text: str) -> None:
    """Replace the generated part; what stands below the mark stays."""
    notes = ""
    if os.path.exists(path):
        with open(path) as f:
            _, mark, rest = f.read().partition(MANUAL_MARK)
        notes = mark + rest
    with open(path, "w") as f:
        f.write(text.rstrip("\n") + "\n\n" + (notes or MANUAL_MARK + "\n"))
