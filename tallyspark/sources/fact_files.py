"""A data source for folders of company-fact files: spark.read.format("company_facts").load(folder).

Each file is one JSON document (or one per line) facts.<namespace>.<tag>.units.<unit>[]; its rows are those of
disclosures.company_facts, and the path. Files are packed into partitions of `bytes_per_partition`; a file of lines is held one line at a time. Filters on
cik, form, fp, fy, namespace, tag and unit (equality or IN) are pushed down: where the path tells the value (a folder
cik=0000000001, or a file CIK0000000001.json) files are not opened, else branches and rows that do not fit are
skipped before they reach Spark. Columns that a query does not need are not asked for by Spark's interface; it
drops them behind the scan.

Listing goes through pyarrow's file systems (local, HDFS, S3, GCS), as a data source runs without a session.
Documents that are not valid JSON, and parts of another shape, give no rows.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TextIO
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "cik string, entity string, namespace string, tag string, unit string, start_date string, end_date string, value double, accession_number string, fy int, fp string, form string, filed_at string, path string"
ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}[c.split()[1]]) for c in SCHEMA.split(", ")])
PUSHED = ("cik", "form", "fp", "fy", "namespace", "tag", "unit")
NAMED = re.compile(r"CIK([0-9]{10})\.json$")
ROWS_AT_ONCE = 8192


@dataclass
class Files(InputPartition):
    paths: list[str]


def told_by(path: str) -> dict[str, str]:
    """Column values that a path tells."""
    found = {k: unquote(v) for k, _, v in (part.partition("=") for part in path.split("/")[:-1]) if v}
    return {**found, "cik": m[1]} if (m := NAMED.search(path)) else found


def child(node: object, name: str) -> dict:
    inner = node.get(name) if isinstance(node, dict) else None
    return inner if isinstance(inner, dict) else {}


def parsed(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return None


def documents(file: TextIO) -> Iterator[dict]:
    """The JSON objects of a file: it has one on each line, and is read line by line; or it is one over several lines."""
    first = next((line for line in file if line.strip()), "")
    found = parsed(first)
    if found is None:  # a document that goes on, or a line that is no JSON before others that are
        rest = [first, *file]
        whole = parsed("".join(rest))
        yield from (d for d in ([whole] if whole is not None else map(parsed, rest)) if isinstance(d, dict))
        return
    if isinstance(found, dict):
        yield found
    for line in file:
        if isinstance(d := parsed(line), dict):
            yield d


def number(x: object) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def word(x: object) -> str | None:
    return x if isinstance(x, str) else None


class FactReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.pack = options["path"], int(options.get("bytes_per_partition", 16 << 20))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column not in PUSHED:
                yield f
                continue
            values = set(f.value if isinstance(f, In) else [f.value])
            self.wanted[column] = self.wanted.get(column, values) & values

    def fits(self, column: str, value: object) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def opened(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[Files]:
        system, top = self.opened()
        listed = system.get_file_info(fs.FileSelector(top, recursive=True))
        files = sorted((f.path, f.size) for f in listed if f.is_file and not f.base_name.startswith((".", "_")))
        packed, held = [], 0
        for path, size in files:
            known = told_by(path[len(top) :])
            if not all(self.fits(c, v) for c, v in known.items() if c in PUSHED and c != "fy"):
                continue
            if not packed or held + size > self.pack:
                packed.append(Files([]))
                held = 0
            packed[-1].paths.append(path)
            held += size
        return packed or [Files([])]

    def rows(self, path: str, file: TextIO) -> Iterator[dict]:
        for d in documents(file):
            cik = str(d["cik"]).zfill(10) if isinstance(d.get("cik"), (str, int)) else None
            if not self.fits("cik", cik):
                continue
            for namespace, tags in child(d, "facts").items():
                for tag in tags if self.fits("namespace", namespace) and isinstance(tags, dict) else ():
                    for unit, values in child(tags[tag], "units").items() if self.fits("tag", tag) else ():
                        for v in values if self.fits("unit", unit) and isinstance(values, list) else ():
                            if isinstance(v, dict) and all(self.fits(c, v.get(c)) for c in ("form", "fp", "fy")):
                                fy = v.get("fy")
                                yield {
                                    "cik": cik, "entity": word(d.get("entityName")), "namespace": namespace, "tag": tag, "unit": unit, "start_date": word(v.get("start")), "end_date": word(v.get("end")), "value": number(v.get("val")),
                                    "accession_number": word(v.get("accn")), "fy": fy if isinstance(fy, int) else None, "fp": word(v.get("fp")), "form": word(v.get("form")), "filed_at": word(v.get("filed")), "path": path,
                                }

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = self.opened()
        held: list[dict] = []
        for path in partition.paths:
            with system.open_input_stream(path) as f, io.TextIOWrapper(f, encoding="utf-8", errors="replace") as file:
                for row in self.rows(path, file):
                    held.append(row)
                    if len(held) == ROWS_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(held, schema=ARROW)
                        held = []
        yield pa.RecordBatch.from_pylist(held, schema=ARROW)


class CompanyFacts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "company_facts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FactReader:  # noqa: ANN001
        return FactReader(dict(self.options))


def company_fact_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The facts of all files below a folder, with filters pushed down."""
    spark.dataSource.register(CompanyFacts)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("company_facts").options(**options).load(path)
