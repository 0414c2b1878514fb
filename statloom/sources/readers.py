"""Readers of heterogeneous sources; every reader returns texts, cast where they are used."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from pathlib import Path
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.text import season_span

# Suffixes of sound and film, which aren't data.
MEDIA = {".mp3", ".mp4", ".wav", ".avi", ".mov", ".mkv", ".flac", ".ogg", ".m4a", ".aac", ".wmv", ".webm", ".mpeg", ".mpg"}


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",", encoding: str | None = None) -> DataFrame:
    """A CSV as texts with markers kept. An absent file is an empty table; a file that isn't UTF-8 throughout is read as Latin-1.

    Only ``columns`` are read if they are given, as far as the file has them.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns or ["value"]]))
    def read(paths: str | list[str], coding: str) -> DataFrame:
        return spark.read.options(header=True, sep=sep, encoding=coding, quote='"', escape='"', multiLine=False).csv(paths)

    if encoding is not None:
        df = read(path, encoding)
    else:
        utf8, latin = _by_encoding(spark, path)
        if utf8 and latin:
            df = read(utf8, "UTF-8").unionByName(read(latin, "ISO-8859-1"), allowMissingColumns=True)
        else:
            df = read(path, "ISO-8859-1" if latin else "UTF-8")
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def _by_encoding(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The files of ``path`` that are UTF-8 to the last byte, and the others.

    By lines, whose ends are never inside a character; so large files are split.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.is_valid_utf8("value").alias("valid"))
    files: tuple[list[str], list[str]] = [], []
    for f in lines.groupBy("path").agg(F.bool_and("valid").alias("valid")).orderBy("path").collect():
        # the path as it is, not as a URL or a pattern
        files[0 if f["valid"] else 1].append(re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(f["path"])))
    return files


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_table(spark: SparkSession, stem: str, rows: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Parquet if there is one, else CSV; ``rows`` needs an order."""
    df = spark.read.parquet(f"{stem}.parquet") if exists(spark, f"{stem}.parquet") else read_csv(spark, f"{stem}.csv")
    return df if rows is None else df.orderBy(*(order or df.columns)).limit(rows)


def read_league_files(spark: SparkSession, root: str, leagues: dict[str, tuple[str, str]]) -> DataFrame:
    """League files ``<season>/<code>.csv`` with season, competition and country from their paths.

    Files of unknown leagues or of directories that aren't four digits are left
    out by their paths, before they are read. A file that isn't UTF-8 throughout
    is read as Latin-1; of rows longer than the header the surplus fields are
    ignored, in shorter ones the absent fields are NULL.
    """
    fields = ["Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "Referee"]
    paths = f"{root}/[0-9][0-9][0-9][0-9]/{{{','.join(leagues)}}}.csv"
    schema = "competition string, country string, season string, " + ", ".join(f"{c} string" for c in fields)
    if not exists(spark, paths):
        return spark.createDataFrame([], schema)
    raw = spark.read.format("binaryFile").load(paths).select("path", F.col("content").alias("value"))
    code, season = F.regexp_extract("path", r"([^/]+)\.csv$", 1), F.regexp_extract("path", r"/([0-9]{4})/[^/]+$", 1)
    meta = F.create_map(*[x for k, (comp, land) in leagues.items() for x in (F.lit(k), F.struct(F.lit(comp).alias("competition"), F.lit(land).alias("country")))])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(1 << 30)  # a field is bounded by its file only
        for b in batches:
            for competition, country, s, content in b.itertuples(index=False):
                try:
                    text = bytes(content).decode("utf-8")
                except UnicodeDecodeError:
                    text = bytes(content).decode("latin-1")
                lines = (row for row in csv.reader(io.StringIO(text.lstrip("\ufeff"), newline="")) if row)
                header = next(lines, [])
                at = [header.index(f) if f in header else None for f in fields]
                out = [(competition, country, s, *[row[i] if i is not None and i < len(row) else None for i in at]) for row in lines]
                yield pd.DataFrame(out, columns=["competition", "country", "season", *fields], dtype=object)

    return raw.select(F.element_at(meta, code)["competition"].alias("competition"), F.element_at(meta, code)["country"].alias("country"), season_span(season).alias("season"), "value").mapInPandas(rows, schema)


def split_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, text): the lines of each text, numbered from 1; a NULL text has none."""
    x = df.select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("p", "text"))
    return x.select(key, (F.col("p") + 1).cast("long").alias("line_no"), "text")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line_no, text): texts by line, numbered from 1."""
    return split_lines(spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"), "path", "value")


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Structs as columns ``a.b``, at any depth."""
    def walk(schema: T.StructType, path: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
        for f in schema.fields:
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    def column(path: tuple[str, ...]):
        c = F.col(f"`{path[0]}`")
        for p in path[1:]:
            c = c[p]
        return c.alias(sep.join(path))

    return df.select(*[column(p) for p in walk(df.schema, ())])


def read_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A list is one table, an object of lists a table for each, another object one row, a scalar a ``value``.

    The text stays with the executors: its first letter tells which it is, and the inferred schema the rest.
    """
    text = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    head = spark.read.text(path, wholetext=True).select(F.substring(text, 1, 1)).first()
    stem = Path(path).stem
    if head is None or head[0] not in ("[", "{"):
        return {stem: spark.read.text(path, wholetext=True).select(text.alias("value"))}
    df = spark.read.option("multiLine", True).json(path)
    if head[0] == "{":
        lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
        if lists:
            return {k: flatten(df.select(F.explode(F.col(f"`{k}`")).alias("x")).select("x.*")) for k in lists}
    return {stem: flatten(df)}


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.text: list[str] = []
        self.depth, self.cell, self.skip = 0, None, 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.depth += 1
            self.tables.append([])
        elif tag == "tr" and self.depth:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.depth:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "table":
            self.depth = max(0, self.depth - 1)
        elif tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)
            if self.cell is not None:
                self.cell.append(data)


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_no, row_no, cells): the rows of each table, also of those in comments; a page without one is a single cell of its text."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, page in b.itertuples(index=False):
                p = _Tables()
                p.feed(re.sub(r"<!--(.*?<table.*?)-->", r"\1", page or "", flags=re.S))
                found = [(k, i, j, cells) for i, t in enumerate(p.tables) for j, cells in enumerate(t)]
                out += found or [(k, -1, 0, [" ".join("".join(p.text).split())])]
            yield pd.DataFrame(out, columns=[key, "table_no", "row_no", "cells"])

    return pages.select(key, html).mapInPandas(run, f"`{key}` {kind}, table_no int, row_no int, cells array<string>")


_XLSX = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _cells_of(sheet: ElementTree.Element, shared: list[str]) -> Iterator[list[str | None]]:
    """The rows of a sheet, each as long as its last cell."""
    for r in sheet.iter(f"{{{_XLSX['m']}}}row"):
        row: dict[int, str | None] = {}
        for c in r.findall("m:c", _XLSX):
            at = 0
            for ch in re.match("[A-Z]+", c.get("r"))[0]:
                at = at * 26 + ord(ch) - 64
            v, inline = c.find("m:v", _XLSX), c.find("m:is/m:t", _XLSX)
            text = inline.text if inline is not None else None if v is None else v.text
            row[at - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
        yield [row.get(k) for k in range(max(row, default=-1) + 1)]


def workbook_rows(files: DataFrame) -> DataFrame:
    """(path, sheet_no, sheet, row_no, cells) of workbooks (path, content), parsed by the executors; a workbook is read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    shared = []
                    if "xl/sharedStrings.xml" in z.namelist():
                        shared = ["".join(t.text or "" for t in s.iter(f"{{{_XLSX['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _XLSX)]
                    names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _XLSX)]
                    for i, name in enumerate(names, 1):
                        rows = list(_cells_of(ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")), shared)) or [[]]
                        yield pd.DataFrame({"path": path, "sheet_no": i, "sheet": name, "row_no": range(len(rows)), "cells": rows})

    return files.select("path", "content").mapInPandas(run, "path string, sheet_no int, sheet string, row_no long, cells array<string>")


def read_xlsx(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sheets of a workbook as tables of texts; only their header rows reach the driver."""
    rows = workbook_rows(spark.read.format("binaryFile").load(path))
    out = {}
    for h in rows.filter("row_no = 0").orderBy("sheet_no").collect():
        own = rows.filter((F.col("sheet_no") == h.sheet_no) & (F.col("row_no") > 0))
        out[h.sheet] = own.select(*[F.get("cells", F.lit(k)).alias(c or f"column_{k}") for k, c in enumerate(h.cells)])
    return out


def unzip(path: str, to: str, spark: SparkSession | None = None) -> list[str]:
    """The files of an archive below ``to``; members that would leave it are refused.

    With ``spark`` the archive is read and the members are written by the
    session's file system, so that the executors see them; without it, by the local one.
    """
    root = Path("/", to.partition("://")[2] or to).resolve()
    if spark is not None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        source: str | io.BytesIO = io.BytesIO(spark.read.format("binaryFile").load(path).first()["content"])
    else:
        source = path
    with zipfile.ZipFile(source) as z:
        for m in z.namelist():
            if not (root / m).resolve().is_relative_to(root):
                raise ValueError(f"{m} lies outside the folder")
        files = [m for m in z.namelist() if not m.endswith("/")]
        if spark is None:
            z.extractall(to)
            return [str(Path(to).resolve() / m) for m in files]
        for m in files:
            target = jvm.org.apache.hadoop.fs.Path(f"{to}/{m}")
            stream = target.getFileSystem(conf).create(target, True)
            stream.write(bytearray(z.read(m)))
            stream.close()
        return [f"{to}/{m}" for m in files]


def read_source(spark: SparkSession, path: str, extract_dir: str) -> list[tuple[str, str, str, DataFrame]]:
    """(path, type, table, data with __source_path, __source_type and __source_table) of a file, archive or directory.

    Directories are read in sorted order and in depth; sound and film are skipped.
    Archives are extracted into ``extract_dir``, a folder that the executors share.
    """
    p = Path(path)
    suffix = p.suffix.lower()
    if p.is_dir():
        return [t for child in sorted(p.iterdir()) for t in read_source(spark, str(child), extract_dir)]
    if suffix in MEDIA:
        return []
    if suffix == ".zip":
        return [t for f in sorted(unzip(path, f"{extract_dir}/{p.stem}", spark)) for t in read_source(spark, f, extract_dir)]
    if suffix in (".csv", ".tsv"):
        kind, tables = suffix[1:], {p.stem: read_csv(spark, path, sep="\t" if suffix == ".tsv" else ",")}
    elif suffix == ".json":
        kind, tables = "json", read_json(spark, path)
    elif suffix == ".jsonl":
        kind, tables = "jsonl", {p.stem: flatten(spark.read.json(path))}
    elif suffix == ".parquet":
        kind, tables = "parquet", {p.stem: spark.read.parquet(path)}
    elif suffix == ".xlsx":
        kind, tables = "xlsx", read_xlsx(spark, path)
    elif suffix in (".html", ".htm"):
        pages = spark.read.text(path, wholetext=True).select(F.lit(p.stem).alias("page"), F.col("value").alias("html"))
        kind, tables = "html", {p.stem: html_tables(pages, "page", "html")}
    else:
        kind, tables = "text", {p.stem: read_lines(spark, path).select(F.col("line_no").alias("line_number"), "text")}
    return [
        (path, kind, name, df.withColumns({"__source_path": F.lit(path), "__source_type": F.lit(kind), "__source_table": F.lit(name)})) for name, df in tables.items()
    ]
