"""File sources and sinks.

CSV: read every column as string, by each file's own header, map the pandas missing-value tokens
to NULL, infer each column's type in ONE aggregate (all values integral → bigint, numeric → double,
True/False → boolean, else string), then cast — ``inferSchema`` alone would turn a numeric column holding
``NA`` into a string. Encodings come from all bytes of each file, and so does
the shape of each JSON file. Every path is read by Spark's own file sources (splittable where the format is).
"""

from __future__ import annotations

import csv
import io
import os
import sys
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import qcol

# what runs in tasks travels by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values: tokens pandas' read_csv treats as missing by default
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# fixed values: boolean spellings pandas recognises
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

# what counts as a number: no Java suffixes (30d, 1f) and no hexadecimal
_NUMBER = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    return bool(fs.globStatus(p)) and len(fs.globStatus(p)) > 0


def _is_empty_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    sts = fs.globStatus(p)
    total = 0
    for st in sts:
        if st.isDirectory():
            for ch in fs.listStatus(st.getPath()):
                if not ch.getPath().getName().startswith(("_", ".")):
                    total += ch.getLen()
        else:
            total += st.getLen()
    return total == 0


# the characters of windows-1252 where ISO-8859-1 has the control codes 0x80-0x9F (five codes are unassigned)
_C1 = "".join(chr(b) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))
_CP1252 = bytes(map(ord, _C1)).decode("cp1252")


def file_traits(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """One row per file that is not blank, from all of its bytes in one scan: path, encoding, odd_quotes, header
    (bytes of its first line that is not blank), cells (most cells of a line).

    ``encoding`` is UTF-16 if the file starts with that byte-order mark, UTF-8 if every line is valid UTF-8; otherwise
    windows-1252 where a byte of 0x80-0x9F occurs, else ISO-8859-1 (the two agree on all other bytes). ``odd_quotes``:
    some line holds an odd number of double quotes, so a quoted cell may go on in the next line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                                         F.monotonically_increasing_id().alias("at"), "value")
    raw = F.col("value").cast("binary")
    latin = F.decode(raw, "ISO-8859-1")
    outside = F.regexp_replace(latin, '"[^"]*"', "")
    cells = (F.length(outside) - F.length(F.replace(outside, F.lit(sep), F.lit("")))) / F.lit(len(sep)) + 1
    full = F.trim("value") != ""
    # a block's lines are read in order by one task; a header is one line a block at most
    blocks = lines.groupBy("path", "block").agg(
        F.bool_or(~F.is_valid_utf8("value")).alias("bad"),
        F.bool_or(latin.rlike("[\\x80-\\x9f]")).alias("c1"),
        F.bool_or((F.length(latin) - F.length(F.replace(latin, F.lit('"'), F.lit("")))) % 2 == 1).alias("odd_quotes"),
        F.max(F.when(full, cells.cast("int"))).alias("cells"),
        F.min(F.when(full, F.col("at"))).alias("first"))
    seen = blocks.groupBy("path").agg(
        F.bool_or("bad").alias("bad"), F.bool_or("c1").alias("c1"), F.bool_or("odd_quotes").alias("odd_quotes"), F.max("cells").alias("cells"),
        F.min_by("first", F.when(F.col("first").isNotNull(), F.col("block"))).alias("at")).where("at is not null")
    heads = lines.select("path", "at", raw.alias("header")).join(F.broadcast(seen), ["path", "at"])
    utf16 = F.hex(F.substring("header", 1, 2)).isin("FFFE", "FEFF")
    enc = F.when(utf16, "UTF-16").when(~F.col("bad"), "UTF-8").when(F.col("c1"), "windows-1252").otherwise("ISO-8859-1")
    return heads.select("path", enc.alias("encoding"), "odd_quotes", "header", "cells")


def _whole_traits(spark: SparkSession, paths: list[str], encoding: str, sep: str) -> dict[str, tuple[list[str], int]]:
    """(header, most cells of a row) of files whose rows may span lines, each parsed as a whole by one task."""
    def parse(it):
        import pandas as pd

        for pdf in it:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = csv.reader(io.TextIOWrapper(io.BytesIO(content), _codec(encoding), "replace", newline=""), delimiter=sep)
                header, cells = None, 0
                for r in rows:
                    if r and header is None:
                        header = r
                    cells = max(cells, len(r))
                yield pd.DataFrame({"path": [p], "header": [header or []], "cells": [cells]})

    files = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path"), "content")
    return {r["path"]: (list(r["header"]), r["cells"]) for r in files.mapInPandas(parse, "path string, header array<string>, cells int").collect()}


def _codec(encoding: str) -> str:
    return {"utf-8": "utf-8-sig", "windows-1252": "cp1252"}.get(encoding.lower(), encoding)


def sniff_encoding(spark: SparkSession, path: str) -> str:
    """The encoding of a file; of a folder, UTF-8 if all files are, else the widest one found."""
    found = {r["encoding"] for r in file_traits(spark, path).select("encoding").distinct().collect()}
    return next((e for e in ("UTF-16", "windows-1252", "ISO-8859-1") if e in found), "UTF-8")


def dedupe_names(names: Sequence[str], case_sensitive: bool = True) -> list[str]:
    """Duplicate headers become ``a``, ``a.1``, ``a.2`` (pandas mangling). Where names are looked up without regard to
    case, as Spark does by default, ``a,A`` are duplicates too: ``a``, ``A.1``."""
    def key(n: str) -> str:
        return n if case_sensitive else n.lower()

    seen: dict[str, int] = {}
    out = []
    for n in names:
        cand = n
        while key(cand) in seen:
            seen[key(n)] = seen.get(key(n), 0) + 1
            cand = f"{n}.{seen[key(n)]}"
        seen[key(cand)] = 0
        out.append(cand)
    return out


_INFER_BATCH = 100  # columns per aggregate (4 expressions each) — stays inside codegen limits


def infer_types(df: DataFrame) -> dict[str, str]:
    """One aggregate per 100 string columns → {column: 'bigint'|'double'|'boolean'|'string'}."""
    out: dict[str, str] = {}
    cols = list(df.columns)
    for start in range(0, len(cols), _INFER_BATCH):
        batch = cols[start : start + _INFER_BATCH]
        exprs = [F.count(F.lit(1)).alias("_rows")]
        for i, c in enumerate(batch):
            x = qcol(c)
            nn = x.isNotNull()
            exprs += [
                F.count_if(nn).alias(f"n{i}"),
                F.count_if(nn & x.rlike(r"^\s*[+-]?[0-9]+\s*$") & F.trim(x).try_cast("bigint").isNotNull()).alias(f"i{i}"),
                F.count_if(nn & x.rlike(_NUMBER) & F.trim(x).try_cast("double").isNotNull()).alias(f"d{i}"),
                F.count_if(nn & x.isin(TRUE_TOKENS + FALSE_TOKENS)).alias(f"b{i}"),
            ]
        r = df.agg(*exprs).first()
        for i, c in enumerate(batch):
            n = r[f"n{i}"]
            if n == 0:
                # an all-missing column is float in pandas; a header-only file keeps text columns
                out[c] = "double" if r["_rows"] > 0 else "string"
            elif r[f"i{i}"] == n:
                out[c] = "bigint"
            elif r[f"d{i}"] == n:
                out[c] = "double"
            elif r[f"b{i}"] == n:
                out[c] = "boolean"
            else:
                out[c] = "string"
    return out


def normalise_na(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    return df.select(*[F.when(qcol(c).isin(list(tokens)), None).otherwise(qcol(c)).alias(c) for c in df.columns])


def _csv_text(spark: SparkSession, paths, header: Sequence[str], encoding: str, multiline: bool, sep: str, base: str | None) -> DataFrame:
    """CSV files of one header and encoding as text columns (quotes are doubled inside quoted cells); columns that come
    from the folder's name keep theirs."""
    cp1252 = encoding.lower() in ("windows-1252", "cp1252")
    reader = (spark.read.option("encoding", "ISO-8859-1" if cp1252 else encoding).option("sep", sep).option("quote", '"')
              .option("escape", '"').option("mode", "PERMISSIVE").option("multiLine", multiline).option("header", True))
    if base:
        reader = reader.option("basePath", base)
    raw = reader.schema(T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(header))])).csv(paths)
    cells = [F.translate(c, _C1, _CP1252) if cp1252 else F.col(c) for c in raw.columns[:len(header)]]
    names = [f"Unnamed: {i}" if h == "" else h for i, h in enumerate(header)]
    names = dedupe_names(names, spark.conf.get("spark.sql.caseSensitive", "false").lower() == "true")
    return raw.select(*[c.alias(n) for c, n in zip(cells, names, strict=True)], *[qcol(c) for c in raw.columns[len(header):]])


def _csv_groups(spark: SparkSession, path: str, encoding: str | None, sep: str) -> dict[tuple, list[str]]:
    """The files that are read alike: {(header, encoding, rows may span lines): paths}. A row with more cells than its
    file's header is refused."""
    groups: dict[tuple, list[str]] = {}
    whole: dict[str, list[str]] = {}

    def add(name: str, header: list[str], cells: int, enc: str, multiline: bool) -> None:
        if cells > len(header):
            raise ValueError(f"{unquote(name)}: a row has {cells} cells, the header {len(header)}")
        groups.setdefault((tuple(header), enc, multiline), []).append(unquote(name))

    for r in file_traits(spark, path, sep).collect():  # one row per file, which the driver lists anyway
        enc = encoding or r["encoding"]
        if r["odd_quotes"] or enc.upper().startswith("UTF-16"):
            whole.setdefault(enc, []).append(r["path"])
        else:
            head = bytes(r["header"]).decode(_codec(enc), "replace").rstrip("\r")
            add(r["path"], next(csv.reader([head], delimiter=sep)), r["cells"], enc, False)
    for enc, files in whole.items():
        for name, (header, cells) in _whole_traits(spark, sorted(unquote(f) for f in files), enc, sep).items():
            add(name, header, cells, enc, True)
    return groups


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, schema: T.StructType | str | None = None,
             sep: str = ",", infer: bool = True) -> DataFrame:
    """S1 (+S2, S3): header row, pandas NA tokens → NULL, one-pass type inference. Each file of a folder is read by its
    own header and encoding and all are united by name (a column that a file lacks is null there); those in which
    a quoted cell may span lines, and UTF-16, are read whole (not split), the others stay splittable. A row with
    fewer cells than the header ends in nulls, one with more is an error.
    Header-only → 0 rows with the header's columns (string); zero-byte → empty table."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    if _is_empty_file(spark, path):
        return spark.createDataFrame([], T.StructType())
    groups = _csv_groups(spark, path, encoding, sep)
    if not groups:
        return spark.createDataFrame([], T.StructType())
    folder = os.path.splitext(path.rstrip("/"))[1] == "" and not any(c in path for c in "*?[{")
    raw = None
    # in the order of the files' names, so the columns stand as in the first file
    for (header, enc, multiline), paths in sorted(groups.items(), key=lambda g: min(g[1])):
        one = len(groups) == 1
        d = _csv_text(spark, path if one else sorted(paths), header, enc, multiline, sep, path if folder and not one else None)
        raw = d if raw is None else raw.unionByName(d, allowMissingColumns=True)
    raw = normalise_na(raw)
    if schema is not None:
        # the caller's types, applied after NA normalisation; an unparsable cell becomes NULL
        sch = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        return raw.select(*[qcol(f.name).try_cast(f.dataType).alias(f.name) for f in sch.fields])
    if not infer:
        return raw
    types = infer_types(raw)
    out = []
    for c in raw.columns:
        t = types[c]
        x = qcol(c)
        if t == "bigint":
            out.append(F.trim(x).try_cast("bigint").alias(c))
        elif t == "double":
            out.append(F.trim(x).try_cast("double").alias(c))
        elif t == "boolean":
            out.append(F.when(x.isin(TRUE_TOKENS), True).when(x.isin(FALSE_TOKENS), False).alias(c))
        else:
            out.append(x.alias(c))
    return raw.select(*out)


_CORRUPT = "quarry_not_json"


def json_shapes(spark: SparkSession, path: str) -> DataFrame:
    """One row per file that is not blank: path, shape ('lines': one object per line, 'array': a JSON array of
    records, 'columns': a single object, e.g. pandas' column-oriented dump; null: not JSON). One scan counts the lines
    of each block and finds its first, a second one fetches each file's first line; no text is sorted or dealt out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                                         F.monotonically_increasing_id().alias("at"), "value")
    # a block's lines are read in order by one task
    blocks = lines.filter(F.trim("value") != "").groupBy("path", "block").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
    heads = blocks.groupBy("path").agg(F.min_by("at", "block").alias("at"), F.sum("n").alias("n"))
    seen = lines.join(F.broadcast(heads), ["path", "at"]).select("path", "n", F.ltrim("value").alias("first"))
    m = F.from_json("first", "map<string,string>")
    nested = (F.size("m") > 0) & F.forall(F.map_values("m"), lambda v: F.coalesce(F.ltrim(v), F.lit("")).startswith("{"))
    one = F.when(F.col("m").isNull() | (nested & (F.col("n") == 1)), "columns").otherwise("lines")
    start = F.regexp_extract("first", r"^\s*(.)", 1)
    return seen.withColumn("m", m).select("path", F.when(start == "[", "array").when(start == "{", one).alias("shape"))


def _files_by_shape(spark: SparkSession, path: str) -> dict[str, list[str]]:
    parts: dict[str, list[str]] = {}
    for r in json_shapes(spark, path).collect():  # one row per file, which the driver lists anyway
        if r["shape"] is None:
            raise ValueError(f"not a JSON file: first non-blank character is neither '{{' nor '[' in {unquote(r['path'])}")
        parts.setdefault(r["shape"], []).append(unquote(r["path"]))
    return parts


def json_shape(spark: SparkSession, path: str) -> str:
    """The shape of a file, or of a folder whose files have one; else 'mixed', or 'empty'."""
    shapes = sorted(_files_by_shape(spark, path))
    return "mixed" if len(shapes) > 1 else shapes[0] if shapes else "empty"


def _json_columns(spark: SparkSession, paths) -> DataFrame:
    """Column-oriented files ({"a": {"0": 1, "1": 2}, "b": {...}}) as text columns, rows in the order of their labels."""
    obj = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    m = obj.select("file", F.from_json("value", "map<string,map<string,string>>").alias("m"))
    cells = m.select("file", F.explode("m").alias("col", "rows")).select("file", "col", F.posexplode("rows").alias("at", "row", "v"))
    # each file has rows of its own; text labels keep their order in the file
    keys = [F.col("file").alias("_file"), F.col("row").alias("_row")]
    place = cells.groupBy(*keys).agg(F.min("at").alias("_at"))
    wide = cells.groupBy(*keys).pivot("col").agg(F.first("v")).join(place, ["_file", "_row"])
    return wide.orderBy("_file", F.col("_row").try_cast("bigint").asc_nulls_last(), "_at").drop("_at", "_file", "_row")


def _one_type(types: set) -> T.DataType:
    """The type that holds the values of all; text where they don't go together."""
    if len(types) == 1:
        return next(iter(types))
    return T.DoubleType() if types <= {T.LongType(), T.DoubleType()} else T.StringType()


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines → ``spark.read.json``; an array of records → ``multiLine``; a
    column-oriented object {col: {row: value}} → exploded and pivoted back to rows. Each file of a folder is read by
    its own shape; a column that some shapes lack is null there, and text where their types don't go together."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    parts = sorted(_files_by_shape(spark, path).items())
    if not parts:
        return spark.createDataFrame([], T.StructType())
    if schema is not None and not isinstance(schema, T.StructType):
        schema = T._parse_datatype_string(schema)

    def records(shape, paths, schema):
        r = spark.read.option("multiLine", shape == "array").option("columnNameOfCorruptRecord", _CORRUPT)
        d = (r if schema is None else r.schema(schema)).json(path if len(parts) == 1 else sorted(paths))
        if _CORRUPT in d.columns:
            others = [c for c in d.columns if c != _CORRUPT][:1]  # Spark does not read the corrupt column alone
            bad = d.where(F.col(_CORRUPT).isNotNull()).select(_CORRUPT, *map(qcol, others), F.col("_metadata.file_path")).first() if others else None
            raise ValueError(f"not JSON: {bad[0][:80]!r} in {unquote(bad[-1])}" if bad else "not JSON: no record could be read")
        return d

    def columns(paths, schema):
        wide = _json_columns(spark, path if len(parts) == 1 else sorted(paths))
        if schema is None:
            types = infer_types(normalise_na(wide))
            return wide.select(*[(qcol(c).try_cast(types[c]) if types[c] != "string" else qcol(c)).alias(c) for c in wide.columns])
        return wide.select(*[(qcol(f.name) if f.name in wide.columns else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in schema.fields])

    def read(schema):
        return [columns(paths, schema) if shape == "columns" else records(shape, paths, schema) for shape, paths in parts]

    found = read(schema)
    if len(found) == 1:
        return found[0]
    if schema is None:
        types: dict[str, set] = {}
        for d in found:
            for f in d.schema.fields:
                types.setdefault(f.name, set()).add(f.dataType)
        found = read(T.StructType([T.StructField(c, _one_type(t)) for c, t in types.items()]))
    out = found[0]
    for d in found[1:]:
        out = out.unionByName(d)
    return out


_XL_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_XL_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _col_index(ref: str) -> int:
    """'C7' → 2 (zero-based column of an A1-style reference)."""
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + (ord(ch.upper()) - 64)
    return n - 1


def xlsx_rows(content: bytes):
    """Yield {column index: text} for each row of the FIRST worksheet of an .xlsx file
    (stdlib zip + streaming XML; shared strings, inline strings, booleans, numbers)."""
    import xml.etree.ElementTree as ET
    import zipfile

    z = zipfile.ZipFile(io.BytesIO(content))
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_XL_MAIN}si"):
            shared.append("".join(t.text or "" for t in si.iter(f"{_XL_MAIN}t")))
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    first = next(wb.iter(f"{_XL_MAIN}sheet"))
    rid = first.get(f"{_XL_REL}id")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in rels if r.get("Id") == rid).lstrip("/")
    if not target.startswith("xl/"):
        target = "xl/" + target
    for _, el in ET.iterparse(z.open(target)):
        if el.tag != f"{_XL_MAIN}row":
            continue
        cells = {}
        for c in el.iter(f"{_XL_MAIN}c"):
            t, v = c.get("t"), c.find(f"{_XL_MAIN}v")
            if t == "s" and v is not None:
                val = shared[int(v.text)]
            elif t == "inlineStr":
                val = "".join(x.text or "" for x in c.iter(f"{_XL_MAIN}t"))
            elif t == "b" and v is not None:
                val = "True" if v.text == "1" else "False"
            else:
                val = v.text if v is not None else None
            cells[_col_index(c.get("r", "A"))] = val
        el.clear()
        yield cells


def read_excel(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """S5 (re-aimed): a file or folder of .xlsx workbooks, first sheet of each, header row first.

    Spark reads the files (``binaryFile``); a first bounded pass returns each file's header (one
    row per file), then ``mapInPandas`` parses every workbook's rows as text and the CSV path's
    NA-token normalisation and one-pass type inference apply (or the caller's ``schema``).
    Legacy binary .xls is not supported (the reference could not read it either)."""
    import pandas as pd

    if not _exists(spark, path):
        raise FileNotFoundError(path)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def headers(it):
        for pdf in it:
            for p_, content in zip(pdf["path"], pdf["content"]):
                first = next(xlsx_rows(content), {})
                yield pd.DataFrame({"path": [p_], "names": [[first[i] or "" for i in sorted(first)]]})

    names: list[str] = []
    for r in sorted(files.mapInPandas(headers, "path string, names array<string>").collect(), key=lambda r: r["path"]):
        for n in r["names"]:
            if n not in names:
                names.append(n)
    cols = dedupe_names(names)

    def parse(it, names=names, cols=cols):
        for pdf in it:
            for content in pdf["content"]:
                rows = xlsx_rows(content)
                hdr = next(rows, {})
                pos = {i: names.index(hdr[i] or "") for i in hdr if (hdr[i] or "") in names}
                out = []
                for cells in rows:
                    rec = [None] * len(cols)
                    for i, v in cells.items():
                        if i in pos:
                            rec[pos[i]] = v
                    out.append(rec)
                yield pd.DataFrame(out, columns=cols, dtype=object)

    text = files.select("content").mapInPandas(parse, T.StructType([T.StructField(c, T.StringType()) for c in cols]))
    text = normalise_na(text)
    if schema is not None:
        sch = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        return text.select(*[qcol(f.name).try_cast(f.dataType).alias(f.name) for f in sch.fields])
    types = infer_types(text)
    out = []
    for c in text.columns:
        t, x = types[c], qcol(c)
        if t == "boolean":
            out.append(F.when(x.isin(TRUE_TOKENS), True).when(x.isin(FALSE_TOKENS), False).alias(c))
        elif t in ("bigint", "double"):
            out.append(F.trim(x).try_cast(t).alias(c))
        else:
            out.append(x.alias(c))
    return text.select(*out)


def load(spark: SparkSession, path: str, format: str | None = None, encoding: str | None = None,
         schema=None) -> DataFrame:
    """Dispatch on the lower-cased extension (.csv, .json, .xls/.xlsx, .parquet) or
    ``format``; anything else is an error, as is a missing path."""
    fmt = (format or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    if fmt in ("csv", "txt"):
        return read_csv(spark, path, encoding, schema)
    if fmt == "json":
        return read_json(spark, path, schema)
    if fmt in ("xlsx", "excel"):
        return read_excel(spark, path, schema)
    if fmt == "xls":
        raise ValueError("legacy binary .xls is not supported; save the workbook as .xlsx")
    if fmt == "parquet":
        if not _exists(spark, path):
            raise FileNotFoundError(path)
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported file type: {fmt!r}")


def load_many(spark: SparkSession, paths: Sequence[str], **kw) -> DataFrame:
    """S3: several files of the same table → one DataFrame (by name, missing columns NULL)."""
    dfs = [load(spark, p, **kw) for p in paths]
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def write_table(df: DataFrame, path: str, format: str = "csv", mode: str = "overwrite") -> None:
    """Scored rows to CSV (header, no index) or Parquet; XLSX writing is not built."""
    if format == "csv":
        (df.write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    elif format == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError("format must be 'csv' or 'parquet'")
