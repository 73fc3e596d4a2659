"""Flexible CSV ingestion.

The header sniff reads at most 80 lines of the first file on the driver (metadata, not
data). The data itself is one distributed, string-typed scan:

* separator: the one of ``,`` ``;`` tab ``|`` most frequent in the header line, outside
  quotes (the reference's first attempt silently returns one column for ``;`` files;
  we always sniff -- a deliberate fix);
* header: the first line if no sniffed line has more fields; otherwise the file has a
  preamble and the line with the most separators is taken;
* preamble and header lines are dropped by position in each file: of a file's first
  split, the first lines equal to them, as many as there are. A later data row with the
  same text stays. All files must begin alike; one that does not is an error;
* bad lines: rows with more fields than the header are dropped, short rows are
  padded with NULLs, as the reference's parser does.
"""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine.sources.records import lines, numbered, quoted_records, refuse_other_heads

SNIFF_LINES = 80
SEPARATORS = [",", ";", "\t", "|"]


def _outside_quotes(line: str) -> str:
    return re.sub(r'"[^"]*"', "", line)


def sniff(lines: list[str]) -> tuple[int, str]:
    """(header line index, separator) from the first 80 lines."""
    def best_of(line):
        counts = [_outside_quotes(line).count(s) for s in SEPARATORS]
        return SEPARATORS[counts.index(max(counts))], max(counts)

    lines = lines[:SNIFF_LINES]
    if not lines:
        return 0, SEPARATORS[0]
    sep, n = best_of(lines[0])
    if n and all(_outside_quotes(line).count(sep) <= n for line in lines):
        return 0, sep
    scores = [max(_outside_quotes(line).count(s) for s in SEPARATORS[:3]) for line in lines]
    header = scores.index(max(scores))
    return header, best_of(lines[header])[0]


def header_names(line: str, sep: str) -> list[str]:
    """Column names from the header line (quote-aware); blanks and repeats renamed
    the way pandas does ('Unnamed: i', 'name.1')."""
    names = next(csv.reader(io.StringIO(line), delimiter=sep)) if line else []
    out, seen = [], {}
    for i, n in enumerate(names):
        n = n.strip() or f"Unnamed: {i}"
        if n in seen:
            seen[n] += 1
            n = f"{n}.{seen[n]}"
        else:
            seen[n] = 0
        out.append(n)
    return out


def _first_lines(spark: SparkSession, path: str) -> list[str]:
    """Up to 80 lines of the first file by name (found by one small aggregate over the
    files' metadata, so no file list comes to the driver)."""
    first = spark.read.text(path).select(F.min("_metadata.file_path")).first()[0]
    if first is None:
        return []
    return [r[0] for r in spark.read.text(first).limit(SNIFF_LINES).collect()]


def _field_count(line, sep: str):
    """Fields of a raw line, ignoring separators inside double quotes."""
    unquoted = F.regexp_replace(line, r'"[^"]*"', "")
    return F.size(F.split(unquoted, "\\" + sep if sep in "|" else sep, -1))


def read_flexible_csv(spark: SparkSession, path: str, sep: str | None = None, multiline: bool = False,
                      validate: bool = True) -> DataFrame:
    """Read CSV files with preamble text, odd separators and bad lines.

    Returns a string-typed frame with the header's column names plus ``_file``,
    ``_block`` (where the row's split begins) and ``_pos``, the row's position over all files
    in order of name, for position-based labels.

    Each file's own preamble and header go, blank lines are skipped, lines with more
    fields than the header are dropped (quote-aware count), and the rest is parsed in
    place with ``from_csv`` (short lines padded with NULLs; doubled quotes are quotes). Records
    with quoted line breaks need ``multiline=True``, which finds the records' ends over all
    splits first. The header's own lines hold no line breaks; a file that ends inside quotes
    is an error.
    """
    first = _first_lines(spark, path)
    if not first:
        raise ValueError(f"{path}: no lines to read a header from")
    header_idx, sniffed = sniff(first)
    sep = sep or sniffed
    names = header_names(first[header_idx], sep)
    if len(names) <= 1:
        raise ValueError(f"{path}: the header line has a single column")
    fields = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
    head = [line for line in first[: header_idx + 1] if line.strip()]
    read = _read_records if multiline else _read_lines
    text = read(spark, path, sep, len(names), head, validate)
    options = {"sep": sep, "mode": "PERMISSIVE", "escape": '"', "multiLine": str(multiline).lower()}
    parsed = text.select(F.from_csv("value", fields.simpleString(), options).alias("_r"), "_file", "_block", "_pos")
    out = parsed.select(*[F.col(f"_r._c{i}").alias(n) for i, n in enumerate(names)], "_file", "_block", "_pos")
    if validate and out.isEmpty():
        raise ValueError(f"{path}: no data rows after the header")
    return out


def _kept(line, sep: str, n_fields: int):
    """Neither blank nor with more fields than the header."""
    return (F.length(F.trim(line)) > 0) & (_field_count(line, sep) <= n_fields)


def _read_lines(spark, path, sep, n_fields, head, validate) -> DataFrame:
    """value, _file, _block, _pos of the data lines; _pos counts them from 0 in file order."""
    like_head = (F.col("_block") == 0) & F.col("value").isin(list(dict.fromkeys(head)))
    kept = lines(spark, path).where(_kept(F.col("value"), sep, n_fields) | like_head)
    text = kept.withColumn("_pos", F.monotonically_increasing_id())
    least = len(head) if validate else 0
    return numbered(text, _head_rows(text, head), "_place", least).drop("_pos").withColumnRenamed("_place", "_pos")


def _read_records(spark, path, sep, n_fields, head, validate) -> DataFrame:
    """The same for records that may hold quoted line breaks; _pos grows in file order, with gaps
    where records were dropped."""
    text = lines(spark, path, "\n").withColumn("_pos", F.monotonically_increasing_id())
    bare = text.withColumn("value", F.regexp_replace("value", "\r$", ""))
    heads = _head_rows(bare, head)
    if validate:
        found = heads.select("_file", F.lit(1).alias("_heads"))
        refuse_other_heads(lines(spark, path, "\n").select("_file", F.lit(0).alias("_heads")).unionByName(found), len(head))
    body = text.join(F.broadcast(heads), ["_file", "_block", "_pos"], "left_anti")
    records, unclosed = quoted_records(body, sep)
    if validate:
        odd = unclosed.first()
        if odd is not None:
            raise ValueError(f"{odd['_file']}: ends inside a quoted field")
    records = records.withColumn("value", F.regexp_replace("value", "\r$", ""))
    return records.where(_kept(F.col("value"), sep, n_fields))


def _head_rows(text: DataFrame, head: list[str]) -> DataFrame:
    """(_file, _block, _pos) of every file's preamble and header lines: the first ``len(head)`` lines
    of its first split that equal one of them (a few rows per file)."""
    alike = text.where((F.col("_block") == 0) & F.col("value").isin(list(dict.fromkeys(head))))
    order = Window.partitionBy("_file").orderBy("_pos")
    return alike.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= len(head)).select("_file", "_block", "_pos")


def load_dataset(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Read, then standardise; machines without a label column are numbered by
    file position (MCH-0001 ...)."""
    from riskengine.operators.indexing import with_index
    from riskengine.operators.standardize import standardize

    raw = read_flexible_csv(spark, path, **kw)
    # Records with line breaks may have been dropped after they were numbered.
    ordered = with_index(raw, ["_pos"], out="record") if kw.get("multiline") else raw.withColumn("record", F.col("_pos"))
    return standardize(ordered.drop("_file", "_block", "_pos"), order_by="record", keep=["record"])


def read_many(spark: SparkSession, sources: dict[str, str], **kw) -> DataFrame:
    """Each source read and standardised separately, tagged with its name, then unioned."""
    frames = [load_dataset(spark, p, **kw).withColumn("dataset", F.lit(name)) for name, p in sources.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
