"""Positions and records of text files, from sums over their splits.

Files are read as lines, many splits at once. A split is known by its file and the byte at
which it begins, and only a few numbers of each split are combined:

* ``numbered``: a line's place in the input is the lines of the splits before plus its place
  in its own. Lines are neither sorted nor shuffled; only the splits' counts are written.
* ``quoted_records``: whether a line break lies inside quotes depends on all text before it.
  A line maps the state before it (outside or inside quotes) to the state after it; maps
  are composed within each split and then over the splits of a file, so every line knows its
  state, and a file of records with line breaks is read by as many tasks as it has splits.

What later steps read again is written once to the shared folder: the splits' numbers (one row
per split, broadcast to the lines), and the pieces of records, whose lines are shuffled once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskengine.session import checkpoint_dir

SPLIT = ["_file", "_block"]


def lines(spark: SparkSession, path: str, line_end: str | None = None) -> DataFrame:
    """value, _file and _block (where the line's split begins) of every line.

    How many parts a small file is cut into follows the session's cores, which may come and go;
    the number is therefore fixed in the session, where it is not set, when files are first read."""
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(max(1, spark.sparkContext.defaultParallelism)))
    reader = spark.read.option("lineSep", line_end) if line_end else spark.read
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("_file"),
                                    F.col("_metadata.file_block_start").alias("_block"))


def _kept_once(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/riskengine-records-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def refuse_other_heads(heads: DataFrame, least: int) -> None:
    """``heads``: _file and _heads (how many were found) by file or by split. A file of fewer than ``least`` is refused."""
    odd = heads.groupBy("_file").agg(F.sum("_heads").alias("_heads")).where(F.col("_heads") < least).select("_file").first()
    if odd is not None:
        raise ValueError(f"{odd['_file']}: its first lines differ from the other files' header; read it on its own")


def numbered(rows: DataFrame, heads: DataFrame, out: str, least: int = 0) -> DataFrame:
    """``rows`` (with _file, _block, and _pos growing inside a split) less the rows listed in
    ``heads`` (_file, _block, _pos; a few of each file), with their dense number from 0. A file with
    fewer than ``least`` of them is refused.

    The splits (one row each) are counted now and broadcast. A row whose split was not
    counted, because the files changed in between, ends the query."""
    listed = heads.groupBy(*SPLIT).agg(F.collect_list("_pos").alias("_heads"))
    splits = rows.groupBy(*SPLIT).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")).join(listed, SPLIT, "left")
    splits = splits.withColumn("_heads", F.coalesce("_heads", F.array().cast("array<bigint>")))
    earlier = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    splits = _kept_once(splits.withColumn("_before", F.coalesce(F.sum(F.col("_n") - F.size("_heads")).over(earlier), F.lit(0))))
    if least:
        refuse_other_heads(splits.select("_file", F.size("_heads").alias("_heads")), least)
    told = rows.join(F.broadcast(splits), SPLIT, "left").where(~F.coalesce(F.array_contains("_heads", F.col("_pos")), F.lit(False)))
    place = F.col("_before") + F.col("_pos") - F.col("_first") - F.size(F.filter("_heads", lambda h: h < F.col("_pos")))
    counted = F.col("_first").isNotNull() & F.col("_pos").between(F.col("_first"), F.col("_first") + F.col("_n") - 1)
    number = F.when(counted, place).otherwise(
        F.raise_error(F.concat(F.lit("files changed while they were read: "), "_file")).cast("long"))
    return told.withColumn(out, number).drop("_first", "_n", "_heads", "_before")


def _after(line: Column, sep: str, inside: bool) -> Column:
    """The state (1: inside quotes) after a line that begins inside quotes or not. A quote opens a
    field only as its first character; inside, a doubled quote is a quote."""
    odd = lambda piece: F.regexp_count(piece, F.lit('"')) % 2 == 1
    pieces = F.split(line, "\\" + sep if sep in "|" else sep, -1)
    walked = F.aggregate(pieces, F.lit(inside), lambda s, p: F.when(s, ~odd(p)).otherwise(p.startswith('"') & odd(p)))
    return F.when(F.contains(line, F.lit('"')), walked).otherwise(F.lit(inside)).cast("int")


def _states(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``df`` (with maps ``_out``, ``_in``: the state after a row entered outside, inside) with
    ``_s0``, ``_s1``: the state before the row if the group is entered outside, inside. A map is
    constant, or keeps or flips the state: so the last constant counts, and the flips since."""
    upto = Window.partitionBy(*keys).orderBy(order)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    flip = ((F.col("_out") == 1) & (F.col("_in") == 0)).cast("int")
    df = df.withColumn("_flips", F.sum(flip).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("_out") == F.col("_in"), F.struct(F.col("_out").alias("s"), F.col("_flips").alias("f")))
    df = df.withColumn("_last", F.last(fixed, ignorenulls=True).over(before)).withColumn("_flips", F.col("_flips") - flip)
    state = lambda e: (F.coalesce(F.col("_last.s"), F.lit(e)) + F.col("_flips") - F.coalesce(F.col("_last.f"), F.lit(0))) % 2
    return df.withColumn("_s0", state(0)).withColumn("_s1", state(1)).drop("_flips", "_last")


def quoted_records(rows: DataFrame, sep: str) -> tuple[DataFrame, DataFrame]:
    """Records of CSV lines (value, _file, _block, _pos growing inside a split) whose quoted fields
    may hold line breaks, as (records, unclosed).

    ``records``: value (the record's lines joined by line breaks), _file, _block (where the record begins) and
    _pos, the record's number from 0 over all files. ``unclosed``: files that end inside quotes, whose last
    record is what follows the quote. Lines are grouped by split, and only records that pass a split's
    end meet again by number."""
    mapped = rows.withColumn("_out", _after(F.col("value"), sep, False)).withColumn("_in", _after(F.col("value"), sep, True))
    lined = _states(mapped, SPLIT, "_pos")
    leaves = lambda s: F.when(F.col(s) == 1, F.col("_in")).otherwise(F.col("_out"))
    opens = lambda s: F.sum((F.col(s) == 0).cast("long"))
    splits = lined.groupBy(*SPLIT).agg(
        F.max_by(leaves("_s0"), "_pos").alias("_out"), F.max_by(leaves("_s1"), "_pos").alias("_in"),
        opens("_s0").alias("_n0"), opens("_s1").alias("_n1"))
    splits = _states(splits, ["_file"], "_block").withColumn("_n", F.when(F.col("_s0") == 1, F.col("_n1")).otherwise(F.col("_n0")))
    earlier = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    splits = _kept_once(splits.select(*SPLIT, F.col("_s0").alias("_entry"), leaves("_s0").alias("_exit"), "_n",
                                      F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    upto = Window.partitionBy(*SPLIT).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    begun = lined.select("value", *SPLIT, "_pos", opens("_s0").over(upto).alias("_b0"), opens("_s1").over(upto).alias("_b1"))
    nth = F.when(F.col("_entry") == 1, F.col("_b1")).otherwise(F.col("_b0"))
    # A record passes the split's end if it was open before it, or is the last and still open after it.
    part = begun.join(F.broadcast(splits), SPLIT).withColumn("_nth", nth).withColumn(
        "_cut", (F.col("_nth") == 0) | ((F.col("_nth") == F.col("_n")) & (F.col("_exit") == 1)))
    joined = lambda order: F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(order, "value"))), lambda r: r["value"]), "\n")
    pieces = _kept_once(part.groupBy(*SPLIT, "_nth").agg(
        joined("_pos").alias("value"), F.first("_cut").alias("_cut"), (F.first("_before") + F.col("_nth") - 1).alias("_number")))
    whole = pieces.where(~F.col("_cut")).select("value", *SPLIT, F.col("_number").alias("_pos"))
    cut = pieces.where("_cut").groupBy("_file", "_number").agg(joined("_block").alias("value"), F.min("_block").alias("_block"))
    records = whole.unionByName(cut.select("value", *SPLIT, F.col("_number").alias("_pos")))
    unclosed = splits.groupBy("_file").agg(F.max_by("_exit", "_block").alias("_exit")).where("_exit = 1").select("_file")
    return records, unclosed
