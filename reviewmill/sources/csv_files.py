"""Tolerant CSV reading over many files.

One scan of the lines profiles every file: encoding, delimiter, header and whether a
quoted field spans lines. Files that agree in all of these are read together, so a
folder costs one more scan however many files it has; files with fields that span lines
are cut into records by many tasks too (`csv_records`). Only the profile, one short
row per file like Spark's own file listing, comes to the driver.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from reviewmill.functions.lexicon import MISSING_CELLS
from reviewmill.functions.text import strip
from reviewmill.session import materialise
from reviewmill.sources.csv_records import FILE, csv_records, parsed

# Delimiters and their names, in order of preference.
DELIMITERS = {",": "comma", ";": "semicolon", "\t": "tab", "|": "pipe"}
# Bytes that cp1252 leaves undefined, and the characters it gives the
# bytes 0x80-0x9f where latin-1 has control characters.
CP1252_UNDEFINED = "\x81\x8d\x8f\x90\x9d"
CP1252_FROM = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
CP1252_TO = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"

BAD_ROW = "_bad_row"
EXTRA = "_extra"
MARK = "\x01end"

EMPTY = "The file holds no text."
NO_ROWS = "No row of the file could be used."


@dataclass(frozen=True)
class CsvScan:
    rows: DataFrame | None
    info: DataFrame


def _quote_free(line: Column) -> Column:
    return F.regexp_replace(line, '"[^"]*"', "")


def profile_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file: encoding, delimiter, header line, multi_line, n_lines."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_size").alias("_size"),
        F.col("_metadata.file_block_start").alias("_start"), "value",
        F.monotonically_increasing_id().alias("_order"))
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    valid = F.is_valid_utf8("value")
    text = F.when(valid, F.col("value")).otherwise(latin)
    text = F.regexp_replace(text, "^\\x{FEFF}", "")
    read = lines.select(
        FILE, "_start", "_order", text.alias("_text"), valid.alias("_valid"),
        (~valid & latin.rlike(f"[{CP1252_UNDEFINED}]")).alias("_undefined"))
    read = read.withColumn("_bare", _quote_free(F.col("_text")))
    filled = F.trim("_text") != ""
    counts = {name: F.when(filled, F.length("_bare") - F.length(F.replace(
        F.col("_bare"), F.lit(mark), F.lit("")))) for mark, name in DELIMITERS.items()}
    stats = [F.min(c).alias(f"_min_{n}") for n, c in counts.items()]
    stats += [F.max(c).alias(f"_max_{n}") for n, c in counts.items()]
    profile = read.groupBy(FILE).agg(
        F.bool_and("_valid").alias("_utf8"), F.bool_or("_undefined").alias("_undefined"),
        # the head of a file is the first filled line of the split that starts at 0
        F.min_by("_text", F.when(filled & (F.col("_start") == 0), F.col("_order"))).alias("header"),
        F.bool_or(F.pmod(F.length("_text") - F.length(F.replace(
            F.col("_text"), F.lit('"'), F.lit(""))), F.lit(2)) == 1).alias("multi_line"),
        F.count_if(filled).alias("n_lines"), *stats)
    encoding = F.when(F.col("_utf8"), "utf-8-sig").when(F.col("_undefined"), "latin-1").otherwise(
        "cp1252")
    # a delimiter found equally often in every line, else the one most frequent in the header
    steady = [F.struct(F.when((F.col(f"_min_{n}") == F.col(f"_max_{n}")), F.col(f"_min_{n}"))
                       .otherwise(0).alias("k"), F.lit(-i).alias("i"), F.lit(n).alias("name"))
              for i, n in enumerate(DELIMITERS.values())]
    head = _quote_free(F.col("header"))
    in_head = [F.struct((F.length(head) - F.length(F.replace(head, F.lit(mark), F.lit("")))).alias("k"),
                        F.lit(-i).alias("i"), F.lit(n).alias("name"))
               for i, (mark, n) in enumerate(DELIMITERS.items())]
    best, top = F.greatest(*steady), F.greatest(*in_head)
    delimiter = F.when(best["k"] > 0, best["name"]).when(top["k"] > 0, top["name"]).otherwise("comma")
    return profile.select(FILE, encoding.alias("encoding"), delimiter.alias("delimiter"),
                          "header", "multi_line", "n_lines")


def _header_names(spark: SparkSession, header: str, separator: str) -> list[str]:
    """Names of a header line; blanks and repeats are told apart as a reader would."""
    fields = spark.range(1).select(
        F.from_csv(F.lit(header), ",".join(f"c{i} string" for i in range(header.count(separator) + 1)),
                   {"sep": separator, "escape": '"'}).alias("f")).select("f.*").first()
    n_fields = len(fields)
    while n_fields > 1 and fields[n_fields - 1] is None and '"' in header:
        n_fields -= 1
    names, seen = [], {}
    for i, name in enumerate(fields[:n_fields]):
        name = name if name else f"Unnamed: {i}"
        times = seen.get(name, 0)
        seen[name] = times + 1
        names.append(f"{name}.{times}" if times else name)
    return names


def _read_group(spark: SparkSession, files: list[str], encoding: str, delimiter: str,
                header: str, multi_line: bool) -> DataFrame:
    separator = next(mark for mark, name in DELIMITERS.items() if name == delimiter)
    if encoding == "cp1252":
        header = header.translate(str.maketrans(CP1252_FROM, CP1252_TO))
    names = _header_names(spark, header, separator)
    plain = [f"c{i}" for i in range(len(names))]
    schema = StructType([StructField(n, StringType()) for n in [*plain, BAD_ROW]])
    options = {"sep": separator, "escape": '"'}
    if multi_line:
        read = parsed(csv_records(spark, files, separator, encoding != "utf-8-sig"), plain, BAD_ROW, options)
    else:
        read = (
            spark.read.schema(schema).options(**options)
            .option("encoding", "UTF-8" if encoding == "utf-8-sig" else "ISO-8859-1")
            # with pruning a row is only checked as far as the wanted columns reach
            .option("columnPruning", False).option("header", True)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_ROW)
            .csv(files).withColumn(FILE, F.col("_metadata.file_path"))
        )
    # A bad row is short or long. Padded with marks it is parsed once more: a short
    # row shows a mark behind the last column, a long row its own extra field.
    padded = F.concat(F.col(BAD_ROW), *[F.lit(separator + MARK)] * (len(names) + 1))
    wide = ",".join(f"{n} string" for n in [*plain, EXTRA])
    extra = F.from_csv(padded, wide, options)[EXTRA]
    # the reader wants a data column to be read along with the bad row
    first = F.length(F.coalesce(F.col(plain[0]), F.lit(""))) >= 0
    too_long = F.col(BAD_ROW).isNotNull() & ~F.coalesce(extra == MARK, F.lit(False))
    # a line of white space is no row; it shows as one cell where fields may span lines
    line = F.col(BAD_ROW) if len(plain) > 1 else F.col(plain[0])
    is_row = ~F.coalesce(strip(line) == "", F.lit(False))
    cells = []
    for column, name in zip(plain, names):
        cell = F.col(column)
        if encoding == "cp1252":
            cell = F.translate(cell, CP1252_FROM, CP1252_TO)
        # null reads as missing, like the texts that stand for it
        cells.append(F.when(~cell.isin(MISSING_CELLS), cell).alias(name))
    return read.where(first & is_row).select(FILE, too_long.alias("_too_long"), *cells)


def scan_csv(spark: SparkSession, paths: str | list[str]) -> CsvScan:
    """Read CSV files of mixed encodings and delimiters.

    `rows` holds every usable row with text columns and the source file; over-long
    rows are left out, short rows end in nulls, columns without any value are gone.
    `info` tells per file the encoding, delimiter, rows, rows_skipped and error.
    Files with different headers are united by column name.
    """
    profile = profile_files(spark, paths).collect()
    groups: dict[tuple, list[str]] = {}
    for row in profile:
        if row["header"] is not None:
            key = (row["encoding"], row["delimiter"], row["header"], row["multi_line"])
            groups.setdefault(key, []).append(row[FILE])
    parts = [_read_group(spark, sorted(files), *key) for key, files in sorted(groups.items())]
    found = spark.createDataFrame(
        [(r[FILE], r["encoding"], r["delimiter"], r["header"] is None) for r in profile],
        f"{FILE} string, encoding string, delimiter string, _blank boolean")
    if not parts:
        info = found.select(FILE, "encoding", "delimiter", F.lit(0).cast("long").alias("rows"),
                            F.lit(0).cast("long").alias("rows_skipped"), F.lit(EMPTY).alias("error"))
        return CsvScan(None, info)
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part, allowMissingColumns=True)
    names = [n for n in everything.columns if n not in (FILE, "_too_long")]
    kept = ~F.col("_too_long")
    # one more pass gives the row counts and shows which columns hold a value
    counted = materialise(everything.groupBy(FILE).agg(
        F.count_if(kept).alias("rows"), F.count_if("_too_long").alias("rows_skipped"),
        *[F.count(F.when(kept, F.col(f"`{n}`"))).alias(f"_n{i}") for i, n in enumerate(names)]),
        "csv-counts")
    filled = counted.agg(*[F.sum(f"_n{i}") for i in range(len(names))]).first()
    info = found.join(counted, FILE, "left").select(
        FILE, "encoding", "delimiter", F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("rows_skipped", F.lit(0)).alias("rows_skipped"),
        F.when(F.col("_blank"), EMPTY).when(F.coalesce("rows", F.lit(0)) == 0, NO_ROWS).alias("error"))
    rows = everything.where(kept).select(
        FILE, *[F.col(f"`{n}`") for i, n in enumerate(names) if filled[i]])
    return CsvScan(rows, info)


def drop_empty_columns(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Without the columns that hold no value, found in one aggregate."""
    names = [n for n in df.columns if n not in keep]
    counts = df.agg(*[F.count(F.col(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(names)]).first()
    return df.select(*keep, *[F.col(f"`{n}`") for i, n in enumerate(names) if counts[i] > 0])
