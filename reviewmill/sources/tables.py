"""Table readers and the prediction writer."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewmill.functions.lexicon import BASE_TARGET_COLUMN, BASE_TEXT_COLUMN
from reviewmill.functions.numbers import to_number
from reviewmill.functions.text import clean_text

SPREAD = 16


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. A small file that comes in a few splits is spread over up to
    SPREAD tasks; a table of more splits is read as it lies, however many cores there are."""
    df = spark.read.parquet(path)
    tasks = min(spark.sparkContext.defaultParallelism, SPREAD)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The table itself, or an error that names the missing columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"column(s) {missing} not found; available: {df.columns}")
    return df


def base_training_rows(df: DataFrame, text_col: str = BASE_TEXT_COLUMN,
                       target_col: str = BASE_TARGET_COLUMN, id_col: str | None = None) -> DataFrame:
    """Rows (id, review_text, recommended) with a target of 0 or 1. Empty texts stay."""
    require_columns(df, text_col, target_col, *([id_col] if id_col else []))
    target = F.expr(f"try_cast(`{target_col}` as double)").cast("int") if dict(df.dtypes)[
        target_col] != "string" else to_number(F.col(target_col)).cast("int")
    rows = df.select(*([id_col] if id_col else []), clean_text(F.col(text_col)).alias("review_text"),
                     target.alias("recommended"))
    return rows.where(F.col("recommended").isin(0, 1))


def export_predictions(df: DataFrame, path: str, file_format: str = "csv") -> None:
    """The full prediction table as a folder of CSV (or Parquet) files."""
    writer = df.write.mode("errorifexists")
    if file_format == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(file_format).save(path)
