"""File sources (S1-S3, S11, S12) and table helpers.

CSV is read as text with an explicit schema and then cast, so the load is
positional/typed like a warehouse COPY: a bad value fails the load (ANSI
cast) unless ``tolerant=True`` (``try_cast``). The three NULL spellings of
the file format are mapped to NULL (Spark's ``nullValue`` takes one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that the file format reads as NULL.
NULL_SPELLINGS = ["NULL", "null", ""]


def write_csv(df: DataFrame, path: str) -> None:
    # keep surrounding spaces: Spark's CSV writer trims them by default
    (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType, tolerant: bool = False,
                   header: bool = True) -> DataFrame:
    """Comma, one header line, optional quotes, NULL spellings,
    positional typing into ``schema``."""
    text_schema = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = (spark.read.schema(text_schema).option("header", header).option("quote", '"').option("escape", '"')
           .option("mode", "FAILFAST").csv(path))
    cols = []
    for f, src in zip(schema.fields, raw.columns):
        c = F.when(F.col(src).isin(*NULL_SPELLINGS) | F.col(src).isNull(), F.lit(None)).otherwise(F.col(src))
        cols.append((c.try_cast(f.dataType) if tolerant else c.cast(f.dataType)).alias(f.name))
    return raw.select(*cols)


def read_json_cases(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """Evaluation cases (JSON lines, or one JSON array with ``multiline``)."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


#: A quoted string, and an object that holds objects three levels deep at most.
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_OBJECT = rf'\{{(?:[^{{}}"]++|{_STRING})*+\}}'
for _ in range(3):
    _OBJECT = rf'\{{(?:[^{{}}"]++|{_STRING}|{_OBJECT})*+\}}'


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Files that are one JSON array each, as rows and as rejects.

    A parser of the whole array gives up at the first broken element. Here
    the objects are cut out of the text and parsed one by one, so a broken
    one costs no other. Rejects (file, pos, text) are objects that do not fit
    ``schema`` or lack its first column, and whatever else stands between
    objects. A file is read by one task; files are the unit of work.
    """
    whole = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"^\s*\[|\]\s*$", "").alias("body"))
    cut = whole.select("file", F.posexplode(F.regexp_extract_all("body", F.lit(_OBJECT), 0)).alias("pos", "text"))
    corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = cut.withColumn("r", F.from_json("text", corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = F.col("r._corrupt").isNull() & F.col(f"r.{schema.fields[0].name}").isNotNull()
    rest = whole.select("file", F.explode(F.split("body", _OBJECT, -1)).alias("text")).select("file", F.lit(None).cast("int").alias("pos"), F.regexp_replace("text", r"^[\s,]+|[\s,]+$", "").alias("text"))
    rejects = parsed.where(~good).select("file", "pos", "text").unionByName(rest.where("text <> ''"))
    return parsed.where(good).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields]), rejects


def apply_table_defaults(df: DataFrame, defaults: dict, id_col: str | None = None,
                         id_from: list[str] | None = None) -> DataFrame:
    """Column defaults and a stable generated id (sha2 of the natural
    key, so a re-run after a failure produces the same ids)."""
    out = df
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    if id_col:
        out = out.withColumn(id_col, F.coalesce(F.col(id_col), F.sha2(F.concat_ws("|", *id_from), 256)))
    return out


def add_column_if_absent(df: DataFrame, name: str, dtype: str) -> DataFrame:
    """Additive migration."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(dtype))
