"""Readers of record exports: arrays, wrappers, single objects and lines of JSON, delimited tables, judgments and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: Names under which exports keep their list of records.
WRAPPERS = ("docs", "items", "records", "data", "results", "hits")


def unwrap(df: DataFrame) -> DataFrame:
    """Records of a wrapper object: the list under a usual name, else the only list of objects, else the rows themselves."""
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType)]
    named = [w for w in WRAPPERS if w in lists]
    pick = named[0] if named else lists[0] if len(lists) == 1 and all(f.name in (*lists, "meta", "counts") for f in df.schema.fields) else None
    return df.select(F.inline(F.col(pick))) if pick else df


def read_records(spark: SparkSession, path: str, schema: StructType | str | None = None, strict: bool = False) -> DataFrame:
    """Records of JSON or lines of JSON, also gzipped (by ending).

    Files ending in .jsonl or .ndjson, with .gz or without, are split by lines and read in parallel; others are whole documents, one
    task per file. A line that is no record is dropped, or fails the job with ``strict``.
    """
    reader = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    if schema is not None:
        reader = reader.schema(schema)
    bare = path[:-3] if path.endswith(".gz") else path
    lined = bare.endswith((".jsonl", ".ndjson"))
    return unwrap(reader.option("multiLine", str(not lined).lower()).json(path))


def read_wanted(spark: SparkSession, path: str, key: str, wanted: DataFrame) -> DataFrame:
    """Only the records whose key is wanted: lines are searched before the rest of them is parsed."""
    keys = wanted.select(F.col(key).cast("string").alias("_k")).distinct()
    lines = spark.read.text(path).withColumn("_k", F.get_json_object("value", f"$.{key}"))
    return lines.join(keys, "_k", "left_semi").select("value")


def newest(spark: SparkSession, folder: str, pattern: str = "*.{json,jsonl,ndjson,json.gz,jsonl.gz,ndjson.gz}") -> str | None:
    """The newest export of a folder by its time of change; null without any."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    best = max(files, key=lambda f: (f.getModificationTime(), f.getPath().toString()), default=None)
    return best.getPath().toString() if best is not None else None


def read_delimited(spark: SparkSession, path: str, numbers: list[str] | None = None, separator: str = "\t", required: list[str] | None = None) -> DataFrame:
    """A delimited table with a header, names trimmed; ``numbers`` become doubles, what is none null. A missing required column raises."""
    df = spark.read.csv(path, sep=separator, header=True, quote='"', escape='"', multiLine=True)
    df = df.toDF(*[c.strip() for c in df.columns])
    if missing := [c for c in required or [] if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.withColumns({c: F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)") for c in numbers or [] if c in df.columns})


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """(query, doc, grade) of a list of {query, relevant: {doc: grade}}; entries without a query are dropped."""
    df = spark.read.schema("query STRING, relevant MAP<STRING, INT>").option("multiLine", "true").json(path)
    return df.where(F.trim("query") != "").select("query", F.explode("relevant").alias("doc", "grade"))


def read_vocabulary(spark: SparkSession, pattern: str) -> DataFrame:
    """(field_name, term, parent_category) of files data_model.<field>.json, each a list of {name, parent_category}."""
    schema = "name STRING, label STRING, value STRING, parent_category ARRAY<STRING>"
    df = spark.read.schema(schema).option("multiLine", "true").json(pattern).withColumn("_f", F.input_file_name())
    term = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("name", "label", "value")])
    return df.select(F.regexp_extract("_f", r"data_model\.([^/]+)\.json", 1).alias("field_name"), term.alias("term"), F.coalesce("parent_category", F.array().cast("array<string>")).alias("parent_category")).where("term IS NOT NULL")


def string_lists(df: DataFrame, *columns: str, separator: str = r"\s*[;,|]\s*") -> DataFrame:
    """Columns that are strings or arrays of strings, all as arrays without blank items."""
    out = {}
    for c in columns:
        items = F.col(c) if isinstance(df.schema[c].dataType, ArrayType) else F.when(F.col(c).isNotNull(), F.split(F.col(c).cast(StringType()), separator))
        out[c] = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumns(out)


def read_log(spark: SparkSession, url: str, table: str, since: str, **options: str) -> DataFrame:
    """The search log of a database: its columns as they are now, rows since a time; both are pushed into the query."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().where(F.col("ts") >= since)


def forward_fill(df: DataFrame, column: str, order: str, by: list[str]) -> DataFrame:
    """Blank cells of a sheet filled from above, within the rows of ``by``."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(F.nullif(F.trim(column), F.lit("")), ignorenulls=True).over(w))
