"""Audit of the fields of a record table: coverage, cardinality, entropy, reuse, kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from granary.functions import numeric


def long_values(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value): one row per atom; arrays give one per item, structs the first of their text fields. Blank values are left out."""
    columns = []
    for f in fields:
        kind = df.schema[f].dataType
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            names = [x.name for x in kind.elementType.fields if isinstance(x.dataType, StringType)]
            items = F.transform(F.col(f), _first_of(names))
        elif isinstance(kind, ArrayType):
            items = F.transform(F.col(f), lambda x: x.cast("string"))
        else:
            items = F.array(F.col(f).cast("string"))
        columns.append(F.struct(F.lit(f).alias("field"), items.alias("items")))
    rows = df.select(key, F.inline(F.array(*columns)))
    atoms = rows.select(key, "field", F.explode("items").alias("value"))
    return atoms.where(F.regexp_like("value", F.lit(r"[^\s\p{Z}]")))


def _first_of(names: list[str]):
    return lambda x: F.coalesce(*[F.nullif(F.trim(x[n]), F.lit("")) for n in names])


def field_audit(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, coverage, n_values, distinct, entropy, mean_length, mean_reuse, facet_fitness).

    ``coverage`` is the share of rows with a value, ``entropy`` of the values in bits per bit possible. Values are counted before anything else, so the measures are
    aggregates over distinct values; lengths are weighted sums over them.
    """
    total = df.agg(F.count("*").alias("rows"))
    values = long_values(df, key, fields)
    covered = values.groupBy("field", key).agg(F.count("*").alias("k")).groupBy("field").agg(F.count("*").alias("covered"))
    counts = values.groupBy("field", "value").agg(F.count("*").alias("n"))
    sums = counts.groupBy("field").agg(
        F.sum("n").alias("n_values"), F.count("*").alias("distinct"), F.sum(F.col("n") * F.length("value")).alias("chars"), F.sum(F.col("n") * F.log2("n")).alias("nlogn")
    )
    out = sums.join(covered, "field").crossJoin(F.broadcast(total))
    entropy = F.log2("n_values") - F.col("nlogn") / F.col("n_values")
    return out.select(
        "field", (F.col("covered") / F.col("rows")).alias("coverage"), "n_values", "distinct", F.when(F.col("distinct") > 1, entropy / F.log2("distinct")).otherwise(0.0).alias("entropy"),
        (F.col("chars") / F.col("n_values")).alias("mean_length"), (F.col("n_values") / F.col("distinct")).alias("mean_reuse"), numeric.cardinality_fitness(F.col("distinct")).alias("facet_fitness"),
    )


def cross_tabs(df: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """(columns..., level, n) for several groupings in one pass; a column that a grouping lacks is null, ``level`` names the grouping."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(F.count("*").alias("n"), F.grouping_id(*names).alias("level"))
    return grouped.select(*names, F.col("level").cast("long").alias("level"), "n")


def shared_values(df: DataFrame, value: str, owner: str) -> DataFrame:
    """(value_key, n, n_owners): values that several rows have in equal words, and how many owners share them."""
    text = F.lower(F.trim(F.regexp_replace(F.col(value), r"\s+", " ")))
    rows = df.where(F.col(value).isNotNull()).select(F.substring(F.sha1(text), 1, 16).alias("value_key"), F.col(owner).alias("owner"), text.alias("_t")).where("_t <> ''")
    return rows.groupBy("value_key", "owner").agg(F.count("*").alias("k")).groupBy("value_key").agg(F.sum("k").alias("n"), F.count("owner").alias("n_owners")).where("n > 1")


def exact_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(text_key, n, first): classes of rows with the same text, blanks and case aside; a class of a third of all rows is one row per map task in the shuffle."""
    norm = F.lower(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")))
    rows = df.where(F.col(text).isNotNull()).select(F.substring(F.sha1(norm), 1, 16).alias("text_key"), F.col(key).alias("k"))
    return rows.groupBy("text_key").agg(F.count("*").alias("n"), F.min("k").alias("first")).where("n > 1")


def vocabulary_check(df: DataFrame, key: str, fields: list[str], terms: DataFrame) -> DataFrame:
    """(key, field, value, known): each value of controlled fields and whether the vocabulary has it, case and outer blanks aside."""
    values = long_values(df, key, fields).withColumn("_v", F.lower(F.trim("value")))
    known = terms.select(F.col("field_name").alias("field"), F.lower(F.trim("term")).alias("_v")).distinct().withColumn("known", F.lit(True))
    return values.join(known, ["field", "_v"], "left").select(key, "field", "value", F.coalesce("known", F.lit(False)).alias("known"))


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the last in the order; reduced before the shuffle."""
    rest = [c for c in df.columns if c != key and c not in order]
    last = df.groupBy(key).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("r"))
    return last.select(key, *[F.col(f"r.`{c}`").alias(c) for c in (*order, *rest)])


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; a change's non-null fields win, fields it lacks stay. The columns are those of either side."""
    names = list(dict.fromkeys([*base.columns, *changes.columns]))
    b = base.select(*[F.col(c).alias(f"b_{c}") for c in base.columns])
    c_ = changes.select(*[F.col(c).alias(f"c_{c}") for c in changes.columns])
    joined = b.join(c_, F.col(f"b_{key}") == F.col(f"c_{key}"), "full_outer")
    pick = lambda c: F.coalesce(*[F.col(f"{s}_{c}") for s, cols in (("c", changes.columns), ("b", base.columns)) if c in cols])
    return joined.select(*[pick(c).alias(c) for c in names])


def drop_deep(df: DataFrame, names: set[str]) -> DataFrame:
    """Columns and struct fields of these names gone, at any depth, also inside arrays of structs."""

    def strip(column, kind):
        if isinstance(kind, StructType):
            kept = [f for f in kind.fields if f.name not in names]
            return F.when(column.isNotNull(), F.struct(*[strip(column[f.name], f.dataType).alias(f.name) for f in kept])) if kept else F.lit(None)
        if isinstance(kind, ArrayType):
            return F.transform(column, lambda x: strip(x, kind.elementType)) if isinstance(kind.elementType, (StructType, ArrayType)) else column
        return column

    return df.select(*[strip(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if f.name not in names])


def flatten(df: DataFrame, depth: int = 4) -> DataFrame:
    """Struct fields as columns with dotted names, down to a depth."""

    def walk(prefix: str, kind, level: int):
        for f in kind.fields:
            path = f"{prefix}.`{f.name}`" if prefix else f"`{f.name}`"
            if isinstance(f.dataType, StructType) and level < depth:
                yield from walk(path, f.dataType, level + 1)
            else:
                yield F.col(path).alias(path.replace("`", ""))

    return df.select(*walk("", df.schema, 1))


def wide_outputs(df: DataFrame, key: str, by: str, values: list[str], names: list[str]) -> DataFrame:
    """Outputs of several producers side by side: one column per producer and value."""
    return df.groupBy(key).pivot(by, names).agg(*[F.first(v, ignorenulls=True).alias(v) for v in values])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
