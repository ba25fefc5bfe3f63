"""File readers: one dispatcher, delimited text with detection, JSON with flattening."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lumenframe.functions.columns import col

# Separators and encodings in the order they are tried, texts read as missing.
DELIMITERS = [",", ";", "\t", "|"]
ENCODINGS = ["UTF-8", "ISO-8859-1", "windows-1252"]
NA_TEXT = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
           "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
DELIMITED = ("csv", "txt", "tsv", "tab", "")


def load(spark: SparkSession, path: str, fmt: str | None = None, sep: str | None = None,
         encoding: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """Table from a path or URI of any store Spark can reach; the format follows the suffix.

    csv, txt, tsv, tab, json, jsonl, parquet, orc. Column names lose surrounding space. A table
    without rows is an error. Spreadsheet files are not read: convert them first.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    kind = (fmt or (name.rsplit(".", 1)[1] if "." in name else "")).lower()
    if kind in ("xlsx", "xls"):
        raise ValueError("spreadsheets are not supported, export to CSV or Parquet")
    if kind in ("parquet", "orc"):
        df = spark.read.format(kind).load(path)
    elif kind in ("json", "jsonl", "ndjson"):
        reader = spark.read.option("multiLine", str(kind == "json").lower())
        df = flatten_documents((reader.schema(schema) if schema else reader).json(path))
    elif kind in DELIMITED:
        df = read_delimited(spark, path, "\t" if kind in ("tsv", "tab") else sep, encoding, schema)
    else:
        raise ValueError(f"unknown format: {kind}")
    df = strip_names(df)
    if not df.columns or df.isEmpty():
        raise ValueError("the dataset is empty")
    return df


def strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lstrip("\ufeff") for c in df.columns])


def sniff_delimiter(header: str) -> str:
    """The first separator that splits the header line, else a comma."""
    return next((d for d in DELIMITERS if d in header), ",")


def sniff_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless any line holds bytes that are not."""
    return ENCODINGS[0] if spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty() else ENCODINGS[1]


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
                   schema: T.StructType | str | None = None) -> DataFrame:
    """Delimited text with a header. Lines with too many fields are skipped, short ones padded with null.

    Types come from one aggregate over the text columns unless a schema is given, so a value
    of the wrong type becomes null instead of losing its row.
    """
    encoding = encoding or sniff_encoding(spark, path)
    if sep in (None, "auto"):
        first = spark.read.text(path).limit(1).collect()
        sep = sniff_delimiter(first[0][0] if first else "")
    options = {"sep": sep, "encoding": encoding, "header": "true"}
    names = spark.read.options(**options).csv(path).columns
    if not names:
        raise ValueError("the dataset is empty")
    extra = "__extra"
    wide = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
                        + [T.StructField(extra, T.StringType())])
    raw = spark.read.options(**options, enforceSchema="true").schema(wide).csv(path).where(F.col(extra).isNull())
    text = raw.select(*[F.when(~F.trim(F.col(f"c{i}")).isin(NA_TEXT), F.col(f"c{i}")).alias(n)
                        for i, n in enumerate(names)])
    if schema is not None:
        kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return text.select(*[col(n).try_cast(f.dataType).alias(f.name) for n, f in zip(names, kinds.fields)])
    return cast_text(text)


def cast_text(df: DataFrame) -> DataFrame:
    """Text columns whose every known value is a whole number, number or true/false get that type."""
    exprs = []
    for c in df.columns:
        t = F.trim(col(c))
        exprs += [F.count(col(c)), F.count(t.try_cast("bigint")), F.count(t.try_cast("double")),
                  F.count_if(F.lower(t).isin("true", "false"))]
    row = df.agg(*exprs).first()
    out = []
    for i, c in enumerate(df.columns):
        known, whole, real, flag = row[4 * i:4 * i + 4]
        kind = next((k for k, n in (("boolean", flag), ("bigint", whole), ("double", real)) if known and n == known), None)
        out.append(F.trim(col(c)).try_cast(kind).alias(c) if kind else col(c))
    return df.select(*out)


def flatten_documents(df: DataFrame, max_depth: int = 2) -> DataFrame:
    """Nested structs become dotted columns down to a depth; arrays stay, ``_id`` becomes text."""
    def leaves(kind: T.StructType, path: tuple[str, ...], depth: int) -> list[Column]:
        out: list[Column] = []
        for f in kind.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType) and depth < max_depth:
                out += leaves(f.dataType, here, depth + 1)
                continue
            value = col(here[0])
            for part in here[1:]:
                value = value.getField(part)
            if here == ("_id",):
                value = value.getField("$oid") if isinstance(f.dataType, T.StructType) else value.cast("string")
            out.append(value.alias(".".join(here)))
        return out
    return df.select(*leaves(df.schema, (), 0))


_FILTERS = {
    "$eq": lambda c, v: c.eqNullSafe(F.lit(v)), "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)), "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~F.coalesce(c.isin(list(v)), F.lit(False)),
    "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
}


def find_documents(documents: DataFrame, filter: Mapping | None = None, projection: Mapping | None = None,
                   limit: int | None = None) -> DataFrame:
    """Documents that match a filter, with chosen fields, flattened.

    Works on any document table: landed JSON files, or a document-store connector's format.
    """
    out = documents
    for field, wanted in (filter or {}).items():
        c = F.col(".".join(f"`{p}`" for p in field.split(".")))
        tests = wanted if isinstance(wanted, Mapping) else {"$eq": wanted}
        for name, value in tests.items():
            if name not in _FILTERS:
                raise ValueError(f"unknown filter: {name}")
            out = out.where(_FILTERS[name](c, value))
    kept = [f for f, on in (projection or {}).items() if on]
    if kept:
        if "_id" in documents.columns and (projection or {}).get("_id", 1) and "_id" not in kept:
            kept = ["_id", *kept]
        out = out.select(*[col(f) for f in kept])
    else:
        out = out.drop(*[f for f, on in (projection or {}).items() if not on])
    flat = flatten_documents(out)
    return flat.limit(limit) if limit else flat


def document_schema(spark: SparkSession, path: str, documents: int | None = None) -> DataFrame:
    """(field, type) read from all documents of a JSON-lines path, or from its first few where a number is given."""
    if documents is None:
        fields = spark.read.json(path).schema.fields
    else:
        first = [r[0] for r in spark.read.text(path).limit(documents).collect()]
        kind = spark.range(1).select(F.schema_of_json(F.lit("[" + ",".join(first) + "]")).alias("s")).first()["s"]
        fields = T.StructType.fromDDL(f"d {kind}")["d"].dataType.elementType.fields
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in fields], "field string, type string")


def json_items(df: DataFrame, column: str, path: str = "", name: str = "item") -> DataFrame:
    """Rows of the list at a dotted path of a JSON text column.

    A list gives a row per element, an object one row, a plain value ``{"value": ...}``. The
    path is followed as far as it exists.
    """
    steps = [p for p in path.split(".") if p]
    found = [F.get_json_object(col(column), "$" + "".join(f"['{p}']" for p in steps[:i]))
             for i in range(len(steps), 0, -1)]
    node = F.coalesce(*found, col(column)) if found else col(column)
    trimmed = F.ltrim(node)
    items = F.when(trimmed.startswith("["), F.from_json(node, "array<string>")).when(
        trimmed.startswith("{"), F.array(node)).when(
        node.isNotNull(), F.array(F.to_json(F.struct(node.alias("value")))))
    return df.select(*[col(c) for c in df.columns if c != column], F.explode(items).alias(name))


def read_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Parquet tables ``<folder>/<name>.parquet``."""
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}.parquet") for n in names}
