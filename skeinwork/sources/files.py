"""Files in and out: CSV, JSON, text, binary cells, and tables kept as Parquet."""

from __future__ import annotations

import json
import platform
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NullType, StructType, VariantType, _parse_datatype_string


#: A manifest is read on the driver.
MANIFEST_LINES = 10_000


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and a stated schema; NA, NaN and Inf as numbers have them."""
    return spark.read.csv(path, schema=schema, header=True, nullValue="NA", nanValue="NaN", positiveInf="Inf", negativeInf="-Inf", enforceSchema=False)


def read_first(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The first of several Parquet paths that exists, asked of the file system that holds it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return spark.read.parquet(p)
    raise FileNotFoundError(", ".join(paths))


def read_listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Paths and sizes of the files of a folder whose names fit a glob pattern."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")


def read_manifest(spark: SparkSession, path: str) -> dict[str, object]:
    """Parameters from JSON, or from lines of key: value, where a key's first line counts. A manifest of more than MANIFEST_LINES lines is an error."""
    lines = [r["value"] for r in spark.read.text(path).limit(MANIFEST_LINES + 1).collect()]
    if len(lines) > MANIFEST_LINES:
        raise ValueError(f"a manifest of more than {MANIFEST_LINES} lines: {path}")
    try:
        return json.loads("\n".join(lines))
    except ValueError:
        out: dict[str, object] = {}
        for line in lines:
            key, colon, value = line.partition(":")
            if colon and key and all(c.isalnum() or c in "_.-" for c in key):
                out.setdefault(key, value.strip())
        return out


def parameter(manifest: Mapping[str, object], key: str, default: object = None) -> object:
    """A dotted key of a manifest, or the default."""
    at: object = manifest
    for part in key.split("."):
        if not isinstance(at, Mapping) or part not in at:
            return default
        at = at[part]
    return at


def decoded(cell: Column) -> Column:
    """A padded byte string as text."""
    return F.trim(F.decode(cell, "UTF-8"))


def zipped(df: DataFrame, keep: Sequence[str] = (), **arrays: str) -> DataFrame:
    """Records of equally long arrays as rows, beside columns to keep; unequal lengths are an error."""
    sizes = [F.size(c) for c in arrays.values()]
    rows = F.arrays_zip(*[F.col(c).alias(n) for n, c in arrays.items()])
    same = F.greatest(*sizes) == F.least(*sizes) if len(sizes) > 1 else F.lit(True)
    checked = F.when(same, rows).otherwise(F.raise_error(F.lit("arrays differ in length")))
    return df.select(*keep, F.inline(checked))


def leaves(kind: DataType, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], DataType]]:
    """Paths of a schema that hold values, with their types; structs are walked, arrays are values."""
    if isinstance(kind, StructType):
        for f in kind.fields:
            yield from leaves(f.dataType, (*path, f.name))
    else:
        yield path, kind


def shared_fields(df: DataFrame, record: str) -> DataFrame:
    """Text records (JSON) as a table of the fields that every record has, named by their path.

    Two passes: one finds the schema that holds all records and one counts, by path, the
    records that have it; what is collected is the schema. A record that is no JSON is an error.
    """
    parsed = df.select(F.parse_json(record).alias("v"))
    told = parsed.agg(F.schema_of_variant_agg("v").alias("s")).first()["s"]
    kind = _parse_datatype_string(told.replace("OBJECT<", "STRUCT<")) if told else StructType()
    paths = [(p, t) for p, t in leaves(kind) if not isinstance(t, NullType)]
    at = lambda p, t: F.variant_get("v", "$" + "".join(f"['{x}']" for x in p), t.simpleString())
    counts = parsed.agg(F.count("*").alias("n"), *[F.count(at(p, t)).alias(str(k)) for k, (p, t) in enumerate(paths)]).first()
    shared = [(p, t) for k, (p, t) in enumerate(paths) if counts["n"] and counts[str(k)] == counts["n"]]
    return parsed.select([at(p, t).alias("_".join(p)) for p, t in shared])


def inspected(df: DataFrame) -> DataFrame:
    """(path, class, size, missing, head): one row a path of the schema, structs and the elements of arrays included, in one pass.

    size counts values, missing the rows (or elements) without one; head is the least value as text, null for what has no order.
    """
    plans: list[tuple[str, str, list[Column]]] = []

    def walk(kind: DataType, path: str, value: Column, inner: Callable[[Column], Column] | None) -> None:
        nested = isinstance(kind, (StructType, ArrayType, MapType, VariantType))
        name = kind.typeName() if nested else kind.simpleString()
        if inner is None:  # one value a row
            plans.append((path, name, [F.count(value), F.count_if(value.isNull()), F.lit(None).cast("string") if nested else F.min(value).cast("string")]))
        else:  # a list of values a row
            own = inner(value)
            size = F.sum(F.size(F.filter(own, lambda x: x.isNotNull())).cast("long"))
            none = F.sum(F.size(F.filter(own, lambda x: x.isNull())).cast("long"))
            plans.append((path, name, [F.coalesce(size, F.lit(0)), F.coalesce(none, F.lit(0)), F.lit(None).cast("string") if nested else F.min(F.array_min(own)).cast("string")]))
        if isinstance(kind, StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}", value[f.name] if inner is None else value, None if inner is None else lambda v, n=f.name: F.transform(inner(v), lambda x: x[n]))
        elif isinstance(kind, ArrayType):
            flat_ = (lambda v: F.coalesce(v, F.array())) if inner is None else (lambda v: F.flatten(F.filter(inner(v), lambda x: x.isNotNull())))
            walk(kind.elementType, f"{path}[]", value, flat_)

    for f in df.schema.fields:
        walk(f.dataType, f.name, F.col(f"`{f.name}`"), None)
    counts = df.agg(*[c.alias(f"{k}_{j}") for k, (*_, cs) in enumerate(plans) for j, c in enumerate(cs)])
    rows = [F.struct(F.lit(p).alias("path"), F.lit(c).alias("class"), F.col(f"{k}_0").alias("size"), F.col(f"{k}_1").alias("missing"), F.col(f"{k}_2").alias("head")) for k, (p, c, _) in enumerate(plans)]
    return counts.select(F.inline(F.array(*rows)))


def flat(df: DataFrame, separator: str = ",") -> DataFrame:
    """Array columns as joined text, for files that hold text only."""
    return df.select([F.array_join(c, separator).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    flat(df, separator).write.mode("overwrite").csv(path, header=True, nullValue="NA")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_lines(df: DataFrame, path: str) -> None:
    """Add the rows of a one-column table to a log."""
    df.select(df[0].cast("string").alias("value")).write.mode("append").text(path)


def provenance(spark: SparkSession) -> dict[str, str]:
    """Versions and settings that a result depends on."""
    keys = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.adaptive.enabled")
    return {"spark": spark.version, "pyspark": pyspark.__version__, "python": platform.python_version()} | {k: spark.conf.get(k) for k in keys}
