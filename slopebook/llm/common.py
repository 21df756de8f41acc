"""Helpers shared by the training-data operators: table access, column naming
and the Arrow row mapper that every text operator uses."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from slopebook.plans.session import ship_package

#: Texts handed to a compute function at once, so that a batch of very long
#: texts does not multiply its working memory.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with any column of ``df`` (case is ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(values: list, chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(start, end) ranges of ``values`` (texts or None) of about ``chars`` characters each."""
    start = size = 0
    for i, v in enumerate(values):
        if i > start and size + len(v or "") > chars:
            yield start, i
            start, size = i, 0
        size += len(v or "")
    if start < len(values):
        yield start, len(values)


def with_text_columns(df: DataFrame, text: str, fields: list[T.StructField],
                      compute: Callable[[list[str | None]], Iterable[tuple]]) -> DataFrame:
    """``df`` plus the columns ``fields``, computed from the column ``text``.

    ``compute`` takes a list of texts (None for null) and yields one tuple of
    values per text.  One Arrow pass, no shuffle; the other columns pass
    through untouched.
    """
    spark = df.sparkSession
    ship_package(spark)
    schema = T.StructType(list(df.schema.fields) + list(fields))
    types = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in fields]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Slices are cut by bytes before any text becomes a Python object.
            for start, end in _byte_slices(batch.column(at)):
                part = batch.slice(start, end - start)
                rows = list(compute(part.column(at).to_pylist()))
                new = [pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(part.columns + new, names=part.schema.names + names)

    return df.mapInArrow(run, schema)


def _byte_slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > SLICE_CHARS:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def field(name: str, kind: str, nullable: bool = True) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind) if kind not in _KINDS else _KINDS[kind], nullable)


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
          "binary": T.BinaryType(), "boolean": T.BooleanType(), "longs": T.ArrayType(T.LongType()),
          "ints": T.ArrayType(T.IntegerType()), "doubles": T.ArrayType(T.DoubleType()),
          "strings": T.ArrayType(T.StringType())}


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About the ``rows`` rows of smallest hash of ``key`` (never more), the hash as column ``h``.

    The table is counted first and the hash range cut to hold half as many
    again, so tasks send the driver a share of the sample, not a whole one each.
    """
    total = df.count()
    hashed = df.withColumn("h", F.xxhash64(key))
    if total > 2 * rows + 1000:
        share = (1.5 * rows + 500) / total
        hashed = hashed.where(F.col("h") < int(-2 ** 63 + share * 2 ** 64))
    return hashed.orderBy("h", key).limit(rows)
