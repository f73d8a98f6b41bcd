"""Parquet footer readers (F1, per-file schemas for S4, per-file rows for P3).

The file list is a DataFrame; footers are read on executors by
``mapInArrow`` with pyarrow, so thousands of footers are read in parallel
and no data page is touched.  Rows leave a task file by file.  Output is one
row per (file, row group, column chunk) with min/max in the same typed lanes
as the profile; a bound that a lane cannot hold exactly (INT96, unsigned
beyond 2^63, binary) is unknown, never dropped from a merge in silence.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import sys
from collections.abc import Iterator
from zoneinfo import ZoneInfo

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lakelens.sources.listing import file_system, s3_options

# The footer readers run in Python workers on the executors.  Pickling this
# module's functions by value ships their code with the task, so executors
# need pyarrow but not this package on their path (it can still be
# shipped the usual way, with --py-files).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_SCHEMA = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("row_group", T.IntegerType()),
    T.StructField("column_index", T.IntegerType()),
    T.StructField("column_path", T.StringType()),
    T.StructField("top_column", T.StringType()),
    T.StructField("physical_type", T.StringType()),
    T.StructField("logical_type", T.StringType()),
    T.StructField("num_rows", T.LongType()),
    T.StructField("num_values", T.LongType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("has_min_max", T.BooleanType()),
    T.StructField("nan_bound", T.BooleanType()),
    T.StructField("min_int", T.LongType()),
    T.StructField("max_int", T.LongType()),
    T.StructField("min_num", T.DoubleType()),
    T.StructField("max_num", T.DoubleType()),
    T.StructField("min_str", T.StringType()),
    T.StructField("max_str", T.StringType()),
    T.StructField("min_ts", T.TimestampNTZType()),
    T.StructField("max_ts", T.TimestampNTZType()),
    T.StructField("compressed_size", T.LongType()),
    T.StructField("uncompressed_size", T.LongType()),
])

FILE_SCHEMA_SCHEMA = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("num_rows", T.LongType()),
    T.StructField("num_row_groups", T.IntegerType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("arrow_type", T.StringType()),
    T.StructField("nullable", T.BooleanType()),
])


FILE_ROWS_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("num_rows", T.LongType()),
])

TYPE_SCHEMA = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("num_rows", T.LongType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("spark_type", T.StringType()),
])


def _open(path: str, s3: dict[str, str]):
    """Open a listed path with pyarrow's file system for its scheme."""
    fs, inner = file_system(path, s3)
    return fs.open_input_file(inner)


def _lane(physical: str, v, zone: str):
    """(lane, value) of one footer bound; lane "nan" for a NaN, None if no lane holds it exactly."""
    if isinstance(v, bool) or physical in ("BOOLEAN", "INT96"):
        return None, None
    if isinstance(v, decimal.Decimal):
        return "dec", v
    if isinstance(v, float):
        return ("nan", None) if math.isnan(v) else ("num", 0.0 if v == 0 else v)  # -0.0 reads as 0.0
    if isinstance(v, _dt.datetime):
        # an instant reads in the session's time zone, like the column itself
        return "ts", v if v.tzinfo is None else v.astimezone(ZoneInfo(zone)).replace(tzinfo=None)
    if isinstance(v, _dt.date):
        return "ts", _dt.datetime(v.year, v.month, v.day)
    if isinstance(v, int):
        return ("int", v) if -(1 << 63) <= v < 1 << 63 else (None, None)
    return ("str", v) if isinstance(v, str) else (None, None)


def _bounds(st, physical: str, zone: str) -> list | None:
    """[(lane, value) of min, of max]; None if they are unknown.  One column's
    unreadable bounds never fail the file."""
    if physical == "INT96":
        return None
    try:
        found = [_lane(physical, v, zone) for v in (st.min, st.max)]
    except (ArithmeticError, ValueError, NotImplementedError):
        return None
    return found if all(lane is not None for lane, _ in found) else None


def _chunk_rows(path: str, meta, zone: str) -> Iterator[dict]:
    for rg_i in range(meta.num_row_groups):
        rg = meta.row_group(rg_i)
        for ci in range(rg.num_columns):
            ch = rg.column(ci)
            st = ch.statistics
            has = st is not None and st.has_min_max
            bounds = _bounds(st, ch.physical_type, zone) if has else None
            r = {
                "file_path": path, "row_group": rg_i, "column_index": ci,
                "column_path": ch.path_in_schema,
                "top_column": ch.path_in_schema.split(".")[0],
                "physical_type": ch.physical_type,
                "logical_type": str(meta.schema.column(ci).logical_type),
                "num_rows": rg.num_rows, "num_values": ch.num_values,
                "null_count": st.null_count if (st is not None and st.has_null_count) else None,
                # booleans and binary have bounds that no lane shows
                "has_min_max": has and (bounds is not None or ch.physical_type in ("BOOLEAN", "BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY")),
                "nan_bound": bounds is not None and any(lane == "nan" for lane, _ in bounds),
                "compressed_size": ch.total_compressed_size,
                "uncompressed_size": ch.total_uncompressed_size,
            }
            if bounds is not None and not r["nan_bound"]:  # a NaN bound makes both unusable
                for b, (lane, v) in zip(("min", "max"), bounds):
                    if lane == "dec":
                        r[f"{b}_num"], r[f"{b}_str"] = float(v), format(v, "f")
                    else:
                        r[f"{b}_{lane}"] = v
            yield r


def _schema_rows(path: str, file) -> Iterator[dict]:
    meta = file.metadata
    for i, fld in enumerate(file.schema_arrow, start=1):
        yield {"file_path": path, "num_rows": meta.num_rows, "num_row_groups": meta.num_row_groups, "ordinal": i,
               "column_name": fld.name, "arrow_type": str(fld.type), "nullable": bool(fld.nullable)}


def _read(spark: SparkSession, files: DataFrame, schema: T.StructType, rows_of, tasks: int = 0) -> DataFrame:
    """``rows_of(path, length, file)`` of every listed file, one batch a file.  The listing
    is spread over the session's cores (or ``tasks``) by one exchange of (path, length) rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    s3, arrow = s3_options(spark), to_arrow_schema(schema)

    def read(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                if length == 0:  # Spark passes over empty files too
                    continue
                with _open(path, s3) as f:
                    rows = list(rows_of(path, length, pq.ParquetFile(f)))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    spread = files.select("path", "length").repartition(tasks or _tasks(spark))
    return spread.mapInArrow(read, schema)


def _tasks(spark: SparkSession) -> int:
    return 4 * spark.sparkContext.defaultParallelism


def _files(spark: SparkSession, path_or_files) -> tuple[DataFrame, int]:
    """The files of a table (those of a Delta table's newest snapshot) or of a listing, and the
    tasks to deal them to: no more than there are files, where they are listed here."""
    if isinstance(path_or_files, DataFrame):
        return path_or_files, _tasks(spark)
    from lakelens.sources.files import live_files

    files = live_files(spark, path_or_files)
    return files, max(1, min(_tasks(spark), files.count()))


def footer_chunks(spark: SparkSession, path_or_files) -> DataFrame:
    """column-chunk statistics of every data file of a table, whatever its
    name ends in (or of a listing DataFrame).  A missing path is an error."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    files, tasks = _files(spark, path_or_files)
    return _read(spark, files, CHUNK_SCHEMA, lambda path, _, file: _chunk_rows(path, file.metadata, zone), tasks)


def file_schemas(spark: SparkSession, path_or_files) -> DataFrame:
    """Per-file Arrow schema and row count, read from footers."""
    files, tasks = _files(spark, path_or_files)
    return _read(spark, files, FILE_SCHEMA_SCHEMA, lambda path, _, file: _schema_rows(path, file), tasks)


def file_rows(spark: SparkSession, path_or_files) -> DataFrame:
    """(path, length, num_rows) of every file, from its footer alone."""
    files, tasks = _files(spark, path_or_files)
    return _read(spark, files, FILE_ROWS_SCHEMA, lambda path, length, file: [
        {"path": path, "length": length, "num_rows": file.metadata.num_rows}], tasks)


# What Spark reads unsigned integers as.
UNSIGNED = {"uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0)}


def _spark_types(file) -> dict[str, T.DataType]:
    """Top-level columns of a file with the types that Spark reads them as."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_type

    plain = {file.schema.column(i).path: file.schema.column(i).physical_type for i in range(len(file.schema))}
    out = {}
    for field in file.schema_arrow:
        kind = field.type.value_type if pa.types.is_dictionary(field.type) else field.type
        if plain.get(field.name) == "INT96":
            out[field.name] = T.TimestampType()
        elif str(kind) in UNSIGNED:
            out[field.name] = UNSIGNED[str(kind)]
        elif pa.types.is_fixed_size_binary(kind):
            out[field.name] = T.BinaryType()
        else:
            out[field.name] = from_arrow_type(kind, prefer_timestamp_ntz=True)
    return out


def file_types(spark: SparkSession, path_or_files) -> DataFrame:
    """Per-file columns with the Spark types (as JSON) that their footers stand for."""
    files, tasks = _files(spark, path_or_files)
    return _read(spark, files, TYPE_SCHEMA, lambda path, _, file: [
        {"file_path": path, "num_rows": file.metadata.num_rows, "ordinal": i, "column_name": name, "spark_type": kind.json()}
        for i, (name, kind) in enumerate(_spark_types(file).items(), start=1)], tasks)


def read_row_groups(spark: SparkSession, files: DataFrame, lanes: list[tuple[str, str]], schema: T.StructType) -> DataFrame:
    """Rows of Parquet files, read a row group at a time by tasks.  A lane is a column (its name in
    lower case) with a Spark type (JSON): it holds the values of the files whose column
    has that type, and NULL elsewhere.  ``schema`` has the lanes' types in their order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    s3, arrow = s3_options(spark), to_arrow_schema(schema)
    groups = _read(spark, files, T.StructType([T.StructField("path", T.StringType()), T.StructField("at", T.IntegerType())]),
                   lambda path, _, file: [{"path": path, "at": i} for i in range(file.metadata.num_row_groups)])

    def read(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("at").to_pylist()):
                with _open(path, s3) as f:
                    file = pq.ParquetFile(f)
                    kinds = {name.lower(): (name, kind.json()) for name, kind in _spark_types(file).items()}
                    for part in file.iter_batches(batch_size=10_000, row_groups=[at]):
                        columns = []
                        for (name, kind), field in zip(lanes, arrow):
                            have, of = kinds.get(name, (None, None))
                            if of != kind:
                                columns.append(pa.nulls(part.num_rows, field.type))
                                continue
                            values = part.column(have)
                            if pa.types.is_dictionary(values.type):
                                values = values.dictionary_decode()
                            if pa.types.is_timestamp(values.type) and values.type.tz is None and pa.types.is_timestamp(field.type) and field.type.tz:
                                values = values.cast(pa.timestamp("us")).cast(field.type)  # INT96 is an instant in UTC
                            columns.append(values.cast(field.type, safe=False) if values.type != field.type else values)
                        yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return groups.repartition(_tasks(spark)).mapInArrow(read, schema)
