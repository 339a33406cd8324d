"""What the operators share: tables written to the cluster's shared folder, and Arrow batches.

A lineage is cut by writing a Parquet table under ``spark.checkpoint.dir`` (any
executor can read it again, and it keeps its columns apart, so later scans prune).
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where it is unset (local tests), one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return _OWN[key]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder (or at path) and returns a scan of it."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session: they need not have it installed."""
    app, root = spark.sparkContext.applicationId, Path(__file__).resolve().parent.parent
    if app in _SHIPPED or not root.is_dir():
        return
    _SHIPPED.add(app)
    files = sorted(root.rglob("*.py"))
    mark = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:12]
    archive = Path(tempfile.mkdtemp(prefix="quillspark-")) / f"{root.name}-{mark}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def free(df: DataFrame, name: str) -> str:
    """name, or it with underscores, such that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch, size_column: str | None = None, most_rows: int = 512, most_bytes: int = 8 << 20):
    """Splits an Arrow record batch (or struct array) into zero-copy slices of bounded rows and text bytes.

    A row longer than most_bytes forms a slice of its own.
    """
    n = len(batch) if isinstance(batch, pa.Array) else batch.num_rows
    if not n:
        return
    if size_column is None:
        for i in range(0, n, most_rows):
            yield batch.slice(i, most_rows)
        return
    column = batch.field(size_column) if isinstance(batch, pa.Array) else batch.column(batch.schema.get_field_index(size_column))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    at, total = 0, 0
    for i, b in enumerate(sizes):
        if i > at and (total + b > most_bytes or i - at >= most_rows):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += b
    yield batch.slice(at, n - at)


def raw_texts(rows, name: str) -> list[bytes | None]:
    """The bytes of a string column; nothing is decoded, so odd bytes do no harm."""
    return pc.struct_field(rows, name).cast(pa.string()).view(pa.binary()).to_pylist()


def with_arrow_columns(df: DataFrame, fields: str, start, size_column: str | None = None, most_rows: int = 512, most_bytes: int = 8 << 20) -> DataFrame:
    """df with further columns that Python computes from Arrow slices of its rows.

    start() is called once a task and returns a function from a struct array of rows to
    arrays, one for each of fields ("name type, ..."). Columns of df that have the name
    of a new one are replaced, as withColumn does.
    """
    ship(df.sparkSession)
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    at = {c: f"c{i}" for i, c in enumerate(df.columns)}
    base = df.select(row.alias("r"))
    names = StructType.fromDDL(fields).names

    def run(batches):
        work = start()
        for batch in batches:
            rows = batch.column(0)
            for part in slices(rows, at.get(size_column), most_rows, most_bytes):
                named = pa.StructArray.from_arrays([pc.struct_field(part, v) for v in at.values()], names=list(at))
                yield pa.RecordBatch.from_arrays([part, *work(named)], names=["r", *[f"n{i}" for i in range(len(names))]])

    schema = StructType([base.schema[0], *[StructField(f"n{i}", f.dataType) for i, f in enumerate(StructType.fromDDL(fields))]])
    out = base.mapInArrow(run, schema)
    kept = [F.col("r").getField(at[c]).alias(c) for c in df.columns if c not in names]
    return out.select(*kept, *[F.col(f"n{i}").alias(c) for i, c in enumerate(names)])
