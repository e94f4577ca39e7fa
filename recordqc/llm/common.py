"""What the operators of this subpackage share: stored tables, word counts, null-safe keys."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+`` as a Java character class.
SPACE = r"[ \t\n\x0B\f\r]+"
WORD = r"[^ \t\n\x0B\f\r]+"
_OWN: dict[str, str] = {}
#: Folders of stored tables, in the order of their making.
STORED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where it is unset on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="llm-")
    return _OWN[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: survives lost executors, is computed once."""
    path = fresh_path(df.sparkSession, label)
    STORED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stored tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Jobs that run inside send at most ``rows`` rows to Python at once; the session's own setting returns after them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(own)) if int(own) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(*cols: Column) -> Column:
    """A number in (0, 1) that the values decide."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) * F.lit(2.0 ** -53)


def key_of(*cols: Column) -> Column:
    """One non-null string for a tuple of strings; null and every string stay apart."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cols]
    return F.concat_ws(",", *parts)


def slices(batch, most: int):
    """Parts of a batch with at most ``most`` bytes of ``text`` each; a longer text is a part of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def map_batches(df: DataFrame, made, fields, keep: list[str], most: int | None = None) -> DataFrame:
    """``keep`` columns of ``df`` beside what ``made(batch)`` returns, a list of values for each of ``fields``.

    ``fields`` are (name, Spark type) pairs. Only the columns of ``df`` travel to Python, only ``keep`` travel back.
    With ``most``, ``made`` is given parts of a batch with so many bytes of ``text`` at most.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType

    schema = StructType([df.schema[c] for c in keep] + [StructField(n, t) for n, t in fields])
    kinds = [to_arrow_type(t) for _, t in fields]

    def run(batches):
        for b in (part for whole in batches for part in (slices(whole, most) if most else [whole])):
            if b.num_rows:
                columns = [b.column(b.schema.get_field_index(c)) for c in keep]
                columns += [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(made(b), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *[n for n, _ in fields]])

    return df.mapInArrow(run, schema)


def texts_of(batch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]
