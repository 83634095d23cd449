"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of one Arrow batch that goes to a Python worker, so that very long texts can't add up.
BATCH_BYTES = 4 << 20
LOCAL: dict[str, str] = {}  # folder by application in local mode


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (unset, in local mode) one of this machine's own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in LOCAL:
        LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="sievemark-")
    return LOCAL[context.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a table in the shared folder: it cuts lineage and outlives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more.

    What made them is garbage then too: collecting it lets Spark's cleaner remove the shuffle files of those jobs.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for df in tables:
        for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = hadoop.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, id and text, whatever else df holds; a null text is empty."""
    return df.select(df[id_col].cast("long").alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))


def texts(batch: pa.RecordBatch) -> tuple[list, list[bytes]]:
    """Ids and UTF-8 texts of a batch of id_and_text()."""
    return batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()


def map_texts(df: DataFrame, rows: Callable[[list, list[bytes]], dict[str, list]], schema: str) -> DataFrame:
    """rows() over Arrow batches of id_and_text() rows; it gets ids and UTF-8 texts and returns columns by name."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    fields = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(rows(*texts(batch)), schema=fields)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))


def fold_of(doc_id, folds: int):
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn, per_class, extra: str | None = None, most_chars: int | None = None) -> DataFrame:
    """(id, text, y, lang) of at most per_class (one bound, or one for each of 0 and 1) labelled documents of each class.

    Those of lowest hashed id are taken; of an id that documents has repeatedly, the least text. Texts of over most_chars
    characters aren't learned from.
    `learn` is a condition on labels.doc_id. The ids are bounded by 2 * per_class, so they are broadcast; texts stay
    in Spark. A document with several labels counts with the highest. `extra` names the column that becomes lang.
    """
    held = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    held = held.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    bounds = (per_class, per_class) if isinstance(per_class, int) else per_class
    some = [held.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(bounds[y]) for y in (0, 1)]
    lang = docs[extra].cast("string") if extra else F.lit(None).cast("string")
    body = docs.select(docs["doc_id"].cast("long").alias("id"), F.coalesce(docs["text"], F.lit("")).alias("text"), lang.alias("lang"))
    if most_chars is not None:
        body = body.filter(F.length("text") <= most_chars)
    rows = body.join(F.broadcast(some[0].union(some[1])), "id")
    return rows.groupBy("id").agg(F.min(F.struct("text", "y", "lang")).alias("r")).select("id", "r.text", "r.y", "r.lang")
