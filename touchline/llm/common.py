"""What the operators of this folder share: tables, words and stored intermediates."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from touchline.session import shared_dir

# Fixed value: a word is a run of characters outside these six (space, tab to carriage return).
WORD_BREAK = r"[\x20\x09-\x0D]+"
CHUNK_CHARS, CHUNK_ROWS = 2_000_000, 1000  # of a batch, handled together


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The frame as a table in the cluster's shared folder: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/touchline-llm-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a `stored` frame that nothing reads any more."""
    spark = df.sparkSession
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        if folder.rpartition("/")[2].startswith("touchline-llm-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of finished steps now. Its cleaner waits for the
    driver's garbage collection, which may not come while a long job fills the disks."""
    df.sparkSession.sparkContext._jvm.System.gc()


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text: other columns, whatever their names, are left out."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Keys and whole texts (null: empty), about two million characters at a time."""
    for batch in batches:
        keys, column = batch.column(0), batch.column(1)
        start, held = 0, 0
        lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        for end, n in enumerate(lengths, 1):
            held += n
            if held >= CHUNK_CHARS or end - start >= CHUNK_ROWS or end == len(lengths):
                texts = column.slice(start, end - start).to_pylist()
                yield keys.slice(start, end - start).to_pylist(), [t or "" for t in texts]
                start, held = end, 0


def map_chunks(
    df: DataFrame, make: Callable[[], Callable[[list, list[str]], dict]], schema: str
) -> DataFrame:
    """Apply `make()(ids, texts) -> columns` to (id, text) rows, in Arrow batches.

    `make` runs once per task, so that what it loads is loaded where it is used.
    """
    target = df.sparkSession.createDataFrame([], schema).schema
    fields = target.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        work = make()
        for ids, texts in chunks(batches):
            columns = work(ids, texts)
            arrays = [pa.array(columns[f], type=arrow.field(f).type) for f in fields]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, target)
