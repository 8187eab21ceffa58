"""Writers: one file or folder for each key, whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_texts(rows: DataFrame, path: str, key: str, text: str, mode: str = "overwrite") -> None:
    """A text file below `key=<value>` for each row; Spark's committer renames finished files only."""
    rows.select(key, text).repartition(key).write.mode(mode).partitionBy(key).option("lineSep", "\n").text(path)


def write_state(state: DataFrame, path: str) -> None:
    state.write.mode("overwrite").parquet(path)


def progress_event(job: Column, percent: Column, step: Column, detail: Column, at: Column) -> Column:
    return F.struct(job.alias("job"), F.greatest(F.lit(0), F.least(F.lit(100), percent)).alias("progress"), step.alias("current_step"), detail.alias("detail"), at.alias("ts"))


def zipped(rows: DataFrame, key: str, name: str, text: str) -> DataFrame:
    """key, content: a ZIP archive of each key's texts, in the order of their names and the same bytes in every run."""
    import io
    import zipfile
    from collections.abc import Iterator

    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for files in batch.column(1).to_pylist():
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                    for f in files:
                        z.writestr(zipfile.ZipInfo(f["name"]), f["text"])
                out.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "content"])

    files = F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text"))))
    g = rows.groupBy(key).agg(files.alias("files"))
    return g.mapInArrow(work, StructType([rows.schema[key]]).add("content", "binary"))


def split_results(rows: DataFrame, path: str, error: str = "error") -> None:
    """Results and errors in folders of their own."""
    rows.where(F.col(error).isNull()).drop(error).write.mode("append").parquet(f"{path}/results")
    rows.where(F.col(error).isNotNull()).write.mode("append").parquet(f"{path}/errors")
