"""Label import as a stream: each batch of new listings is merged into the label table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import pricing

#: Columns of incoming listing files, all as text.
COLUMNS = ("listing_id", "source", "source_url", "observed_at", "city", "province", "property_type", "latitude", "longitude", "price_php", "lot_area_sqm", "price_per_sqm_php")


def listing_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New CSV files of a folder, as text columns."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
    return spark.readStream.schema(schema).option("header", True).csv(folder)


def _tables(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    done = [str(s.getPath().getParent()) for s in (fs.globStatus(path(f"{root}/batch=*/_SUCCESS")) or [])]
    return sorted((int(p.rsplit("=", 1)[1]), p) for p in done)


def current(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The label table after the last whole batch (before the given one)."""
    found = [p for n, p in _tables(spark, root) if before is None or n < before]
    return spark.read.parquet(found[-1]) if found else None


def import_labels(stream: DataFrame, root: str, checkpoint: str, model: dict) -> StreamingQuery:
    """Merges each batch with the table so far and writes the next version. A batch that
    runs again after a failure starts from the version before it, so it counts once."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = current(spark, root, number)
        new = pricing.imported(old, batch, model) if old is not None else pricing.normalize_listings(batch, model)
        new.drop("city_group").write.mode("overwrite").parquet(f"{root}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
