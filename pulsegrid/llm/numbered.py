"""Documents with a number for each row, dealt out by it once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared_files import new_folder
from pulsegrid.session import shuffles_freed, track


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``, stored as a table bucketed by it in the shared folder.

    The numbers stay when a task runs again, rise in the order of the input,
    and joins on ``__row`` move the other side only: texts are shuffled once.
    """
    spark = docs.sparkSession
    name, folder = f"numbered_{uuid.uuid4().hex}", new_folder(spark, "numbered")
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.withColumn("__row", F.monotonically_increasing_id()).repartition(buckets, "__row")
    with shuffles_freed(spark):
        rows.write.format("parquet").bucketBy(buckets, "__row").option("path", folder).saveAsTable(name)
    track(folder)
    return spark.table(name)
