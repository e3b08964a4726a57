"""Hospital stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stay_length(stays: DataFrame, entry: str, discharge: str, stored: str, pattern: str = "dd/MM/yyyy") -> DataFrame:
    """Days between two day-first dates (``duree``) and whether they equal the stored length (``coherent``).

    Unreadable dates give a null length and an incoherent row.
    """
    days = F.datediff(F.try_to_date(F.col(discharge), pattern), F.try_to_date(F.col(entry), pattern)).cast("bigint")
    return stays.withColumn("duree", days).withColumn("coherent", F.coalesce(F.col("duree") == F.col(stored), F.lit(False)))
