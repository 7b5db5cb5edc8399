"""Rounds of a competition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seniority of the rounds below a final.
SENIORITY = {"SF": 3, "Q": 2, "H": 1}


def round_seniority(race):
    """9 for a final (`F`, `F1`), 3, 2, 1 for codes that begin with SF, Q, H, else 0; case and outer blanks do not count."""
    code = F.upper(F.trim(F.coalesce(race, F.lit(""))))
    out = F.when(code.rlike(r"^F\d*$"), 9)
    for name, rank in SENIORITY.items():
        out = out.when(code.startswith(name), rank)
    return out.otherwise(0)


def classify_rounds(results: DataFrame, bucket: Sequence[str], race: str = "race") -> DataFrame:
    """Adds round_kind (final, before_final, other) and advanced (a non-final whose bucket holds a final).

    A bucket is an athlete's rows of one competition and discipline; a null competition is one of
    its own. One window serves both columns.
    """
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in bucket]
    w = Window.partitionBy(*keys)
    s = results.withColumn("_s", round_seniority(F.col(race)))
    s = s.withColumn("_top", F.max(F.when(F.col("_s") < 9, F.col("_s"))).over(w)).withColumn("_final", F.max(F.col("_s") == 9).over(w))
    kind = F.when(F.col("_s") == 9, "final").when((F.col("_s") > 0) & (F.col("_s") == F.col("_top")), "before_final").otherwise("other")
    return s.withColumn("round_kind", kind).withColumn("advanced", F.col("_final") & (F.col("_s") < 9)).drop("_s", "_top", "_final")
