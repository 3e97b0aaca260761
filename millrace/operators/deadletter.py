"""Dead letters: a table of the skipped rows beside the written ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.sequence import numbered


def dead_letters(skipped: DataFrame, job: str, step: str, item: list[str], item_type: str = "Row", skipped_before: int = 0) -> DataFrame:
    """One entry for each skipped row (``_seq``, ``_err`` and item columns), numbered in order of reading."""
    rows = numbered(skipped, ["_seq"], "__n")
    json = F.to_json(F.struct(*item), {"ignoreNullFields": "false"}) if item else F.lit(None).cast("string")
    json = F.coalesce(F.col("_item"), json) if "_item" in skipped.columns else json
    err = F.col("_err")
    return rows.select(
        F.lit(job).alias("job_name"), F.lit(step).alias("step_name"), F.coalesce(json, F.lit('{"SerializationError":"null"}')).alias("item_json"), F.lit(item_type).alias("item_type_name"), F.get(err["types"], F.lit(0)).alias("exception_type"),
        F.coalesce(err["message"], F.lit("")).alias("exception_message"), err["stack"].alias("stack_trace"), (F.col("__n") + skipped_before).alias("skip_count_at_time"), F.current_timestamp().alias("occurred_at"), F.col("_seq"),
    )
