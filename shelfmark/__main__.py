"""``python -m shelfmark monitor|dedup|tag FOLDER [--mode init|increment]``: one run over the stores of a folder."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from shelfmark.plans import pipelines
from shelfmark.session import builder


def main() -> None:
    a = argparse.ArgumentParser(prog="shelfmark")
    a.add_argument("pipeline", choices=("monitor", "dedup", "tag"))
    a.add_argument("folder")
    a.add_argument("--mode", choices=(pipelines.INITIAL, pipelines.INCREMENTAL), default=pipelines.INITIAL)
    said = a.parse_args()
    stores, now = pipelines.Stores(builder().getOrCreate(), said.folder), F.current_timestamp().cast("timestamp_ntz")
    if said.pipeline == "monitor":
        pipelines.monitor_run(stores, now).groupBy("status", "is_hidden").agg(F.count(F.lit(1)).alias("sites"), F.sum("link_num").alias("probes")).show()
    elif said.pipeline == "dedup":
        pipelines.dedup_run(stores).agg(F.count(F.lit(1)).alias("records"), F.countDistinct("canonical_id").alias("datasets")).show()
    else:
        pipelines.tag_run(stores, said.mode, now).agg(F.count(F.lit(1)).alias("records"), F.count_if(F.size("tags") > 0).alias("tagged")).show()


if __name__ == "__main__":
    main()
