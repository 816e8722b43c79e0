"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default
8), BENCH_RUNS (warm runs per query, default 2), BENCH_QUERIES (names, comma
separated, or ``all``). Each query runs once cold, then the warm runs; its time
is the warm median. Every result is computed in full into a no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from furrow import fixtures as fx  # noqa: E402
from furrow.operators import transforms  # noqa: E402
from furrow.plans.queries import QUERIES  # noqa: E402
from furrow.session import build_session  # noqa: E402

HEADLINE = [
    "district_counts",
    "top_districts",
    "class_index",
    "sample_per_class",
    "wkt_bounds",
    "scene_search",
    "download_plan",
    "assign_best_scene",
    "assign_best_scene_windows",
    "assign_first_yielding",
    "fields_by_scene",
    "bounds_to_utm",
    "min_pixels_multires",
    "resize_bilinear",
    "multitemporal_stack",
    "series_to_grid",
    "band_stats",
    "train_transform",
    "split_assign",
    "batch_plan",
    "confusion_matrix",
    "ce_loss",
    "best_epoch",
    "early_stop",
]


def full_chips(spark, sf_dir: str):
    """Chips of the real size, 30 x 64 x 64; every tenth, as each is 1,920 times a small one."""
    return fx.full_chips(spark, sf_dir).where("chip_id % 10 = 0")


# Transforms at the size of real chips; the registered queries use small ones.
FULL_SIZE = {
    "val_transform_full": lambda spark, d: full_chips(spark, d).transform(transforms.val_transforms([0.5] * 30, [0.1] * 30)),
    "train_transform_full": lambda spark, d: full_chips(spark, d).transform(transforms.train_transforms([0.5] * 30, [0.1] * 30, 7)),
}
TABLES = ["region", "nation", "customer", "supplier", "orders", "events", "embeddings"]


def spread(spark, sf_dir: str, cpus: int) -> str:
    """Copy the tables to folders of one file per core: a single small file is
    one split, which no setting divides below a row group."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(cpus).write.parquet(f"{folder}/{name}.parquet")
    return folder


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    run = FULL_SIZE.get(name) or QUERIES[name]
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = [*QUERIES, *FULL_SIZE] if chosen == "all" else [n for n in chosen.split(",") if n] or [*HEADLINE, *FULL_SIZE]
    spark = build_session(f"local[{cpus}]", "bench", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    inputs = spread(spark, sf_dir, int(cpus))
    for name in names:
        cold[name] = round(timed(spark, name, inputs), 3)
        warm[name] = round(statistics.median(timed(spark, name, inputs) for _ in range(runs)), 3) if runs else cold[name]
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
