"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a01_swap_summary",
    "a02_day_summary",
    "a03_daily_by_venue",
    "a05_routes",
    "a06_account_rollup",
    "a08_account_flows",
    "a09_counterparties",
    "a11_corridors",
    "a18_address_profiles",
    "a22_capital_by_venue",
    "a24_holder_decomposition",
    "a27_day_with_dust",
    "a30_object_rollups",
    "a38_window_summary",
    "a41_daily_activity",
    "g01_dense_daily_by_venue",
    "j03_described_legs",
    "j04_priced_by_location",
    "p01_routed_trades",
    "p05_decoded_transfers",
    "q01_derived_rates",
    "q05_flagged_rows",
    "q07_hub_prices",
    "q11_pool_checks",
    "r01_settled_days",
    "s06_idempotent_facts",
    "t03_top_accounts_per_day",
    "w03_rate_board",
    "w05_zero_after_dropout",
    "w10_adjacent_runs",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from ledgerloom import plans
    from ledgerloom.plans import registry
    from ledgerloom.session import build_session, clear_run

    plans.load()
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.checkpoint.dir": os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="bench-"), "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = list(registry.QUERIES) if sys.argv[1:] == ["all"] else (sys.argv[1:] or HEADLINE)
    # The first scan pays for class loading and code generation; it is not a query.
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    clear_run(spark)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
