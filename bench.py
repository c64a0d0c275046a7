"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from caselens import registry  # noqa: E402
from caselens.session import build, release  # noqa: E402

QUERIES = (
    "signal_matrix",
    "ebgm_scores",
    "pair_counts",
    "quarterly_trend",
    "emerging_signals",
    "subgroup_signals",
    "interaction_signals",
    "drug_facets",
    "stratified_sample",
    "signals_page",
    "label_match",
    "literature_support",
    "survey_profile",
    "json_props_matrix",
    "ascii_ingest_roundtrip",
)


def main() -> None:
    """queries: one application's queries in turn; the first that needs the case tables and the
    matrix writes them within its own time. queries_alone: each with nothing kept from another."""
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(name: str) -> float:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    seconds("drug_marginals")  # starts the engine
    release(spark)  # what it kept is not given to the queries
    took = {name: seconds(name) for name in QUERIES}
    alone = {}
    for name in QUERIES:
        release(spark)
        alone[name] = seconds(name)
    total = {"metric": "total wall time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}
    print(json.dumps(total | {"value_alone": round(sum(alone.values()), 3), "queries_alone": alone}))
    spark.stop()


if __name__ == "__main__":
    main()
