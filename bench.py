"""Times the headline queries; prints one JSON line.

The two redactions are run once on the smallest tables first, so that class loading is not part of
any time. Results are computed in full and thrown away.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from checks.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM_DIR = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")

HEADLINE = (
    "redacted_documents", "redacted_text", "resolved_document_spans", "email_spans", "phone_spans", "companies",
    "label_pairs", "dictionary", "dictionary_hits", "ordinals", "preview", "redacted_turns",
)


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE[:2]:
        run(spark, name, WARM_DIR)
    for name in HEADLINE:
        seconds[name] = round(run(spark, name, SF_DIR), 3)
    size = spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr(
        "count(*) AS docs", "sum(octet_length(text)) / 1e6 AS mb"
    ).first()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "redaction": {
                    "docs_per_sec": round(size["docs"] / seconds["redacted_documents"], 1),
                    "mb_per_sec": round(float(size["mb"]) / seconds["redacted_documents"], 2),
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
