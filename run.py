"""python run.py --config FILE [--summarize ROOT]: runs an experiment, or summarises finished ones."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--config")
    p.add_argument("--summarize")
    a = p.parse_args()
    spark = SparkSession.builder.appName("patchwarden").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    if a.config:
        from patchwarden.plans import config, experiment

        with open(a.config) as f:
            text = f.read()
        experiment.run_experiment(spark, config.parse(text), text)
    if a.summarize:
        from patchwarden.sources import runs

        table = runs.summarize(spark, a.summarize)
        runs.write_csv(table, f"{a.summarize}/summary_table.csv")
        runs.write_text(f"{a.summarize}/summary.md", runs.markdown_report(table, runs.METRICS))


if __name__ == "__main__":
    main()
