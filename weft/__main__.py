"""``python -m weft``: trains models on a learn set, or with a flag measures, compares or searches.

    -config FILE   key = value lines, over which the other flags lie
    -learn PATH -seed N -r GENERATIONS -out FOLDER -repeats RUNS
    -md FOLDER     measures every model of a folder on the learn set, into FOLDER/table
    -c FOLDER      compares them
    -predict FOLDER   searches sequences by all of them
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from weft import runs
from weft.sources import files

ACTIONS = ("-md", "-c", "-predict")


def main(argv: list[str], spark: SparkSession | None = None) -> DataFrame:
    """The result of the run that the arguments ask for; configuration keys are those of ``files.options``."""
    given = dict(zip(argv, argv[1:], strict=False))
    spark = spark or SparkSession.builder.getOrCreate()
    text = "\n".join(r.line for r in files.lines(spark, given["-config"]).orderBy("line_no").collect()) if "-config" in given else ""
    options = files.options(argv, files.parse_config(text))
    learn, out, metric = options["learn_data"], given.get("-out", "output"), options.get("fitness_alg", "RMSE")
    if "-md" in given:
        return runs.measure_dataset(spark, given["-md"], learn, f"{out}/table", metric)
    if "-c" in given:
        return runs.compare_models(spark, given["-c"], learn, metric)
    seed, rounds = int(options.get("seed", 1)), int(options.get("runs", 10))
    if "-predict" in given:
        return runs.predict(spark, given["-predict"], learn, iterations=rounds, seed=seed)
    return runs.train(spark, learn, out, rounds, seed=seed, repeats=int(given.get("-repeats", 1)), **runs.options(options))


if __name__ == "__main__":
    main(sys.argv[1:]).show(truncate=False)
