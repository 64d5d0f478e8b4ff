"""Run one query on a folder and show its time, size and first rows: python -m tests.llm.try_query NAME FOLDER."""

import sys
import time

from pyspark.sql import SparkSession

from growthpanel.llm.queries import QUERIES

if __name__ == "__main__":
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "12")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for folder in sys.argv[2:]:
        for _ in range(2):
            began = time.time()
            rows = QUERIES[sys.argv[1]](spark, folder).toPandas()
            print(folder, len(rows), f"{time.time() - began:.1f}s")
        print(rows.head(8).to_string())
