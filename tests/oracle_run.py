"""Compare named (or all) queries with DuckDB: python -m tests.oracle_run [FOLDER] [NAME...]"""

import sys
import time
import traceback

from pyspark.sql import SparkSession

import __spark_entry__ as entry
from tests.oracle import run_sql, same_kind

if __name__ == "__main__":
    folder, names = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = []
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sql:
                same_kind(df, *run_sql(sql[name], folder))
                said = "ok"
            else:
                said = f"{df.count()} rows"
        except BaseException as e:
            bad.append(name)
            said = "BAD " + ("".join(traceback.format_exception_only(e)))[:700]
        print(f"{name} {time.time() - start:.1f}s {said}", flush=True)
    print("bad:", bad)
