"""python -m kvlake --base_dir DIR get KEY | set KEY VALUE | delete KEY | loaddata | bench | flush | compact | clean | verify | printdescriptor"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import workload
from .plans.engine import Engine, InvalidArgument, NotFound


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kvlake")
    top.add_argument("--base_dir", required=True, help="the store's folder, on any file system that Spark reads")
    commands = top.add_subparsers(dest="command", required=True)
    for name, names in {"get": ["key"], "set": ["key", "value"], "delete": ["key"], "flush": [], "compact": [], "clean": [], "verify": [], "printdescriptor": []}.items():
        c = commands.add_parser(name)
        for n in names:
            c.add_argument(n)
    load = commands.add_parser("loaddata")
    for name, value in {"--n": 1000, "--key_size": 10, "--value_size": 800, "--seed": 1}.items():
        load.add_argument(name, type=int, default=value)
    bench = commands.add_parser("bench", help="looks up keys of the store, one lookup after the other")
    bench.add_argument("--requests", type=int, default=100)
    bench.add_argument("--interval_us", type=int, default=1_000_000, help="the interval that latencies are corrected by")
    return top


def bench(db: Engine, requests: int, interval: int) -> None:
    """Lookups through the public get, timed; the figures of their latencies."""
    asked = workload.paced_requests(db.view(), requests, 10.0, 1).orderBy("at_us").select("key")
    samples, began = [], time.time()
    for row in asked.toLocalIterator():
        at, bad = time.time_ns(), False
        try:
            db.get(row["key"])
        except (InvalidArgument, NotFound):
            bad = True
        samples.append((int(time.time_ns() - at) // 1000, bad))
    took = time.time() - began
    taken = workload.corrected(db.spark.createDataFrame(samples, "latency_us long, error boolean"), interval)
    for frame in (workload.count_and_rate(taken, max(took, 1e-6)), workload.quantiles(taken)):
        frame.show(truncate=False)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("kvlake").getOrCreate()
    db = Engine(spark, a.base_dir)
    try:
        if a.command == "get":
            ts, value = db.get(a.key)
            print(ts, value.decode("utf-8", "backslashreplace"))
        elif a.command == "set":
            print(db.set(a.key, a.value.encode()))
        elif a.command == "delete":
            print(db.delete(a.key))
        elif a.command == "loaddata":
            print(db.load_data(a.n, a.key_size, a.value_size, a.seed))
        elif a.command == "bench":
            bench(db, a.requests, a.interval_us)
        elif a.command == "printdescriptor":
            db.manifest.rows(spark).orderBy("place").show(1000, truncate=False)
        elif a.command == "verify":
            db.verify().orderBy(F.desc("start_seq")).show(1000, truncate=False)
        else:
            print({"flush": lambda: db.flush(force=True), "compact": lambda: db.compact(force=True), "clean": db.clean}[a.command]())
    except (InvalidArgument, NotFound) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
