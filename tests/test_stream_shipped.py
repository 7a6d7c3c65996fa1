import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
RUN = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.addPyFile(sys.argv[1])
from seatflow.catalog.streams import QUERIES
print(sorted(tuple(r) for r in QUERIES["stream_latest"](spark, sys.argv[2]).collect()))
"""


def test_latest_where_only_tasks_have_the_package(spark, tmp_path):
    """The package comes as a zip for the tasks; numbers of 60 bits and NULLs come back as they were."""
    big = 2**60 + 1
    data = [(big + i, i % 3, "view", f"2024-01-{i + 1:02} 12:00:00", None if i == 8 else i / 2) for i in range(9)]
    events = spark.createDataFrame(data, "event_id long, user_id long, event_type string, ts string, value double")
    events.withColumn("ts", events.ts.cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    package = shutil.make_archive(str(tmp_path / "package"), "zip", REPO, "seatflow")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith(("PYSPARK", "SPARK"))}
    ran = subprocess.run(
        ["timeout", "300", sys.executable, "-c", RUN, package, str(tmp_path)], cwd=tmp_path, env=env,
        capture_output=True, text=True, check=False,
    )
    want = [
        (i % 3, "view", f"2024-01-{i + 1:02}", f"2024-01-{i + 1:02}T12:00:00.000000", big + i, None if i == 8 else i / 2)
        for i in (6, 7, 8)
    ]
    assert str(want) in ran.stdout, ran.stderr[-3000:]
