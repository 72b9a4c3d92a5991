"""Every operator on workers that have no copy of the package: the code travels with the tasks."""

import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[2])
RUN = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def importable(batches):
    import importlib.util
    for b in batches:
        yield b.assign(id=int(importlib.util.find_spec("urbandemand") is not None))
assert spark.range(1).mapInPandas(importable, "id long").first().id == 0, "workers can import the package"
failed = []
for name, query in entry.queries().items():
    if name.startswith("op") or name in ("line_buffer", "drawn_shapes", "runway_features"):
        try:
            query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        except Exception as e:
            failed.append((name, str(e)[-300:]))
assert not failed, failed
"""


def test_workers_need_no_package(tmp_path):
    done = subprocess.run([sys.executable, "-c", RUN, ROOT], cwd=tmp_path, capture_output=True, text=True, timeout=900, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr[-1500:]
