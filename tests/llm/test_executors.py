"""What the executors hold when a stage of the pipeline begins."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark

SCRIPT = """
import json, re, sys
import pyarrow as pa
from pyspark.sql import SparkSession
import corpus_pipeline

conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "700m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.config(map=conf | {"spark.sql.warehouse.dir": sys.argv[1], "spark.checkpoint.dir": sys.argv[1]}).getOrCreate()

def seen(parts):
    import os, re
    for _ in parts:
        pid = os.getpid()
        while "CoarseGrainedExecutorBackend" not in open(f"/proc/{pid}/cmdline").read():
            pid = int(open(f"/proc/{pid}/stat").read().rsplit(")", 1)[1].split()[1])
        kb = re.search(r"Pss_Anon:\\s+(\\d+)", open(f"/proc/{pid}/smaps_rollup").read())[1]
        yield pa.RecordBatch.from_pydict({"pid": [pid], "mb": [int(kb) / 1024]})

def held():
    return {r.pid: r.mb for r in spark.range(0, 2, 1, 2).mapInArrow(seen, "pid long, mb double").collect()}

wide = spark.range(0, 2_000_000, 1, 8).selectExpr("id", "repeat(sha2(cast(id as string), 256), 3) as s")
wide.repartition(8, "s").sortWithinPartitions("s").write.format("noop").mode("overwrite").save()
before = held()
after = corpus_pipeline.bounded(lambda spark, docs, sf_dir: held())(spark, None, "")
print(json.dumps([before, after]))
spark.stop()
"""


def test_executors_give_back_their_heaps_before_a_stage(tmp_path):
    home = tmp_path / "home"  # the executors' logs go to work in Spark's home
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_LOCAL_DIRS": str(tmp_path), "SPARK_LOCAL_IP": "127.0.0.1"}
    env |= {"PYSPARK_PYTHON": sys.executable, "PYTHONPATH": f"{Path(__file__).parents[2]}:{os.environ.get('PYTHONPATH', '')}"}
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert run.returncode == 0, run.stderr[-2000:]
    before, after = json.loads(run.stdout.strip().splitlines()[-1])
    assert len(before) == 2 and before.keys() == after.keys()
    assert all(after[pid] < 0.75 * before[pid] for pid in before), (before, after)
