import os
import subprocess
import sys

#: On executors of their own: their memory after a large sort, and after a stage of the pipeline on a few rows.
SCRIPT = """
import sys, tempfile
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
import corpus_pipeline

tmp = sys.argv[1]
spark = (
    SparkSession.builder.master("local-cluster[2,1,900]")
    .config("spark.executor.memory", "900m")
    .config("spark.sql.shuffle.partitions", "4")
    .config("spark.ui.enabled", "false")
    .config("spark.local.dir", f"{tmp}/local")
    .config("spark.checkpoint.dir", f"file://{tmp}/shared")
    .getOrCreate()
)

def memory(batches):
    for b in batches:
        parent = lambda pid: int(open(f"/proc/{pid}/stat").read().rsplit(")", 1)[1].split()[1])
        pid = "self"
        while "CoarseGrainedExecutorBackend" not in open(f"/proc/{pid}/cmdline").read():
            pid = parent(pid)
        mb = int(open(f"/proc/{pid}/statm").read().split()[1]) * 4096 >> 20
        yield pa.RecordBatch.from_arrays([pa.array([int(pid)], pa.int64()), pa.array([mb], pa.int64())], names=["pid", "mb"])

def most():
    return max(r.mb for r in spark.range(0, 8, 1, 8).mapInArrow(memory, "pid long, mb long").collect())

spark.createDataFrame([(0, "one two three four five six seven eight")], "item_id long, text string").write.parquet(f"{tmp}/in/benchmark.parquet")
docs = spark.createDataFrame([(0, "a b c", None, None, 5)], "doc_id long, text string, lang string, source string, n_chars long")
spark.range(0, 6_000_000, 1, 8).withColumn("k", F.xxhash64("id")).groupBy("k").count().orderBy("k").write.format("noop").mode("overwrite").save()
before = most()
rows = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, f"{tmp}/in").count()
print("found", rows, before, most())
spark.stop()
"""


def test_a_stage_begins_with_the_executors_memory_given_back(tmp_path):
    script = tmp_path / "script.py"
    script.write_text(SCRIPT)
    out = subprocess.run([sys.executable, script, str(tmp_path)], capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_PYTHON": sys.executable}).stdout
    rows, before, after = map(int, out.split("found ")[1].split())
    assert rows == 1
    assert after < before - 150
