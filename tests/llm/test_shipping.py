"""Workers without a copy of the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from tessarine.llm import decontaminate, hmm
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i")], "doc_id long, text string")
bench = spark.createDataFrame([(7, "b c d e f")], "item_id long, text string")
assert [len(r.matches) for r in decontaminate.matches(docs, bench).orderBy("doc_id").collect()] == [1, 0]
assert hmm.train_and_score(docs, ["doc_id"], own=4, shared=2, states=2, max_iterations=2).count() == 2
print("shipped")
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert done.stdout.split()[-1:] == ["shipped"], done.stderr[-2000:]
