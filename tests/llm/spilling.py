"""Run by test_training_order.py in a process of its own, as a sort's spilling is set when Spark starts: prints how many slots differ from the key's."""

import sys

from pyspark.sql import SparkSession

from tests.llm.test_training_order import expected_slots
from tidebar.llm import training_order as O

if __name__ == "__main__":
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "2").config("spark.shuffle.spill.numElementsForceSpillThreshold", sys.argv[1]).getOrCreate()
    rows = [(i, bytes([i % 251]) * (1 + i % 700)) for i in range(12_000)]
    made = O.materialise(spark.createDataFrame(rows, "doc_id long, ids binary").coalesce(1), key=77, length=64, width=1, records=20_000)
    got = {r.slot: (r.doc_id, r.place) for r in made.read().select("slot", "doc_id", "place").collect()}
    expected = expected_slots(rows, made.n, 77, 64)
    print("wrong slots:", sum(got.get(s) != x for s, x in expected.items()) + abs(len(got) - len(expected)))
    spark.stop()
