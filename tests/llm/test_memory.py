import subprocess
import sys

from pyspark.sql import functions as F

from eventlake.llm import simhash
from eventlake.llm.memory import released
from eventlake.llm.tokens import default_path, tokenizer

SCRIPT = """
import re
from eventlake.llm.memory import released

def held():
    return int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def run(batches):
    for n in batches:
        words = [bytes(600) for _ in range(n)]
        yield words[::5000]

released(lambda batches: batches)([])  # imports
before, kept = held(), list(run([300_000]))
after = held()
kept += list(released(run)([300_000]))
print(after - before, held() - before)
"""


def test_workers_give_back_what_tasks_freed():
    plain, given_back = map(float, subprocess.run([sys.executable, "-c", SCRIPT], capture_output=True, text=True, check=True).stdout.split())
    assert plain > 150 and given_back < 40


def test_words_go_with_the_next_stage():
    words = tokenizer(default_path())
    assert list(released(iter, words=True)([1])) == [1] and tokenizer(default_path()) is words
    assert list(released(iter)([1])) == [1] and tokenizer.cache_info().currsize == 0


def test_joins_for_few_texts_shuffle_few(spark):
    """Texts that no mark names are not shuffled, where the marks are too many to broadcast."""
    rows = spark.range(20_000).select(F.xxhash64("id").alias("mark_"), F.col("id").cast("string").alias("text"))
    wanted = rows.where("text % 100 = 0").select("mark_")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = simhash._of_marks(rows.unionByName(rows), wanted)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted(int(r.text) for r in found.collect()) == list(range(0, 20_000, 100))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert 0 < plan.index("SortMergeJoin") < plan.index("Exchange hashpartitioning(mark_") < plan.index("BroadcastHashJoin") < plan.index("Union")
    ends = spark.createDataFrame([(-1,), (-(1 << 63),), ((1 << 63) - 1,), (0,), (63 << 18,)], "mark_ long")
    assert simhash._of_marks(ends, ends).count() == 5 and simhash._of_marks(ends, ends.limit(0)).count() == 0
