"""Session helpers: cluster sizing, scratch locations, lineage cuts."""

from qualmark import session


def test_recommended_conf_scales_with_input():
    big = session.recommended_conf(100 << 40, 1000, 8)
    small = session.recommended_conf(1 << 20, 2, 4)
    assert int(big["spark.sql.shuffle.partitions"]) == 819200
    assert int(small["spark.sql.shuffle.partitions"]) == 16  # at least 2x the task slots
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_driver_memory_is_bounded():
    m = session._driver_memory(8)
    assert m.endswith("m") and 1024 <= int(m[:-1]) <= 8192


def test_scratch_under_checkpoint_dir_and_materialize(spark):
    base = session.ensure_checkpoint_dir(spark)
    p = session.scratch_path(spark, "t")
    assert p.startswith(base) and p != session.scratch_path(spark, "t")
    df = spark.range(5).withColumnRenamed("id", "item_id")
    m = session.materialize(df, "t")
    assert sorted(r.item_id for r in m.collect()) == [0, 1, 2, 3, 4]
    assert "Scan parquet" in m._jdf.queryExecution().executedPlan().toString()
    c = session.cut_lineage(df.filter("item_id > 2"))
    assert c.count() == 2


def test_python_stages_from_a_foreign_folder(tmp_path):
    """Workers get the package although neither their folder nor PYTHONPATH has it."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from qualmark.operators import completion
from qualmark.sources import standins
from qualmark.session import build_session
spark = build_session("local[2]", 2)
df = spark.sql("select 1L as item_id, array(named_struct('role', 'user', 'content', 'abc')) as messages")
print("GOT", completion.complete_batch(df, standins.length_rule_evaluator).first().response.split()[1])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "GOT 1" in out.stdout, out.stderr[-2000:]
