"""The package reaches Python workers from any working folder."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

from tickloom.session import remove_written, written

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from tickloom.operators import indicators as I
from tickloom.session import local_session
sys.path.remove({root!r})
spark = local_session(1, 1)
bars = spark.range(40).selectExpr("'A' AS symbol", "timestamp_seconds(id * 3600) AS time", "CAST(id AS DOUBLE) AS close")
print("rows", I.rsi(bars).filter("RSI_14 = 100").count())
"""


def test_workers_find_the_package_from_another_folder(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 26" in run.stdout, run.stderr[-2000:]


UNSET = """
import sys
sys.path.insert(0, {root!r})
from tickloom.session import local_session, shared_folder, written
spark = local_session(1, 1)
assert spark.conf.get("spark.checkpoint.dir", None) is None
print("rows", written(spark.range(7).toDF("id"), "numbers").count(), shared_folder(spark).startswith("file:/"))
"""


def test_local_mode_works_without_the_setting(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", UNSET.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 7 True" in run.stdout, run.stderr[-2000:]


def test_written_tables_can_be_removed(spark):
    remove_written(spark)
    table = written(spark.range(5).toDF("id"), "numbers")
    assert table.count() == 5
    (file,) = {f.rsplit("/", 1)[0].removeprefix("file://") for f in table.inputFiles()}
    assert os.path.isdir(file)
    assert remove_written(spark) == 1 and not os.path.exists(file)
