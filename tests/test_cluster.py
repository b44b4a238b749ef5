"""A standalone master and two workers, as processes of their own: the package reaches the executors."""

import os
import re
import socket
import subprocess
import sys
import time
from pathlib import Path

import pyspark

HOME = os.path.dirname(pyspark.__file__)
ROOT = Path(__file__).resolve().parent.parent

JOB = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master({master!r}).config("spark.ui.enabled", "false").config("spark.executor.memory", "600m").config("spark.cores.max", "2")
         .config("spark.checkpoint.dir", {folder!r}).config("spark.sql.shuffle.partitions", "4").config("spark.driver.host", "127.0.0.1").getOrCreate())
import __spark_entry__ as e
for name in {names!r}:
    print("ROWS", name, e.queries()[name](spark, {data!r}).count(), flush=True)
spark.stop()
"""


def _free_port() -> int:
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def test_standalone_master(tmp_path, data):
    port = _free_port()
    master = f"spark://127.0.0.1:{port}"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_LOCAL_IP": "127.0.0.1", "SPARK_HOME": HOME, "PYSPARK_PYTHON": sys.executable}
    start = [f"{HOME}/bin/spark-class", "org.apache.spark.deploy"]
    run = lambda *a: subprocess.Popen([start[0], f"{start[1]}.{a[0]}", *a[1:]], cwd=tmp_path, env=env, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    held = [run("master.Master", "--host", "127.0.0.1", "--port", str(port), "--webui-port", str(_free_port()))]
    try:
        time.sleep(4)
        held += [run("worker.Worker", "-c", "1", "-m", "1g", "-d", str(tmp_path / f"w{i}"), "--webui-port", str(_free_port()), master) for i in range(2)]
        names = ["p1_found", "p4_found"]
        job = JOB.format(root=str(ROOT), master=master, folder=f"file://{tmp_path}/shared", names=names, data=data)
        got = subprocess.run([sys.executable, "-c", job], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
        rows = dict(re.findall(r"ROWS (\w+) (\d+)", got.stdout))
        assert set(rows) == set(names), got.stderr[-3000:]
        assert all(int(n) > 0 for n in rows.values())
        assert not list((tmp_path / "shared").glob("*package*"))
    finally:
        for p in reversed(held):
            p.terminate()
            p.wait(20)
