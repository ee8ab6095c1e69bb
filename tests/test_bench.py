import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2",
               BENCH_REPEATS="1", BENCH_QUERIES="word_count")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env,
                         capture_output=True, text=True, timeout=600, check=True).stdout
    lines = [l for l in out.splitlines() if l.strip()]
    assert len(lines) == 1
    res = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= res.keys()
    assert res["unit"] == "sec" and res["sf"] == "0.001" and set(res["queries"]) == {"word_count"}
