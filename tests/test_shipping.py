"""The package reaches executors that do not have it on their path."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {repo!r})
from tallyscope.session import local_session, ship_package
spark = local_session(2)
ship_package(spark)
ship_package(spark)
def run(batches):
    from tallyscope.functions.special import chi2_sf
    for b in batches:
        yield b.assign(id=b.id + int(chi2_sf(0.0, 2)))
print("sum", spark.range(3).mapInPandas(run, "id bigint").groupBy().sum("id").first()[0])
"""


def test_package_is_shipped(tmp_path):
    repo = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "sum 6" in out.stdout, out.stderr[-2000:]
