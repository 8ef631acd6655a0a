"""A session whose Spark defaults name no shared folder."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
from postmill.session import build_session, local_scratch, shared_dir, stage
spark = build_session("bare", **{"spark.master": "local[1]", "spark.ui.enabled": "false"})
assert not spark.conf.get("spark.checkpoint.dir", None)
folder = shared_dir(local_scratch(spark))
assert folder == shared_dir(local_scratch(spark))
assert stage(spark.range(3), "rows").count() == 3
"""


def test_scratch_folder_without_defaults():
    environment = {**os.environ, "SPARK_CONF_DIR": tempfile.mkdtemp(prefix="spark-"), "PYTHONPATH": ROOT}
    subprocess.run([sys.executable, "-c", SCRIPT], env=environment, check=True, timeout=120)
