import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_workers_find_the_package_from_any_folder(tmp_path):
    """A driver in another folder, whose workers inherit no path to the package."""
    code = f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession, functions as F
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        from strandline.functions.text import format_property
        from strandline.ship import ship
        from concurrent.futures import ThreadPoolExecutor
        with ThreadPoolExecutor(4) as pool:
            list(pool.map(ship, [spark] * 8))
        print(spark.range(1).select(format_property(F.lit(0.25)).alias("x")).first().x)
        spark.stop()
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("0.2"), out.stderr[-2000:]
