"""The package reaches workers that have no copy of it."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_workers_elsewhere_can_import_the_package(tmp_path):
    code = f"""
        import sys
        sys.path.insert(0, {str(ROOT)!r})
        from popquilt.operators import geometry as G, spatial_join
        from popquilt.session import session
        s = session("elsewhere", "local[1]", spark_ui_enabled="false", spark_sql_shuffle_partitions="1")
        shape = G.with_bounds(s.createDataFrame([(1, bytearray(G.write_wkb(G.box(0, 0, 2, 2))))], "shape_id int, geometry binary"))
        points = s.createDataFrame([(1.0, 1.0, 5.0), (3.0, 1.0, 7.0)], "x double, y double, value double")
        print("sum", spatial_join.zonal_sum(points, shape, 1.0, ["shape_id"]).first()["value"])
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "sum 5.0" in run.stdout, run.stderr[-2000:]
