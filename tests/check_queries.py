"""python -m tests.check_queries [module] [sf]: every query of a plan module against its SQL."""

import importlib
import sys
import time
import traceback

from strandline.plans import registry
from strandline.session import local_session
from tests.oracle import compare, connection

if __name__ == "__main__":
    for name in sys.argv[1].split(","):
        importlib.import_module(f"strandline.plans.{name}")
    sf = f"/root/testdata/{sys.argv[2] if len(sys.argv) > 2 else 'sf0.001'}"
    only = sys.argv[3:]
    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(sf)
    for name, function in registry.QUERIES.items():
        if only and name not in only:
            continue
        began = time.time()
        try:
            frame = function(spark, sf)
            said = compare(frame, con, registry.ORACLES[name]) if name in registry.ORACLES else f"no SQL; {frame.count()} rows"
        except Exception as e:
            said = f"ERROR {str(e)[:700]}" if "-v" not in only else traceback.format_exc()
        print(f"{name}: {said or 'ok'} ({time.time() - began:.1f} s)", flush=True)
