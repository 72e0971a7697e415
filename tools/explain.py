"""Print the formatted physical plan of registered queries.

    python tools/explain.py [sf_dir] name [name ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from codeloom.plans.registry import load_all  # noqa: E402
from codeloom.session import local_session  # noqa: E402


def main(argv):
    sf_dir, names = argv[1], argv[2:]
    spark = local_session(8)
    reg = load_all()
    for name in names:
        print(f"==== {name}")
        reg[name].run(spark, sf_dir).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
