"""Print the formatted physical plan of catalog queries.

Usage: python tools/show_plans.py SF_DIR [name ...]   (default: the bench headline set)
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from evalspark.plans import catalog  # noqa: E402
from evalspark.session import build_session  # noqa: E402

STREAMING = {"stream_stop_function", "stream_stop_signature", "stream_stop_chat", "stream_stop_marker",
             "stream_collect_partials"}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or [n for n in HEADLINE if n not in STREAMING]
    spark = build_session("local[8]", 16)
    for name in names:
        print(f"===== {name} =====")
        catalog.QUERIES[name](spark, sf).explain("formatted")


if __name__ == "__main__":
    main()
