"""``python -m rillstone JOB --option value ...``: runs a job and prints its summary."""

from __future__ import annotations

import argparse
import inspect
import sys

from rillstone.jobs import JOBS, summary_line
from rillstone.runtime import session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rillstone")
    sub = parser.add_subparsers(dest="job", required=True)
    for name, job in JOBS.items():
        p = sub.add_parser(name, help=(job.__doc__ or "").splitlines()[0])
        for option in list(inspect.signature(job).parameters.values())[1:]:
            kind = str(option.annotation)
            flag = "--" + option.name.replace("_", "-")
            needed = option.default is inspect.Parameter.empty
            if kind == "bool":
                p.add_argument(flag, action="store_true")
            elif kind.startswith("list"):
                p.add_argument(flag, action="append", default=None)
            else:
                p.add_argument(flag, required=needed, default=None if needed else option.default, type=int if kind == "int" else str)
    args = vars(parser.parse_args(argv))
    code, summary = JOBS[args.pop("job")](session(), **args)
    print(summary_line(summary))
    return code


if __name__ == "__main__":
    sys.exit(main())
