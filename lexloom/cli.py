"""Command line: list queries, run one and write or show its rows."""

import argparse

from lexloom.plans.queries import QUERIES
from lexloom.session import local_session


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lexloom")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name", choices=sorted(QUERIES))
    run.add_argument("sf_dir")
    run.add_argument("--out", help="write Parquet here instead of showing rows")
    a = p.parse_args(argv)
    if a.what == "list":
        print("\n".join(sorted(QUERIES)))
        return
    df = QUERIES[a.name](local_session(), a.sf_dir)
    df.write.parquet(a.out) if a.out else df.show(20, truncate=80)


if __name__ == "__main__":
    main()
