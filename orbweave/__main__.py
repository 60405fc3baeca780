"""python -m orbweave ROOT [COMMAND ...]: the database below ROOT from the command line.

A command is one of the text commands (PING, QUERY, VINSERT, VSEARCH, GADD, KVGET, KVSET,
STATS), for example ``python -m orbweave data QUERY "MATCH (n:User) RETURN n"``.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .config import Config
from .session import Engine
from .sources import log, snapshot

DEFAULTS = """[vector]
dimension = 1536
space = "cosine"

[kv]
hot_capacity = 524288
warm_capacity = 13107200
"""


def _config(root: str) -> Config:
    path = os.path.join(root, "config.toml")
    return Config.from_toml(path) if os.path.exists(path) else Config()


def main(args: list[str], spark: SparkSession | None = None) -> int:
    cli = argparse.ArgumentParser("orbweave", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    cli.add_argument("root")
    cli.add_argument("command", nargs="*")
    cli.add_argument("--init", action="store_true", help="create ROOT with default settings")
    cli.add_argument("--replay-wal", action="store_true", help="count the valid entries of the log")
    cli.add_argument("--snapshot", action="store_true", help="write a snapshot of all tables")
    cli.add_argument("--restore", metavar="ID", help="make a snapshot the newest one")
    cli.add_argument("--list-snapshots", action="store_true")
    cli.add_argument("--gc", action="store_true", help="run a cycle of garbage collection")
    given = cli.parse_args(args)
    if given.init:
        os.makedirs(given.root, exist_ok=True)
        path = os.path.join(given.root, "config.toml")
        if not os.path.exists(path):
            with open(path, "w") as f:
                f.write(DEFAULTS)
        print(f"initialised {given.root}")
        return 0
    spark = spark or SparkSession.builder.appName("orbweave").getOrCreate()
    if given.list_snapshots:
        for r in snapshot.listing(spark, given.root).collect():
            print(r["snapshot_id"], r["created"], r["lsn"] or 0, sep="\t")
        return 0
    if given.replay_wal:
        print(log.replay(spark, f"{given.root.rstrip('/')}/wal").count())
        return 0
    if given.restore:
        engine = Engine(spark, _config(given.root), given.root)
        engine.restore(given.restore)
        print(engine.save())
        return 0
    engine = Engine.open(spark, given.root, _config(given.root))
    if given.gc:
        for step, n in engine.collect_garbage().items():
            print(step, n, sep="\t")
        engine.save()
    if given.command:
        out = engine.command(given.command[0] + " " + (given.command[1] if len(given.command) == 2 else " ".join(given.command[1:])))
        print(out if isinstance(out, str) else "\n".join("\t".join(map(str, r)) for r in out))
    if given.snapshot:
        print(engine.save())
    if not (given.gc or given.command or given.snapshot):
        cli.print_usage()
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
