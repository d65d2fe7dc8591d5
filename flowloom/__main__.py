"""python -m flowloom SOURCE [TARGET] [--block-app X] [--block-ip X] [--block-domain X] [--block-port N] [--rules FILE]: filters captures and reports on them."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.pipeline import filter_captures, judge, report_text
from .sources.pcap import read_captures
from .sources.rules import Rules, load_rules


def main(args: list[str] | None = None) -> str:
    parser = argparse.ArgumentParser(prog="flowloom", description="Filters capture files by rules and reports on their flows.")
    parser.add_argument("source")
    parser.add_argument("target", nargs="?")
    for kind in ("app", "ip", "domain", "port"):
        parser.add_argument(f"--block-{kind}", action="append", default=[])
    parser.add_argument("--rules")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("flowloom").getOrCreate()
    rules = (load_rules(spark, given.rules) if given.rules else None) or Rules()
    for app in given.block_app:
        rules = rules.block_app(app)
    for ip in given.block_ip:
        rules = rules.block_ip(ip)
    for domain in given.block_domain:
        rules = rules.block_domain(domain)
    for port in given.block_port:
        rules = rules.block_port(int(port))
    made = filter_captures(spark, given.source, given.target, rules) if given.target else judge(read_captures(spark, given.source), rules)
    return report_text(made)


if __name__ == "__main__":
    print(main())
