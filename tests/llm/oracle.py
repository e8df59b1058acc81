"""Registered queries against their SQL."""

from ledgerflow.llm.queries import QUERIES, SQL
from ledgerflow.plans.oracle import compare, duckdb_connection


def equal(spark, name, sf_dir):
    return compare(QUERIES[name](spark, sf_dir), duckdb_connection(sf_dir), SQL[name])
