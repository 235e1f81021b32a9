"""Run registered queries beside their oracles: ``python tests/compare.py [sf_dir] [names...]``."""

import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(row[i]) for i in order] for row in rows), key=repr)


TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, con, sf_dir, name, query, sql):
    """A list of differences, empty when there are none."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return [], len(got)
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    wanted = rows_of(columns, result.fetchall())
    problems = []
    if sorted(columns) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(columns)}")
    kinds = {d[0]: str(d[1]) for d in result.description}
    for column, kind in df.dtypes:
        if kinds.get(column) not in (TYPES.get(kind, kind), None):
            problems.append(f"type of {column}: {kind} != {kinds[column]}")
    if len(got) != len(wanted):
        problems.append(f"{len(got)} rows != {len(wanted)}")
    if got != wanted:
        a, b = {repr(r) for r in got}, {repr(r) for r in wanted}
        problems.append(f"{len(a - b)} only in Spark, {len(b - a)} only in SQL")
        problems += [f"  spark {r[:400]}" for r in sorted(a - b)[:2]]
        problems += [f"  sql   {r[:400]}" for r in sorted(b - a)[:2]]
    return problems, len(got)


def main():
    import __spark_entry__ as entry
    from readlake.session import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": os.environ.get("PARTITIONS", "8"), "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            problems, n = compare(spark, con, sf_dir, name, queries[name], oracles.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            problems, n = [f"{type(error).__name__}: {str(error)[:700]}"], 0
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok ' if name in oracles else 'rows'} {name} {n} rows {time.time() - start:.1f}s", flush=True)
        for problem in problems:
            print("    " + problem, flush=True)
    print(f"{bad} bad of {len(queries)}; {len(oracles)} with oracle")


if __name__ == "__main__":
    main()
