"""Comparison of the queries with their SQL in DuckDB."""

import duckdb

TABLES = "records raw_records predictions documents robustness_probes routes piece_limits sample_targets mix_targets".split()


def plain(value):
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None).isoformat()
    return round(value, 6) if isinstance(value, float) else value


def oracle_rows(sql: str, sf_dir: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    connection.execute("SET max_temp_directory_size = '2GB'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    found = connection.execute(sql)
    return sorted_rows([c[0] for c in found.description], found.fetchall())


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(plain(row[k]) for k in order) for row in rows), key=repr)


def query_rows(frame):
    return sorted_rows(frame.columns, [tuple(row) for row in frame.collect()])
