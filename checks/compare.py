"""Run the registered queries beside their SQL: ``python -m checks.compare [folder] [name ...]``."""

from __future__ import annotations

import sys
import tempfile
import time
import traceback

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from .oracle import ORACLE
from .queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checks-"))  # one machine, so its own folder is shared
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        if c in ("date", "next_date"):
            df[c] = pd.to_datetime(df[c])
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = ordered(got), ordered(want)
    for c in got.columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        if not same.all():
            i = same.idxmin()
            return f"{c}: {(~same).sum()} of {len(got)} differ, first {got[c][i]!r} != {want[c][i]!r} at {got.loc[i].to_dict()}"
    return None


def main(folder: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark, con, bad = session(), database(folder), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            got = QUERIES[name](spark, folder).toPandas()
            took, start = time.time() - start, time.time()
            if name in ORACLE:
                want = con.execute(ORACLE[name]).df()
                why = difference(got, want)
                note = "ok" if why is None else f"DIFFERS {why}"
            else:
                why, note = None, "no SQL"
        except Exception as e:
            why, took, note = str(e), time.time() - start, "FAILED " + str(e)[:600]
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += why is not None
        rows = len(got) if "FAILED" not in note else "-"
        print(f"{name:24} {took:6.2f}s {time.time() - start:6.2f}s {rows:>7} {note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(*[a for a in sys.argv[1:] if a != "-v"]))
