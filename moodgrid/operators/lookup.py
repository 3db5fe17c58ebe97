"""Size-checked lookup tables (the broadcast side of hash joins).

Word lists, lexicons and cluster tables are joined against every token
of every post.  Broadcasting them avoids shuffling the token stream, but
only a table whose size is *known* may be broadcast: the table is first
materialised as a reliable checkpoint in the shared checkpoint folder
(``spark.checkpoint.dir``), its rows and the bytes of their values are
summed, and only under both bounds is the broadcast hint applied.  Beyond the bound the plain
DataFrame is returned and Spark plans a sort-merge join (AQE splits
skewed key partitions, so a hot token does not stall one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

DEFAULT_MAX_ROWS = 2_000_000
DEFAULT_MAX_BYTES = 256 << 20
ROW_OVERHEAD = 32
BYTES_KEY = "moodgrid.broadcast.maxBytes"
CONF_KEY = "moodgrid.broadcast.maxRows"


def max_rows(df: DataFrame) -> int:
    v = df.sparkSession.conf.get(CONF_KEY, None)
    return int(v) if v else DEFAULT_MAX_ROWS


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (shared folder): cuts lineage so that a lookup
    derived from the big tables is computed once, and survives the loss
    of the executors that computed it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def max_bytes(df: DataFrame) -> int:
    v = df.sparkSession.conf.get(BYTES_KEY, None)
    return int(v) if v else DEFAULT_MAX_BYTES


def _value_bytes(df: DataFrame):
    """Approximate bytes of one row: fixed types by their width, all other
    values by the length of their text form."""
    fixed = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
             "date": 4, "timestamp": 8}
    total = F.lit(ROW_OVERHEAD).cast("long")
    for name, kind in df.dtypes:
        col = df[name]
        total = total + (F.lit(fixed[kind]) if kind in fixed else
                         F.coalesce(F.octet_length(col if kind == "string" else F.to_json(F.struct(col))), F.lit(0)))
    return total


def sized_lookup(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Materialise ``df`` and broadcast it only if it has ``<= limit`` rows
    and its values fit the byte bound."""
    m = materialise(df)
    r = m.select(F.count(F.lit(1)).alias("n"), F.sum(_value_bytes(m)).alias("b")).first()
    lim = max_rows(df) if limit is None else limit
    return F.broadcast(m) if r["n"] <= lim and (r["b"] or 0) <= max_bytes(df) else m


def constant_table(spark, rows, schema: str) -> DataFrame:
    """A literal table of fixed, tiny size (ranges, labels, thresholds) —
    always safe to broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread a (small) intermediate over ``spark.sql.shuffle.partitions``
    parts before CPU-heavy per-row work.  After a small aggregation AQE
    coalesces partitions by *bytes*; an explicit repartition keeps the
    expensive step (e.g. edit distances) on every core."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys) if keys else df.repartition(n)
