"""Session helpers: building a session, lineage cuts and size-checked joins."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows stay at or under this.
BROADCAST_ROWS = 50_000


def build_session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and a fixed UTC clock; `conf` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Points checkpoints at the shared folder named in `spark.checkpoint.dir`.

    Only where the setting is absent and the master is this one machine (tests, bench)
    is a fresh temporary folder used; on a cluster without the setting this raises, as a
    machine's own folder would be lost with the machine.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quern-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: survives the loss of executors and ends the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sized_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", limit: int = BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """Joins a large `left` to a `right` that is unique on `keys` and usually small.

    `right` is counted first. Up to `limit` rows it is broadcast. Beyond that both sides
    are salted: each right row is repeated `salts` times and each left row goes to one
    salt, so a key that holds a third of all left rows is spread over `salts` tasks.
    `how` is inner, left, left_semi or left_anti.
    """
    if right.limit(limit + 1).count() <= limit:
        return left.join(F.broadcast(right), keys, how)
    salted = right.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(salts)])))
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    return spread.join(salted, [*keys, "_salt"], how).drop("_salt")
