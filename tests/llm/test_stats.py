import numpy as np
import pyarrow as pa

from quern.llm import _stats


def test_tree_of_many_parts(spark):
    # 10,000 partial tables of two chunks: no key of the first level has more than FAN_IN of them
    rows = [(at, part, 1, np.full(3, part % 7 + at, dtype="<u2").tobytes()) for part in range(10_000) for at in (0, 5)]
    parts = spark.createDataFrame(rows, "at int, part int, kind int, data binary").repartition(16)
    widest = parts.selectExpr("at", f"floor(part / {_stats.FAN_IN}) p").groupBy("at", "p").count().agg({"count": "max"}).collect()[0][0]
    assert widest == _stats.FAN_IN
    got = {r.at: np.frombuffer(bytes(r.data), dtype=_stats._KINDS[r.kind]).tolist() for r in _stats.added(parts).collect()}
    want = sum(k % 7 for k in range(10_000))
    assert got == {0: [want] * 3, 5: [want + 50_000] * 3}


def test_summed_table(spark):
    def fill(batch: pa.RecordBatch, counts: np.ndarray) -> None:
        np.add.at(counts, [v for v in batch.column(0).to_pylist() if v is not None], 1 << 33)

    length = _stats.CHUNK * 2 + 5
    df = spark.range(1000).selectExpr(f"if(id % 10 = 0, null, id * 37 % {length}) v").repartition(7)
    want = np.zeros(length, dtype=np.int64)
    np.add.at(want, [k * 37 % length for k in range(1000) if k % 10], 1 << 33)
    assert (_stats.summed_table(df, fill, length) == want).all()
    assert not _stats.summed_table(df.limit(0), fill, length).any()
