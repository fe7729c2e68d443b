"""An index of several segments gives what a scan gives, after updates, purges, retries and merges, and where it lacks batches."""

from __future__ import annotations

import random
from datetime import timedelta

from pyspark.sql import functions as F

from emberlog.functions import predicates as P
from emberlog.operators import index as I
from emberlog.operators import sinks as K
from tests.conftest import BASE

TERMS = [["red"], ["red dog"], ["dog red"], ["re"], ["red do"], ["the red dog", "cat"], ["cat cat"], ["cat cat cat"], ["x"], ["none"], ["svc"], ["k 7"], [""], ["red", ""], ["é"], ["DOG, the"]]


def test_segments_are_a_scan(spark, make_logs, tmp_path):
    r, path = random.Random(3), str(tmp_path / "logs")
    words = ["red", "dog", "the", "cat", "cat", "Redo", "é,", "x_y", "7"]

    def write(batch, ids, day=0, seconds=0):
        df = make_logs([(i, day * 1440 + k, "svc a", "h", "info", " ".join(r.choice(words) for _ in range(r.randint(0, 9))), '{"k":7}' if k % 5 == 0 else "{}") for k, i in enumerate(ids)])
        K.write_logs(df.withColumn("received_at", F.lit(BASE + timedelta(seconds=seconds)).cast("timestamp")), path, batch)

    calls = iter(range(100))

    def same(filters=()):
        current = K.read_logs(spark, path)
        for terms in TERMS[next(calls) % 3 :: 3]:
            want = sorted((x.id, x.message) for x in P.search(current, filters, terms).collect())
            assert sorted((x.id, x.message) for x in I.search_stored(spark, path, filters, terms).collect()) == want, terms
        return current.count()

    ids = [f"i{k}" for k in range(60)]
    for batch in ("1", "2", "3"):
        write(batch, ids[20 * (int(batch) - 1) : 20 * int(batch)], day=int(batch))
        I.index_batch(spark, path, batch)
    assert same() == 60 and len(I._last(spark, path)[1]) == 3
    write("4", ids[10:30], day=2, seconds=9)  # an update that isn't indexed yet
    assert same() == 60
    I.index_batch(spark, path, "4")
    assert same([("attr.k", "=", "7")]) == 60
    K.compact(spark, path)
    assert same() == 60 and len(I._last(spark, path)[1]) == 1
    write("2", ids[20:40], day=2)  # written again with other texts, after it was compacted
    assert same() == 60
    I.forget_changed(spark, path)
    assert "2" not in {b for held in I._last(spark, path)[1].values() for b in held}
    K.compact(spark, path)  # indexes the new texts with it
    assert same() == 60 and "2" in {b for held in I._last(spark, path)[1].values() for b in held}
    K.purge(spark, path, 1, BASE + timedelta(days=3, minutes=5))
    assert 0 < same() < 60
    write("5", ["new"], day=4)
    I.index_batch(spark, path, "5")
    I.merge_index(spark, path)
    same()
    plan = I.find(I._read(spark, path, I._last(spark, path)[1]), ["red dog"])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token" in plan or "PushedFilters: [In(ingest_batch" in plan or "Or(EqualTo(token" in plan
