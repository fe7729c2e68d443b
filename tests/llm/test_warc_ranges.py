"""Archives over ids of the whole range of longs, and how their bounds are found."""

from __future__ import annotations

import random

import pytest

from emberlog.llm import warc

SCHEMA = "page_id long, url string, html string"


def test_far_ids(spark, tmp_path):
    """Ids as hashes give them, both ends of the range included, archive and read back in order of their shards."""
    r = random.Random(4)
    ids = [-(2**63), 2**63 - 1, -(9 * 10**18), 9 * 10**18, 0, -1, None, *(r.randint(-(2**63), 2**63 - 1) for _ in range(200))]
    rows = [(i, "u", f"page {i} " * 30) for i in ids]
    manifest = warc.write(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "w"), shard=4000).collect()
    assert len({x.shard for x in manifest}) > 10
    got = [(x.page_id, x.url, x.payload) for x in warc.read(spark, str(tmp_path / "w")).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, rows))
    spans = []
    for x in manifest:
        found = [p for p, *_ in warc.parse(__import__("gzip").open(tmp_path / "w" / x.name)) if p is not None]
        spans.append((x.shard, min(found, default=0), max(found, default=0)))
    ranged = sorted(s for s in spans)[:-1]  # the last shard holds the missing id
    assert all(a[2] <= b[1] for a, b in zip(ranged, ranged[1:], strict=False))


@pytest.mark.parametrize("kind", ["even", "two heaps", "one id", "hashes"])
def test_bounds(spark, kind, monkeypatch):
    """Shards hold about the target, few jobs find them, and no more numbers than a few for each shard reach the driver."""
    r = random.Random(9)
    make = {"even": lambda k: k, "two heaps": lambda k: (10**18 if k % 2 else -(10**18)) + k, "one id": lambda k: 5, "hashes": lambda k: r.randint(-(2**63), 2**63 - 1)}[kind]
    rows = [(make(k), 100) for k in range(4000)]
    calls, numbers = [], []
    plain = warc._slot_sums

    def counted(keys, ranges):
        found = plain(keys, ranges)
        calls.append(len(ranges))
        numbers.append(sum(map(len, found.values())))
        return found

    monkeypatch.setattr(warc, "_slot_sums", counted)
    monkeypatch.setattr(warc, "SLOTS", 64)
    ends = warc.bounds(spark.createDataFrame(rows, "page_id long, n long"), 20_000)
    assert ends == sorted(set(ends)) and len(calls) <= 12 and max(numbers) <= 64 + 8 * 20
    sizes = [0] * (len(ends) + 1)
    for i, n in rows:
        sizes[sum(i > e for e in ends)] += n
    if kind == "one id":
        assert ends == []
    else:
        assert 5 <= len(ends) <= 20 and max(sizes) <= 5 * 20_000 and min(sizes[:-1]) >= 20_000
    assert warc.bounds(spark.createDataFrame([], "page_id long, n long"), 10) == []


def test_long_payload(spark, tmp_path):
    """A payload of many MB goes through whole, beside small ones."""
    big = "".join(random.Random(3).choices("abcdefgh \n", k=100_000)) * 120
    rows = [(1, "u", big), (2, "u", "small"), (3, "u", big)]
    warc.write(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "w"))
    got = {x.page_id: x for x in warc.read(spark, str(tmp_path / "w")).collect()}
    assert got[1].payload == big and got[3].refers_to == 1 and got[3].payload_bytes == len(big) and got[2].payload == "small"
