"""Mixing overlapping sources to target weights by a minimum-cost flow.

Documents are counted by membership pattern (the set of sources they belong to). Each pattern offers its words
once at no cost, and again at a cost that rises with each repetition; each source asks for its target. The flow
from patterns to sources that meets the targets at least cost says how many words each pattern gives: whole
passes over its documents, and for the rest the documents that come first in a seeded order. Costs lie only on
the arcs that leave the patterns' supply, so shortest augmenting paths are found tier by tier.

Targets. Sources in code-point order, null last, weigh 5, 2, 1, repeating; together they get `share` times all
words; a target stops at `most` times its source's words and what is left over goes to the others by weight.

Targets are found on Spark. Patterns and sources that hang together, by patterns of two or more sources, make a
component, found by joins; each component is one flow, solved by a task that holds its patterns, a row each, and never a
document. Nothing of them reaches the driver. Callers may give limits: more than `max_shared` patterns of two or more
sources, or `max_patterns` of any kind, are then refused with an error; without them there is none.

Defined results. A null text has size 0, as has a blank one. A document without a source belongs to the source
null. Null doc_ids sort first. Rows that repeat doc_id and size are taken or left together at the boundary. An
empty table gives an empty result. Extra columns pass through `mix`.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import stage, table, text_of
from emberlog.llm.components import components

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, "mix-1"
BUCKETS = (3, 6)  # digits of the order by which the cut is narrowed down, to a 16 millionth of a source
FEW = 50_000  # patterns of a plan that is sent to all tasks; a larger one is joined by key
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def order_of(doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(sizes: dict[str | None, int], share: float = SHARE, most: int = MOST) -> dict[str | None, float]:
    """Target of each source: in proportion to its weight, but for those that stop at `most` times their size. For a few sources; see targets_of."""
    ordered = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sizes)
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(ordered)}
    total, full, heavy = share * sum(sizes.values()), 0, sum(weight.values())
    level = 0.0
    for s in sorted(ordered, key=lambda s: most * sizes[s] / weight[s]):
        level = (total - full) / heavy
        if level * weight[s] <= most * sizes[s]:
            break
        full, heavy = full + most * sizes[s], heavy - weight[s]
    return {s: min(float(most * sizes[s]), level * weight[s]) for s in ordered}


def targets_of(sizes: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes (source, size; a row per source) with the target that `targets` gives, of any number of sources."""
    order = F.col("source").asc_nulls_last()
    placed = stage(sizes.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("at", 33).cast("int")
    counts = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per partition
    if not counts:
        return placed.select("source", "size", F.lit(0.0).alias("target"))
    before = [0]
    for k in range(max(counts)):
        before.append(before[-1] + counts.get(k, 0))
    place = F.element_at(F.array(*map(F.lit, before)), part + 1) + F.col("at").bitwiseAND((1 << 33) - 1)
    weighed = stage(placed.select("source", "size", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")).cast("long").alias("weight")), "mix-weights")
    total, heavy = weighed.agg(F.sum("size"), F.sum("weight")).first()
    total, level = share * total, share * total / heavy
    while True:  # the level rises until no source stops below it that didn't before
        under = F.lit(level) * F.col("weight") <= most * F.col("size")
        full, heavy = weighed.agg(F.coalesce(F.sum(F.when(~under, most * F.col("size"))), F.lit(0)), F.sum(F.when(under, F.col("weight")))).first()
        if not heavy or (total - full) / heavy <= level:
            break
        level = (total - full) / heavy
    return weighed.select("source", "size", F.least((most * F.col("size")).cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def flow(supply: dict[str, int], members: dict[str, list[str | None]], demand: dict[str | None, int], tiers: int) -> dict[str, int]:
    """Words that each pattern gives: a minimum-cost maximum flow in which the k-th reading of a word costs k - 1."""
    sent: dict[tuple[str, str | None], int] = {(p, s): 0 for p in sorted(supply) for s in members[p]}
    holders: dict[str | None, list[str]] = {}
    for p, s in sent:
        holders.setdefault(s, []).append(p)
    used, need = dict.fromkeys(supply, 0), dict(demand)
    for tier in range(1, tiers + 1):
        for start in sorted(supply):
            while used[start] < tier * supply[start]:
                before: dict = {("p", start): None}
                queue, end = deque([("p", start)]), None
                while queue and end is None:
                    kind, x = queue.popleft()
                    if kind == "p":
                        near = [("s", s) for s in members[x]]
                    elif need[x] > 0:
                        end = ("s", x)
                        break
                    else:
                        near = [("p", p) for p in holders[x] if sent[p, x] > 0]
                    for y in near:
                        if y not in before:
                            before[y] = (kind, x)
                            queue.append(y)
                if end is None:
                    break
                path, at = [], end
                while before[at] is not None:
                    path.append((before[at], at))
                    at = before[at]
                amount = min([tier * supply[start] - used[start], need[end[1]], *(sent[b[1], a[1]] for a, b in path if a[0] == "s")])
                for a, b in path:
                    if a[0] == "p":
                        sent[a[1], b[1]] += amount
                    else:
                        sent[b[1], a[1]] -= amount
                used[start] += amount
                need[end[1]] -= amount
    return used


def _of_source(source: Column) -> Column:
    """The key of the pattern of one source, which also names the source in the graph of patterns."""
    return F.to_json(F.array(source))


def _served(supply: DataFrame, wanted: DataFrame, most: int, max_shared: int | None) -> DataFrame:
    """(key, given) of every pattern, by the flow of its component."""
    many = supply.where(F.size("members") > 1)
    if max_shared is not None and many.limit(max_shared + 1).count() > max_shared:
        raise ValueError(f"more than {max_shared} membership patterns of two or more sources")
    asked = supply.select("key", "n", F.explode("members").alias("member")).join(wanted, F.col("member").eqNullSafe(F.col("source")))
    asked = asked.groupBy("key", "n").agg(F.to_json(F.collect_list(F.struct("source", F.floor("target").cast("long").alias("target")))).alias("asks"))
    if many.isEmpty():
        asked = asked.withColumn("component", F.col("key"))
    else:
        edges = many.select(F.col("key").alias("u"), F.explode("members").alias("member")).select("u", _of_source(F.col("member")).alias("v"))
        asked = asked.join(components(edges), F.col("key") == F.col("node"), "left").withColumn("component", F.coalesce("component", "key"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def solved() -> pa.RecordBatch:
            members = {key: [x.get("source") for x in asks] for key, _, asks in rows}
            demand = {x.get("source"): x["target"] for _, _, asks in rows for x in asks}
            given = flow({key: n for key, n, _ in rows}, members, demand, most)
            return pa.RecordBatch.from_arrays([pa.array(list(given), pa.string()), pa.array(list(given.values()), pa.int64())], names=["key", "given"])

        for b in batches:
            for component, key, n, asks in zip(*(b.column(c).to_pylist() for c in ("component", "key", "n", "asks")), strict=True):
                if component != now and rows:
                    yield solved()
                    rows.clear()
                now = component
                rows.append((key, n, json.loads(asks)))
        if rows:
            yield solved()

    return asked.repartition("component").sortWithinPartitions("component", "key").mapInArrow(solve, "key string, given long")


def plan(sized: DataFrame, *, share: float = SHARE, most: int = MOST, max_patterns: int | None = None, max_shared: int | None = None) -> DataFrame:
    """A row per pattern: key, source_size, target (of its first source), passes, cut.

    sized: key (JSON of the sources), doc_id, size, h. A document is read `passes` times, and once more if
    (h, doc_id, size) isn't above the cut. The cut is found from sums by hash prefix, by longer ones within it, and then row by row.
    """
    supply = stage(sized.groupBy("key").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).withColumn("members", F.from_json("key", "array<string>")), "mix-patterns")
    if max_patterns is not None and supply.limit(max_patterns + 1).count() > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    sizes = supply.select(F.explode("members").alias("source"), "n").groupBy("source").agg(F.sum("n").alias("size"))
    wanted = stage(targets_of(sizes, share, most), "mix-targets")
    own = supply.join(wanted, F.col("members")[0].eqNullSafe(F.col("source"))).join(_served(supply, wanted, most, max_shared), "key")
    passes = F.when(F.col("n") > 0, F.expr("given div n")).otherwise(F.lit(0)).cast("long")
    own = own.withColumn("passes", passes).select("key", F.col("size").alias("source_size"), "target", "passes", (F.col("given") - F.col("passes") * F.col("n")).alias("rest"))
    own = stage(own, "mix-passes")

    inner, cuts = sized, own.select("key", "rest")
    for width in BUCKETS:
        prefix = F.substring("h", 1, width)
        upto = F.sum("n").over(Window.partitionBy("key").orderBy("prefix"))
        sums = inner.groupBy("key", prefix.alias("prefix")).agg(F.sum("size").alias("n")).withColumn("upto", upto)
        cuts = sums.join(cuts.select("key", "rest"), "key").where("upto - n <= rest and rest < upto").select("key", "prefix", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))
        cuts = stage(cuts, "mix-cuts")
        inner = sized.withColumn("prefix", prefix).join(cuts, ["key", "prefix"])
    past = F.sum("size").over(Window.partitionBy("key").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    last = inner.withColumn("past", past).where("2 * past + size <= 2 * rest").groupBy("key").agg(F.max(F.struct("h", "doc_id", "size")).alias("last"))
    none = F.struct(F.col("prefix").alias("h"), F.lit(None).cast(sized.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("long").alias("size"))
    cut = F.coalesce("last", F.when(F.col("prefix").isNotNull(), none)).alias("cut")
    return stage(own.join(cuts.select("key", "prefix"), "key", "left").join(last, "key", "left").select("key", "source_size", "target", "passes", cut), "mix-plan")


def _key(sources: Column | None) -> Column:
    each = F.array(F.col("source").cast("string")) if sources is None else F.array_sort(F.array_distinct(sources))
    return F.to_json(F.when(F.size(each) > 0, each).otherwise(F.array(F.lit(None).cast("string"))))


def _taken(df: DataFrame, made: DataFrame) -> DataFrame:
    """df with the plan's columns and copies."""
    more = F.coalesce(F.struct("h", "doc_id", "size") <= F.struct("cut.h", "cut.doc_id", "cut.size"), F.lit(False))
    few = made.limit(FEW + 1).count() <= FEW
    return df.join(F.broadcast(made) if few else made, "key").withColumn("copies", F.col("passes") + F.when(F.col("cut").isNotNull() & more, 1).otherwise(0))


def decide(docs: DataFrame, sources: Column | None = None, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row; sources: array of a row's sources, `source` alone by default."""
    sized = stage(docs.select(_key(sources).alias("key"), F.col("doc_id"), size_of(text_of()).alias("size"), order_of(F.col("doc_id")).alias("h")), "mix")
    return _taken(sized, plan(sized, **options)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, sources: Column | None = None, **options) -> DataFrame:
    """The rows of docs that the mix takes, with `copies`: how often each is read."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(whole, _key(sources).alias("key"), F.col("doc_id"), size_of(text_of()).alias("size"), order_of(F.col("doc_id")).alias("h"))
    made = plan(stage(rows.drop("row"), "mix"), **options)
    return _taken(rows, made).where("copies > 0").select("row.*", F.col("copies").alias("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5(concat('{SEED}:', doc_id)) AS h FROM documents
), s AS (
  SELECT source, sum(size) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source
), w AS (
  SELECT source, n, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), r AS (
  SELECT *, row_number() OVER o AS k, coalesce(sum({MOST} * n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before
  FROM w WINDOW o AS (ORDER BY {MOST} * n / weight, source)
), l AS (
  SELECT *, ({SHARE} * (SELECT sum(n) FROM w) - full_before)::DOUBLE / ((SELECT sum(weight) FROM w) - weight_before)::DOUBLE AS level FROM r
), c AS (
  SELECT level FROM l WHERE level * weight <= {MOST} * n ORDER BY k LIMIT 1
), t AS (
  SELECT source, n, least(({MOST} * n)::DOUBLE, (SELECT level FROM c) * weight::DOUBLE) AS target FROM w
), g AS (
  SELECT *, CASE WHEN n > 0 THEN floor(target)::BIGINT // n ELSE 0 END AS passes FROM t
), x AS (
  SELECT d.doc_id, d.size, g.n, g.target, g.passes, floor(g.target)::BIGINT - g.passes * g.n AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS past
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, target,
       (size * (passes + CASE WHEN 2 * past + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x
"""
