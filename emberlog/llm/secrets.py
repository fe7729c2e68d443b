"""Secret scans: three exact patterns, and a battery of randomness tests on what else looks encoded.

Base kinds (leftmost, non-overlapping, per kind): `assign`, a named value of 12 characters or more; `access`, an
access key id; `hex`, a hexadecimal run. The battery takes the runs of 16 or more base-64 characters that no base
span covers, infers each one's encoding (hexadecimal, base 32 or base 64; decimals and plain lower-case or
capitalised words are ordinary text) and counts its symbols. Of n symbols out of m, x pairs agree, which gives
chi-squared against a uniform alphabet as (2x + n)m/n - n. Two hypotheses are tested by it and two more statistics:
  ordinary   the symbols are drawn one by one as ordinary text draws them, whose chances add up to
             `Encoding.kappa` when squared and to `Encoding.cubes` when cubed. Then x has the mean P kappa, of P
             pairs, and the variance P(kappa - kappa^2) + n(n-1)(n-2)(cubes - kappa^2); p is the chance of so few
             of a gamma law of these moments, by Wilson and Hilferty's root. Where the corpus has `LEAST` ordinary tokens or more of that band of lengths and encoding and
             these agree less, or vary more, their mean and deviation are taken instead;
  random     the symbols are uniform. Chi-squared too large (by Wilson and Hilferty's root), the runs above and
             below the alphabet's middle too few or many (Wald and Wolfowitz's moments), or neighbours correlated
             (Moran's moments of the first serial correlation) speak against it; three times the least of these
             p-values below `FIT` rejects it, so that at most a share of FIT of random tokens is lost so.
A token is found if it isn't ordinary and may be random: its p is that of `ordinary`, and 1 where `random` is
rejected, which keeps it a valid p-value. Benjamini and Hochberg's procedure then holds the rate of false
discoveries at `RATE` in each band of lengths by itself, over all tokens of the corpus, because short tokens have
little power and would else borrow it from long ones. It runs on counts by band and step of log p, a few thousand
rows at most, that alone reach the driver. What it accepts has the kind `random`.

Everything is Spark columns. The documents are read once and not shuffled.

Defined results. Null and empty texts have no span; texts may have any length and number of spans. Null doc_ids are
kept. Positions count code points. Repeated rows each have their
own result. An empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import stage, table, text_of

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the runs of [0-9a-f]+ that are long enough
TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
BANDS = (24, 32, 48, 96)  # lengths at which the next band begins
RATE, STEPS, TOP = 0.05, 50, 1000  # steps of a 50th power of ten of p; the last step
LEAST, FIT = 30, 0.01
BLOCK = 256  # matches of a text that are placed together
SPANS = "array<struct<start:int,kind:int,end:int>>"


class Encoding(NamedTuple):
    pattern: str
    alphabet: str
    kappa: float  # chance that two symbols of ordinary text agree
    cubes: float  # chance that three do


#: Ordinary text: the letters of English prose, and one symbol in twenty one of a dozen others.
HEX16 = Encoding(r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.125, 0.02)
BASE32 = Encoding(r"^[A-Z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567", 0.0591, 0.00456)
BASE64 = Encoding(r".", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.0591, 0.00456)
ENCODINGS = (HEX16, BASE32, BASE64)
ORDINARY = r"^(?:[0-9]+|[A-Z_/+=-]+|(?:[A-Z]?[a-z]++[-_/+=]?)++)$"


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, hit>> of the matches; hit: the group's text. Positions come from the lengths of matches and of what lies between."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("whole"), kept.alias("hit"))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["whole"])
        return F.when(x["whole"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("out")))

    def parts(whole: Column) -> Column:
        """BLOCK pieces at a time, so that appending doesn't copy all that a long text has already."""
        slices = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / BLOCK).cast("int")), lambda k: F.slice(whole, k * BLOCK + 1, F.lit(BLOCK)))
        each = F.transform(slices, lambda x: F.aggregate(x, F.struct(F.lit(0).alias("at"), none.alias("out")), add))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,hit:string>>>").alias("out"))

        def join(acc: Column, x: Column) -> Column:
            moved = F.transform(x["out"], lambda y: F.struct((y["start"] + acc["at"]).alias("start"), (y["end"] + acc["at"]).alias("end"), y["hit"].alias("hit")))
            return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

        return F.flatten(F.aggregate(each, start, join, lambda acc: acc["out"]))

    return F.when(F.regexp_like(text, F.lit(pattern)), _let(pieces, parts)).otherwise(none)


def _spans(found: Column, kind: int, least: int) -> Column:
    return F.transform(F.filter(found, lambda x: F.length(x["hit"]) >= least), lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))).cast(SPANS)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _below(z: Column) -> Column:
    """P(Z < z) of the standard normal, to 1.2e-7 or so (Abramowitz and Stegun 7.1.26)."""

    def tail(v: Column) -> Column:
        x, t = v["x"], v["t"]
        return 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)

    def both(v: Column) -> Column:
        x = F.abs(v) / F.lit(2**0.5)
        p = _let(F.struct(x.alias("x"), (1 / (1 + 0.3275911 * x)).alias("t")), tail)
        return F.when(v < 0, p).otherwise(1 - p)

    return _let(z, both)


def _stats(raw: Column, e: Encoding) -> Column:
    """struct<code, even, fit> of a token read in the encoding e: the deviation of its agreeing pairs from those of
    ordinary text, and the p-value of the hypothesis that it is random."""
    m = len(e.alphabet)
    mid, df = (m - 1) / 2, m - 1

    def of(s: Column) -> Column:
        n = F.length(s).cast("double")
        counts = F.transform(F.split(F.lit(e.alphabet), ""), lambda c: n - F.length(F.replace(s, c, F.lit(""))))
        agree = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * (c - 1) / 2)
        values = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.position(F.substr(s, i, F.lit(1)), F.lit(e.alphabet)) - 1 - mid)
        start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("x"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("xy"), F.lit(None).cast("double").alias("first"))

        def add(a: Column, d: Column) -> Column:
            return F.struct(d.alias("last"), (a["x"] + d).alias("x"), (a["xx"] + d * d).alias("xx"), (a["xy"] + F.coalesce(a["last"] * d, F.lit(0.0))).alias("xy"), F.coalesce(a["first"], d).alias("first"))

        halves = F.translate(s, e.alphabet, "L" * (m // 2) + "H" * (m - m // 2))
        low = n - F.length(F.replace(halves, F.lit("L")))
        runs = F.length(F.regexp_replace(halves, "L+|H+", "x")).cast("double")
        found = F.struct(n.alias("n"), agree.alias("agree"), low.alias("low"), runs.alias("runs"), F.aggregate(values, start, add).alias("v"))
        return _let(found, judged_)

    def judged_(t: Column) -> Column:
        n, x, v = t["n"], t["agree"], t["v"]
        pairs = n * (n - 1) / 2
        usual = pairs * e.kappa
        root = (pairs * (e.kappa - e.kappa**2) + n * (n - 1) * (n - 2) * (e.cubes - e.kappa**2)) / (9 * usual * usual)
        even = (F.cbrt((x + 1) / usual) - (1 - root)) / F.sqrt(root)
        chi = (2 * x + n) * m / n - n
        wilson = (F.cbrt(chi / df) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5
        mean = 2 * t["low"] * (n - t["low"]) / n + 1
        wald = F.try_divide(F.greatest(F.abs(t["runs"] - mean) - 0.5, F.lit(0.0)), F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(0.0))))
        # sum over neighbours of the products of deviations from the mean, over the sum of squared deviations
        average = v["x"] / n
        serial = F.try_divide(v["xy"] - average * (2 * v["x"] - v["first"] - v["last"]) + (n - 1) * average * average, v["xx"] - n * average * average)
        moran = F.abs(serial + 1 / n) * n * F.sqrt(n - 1) / (n - 2)
        least = F.least(_below(-wilson), 2 * _below(-F.coalesce(wald, F.lit(40.0))), 2 * _below(-F.coalesce(moran, F.lit(40.0))))
        return F.struct(F.lit(ENCODINGS.index(e)).alias("code"), even.alias("even"), F.least(3 * least, F.lit(1.0)).alias("fit"))

    return _let(F.rtrim(F.translate(raw, "-_", "+/"), F.lit("=")) if e is BASE64 else F.lower(raw), of)


def _band(n: Column) -> Column:
    return sum(((n >= b).cast("int") for b in BANDS[1:]), (n >= BANDS[0]).cast("int"))


def _step(p: Column) -> Column:
    return F.least(F.lit(TOP), F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * STEPS)).cast("int")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, tokens): base spans in order; the tokens that no base span covers, with band and step of p."""
    text = F.col("text")
    base = F.array_sort(F.concat(_spans(_found(text, ASSIGN, 2), 0, 12), _spans(_found(text, ACCESS), 1, 18), _spans(_found(text, HEX), 2, 16)))
    df = docs.select(F.col("doc_id"), text_of().alias("text")).select("doc_id", base.alias("base"), _found(text, TOKEN).alias("found"))

    def block(own: Column) -> Column:
        return F.struct(F.element_at(own, 1)["start"].alias("start"), F.array_max(F.transform(own, lambda b: b["end"])).alias("end"), own.alias("own"))

    def meets(x: Column, b: Column) -> Column:
        return (b["start"] < x["end"]) & (x["start"] < b["end"])

    # base spans BLOCK at a time, so that a token is held against few of a long text's spans
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("base") - 1) / BLOCK).cast("int")), lambda k: _let(F.slice("base", k * BLOCK + 1, F.lit(BLOCK)), block))
    outside = _let(blocks, lambda bs: F.filter("found", lambda x: ~F.exists(bs, lambda b: meets(x, b) & F.exists(b["own"], lambda o: meets(x, o)))))
    free = F.when(F.size("base") == 0, F.col("found")).otherwise(outside)
    stats = lambda h: F.when(F.rlike(h, F.lit(HEX16.pattern)), _stats(h, HEX16)).when(F.rlike(h, F.lit(BASE32.pattern)), _stats(h, BASE32)).otherwise(_stats(h, BASE64))
    tokens = F.transform(free, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _band(F.length(x["hit"])).alias("band"), F.rlike(x["hit"], F.lit(ORDINARY)).alias("ordinary"), stats(x["hit"]).alias("s")))
    return df.select("doc_id", "base", tokens.alias("tokens"))


def nulls(scanned: DataFrame) -> Column:
    """By band and encoding struct<mean, dev> of `even`: those of the corpus's ordinary tokens where they are stricter than the hypothesis's 0 and 1."""
    t = scanned.select(F.explode("tokens").alias("t")).where("t.ordinary").groupBy("t.band", "t.s.code")
    even = F.least("t.s.even", F.lit(3.0))  # a run of one symbol tells nothing of the others
    rows = {(r.band, r.code): r for r in t.agg(F.count(F.lit(1)).alias("n"), F.avg(even).alias("mean"), F.stddev(even).alias("dev")).where(F.col("n") >= LEAST).collect()}  # 15 rows at most

    def cell(r) -> Column:
        return F.struct(F.lit(min(0.0, r.mean) if r else 0.0).alias("mean"), F.lit(max(1.0, r.dev) if r else 1.0).alias("dev"))

    return F.array(*(cell(rows.get((b, c))) for b in range(len(BANDS) + 1) for c in range(len(ENCODINGS))))


def judged(scanned: DataFrame) -> DataFrame:
    """(doc_id, base, tokens) with the band and the step of the p of each token that isn't ordinary."""
    known = nulls(scanned)

    def step(t: Column) -> Column:
        p = _let(F.element_at(known, t["band"] * len(ENCODINGS) + t["s"]["code"] + 1), lambda v: _below((t["s"]["even"] - v["mean"]) / v["dev"]))
        return _step(F.when(t["s"]["fit"] >= FIT, p).otherwise(1.0))

    tokens = F.transform(F.filter("tokens", lambda t: ~t["ordinary"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["band"].alias("band"), step(t).alias("step")))
    return scanned.select("doc_id", "base", tokens.alias("tokens"))


def cutoffs(scanned: DataFrame, rate: float = RATE) -> list[int]:
    """By band the least step of p that is accepted (TOP + 1: none), by Benjamini and Hochberg over all tokens."""
    counts = scanned.select(F.explode("tokens").alias("t")).groupBy("t.band", "t.step").count().collect()  # a few hundred rows
    out = []
    for band in range(len(BANDS) + 1):
        own = {r.step: r["count"] for r in counts if r.band == band}
        total, least, seen = sum(own.values()), TOP + 1, 0
        for step in range(TOP, -1, -1):
            seen += own.get(step, 0)
            if seen and 10 ** (-step / STEPS) * total <= rate * seen:
                least = step
        out.append(least)
    return out


def _text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _is_kind(k: int):
    return lambda x: x["kind"] == k


def decide(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) for each row of docs."""
    scanned = stage(judged(stage(scan(docs), "secrets-stats")), "secrets")
    least = F.array(*map(F.lit, cutoffs(scanned, rate)))
    random = F.transform(F.filter("tokens", lambda t: t["step"] >= F.element_at(least, t["band"] + 1)), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end"))).cast(SPANS)
    n = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return scanned.withColumn("random", random).select("doc_id", *n, F.size("random").cast("long").alias("n_random"), F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.array_sort(F.concat("base", "random"))).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "documents"))
