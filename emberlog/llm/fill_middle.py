"""Fill-in-middle transformation by repeated captures: a text's units, cut into prefix, middle and suffix.

One `fullmatch` of (unit)* keeps every repetition of its group, so `ends(1)` holds where each unit ends: its length is
the number of units, and both cuts are looked up in it. Cuts, form and order follow from the digest of a document's id
alone, so reruns agree. A marker can't come about where parts and markers meet, as each begins with `<` and ends with
`>`; texts that hold one themselves stay plain. `restored` therefore rebuilds every text exactly.

A text longer than `BLOCK` code points is matched block by block, each ending where a unit does, so that memory is
bounded by 8 bytes a unit beside the text.

Defined results. Null texts count as empty, and empty ones are plain, with no units. The id of a null doc_id is the empty
text. Repeated rows give equal rows. An empty table gives an empty result. Extra columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import pick, table, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, TRANSFORMED, SPM = "1", 90, 20  # of 100 documents that many are transformed, and of 100 of these that many suffix first
UNIT = r"[A-Za-z]+|[^A-Za-z]"
BLOCK = 1 << 20
FIM = "n long, form string, prefix_chars long, middle_chars long, output string"
_units, _run, _marker = regex.compile(f"({UNIT})*"), regex.compile("[A-Za-z]*"), regex.compile("|".join((PREFIX, SUFFIX, MIDDLE)))


def unit_ends(text: str, block: int = BLOCK) -> list[int] | array:
    """Where each unit of the text ends."""
    if len(text) <= block:
        return _units.fullmatch(text).ends(1)
    ends, at = array("q"), 0
    while at < len(text):
        to = _run.match(text, min(at + block, len(text))).end()  # a run of letters stays whole
        ends.extend(_units.fullmatch(text, at, to).ends(1))
        at = to
    return ends


def transform_text(text: str, doc_id: int | None, seed: str = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = unit_ends(text)
    n = len(ends)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[4 * k : 4 * k + 4]) for k in range(4))
    if not text or h3 % 100 >= TRANSFORMED or _marker.search(text):
        return n, "plain", None, None, text
    a, b = (0 if k == 0 else ends[k - 1] for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    if h4 % 100 < SPM:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def transform(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of docs (doc_id, text)."""
    rows = pick(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    names = ["doc_id", *(x.split()[0] for x in FIM.split(", "))]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [transform_text(t.as_py(), i.as_py(), seed) for i, t in zip(b.column("doc_id"), b.column("text"), strict=True)]
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=names)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FIM}")


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of."""
    first = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    one = F.substring_index(body, PREFIX, 1)
    one = F.when(form == "psm", F.substring_index(body, SUFFIX, 1)).otherwise(one)
    rest = F.substr(body, F.length(one) + F.length(first) + 1)
    two = F.substring_index(rest, MIDDLE, 1)
    middle = F.substr(rest, F.length(two) + len(MIDDLE) + 1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


def _h(k: int) -> str:
    return f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '{UNIT}') AS u
  FROM documents
), c AS (
  SELECT *, len(u) AS n, least({_h(0)} % (len(u) + 1), {_h(1)} % (len(u) + 1)) AS a, greatest({_h(0)} % (len(u) + 1), {_h(1)} % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR {_h(2)} % 100 >= {TRANSFORMED} THEN 'plain'
              WHEN {_h(3)} % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, array_to_string(list_slice(u, 1, a), '') AS pre, array_to_string(list_slice(u, a + 1, b), '') AS mid, array_to_string(list_slice(u, b + 1, n), '') AS suf FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('{PREFIX}', pre, '{SUFFIX}', suf, '{MIDDLE}', mid) ELSE concat('{SUFFIX}', suf, '{PREFIX}', pre, '{MIDDLE}', mid) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
