"""Regular expressions: what each pattern finds, as RE2 has it, and what is refused."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlog.functions import grok as G
from emberlog.functions import predicates as P
from emberlog.functions.dialect import translate

#: pattern, texts that it is found in, texts that it isn't found in
TABLE = [
    ("error$", ["an error"], ["error\n", "error x"]),
    ("^error", ["error x"], ["\nerror", " error"]),
    (r"(?m)error$", ["error\nx", "an error"], ["error x"]),
    (r"(?m)^b", ["a\nb", "b"], ["ab"]),
    (r"(?m)x\n^$", ["x\n"], ["x"]),
    (r"\Aab\z", ["ab"], ["ab\n", "xab"]),
    ("a.b", ["a\rb", "a b", "a\x85b", "axb"], ["a\nb", "ab"]),
    ("(?s)a.b", ["a\nb"], ["ab"]),
    ("(?s:a.)b", ["a\nb"], ["ab"]),
    ("a[^x]b", ["a\nb"], ["axb"]),
    ("^[[:alpha:]]+$", ["zebra", "lap"], ["lap1", "é", ""]),
    ("^[[:^digit:]]$", ["x", "é"], ["5"]),
    ("^[^[:space:]a]+$", ["b[:"], ["a", "b c"]),
    ("^[[:word:]-]+$", ["a_1-b"], ["a b"]),
    ("^[[:punct:]]+$", ["!#%[]^`{|}~"], ["a", "é"]),
    ("^[[:print:][:cntrl:]]$", ["a", "\t"], ["é"]),
    (r"\p{L}+1", ["é1"], ["11"]),
    (r"^\pL\PL$", ["a1"], ["aa"]),
    (r"^\p{Greek}+$", ["αβγ"], ["abc"]),
    (r"^[\p{Lu}\d]+$", ["É5"], ["é"]),
    (r"^\p{^L}$", ["5"], ["a"]),
    (r"\Qa.b*\E+", ["a.b***"], ["axb"]),
    (r"x\Q[", ["x["], ["x"]),
    (r"^\x{7a}\x41\x{1F600}$", ["zA😀"], ["za"]),
    (r"^\101\07?\0$", ["A\x00"], ["A"]),
    (r"^\v$", ["\x0b"], ["\n", "\x0c"]),
    (r"^\a\f\t\r\n$", ["\x07\x0c\t\r\n"], ["a"]),
    (r"^\s+$", [" \t\n\f\r"], ["\x0b", "\xa0", " "]),
    (r"^[\s]\S$", [" \x0b"], ["\x0b "]),
    (r"^\d+$", ["059"], ["٣"]),
    (r"^\w+$", ["aZ_9"], ["é", "a-b"]),
    (r"\bé", ["xé"], ["é"]),
    (r"\bcat\b", ["a cat!", "cat"], ["cats", "_cat"]),
    (r"o\Bo", ["foo"], ["o o"]),
    ("(?i)straSSe", ["STRASSE"], ["straße"]),
    ("(?i)É", ["é", "É"], ["e"]),
    ("(?i)k", ["K", "K"], ["x"]),
    ("a(?i)b(?-i)c", ["aBc"], ["ABc", "aBC"]),
    ("(?i:a)b", ["Ab"], ["AB"]),
    ("(?i:a(?-i:b))c", ["Abc"], ["ABc"]),
    ("(?i)a|b", ["B"], ["c"]),
    ("(a(?i)b)c", ["aBc"], ["aBC"]),
    ("a{,2}", ["a{,2}"], ["aa"]),
    ("a{2", ["a{2"], ["aa"]),
    ("^a{2}$", ["aa"], ["a", "aaa"]),
    ("^a{2,}$", ["aaa"], ["a"]),
    ("^a{1,2}?b$", ["aab"], ["aaab"]),
    ("{", ["{"], ["}"]),
    ("a}b]", ["a}b]"], ["ab"]),
    ("^[]a]+$", ["]a"], ["b"]),
    ("^[^]a]+$", ["b"], ["]"]),
    ("^[a-]+$", ["a-"], ["b"]),
    ("^[-a]+$", ["-a"], ["b"]),
    (r"^[a\-z]+$", ["a-z"], ["b"]),
    ("^[a&&b]+$", ["a&b"], ["c"]),
    ("^[[a]+$", ["[a"], ["b"]),
    (r"^[\]\\^]+$", ["]\\^"], ["a"]),
    (r"^[\x00-\x{20}]+$", ["\x01 "], ["a"]),
    ("^(a|b)*c$", ["abac", "c"], ["abd"]),
    ("^(?:ab?)+$", ["aab"], ["b"]),
    ("^(,\\d+)+$", [",1,22"], [",", "1"]),
    ("^(?:/[^/]*)+$", ["/a/b//"], ["a/"]),
    ("(?U)^a+b*?$", ["aab"], ["b"]),
    ("^*a", ["ba"], ["b"]),
    ("a||b", [""], []),
    ("()", [""], []),
    ("#x ~y", ["#x ~y"], ["x y"]),
    (r"\_\-\/\%\ ", ["_-/% "], ["x"]),
    ("😀+", ["😀"], ["😁"]),
]
REFUSED = [
    "(", ")", "a)", "[a", "[]", "[^]", "*a", "a**", "a++", "a*+", "a?*", "a{2}{3}", "|*", "(*)", "(?i)*", "a{1001}", "a{3,2}", "\\", r"\1", r"\8", r"(a)\1", r"\C", r"\Z", r"\G", r"\R", r"\X", r"\h",
    r"\e", r"\é", r"\x{110000}", r"\x4", r"\p{", "(?=a)", "(?!a)", "(?<=a)b", "(?<!a)b", "(?>a)", "(?#c)a", "(?x)a", "[z-a]", r"[a-\d]", "[[:nope:]]", "(a+)+", "(a*)*", "(a+|b)*", r"(?:\s+|x)+", "((ab)+)+", r"(\w+)*$", "(a+b?)+", "((a+))*", "(?:(?:a*)b*)+",
]


def test_table(spark):
    rows = [(k, java, text, want) for k, (pattern, yes, no) in enumerate(TABLE) for java in [translate(pattern)] for text, want in [*((t, True) for t in yes), *((t, False) for t in no)]]
    df = spark.createDataFrame(rows, "k int, java string, text string, want boolean")
    wrong = df.where(F.rlike("text", F.col("java")) != F.col("want")).collect()
    assert not wrong, [(TABLE[r.k][0], r.java, r.text, r.want) for r in wrong]


@pytest.mark.parametrize("pattern", REFUSED)
def test_refused(pattern):
    with pytest.raises(ValueError):
        translate(pattern)


def test_groups_keep_their_numbers(spark):
    java = translate(r"(?P<a_b>x)(?:y)(?i:(z))(?<n>[(]w)")
    got = spark.createDataFrame([("xyZ(w",)], "t string").select(*[F.regexp_extract("t", java, k) for k in (1, 2, 3)]).first()
    assert tuple(got) == ("x", "Z", "(w")


def test_builtin_patterns_are_taken():
    for name in G.PATTERNS:
        G.numbered(G.expand(f"^%{{{name}:x}} and %{{{name}:y}}$"))


atoms = st.sampled_from(["a", "b", ".", "[ab]", "[^a]", r"\d", r"\w", r"\s", "^", "$", "x", "(?:a|b)", "(b)", "1", r"\.", r"\x61", "[a-c1]"])
patterns = st.lists(st.tuples(atoms, st.sampled_from(["", "", "", "?", "*", "+", "{2}", "{1,2}", "*?"])), min_size=1, max_size=5).map(lambda xs: "".join(a + ("" if a in "^$" else q) for a, q in xs))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(patterns, st.text(alphabet="ab1x. \n", max_size=6)), min_size=40, max_size=40))
def test_as_another_engine(spark, cases):
    """Where both have the same meaning, as Python's engine, with its ASCII classes and `$` said as the end."""
    known = []
    for p, t in cases:
        ours = re.sub(r"(?<!\\)\$", r"\\Z", p).replace(r"\s", r"[\t\n\f\r ]")
        known.append((translate(p), t, re.search(ours, t, re.ASCII) is not None, p))
    df = spark.createDataFrame(known, "java string, text string, want boolean, p string")
    assert df.where(F.rlike("text", F.col("java")) != F.col("want")).collect() == []


def test_predicates(spark, make_logs):
    df = make_logs([("a", 0, "s", "h", "info", "lap", "{}"), ("b", 1, "s", "h", "info", "zebra", "{}"), ("c", 2, "s", "h", "info", "error\n", '{"k":"é"}'), ("d", 3, "s", "h", "info", "error", '{"k":"x"}')])
    for f, want in ((("message", "regex", "^[[:alpha:]]+$"), "abd"), (("message", "regex", "error$"), "d"), (("attr.k", "regex", r"^\p{L}$"), "cd"), (("attr.k", "regex", r"\Qx\E|\x{e9}"), "cd")):
        assert "".join(sorted(r.id for r in P.search(df, [f]).collect())) == want, f
