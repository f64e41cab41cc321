import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.operators.packed import explode_packed, split_packed

CASES = {
    "a;b": ["a", "b"],
    "'bare \"1 of 2\"'": ['bare "1 of 2"'],
    '"bare ""1 of 2"""': ['bare "1 of 2"'],
    "'signer''s script'; x": ["signer's script", "x"],
    '["a", "b"]': ["a", "b"],
    "{a,b}": ["a", "b"],
    " a;; ;b| c": ["a", "b", "c"],
    None: [],
    "": [],
    " \t ": [],
    "('x')": ["x"],
    "o'brien;y": ["o'brien", "y"],
    '"open a,b': ["open a,b"],
    "p2pkh\tp2sh": ["p2pkh", "p2sh"],
    "'a\tb'": ["a\tb"],
    "'';x": ["x"],
}


def test_cases(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "c string")
    got = {r.c: r.o for r in df.select("c", split_packed("c").alias("o")).collect()}
    assert got == CASES


def scan(text):
    """A plain scanner by the rules, for values that are quoted whole or not at all."""
    out = re.findall(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|[^;,|/\s]+", text)
    clean = [x[1:-1].replace(x[0] * 2, x[0]).strip() if x[0] in "'\"" and len(x) > 1 else x for x in out]
    return [x for x in clean if x]


def test_against_scanner(spark):
    found = []

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.tuples(st.text("ab ;,|/'\"", min_size=1, max_size=6), st.sampled_from(["'", '"'])), max_size=4), st.sampled_from([";", ", ", " | ", "/", "\t"]))
    def collect(values, delimiter):
        found.append(delimiter.join(q + v.replace(q, q + q) + q for v, q in values))

    collect()
    df = spark.createDataFrame([(x,) for x in found], "c string")
    for r in df.select("c", split_packed("c").alias("o")).collect():
        assert r.o == scan(r.c), r.c


def test_explode_keeps_positions_and_extra_columns(spark):
    df = spark.createDataFrame([("t", "a;b", None, 1), ("u", "", "x", 2)], "txid string, f string, g string, field_name int")
    got = {tuple(r) for r in explode_packed(df, ["txid"], ["f", "g"]).collect()}
    assert got == {("t", "f", 1, "a"), ("t", "f", 2, "b"), ("u", "g", 1, "x")}


def test_empty_table(spark):
    df = spark.createDataFrame([], "txid string, f string")
    assert explode_packed(df, ["txid"], ["f"]).count() == 0
    assert df.select(split_packed(F.col("f"))).count() == 0
