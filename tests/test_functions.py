import pytest
from pyspark.sql import functions as F

from ledgerline.functions import identifiers as I
from ledgerline.functions.text import tokens, with_stem

SAME = [("vulnerability", "vulnerabilities"), ("policy", "policies"), ("store", "stored"), ("store", "stores"), ("organisation", "organization"), ("authorise", "authorized"), ("analyse", "analyzing"), ("behaviour", "behavior"), ("log", "logging")]
APART = [("process", "proces"), ("promise", "promize"), ("our", "or"), ("use", "user")]


def stems(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "token string")
    return {r.token: r.stem for r in with_stem(df).collect()}


def test_stems_together_and_apart(spark):
    got = stems(spark, {w for p in SAME + APART for w in p})
    assert [p for p in SAME if got[p[0]] != got[p[1]]] == []
    assert [p for p in APART if got[p[0]] == got[p[1]]] == []


def test_stopwords_leak_by_their_stems(spark):
    assert stems(spark, ["this", "have", "those"]) == {"this": "thi", "have": "hav", "those": "thos"}


def test_tokens_of_null_and_quotes(spark):
    df = spark.createDataFrame([(None,), ("It's MFA-ready, 2x!",)], "t string").select(tokens(F.col("t")).alias("w"))
    assert [r.w for r in df.collect()] == [[], ["it's", "mfa", "ready", "2x"]]


@pytest.mark.parametrize("raw,folded", [("AC-06(05)", "ac-6.5"), ("AC-6[5]", "ac-6.5"), (" s 8 (4) ", "s 8.4"), ("a – b", "a-b"), ("ISM-0421", "ism-421"), ("x..y.", "x.y"), (None, "")])
def test_identifiers_fold(spark, raw, folded):
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(I.normalise(F.col("x")).alias("n")).first().n == folded


def test_variants_and_shape(spark):
    df = spark.createDataFrame([("ism-421",), ("gov-1",)], "n string").select(I.variants(F.col("n")).alias("v"))
    assert [r.v for r in df.collect()] == [["ism-421", "ism 421", "421"], ["gov-1", "gov 1"]]
    shaped = spark.createDataFrame([("multi-factor authentication",), ("AC-6",), ("",), ("1 2 3 4 5 6",)], "q string").select(I.looks_like(F.col("q")).alias("l"))
    assert [r.l for r in shaped.collect()] == [False, True, False, False]
