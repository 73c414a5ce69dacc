import hashlib
import json
import sys

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import hashing, text
from gridloom.functions.columns import pick


def test_space_is_pythons(spark):
    chars = [chr(i) for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000]
    got = {r.c for r in spark.createDataFrame([(c,) for c in chars], "c string").where(F.col("c").rlike(f"^{text.SPACE}$")).collect()}
    assert got == {c for c in chars if c.isspace()}


def test_keys_and_texts(spark):
    df = spark.createDataFrame([("　 Ab\t",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(text.fold_key(F.col("s"))).collect()] == ["ab", None, ""]
    df = spark.createDataFrame([("x² ﬁ\n",), (None,), ("Ａ",)], "s string")
    assert [r[0] for r in df.select(text.normalize_text(F.col("s"))).collect()] == ["x2fi", "", "A"]


def test_hashes_of_64_bits(spark):
    df = spark.createDataFrame([("0" * 16, "8" + "0" * 15), ("f" * 16, "0" * 16), ("f" * 16, "f" * 16)], "a string, b string")
    assert [r[0] for r in df.select(hashing.hamming(F.col("a"), F.col("b"))).collect()] == [1, 64, 0]


def test_perceptual_bits(spark):
    grey = [[(r * 37 + c * 91) % 256 for c in range(9)] for r in range(8)]
    bits = [grey[r][c] > grey[r][c + 1] for r in range(8) for c in range(8)]
    want = f"{sum(b << i for i, b in enumerate(bits)):016x}"
    df = spark.createDataFrame([(grey,)], "g array<array<int>>")
    assert df.select(hashing.perceptual_bits(F.col("g"))).first()[0] == want


def test_canonical_json(spark):
    docs = ['{"b": 1.0, "a": [1, null, "ü"]}', "{broken", None, "1e7"]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in docs], "d string").select(hashing.canonical_json(F.col("d"))).collect()]
    assert got == ['{"a":[1,null,"ü"],"b":1.0}', None, None, "10000000.0"]
    try:
        hashing.stable_json(float("nan"))
        raise AssertionError
    except ValueError:
        pass


def test_row_sha_tells_nulls_and_borders(spark):
    df = spark.createDataFrame([("a", "b"), ("ab", ""), ("ab", None), (None, "ab")], "x string, y string")
    assert df.select(hashing.row_sha256(F.col("x"), F.col("y"))).distinct().count() == 4


def test_label(spark):
    want = f"S{hashlib.sha256(b'cell-text|5|0|1').hexdigest()[:10].upper()}-R1-C2"
    assert spark.range(5, 6).select(hashing.deterministic_label(F.col("id"), F.lit(0), F.lit(1))).first()[0] == want


@settings(max_examples=20, deadline=None)
@given(st.text(max_size=20), st.integers())
def test_generator_is_stable(name, part):
    assert hashing.deterministic_rng(name, part).random() == hashing.deterministic_rng(name, part).random()


def test_pick(spark):
    df = spark.createDataFrame([(1, 2, 3)], "text int, x int, TEXT int")
    assert pick(df, "text").columns == ["text"] and pick(df, "text").first()[0] == 1
    assert pick(df.toDF("x", "text", "text"), "text", "x").first() == (2, 1)
    assert json.dumps(sys.version)


def test_copies_are_cleared(spark, tmp_path):
    from gridloom import session

    held = session.cut(spark.range(3))
    assert held.count() == 3 and session.clear(spark) and not session.clear(spark)
