"""Cleaning, words, lines, truncation against small Python models."""

import random

from pyspark.sql import functions as F

from veritext.functions import text as T

INVISIBLE = {0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD, *range(0xE0100, 0xE01F0), 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A), *range(0xE0000, 0xE0080)}
FILL = {0x3164, 0x2800, 0x180E, 0x2028, 0x2029}


def model_strip(t):
    return "".join(" " if ord(c) in FILL else "" if ord(c) in INVISIBLE else c for c in t)


def model_clean(t, n):
    if not t:
        return None
    t = "".join(" " if ord(c) < 32 or 0x7F <= ord(c) <= 0x9F else c for c in model_strip(t))
    return t.strip()[:n] or None


def texts():
    r = random.Random(7)
    chars = "ab cé\n\t #\r\x0b\x1c\x85​‮\U000e0049⠀　️ﻠ\U0001f600"
    return ["", " ", "plain", *["".join(r.choice(chars) for _ in range(r.randint(0, 60))) for _ in range(300)]]


def rows_of(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i int, t string")


def test_strip_and_clean(spark):
    got = rows_of(spark, texts()).select("t", T.strip_invisible(F.col("t")).alias("s"), T.clean_field(F.col("t"), 9).alias("c")).collect()
    for r in got:
        if r.t is None:
            assert r.s is None and r.c is None
        else:
            assert r.s == model_strip(r.t)
            assert r.c == model_clean(r.t, 9)


def test_lines_and_words(spark):
    got = rows_of(spark, texts()).where("t IS NOT NULL").select("t", T.lines(F.col("t")).alias("l"), T.word_count(F.col("t")).alias("n")).collect()
    for r in got:
        assert list(r.l) == r.t.splitlines(keepends=True)
        assert r.n == len(r.t.split())


def test_truncation(spark):
    cases = ["a" * 50, "a" * 12 + "\n\n" + "b" * 50, "\n\n" + "c" * 60, "d d \n\n e" * 9, "x" * 40]

    def model(t, limit):
        if len(t) <= limit:
            return t
        cut = t.rfind("\n\n", 0, limit)
        return t[: cut if cut > 0 else limit].rstrip() + "\n\n[... truncated]"

    got = rows_of(spark, cases).where("t IS NOT NULL").select("t", T.truncated(F.col("t"), 10).alias("c")).collect()
    assert all(r.c == model(r.t, 40) for r in got)


def test_scores_and_budgets(spark):
    values = ["1.5", "nan", "inf", "1e400", "-2", "x", ""]
    got = [r[0] for r in rows_of(spark, values).orderBy("i").select(T.finite_score(F.col("t"))).collect()]
    assert got == [1.5, 0.0, 0.0, 0.0, -2.0, 0.0, 0.0, 0.0]
    budget = spark.createDataFrame([(None,), (0,), (-1,), (5,)], "n int").select(T.token_budget(F.col("n"))).collect()
    assert [r[0] for r in budget] == [20000, 20000, 20000, 5]


def test_authors(spark):
    values = ["  A \n Writer ", "x" * 81, "a b c d e f g h i", "", "a b c d e f g h"]
    got = [r[0] for r in rows_of(spark, values).orderBy("i").select(T.plausible_author(F.col("t"))).collect()]
    assert got == ["A Writer", None, None, None, "a b c d e f g h", None]
