"""The chunker and the ranking against small models."""

import math
import random
import re

from pyspark.sql import functions as F

from veritext.operators import passages as R


def model_chunks(md):
    out, heading, lines, offset, pos = [], None, [], 0, 0
    for raw in [*md.splitlines(keepends=True), ""]:
        line = raw.rstrip("\n")
        is_head = re.match(r"#{1,6}\s+", line) is not None
        if not line.strip() or is_head:
            if lines:
                out.append((heading, offset, "\n".join(lines)))
                lines = []
            if is_head and line.strip():
                heading = re.sub(r"^#{1,6}\s+", "", line).strip()[:200]
        else:
            if not lines:
                offset = pos
            lines.append(line)
        pos += len(raw)
    return out


def test_chunks(spark):
    r = random.Random(5)
    parts = ["# Head\n", "## \n", "#no\n", "####### seven\n", "text a\n", "b\r\n", "\n", " \t\n", "c", "# tail  \n", "d\x0be\n", "\x85f"]
    docs = ["", "# only", "x", "# " + "h" * 300 + "\nbody", *["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(200)]]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, md string")
    got = {}
    for x in R.chunk_table(df, "id", "md").collect():
        got.setdefault(x.id, []).append((x.pos, x.heading, x.offset, x.text))
    for i, d in enumerate(docs):
        assert [(h, o, t) for _, h, o, t in sorted(got.get(i, []))] == model_chunks(d), d


def model_scores(texts, query):
    tok = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    mean = sum(map(len, tok)) / len(tok) or 1.0
    out = []
    for d in tok:
        s = 0.0
        for q in re.findall("[a-z0-9]+", query.lower()):
            df, f = sum(q in x for x in tok), d.count(q)
            if f:
                s += math.log(1 + (len(tok) - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(d) / mean))
        out.append(s)
    return out


def test_scores_and_budget(spark):
    texts = ["cats eat fish", "dogs eat", "the cats and the cats", "", "été cat's", "fish fish fish"]
    df = spark.createDataFrame([(i, t, f"h{i}", i * 10) for i, t in enumerate(texts)], "pos int, text string, heading string, offset int").withColumn("id", F.lit(1))
    got = {r.pos: r.score for r in R.bm25(df, "cats fish cats").collect()}
    want = model_scores(texts, "cats fish cats")
    assert all(abs(got[i] - w) < 1e-9 for i, w in enumerate(want))
    scored = R.bm25(df, "cats fish cats", ["id"])
    order = sorted((i for i in range(len(texts)) if want[i] > 0), key=lambda i: (-want[i], i))
    for tokens in (1, 5, 8, 100):
        used, keep = 0, []
        for i in order:
            if keep and used + len(texts[i]) + 2 > tokens * 4:
                break
            keep.append(i)
            used += len(texts[i]) + 2
        best = R.admitted(scored, tokens, ["id"], [F.col("pos")])
        rows = best.orderBy("rank").collect()
        assert [r.pos for r in rows] == keep
        assert all(r.truncated == (len(keep) < len(order)) for r in rows)
        body = R.in_reading_order(best, "id").first()
        assert body.body == "\n\n".join(texts[i] for i in sorted(keep))
    assert R.bm25(df, "zebra").where("score > 0").count() == 0


def test_one_budget_needs_few_chunks(spark):
    """Under one budget for all, only as many chunks as could fit reach the window."""
    from pyspark.sql import functions as F

    from veritext.operators import passages as R

    scored = spark.range(5000).select("id", F.lit("x").alias("text"), (F.col("id") % 7 + 1.0).alias("score"))
    best = R.admitted(scored, 30, [], [F.col("id")])
    assert "TakeOrderedAndProject" in best._jdf.queryExecution().executedPlan().toString()
    got = [r.id for r in best.orderBy("rank").collect()]
    assert got == [6 + 7 * i for i in range(40)] and best.first().truncated
    assert not R.admitted(scored.limit(3), 30, [], [F.col("id")]).first().truncated
