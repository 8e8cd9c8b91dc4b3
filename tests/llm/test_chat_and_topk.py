import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm.chat import conversation_digests, escaped, op3_prefix_targets, prefix_targets, unescaped
from threadloom.llm.topk import exact_top_k, integer_vectors, op4_columnar_top_k

TRICKY = ["", None, "</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\s>", "<", "</s", "[/INST", "a\nb", "é<s>\\n", "x" * 50000]


def brute_chat(rows):
    groups: dict = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        yield conv, len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_escapes_are_reversible_and_hide_marks(spark):
    df = spark.createDataFrame([(t or "",) for t in TRICKY], "t string").select("t", escaped(F.col("t")).alias("e")).withColumn("u", unescaped(F.col("e")))
    for r in df.collect():
        assert r.u == r.t
        assert not any(m in r.e for m in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_prefix_targets_of_odd_rows(spark):
    rows = [(1, i, "assistant" if i % 3 == 1 else "user", t) for i, t in enumerate(TRICKY)] + [(2, 0, None, None), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (2, None, "[INST]", "first"), (3, 5, "user", "alone"), (None, 1, "assistant", "no id")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    examples = prefix_targets(df)
    assert sorted((tuple(r)[:5] for r in conversation_digests(examples).collect()), key=str) == sorted(brute_chat(rows), key=str)
    found = [r for r in examples.collect() if r.conv_id == 2]
    assert [(r.example, r.n_turns) for r in sorted(found, key=lambda r: r.example)] == [(0, 3), (1, 4)]
    for r in found:
        assert r.formatted[r.loss_start : r.loss_end] == "b"
        assert r.formatted[r.loss_end :] == "</s>"
    assert conversation_digests(prefix_targets(df.limit(0))).count() == 0


def test_op3_is_native_and_whole(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", TRICKY[2]), (-1, 1, "assistant", TRICKY[2])]
    got = op3_prefix_targets(spark, sf_dir)
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(brute_chat(rows))
    assert "Python" not in got._jdf.queryExecution().toString()


def brute_top(rows, k):
    whole = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(64 * float(np.float32(x))) for x in v]
        if sum(x * x for x in ints) <= 9.2e18:  # scores are longs
            whole.append((i, ints))
    for n, (i, q) in enumerate(whole):
        if i % 20 or (i, q) in whole[:n]:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j) for j, c in whole if j != i)[:k]
        for rank, (s, j) in enumerate(scores, 1):
            yield i, rank, j, -s


@pytest.mark.parametrize("k", [1, 5, 200])
def test_top_k_of_odd_rows(spark, k):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=13)]) for i in range(0, 120)]
    rows += [(200 + i, [0.5] * 13) for i in range(30)]  # ties
    rows += [(260, None), (280, []), (300, [1.0, None]), (320, [float("nan")] * 13), (340, [float("inf")] * 13), (None, [1.0] * 13), (360, [1.0]), (20, rows[20][1]), (380, [1e30] * 13)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, v int, key string")
    got = exact_top_k(integer_vectors(df), F.col("vec_id") % 20 == 0, k=k, query_block=3, block=16, step=4)
    assert sorted(map(tuple, got.collect())) == sorted(brute_top(rows, k))
    assert exact_top_k(integer_vectors(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


def test_sql_of_top_k_on_odd_rows(spark, tmp_path):
    import duckdb

    from threadloom.llm.topk import OP4_SQL

    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(90)]
    rows += [(100, []), (101, []), (120, [0.5]), (140, None), (160, [1.0, None]), (180, [float("nan")]), (None, [1.0]), rows[20], rows[20], (40, [3.0, 1.0]), (7, [9.0] * 5), (7, [9.0] * 5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = sorted(db.execute(OP4_SQL).fetchall())
    assert sorted(map(tuple, op4_columnar_top_k(spark, f"file://{tmp_path}").collect())) == want == sorted(brute_top(rows, 20))


def test_repeated_rows_of_a_query_leave_its_candidates(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=32)]) for i in range(300)]
    rows += [rows[40]] * 150  # a third of all rows, in every block more than k
    rows += [(60, [2 * x for x in rows[60][1]])] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for block in (64, 4096):
        got = exact_top_k(integer_vectors(df), F.col("vec_id") % 20 == 0, k=20, block=block)
        assert sorted(map(tuple, got.collect())) == sorted(brute_top(rows, 20))


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**17 + i), float(-(2**17) + 3 * i), 0.25]) for i in range(0, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_top_k(integer_vectors(df), F.col("vec_id") % 20 == 0, k=7, step=1)
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    want = [(i, n, j, -s) for i, q in whole if i % 20 == 0 for n, (s, j) in enumerate(sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in whole if j != i)[:7], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_components_of_any_size_take_part_while_scores_fit_a_long(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.integers(-(10**7), 10**7, 24)]) for i in range(200)]  # scores beyond 2**53
    rows += [(200 + i, [3.0e7 + i / 64] + [0.0] * 23) for i in range(40)]  # scores that doubles can't tell apart
    rows += [(240, [4.0e7] + [0.25] * 23), (241, [300_000.0] * 24), (242, [-300_000.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    want = [(i, n, j, -s) for i, q in whole if i % 20 == 0 for n, (s, j) in enumerate(sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j) for j, c in whole if j != i)[:15], 1)]
    for block in (32, 4096):
        got = exact_top_k(integer_vectors(df), F.col("vec_id") % 20 == 0, k=15, block=block, step=4)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_op4_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, op4_columnar_top_k(spark, sf_dir).collect())) == sorted(brute_top(rows, 20))
