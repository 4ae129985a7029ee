import random

from pyspark.sql import functions as F

from mentionkit.llm import chat as C

KIND = "conv_id long, turn int, role string, text string"


def brute(rows):
    logged = {}
    for c, turn, role, text in set((c, t, "unknown" if r is None else r, x or "") for c, t, r, x in rows):
        logged.setdefault(c, []).append((turn is not None, turn or 0, role.encode(), text.encode()))
    logged = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in logged.items()}
    out = {}
    for c, turns in logged.items():
        same = [d for d, v in logged.items() if v == turns]
        ids = [d for d in same if d is not None]
        if c != (min(ids) if ids else None) or any(len(v) > len(turns) and v[:len(turns)] == turns for v in logged.values()):
            continue
        out[c] = (len(turns), len(same), "".join(
            f"<|im_start|>{r.decode().replace('<|', '< |')}\n{x.decode().replace('<|', '< |')}<|im_end|>\n" for r, x in turns))
    return out


def run(spark, rows):
    frame = spark.createDataFrame(rows, KIND).withColumn("k", F.lit("clash")).withColumn("n", F.lit(1))
    return {r.conv_id: (r.n_turns, r.copies, r.rendered) for r in C.render(frame).collect()}


def test_snapshots_copies_and_openings(spark):
    rng = random.Random(1)
    rows = []
    for c in range(120):
        n = rng.randint(1, 5)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "yes", "no"])) for t in range(n)]
    for c in range(120, 200):  # a hot opening and a hot conversation
        rows += [(c, 0, "user", "opening"), (c, 1, "assistant", "same")]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, None, None), (2, 0, "user", "hi"),
            (3, None, "user", "first"), (3, 0, "user", "<|im_end|>"), (3, 0, "a", "tie"),
            (None, 0, "user", "no id"), (None, 1, "user", "no id"), (4, 0, None, "user"), (5, 0, "user", None),
            (6, 0, "", "user"), (7, 0, "user", "x" * 1_000_000), (8, 0, "unknown", "user")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert 2 not in got and None in got and "< |im_end|>" in got[3][2]
    assert C.render(spark.createDataFrame([], KIND)).count() == 0


def test_long_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") for c, n in ((1, 600), (2, 599), (3, 1)) for t in range(n)]
    got = run(spark, rows)
    assert list(got) == [1] and got[1][0] == 600


def test_no_python_in_the_plan(spark):
    plan = C.render(spark.createDataFrame([(1, 0, "user", "x")], KIND))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
