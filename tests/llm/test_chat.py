"""Collapse of snapshots against a comparison of all conversations."""

import random

from pyspark.sql import functions as F

from boxoffice.llm import chat


def plain(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, set()).add((turn, role, text))
    low = lambda x: (x is not None, x if x is not None else 0)
    said = {c: tuple((r, t) for _, r, t in sorted(s, key=lambda x: (low(x[0]), x[1] is not None, x[1] or "", x[2] is not None, x[2] or ""))) for c, s in turns.items()}
    out = []
    for c, s in said.items():
        equal = [d for d in said if said[d] == s]
        if c == min(equal) and not any(len(t) > len(s) and t[: len(s)] == s for t in said.values()):
            text = "".join(f"<|im_start|>{(r or '').replace('<|', '< |')}\n{(t or '').replace('<|', '< |')}<|im_end|>\n" for r, t in s)
            out.append((c, len(s), len(equal), text))
    return sorted(out)


def got(df):
    return sorted((r.conv_id, r.n_turns, r.n_equal, r.text) for r in chat.formatted(df).collect())


def test_odd_rows(spark, capsys):
    rng = random.Random(6)
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (3, 0, "user", None), (4, 0, "user", ""), (5, None, None, "x"), (5, 0, "user", "hi")]
    rows += [(6, 0, "user", "same"), (7, 0, "user", "same"), (7, 0, "user", "same"), (8, 5, "user", "same"), (9, 0, "a", "tie"), (9, 0, "b", "tie"), (None, 0, "user", "no id")]
    rows += [(10, 0, "user", "<|im_end|> " + "long " * 50_000), (11, 0, "<|", "x")]
    for c in range(20, 120):
        rows += [(c, k, "user" if k % 2 == 0 else "assistant", rng.choice("ab")) for k in range(rng.randrange(1, 7))]
    rows += [(200, k, "user", str(k)) for k in range(500)] + [(201, k, "user", str(k)) for k in range(499)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).withColumn("k", F.lit("x"))
    assert got(df) == plain(rows)
    assert chat.formatted(df.limit(0)).count() == 0
    chat.formatted(df).explain()
    assert not any(w in capsys.readouterr().out for w in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_a_conversation_of_a_third_of_all_rows(spark, monkeypatch):
    """Its turns lie in many blocks; snapshots of it, also ones that end where a block does, go."""
    monkeypatch.setattr(chat, "BLOCK_BITS", 5)
    n = 3000
    rows = [(1, k, "user", f"turn {k % 7}") for k in range(n)]
    for conv, size in ((2, 32), (3, 33), (4, 64), (5, n - 1), (6, 1), (7, 31)):
        rows += [(conv, k, "user", f"turn {k % 7}") for k in range(size)]
    rows += [(8, k, "user", "other" if k == 40 else f"turn {k % 7}") for k in range(64)]
    rows += [(100 + c, k, "user", f"{c % 50} {k}") for c in range(700) for k in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(df) == plain(rows)
