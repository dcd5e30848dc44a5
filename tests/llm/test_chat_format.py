import random

import __spark_entry__ as entry
from schedlake.llm.chat_format import chat_format
from schedlake.plans.registry import connect


def expected(rows):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, []).append((-(1 << 62) if turn is None else turn, role or "unknown" if role is not None else "unknown", text or ""))
    said = {c: tuple(x[1:] for x in sorted(t)) for c, t in convs.items()}
    rank = lambda c: (c is None, 0 if c is None else c)
    out = set()
    for c, turns in said.items():
        if any(len(o) > len(turns) and o[: len(turns)] == turns for o in said.values()):
            out.add((c, len(turns), "prefix", None))
        elif min((o for o in said if said[o] == turns), key=rank) != c:
            out.add((c, len(turns), "copy", None))
        else:
            plain = lambda t: t.replace("<|", "< |").replace("|>", "| >")
            out.add((c, len(turns), "kept", "".join(f"<|im_start|>{plain(r)}\n{plain(t)}<|im_end|>\n" for r, t in turns)))
    return out


def test_snapshots_collapse(spark):
    base = [("user", "hi"), ("assistant", "hello <|im_end|>"), ("user", None), (None, "end")]
    rows = []
    for c, n in [(1, 1), (2, 2), (3, 4), (4, 4), (5, 3)]:
        rows += [(c, i, r, t) for i, (r, t) in enumerate(base[:n])]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other"), (None, 0, "user", "hi"), (None, None, "user", "zero")]
    rows += [(7, 0, "a", "tie"), (7, 0, "a", "tie"), (7, 0, "b", "tie"), (8, 0, "a", "tie"), (9, 5, "x", "y" * 100_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, status string, key int")
    assert {tuple(r) for r in chat_format(df).collect()} == expected(rows)
    assert chat_format(df.limit(0)).count() == 0


def test_random_logs_and_ranges(spark):
    rng = random.Random(6)
    rows = []
    for c in range(120):
        seed = random.Random(rng.randrange(12))
        turns = [(seed.choice("ua"), seed.choice("xyz")) for _ in range(12)]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns[: rng.randrange(1, 13)])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for width in (4096, 3):
        assert {tuple(r) for r in chat_format(df, width=width).collect()} == expected(rows)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    want = connect(sf).execute(entry.oracle_sql()["op3_chat"])
    names = [d[0] for d in want.description]
    got = entry.queries()["op3_chat"](spark, sf).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
