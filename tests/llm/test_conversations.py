from tessera.llm import conversations as C


def test_collapse(spark):
    a = [("system", "s"), ("user", "hi"), ("assistant", "yo"), ("user", "bye")]
    logs = {1: a[:2], 2: a[:3], 3: a, 4: a, 5: [("user", "hi")], 6: a[:1] + [("user", "ho")], 7: [("user", None), (None, "x")]}
    rows = [(k, i, r, t, "extra") for k, turns in logs.items() for i, (r, t) in enumerate(turns)] + [(8, 0, "user", "dup", "e"), (8, 0, "user", "dup", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chat string").repartition(3)
    got = {r.conv_id: r for r in C.format_chats(df).collect()}
    assert set(got) == {3, 5, 6, 7, 8}
    assert got[3].n_copies == 2 and got[3].n_turns == 4
    assert got[3].chat == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in a)
    assert got[7].chat == "<|im_start|>user\n<|im_end|>\n<|im_start|>\nx<|im_end|>\n"
    assert got[8].n_turns == 2
    assert C.format_chats(df.limit(0)).count() == 0


def test_native_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = C.format_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_null_ids_and_turns(spark):
    """Rows with a null conv_id are one conversation; a null turn comes first; a long turn is kept whole; the same text under other names too."""
    long = "x" * 200_000
    rows = [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (3, None, "system", "first"), (3, 0, "user", long), (4, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in C.format_chats(df).collect()}
    assert set(got) == {None, 3}
    assert got[None].n_turns == 2 and got[None].chat.startswith("<|im_start|>user\na")
    assert got[3].chat == f"<|im_start|>system\nfirst<|im_end|>\n<|im_start|>user\n{long}<|im_end|>\n"
