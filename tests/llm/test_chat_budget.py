"""Windows of conversations against a plain walk, and every window against its budget."""

import random

import pytest

import __spark_entry__
from heron.llm import chat

TURN = "conv_id long, turn long, role string, text string"


def plain(turns, new, history):
    """Windows of one conversation (role, text): what each holds, as (again, role, text)."""
    cost = [len(t.split()) + chat.MARKS for _, t in turns]
    at = [sum(cost[:k]) for k in range(len(turns))]
    begins, used = [], new
    for k, c in enumerate(cost):
        if used + c > new:
            begins.append(k)
            used = 0
        used += c
    head = next((k for k, (r, _) in enumerate(turns) if r == "system"), None)
    out = []
    for w, b in enumerate(begins):
        end = begins[w + 1] if w + 1 < len(begins) else len(turns)
        room = history - (cost[head] if head is not None else 0)
        again = {k for k in range(b) if at[b] - at[k] <= room} | ({head} if head is not None and head < b else set())
        out.append([(True, *turns[k]) for k in sorted(again)] + [(False, *turns[k]) for k in range(b, end)])
    return out


def talks():
    r = random.Random(8)
    out = {}
    for c in range(60):
        turns = [("system", "s " * r.choice([1, 5, 60, 200]))] if r.random() < 0.6 else []
        for k in range(r.choice([1, 2, 9, 40])):
            turns.append((["user", "assistant"][k % 2], "w " * r.choice([0, 1, 3, 20, 90, 379, 380, 381, 900])))
            if r.random() < 0.03:
                turns.append(("system", "late"))
        out[c] = [(a, b.strip()) for a, b in turns]
    return out


@pytest.mark.parametrize("fold", [256, 3, 0])
@pytest.mark.parametrize("new,history", [(384, 128), (50, 30)])
def test_windows(spark, monkeypatch, fold, new, history):
    monkeypatch.setattr(chat, "FOLD", fold)
    talk = talks()
    rows = [(c if c else None, k, r, t) for c, turns in talk.items() for k, (r, t) in enumerate(turns)]
    made = chat.windows(spark.createDataFrame(rows, TURN).repartition(4), new, history)
    got = {}
    for r in chat.read_turns(made).orderBy("window", "place").collect():
        got.setdefault(r["conv_id"] or 0, {}).setdefault(r["window"], []).append((r["again"], r["role"], r["text"]))
    assert {c: [w for _, w in sorted(ws.items())] for c, ws in got.items()} == {c: plain(turns, new, history) for c, turns in talk.items()}
    for c, windows in got.items():
        longest = max((len(t.split()) + chat.MARKS for r, t in talk[c] if r == "system"), default=0)
        for w in windows.values():
            own = [len(t.split()) + chat.MARKS for again, _, t in w if not again]
            repeated = sum(len(t.split()) + chat.MARKS for again, _, t in w if again)
            assert sum(own) <= new or len(own) == 1
            assert repeated <= max(history, longest)


def test_a_long_conversation(spark):
    turns = [(["user", "assistant"][k % 2], "w " * (k * 37 % 150)) for k in range(3000)]
    rows = [(5, k, r, t.strip()) for k, (r, t) in enumerate(turns)]
    made = chat.windows(spark.createDataFrame(rows, TURN))
    want = plain([(r, t) for _, _, r, t in rows], chat.NEW_TOKENS, chat.HISTORY_TOKENS)
    got = {}
    for r in chat.read_turns(made).orderBy("window", "place").collect():
        got.setdefault(r["window"], []).append((r["again"], r["role"], r["text"]))
    assert [w for _, w in sorted(got.items())] == want


def test_every_window_of_the_table_keeps_its_budget(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    own = chat.read_turns(chat.windows(turns)).filter("not again").selectExpr("conv_id", "window", "size(filter(split(text, '\\\\s+'), w -> w <> '')) + 4 as n")
    over = own.groupBy("conv_id", "window").agg({"n": "sum", "*": "count"}).filter("`sum(n)` > 384 and `count(1)` > 1")
    assert over.count() == 0


def test_query_and_sql(spark, same_as_oracle):
    name = "op3_chat_formatting"
    same_as_oracle(__spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name])
