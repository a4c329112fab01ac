import itertools
import random

import pytest

from tessera.llm import chat as H


def brute(roles, c):
    """Least cost over all ways to give each turn a role or merge it, with empty turns wherever needed."""
    best = {H.START: 0}
    for role in roles:
        after = {}
        for s, paid in best.items():
            for t in range(4):
                for k in range(4):
                    for ways in itertools.product(range(4), repeat=k):
                        seq = [s, *ways, t]
                        if all(b in H.FOLLOWS[a] for a, b in zip(seq, seq[1:])):
                            r = H.role_number(role)
                            cost = paid + c.insert * k + (0 if r == t else c.unknown if r is None else c.relabel)
                            after[t] = min(after.get(t, cost), cost)
            if s != H.START:
                r = H.role_number(role)
                cost = paid + c.merge + (0 if r == s else c.unknown if r is None else c.relabel)
                after[s] = min(after.get(s, cost), cost)
        best = after
    return min(paid + H.end_cost(s, c) for s, paid in best.items())


@pytest.mark.parametrize("costs", [H.Costs(), H.Costs(1, 1, 1, 1), H.Costs(5, 2, 0, 4)])
def test_least_cost(costs):
    for n in (1, 2, 3):
        for roles in itertools.product(["system", "user", "assistant", "tool", None], repeat=n):
            blocks = [H.block_costs([r], costs) for r in roles]
            ahead = H.costs_ahead(blocks, costs)
            steps = H.repair(list(roles), H.START, ahead[-1], costs)
            assert sum(x[3] for x in steps) + H.end_cost(steps[-1][1], costs) == ahead[0][H.START] == brute(roles, costs)
            s, parts = H.START, []
            for r, after in zip(roles, ahead[1:], strict=True):  # block by block: the same choices
                parts += H.repair([r], s, after, costs)
                s = parts[-1][1]
            assert parts == steps


def legal(text):
    roles = [part.split("\n")[0] for part in text.split("<|im_start|>")[1:]]
    seq = [H.START, *map(H.ROLES.index, roles)]
    return all(b in H.FOLLOWS[a] for a, b in zip(seq, seq[1:])) and seq[-1] == H.LAST


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "user", "again"), (1, 2, "assistant", "yes"), (2, 0, "assistant", "first"), (2, 1, "system", "late"), (2, 2, "user", None),
    (3, 0, "weird", "x"), (4, 1, "user", "tie a"), (4, 1, "assistant", "tie b"), (4, None, "user", "no turn"), (None, 0, "user", "no id"), (None, None, None, None),
    (5, 0, "Human", "q"), (5, 1, "gpt", "a"), (1, 2, "assistant", "yes"),
] + [(9, i, ("user", "assistant", "assistant", "tool")[i * 7 % 4], f"t{i}") for i in range(200)]


@pytest.mark.parametrize("partitions", [1, 13])
def test_conversations(spark, partitions):
    df = spark.createDataFrame([(*r, 1, "z") for r in ROWS], "conv_id long, turn long, role string, text string, cost int, block string")
    out = H.format_turns(df, partitions=partitions).collect()
    assert len(out) == len(ROWS)
    by = {}
    for r in sorted(out, key=lambda r: r.seq):
        by.setdefault(r.conv_id, []).append(r)
    assert set(by) == {r[0] for r in ROWS}
    for rows in by.values():
        assert [r.seq for r in rows] == list(range(len(rows))) and legal("".join(r.rendered for r in rows))
    assert "".join(r.rendered for r in by[5]) == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert "".join(r.rendered for r in by[1]).startswith("<|im_start|>user\nhi\nagain<|im_end|>\n<|im_start|>assistant\nyes\nyes<|im_end|>")
    for k in (1, 2, 3, 9):
        assert sum(r.cost for r in by[k]) == brute([r.role_in for r in by[k]], H.Costs())
    assert H.format_turns(df.limit(0)).count() == 0


def test_partitions_and_blocks_make_no_difference(spark, monkeypatch):
    r = random.Random(5)
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "bot", None, "odd"]
    rows = [(c, t, r.choice(roles), f"{c}.{t}") for c in [*range(60), None] for t in range(r.choice((1, 2, 3, 9)))] + [(70, t, r.choice(roles), "") for t in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = None
    for partitions, turns, chars in ((1, 20_000, 1 << 20), (7, 20_000, 1 << 20), (3, 16, 1 << 20), (2, 20_000, 12), (40, 5, 40)):
        monkeypatch.setattr(H, "BLOCK_TURNS", turns)
        monkeypatch.setattr(H, "BLOCK_CHARS", chars)
        got = sorted(map(tuple, H.format_turns(df, partitions=partitions).collect()), key=str)
        want = want or got
        assert got == want and len(got) == len(rows)


def test_a_very_long_turn(spark):
    text = "long " * 2_000_000
    out = H.format_turns(spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "ok"), (2, 0, "user", "x")], "conv_id long, turn long, role string, text string"))
    assert [r.rendered.replace(text, "L") for r in out.where("conv_id = 1").orderBy("seq").collect()] == ["<|im_start|>user\nL", "<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n"]


def test_table(spark, sf):
    out = H.op9_chat(spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/conversations.parquet").count()
