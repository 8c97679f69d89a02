"""Conversation repair against a plain search over edits, in one block and in very small blocks."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from loamworks.llm import common, conversations

SCHEMA = "conv_id long, turn long, role string, text string, whole string"
BLANKS = " \t\n\x0b\x0c\r"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def plain(rows):
    """The contract, by a search over states turn by turn; ``rows``: (turn, role, text) after damage, in order."""
    seen, kinds = set(), []
    for _, role, text in rows:
        bare = text.rstrip(BLANKS)
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {0: (0, "", [])}
    for (_, role, text), kind in zip([*rows, (None, None, None)], [*kinds, None], strict=True):
        opened = dict(best)
        for state, (c, a, out) in best.items():
            for _ in range(3):
                new = "assistant" if state == 2 else "user"
                state, c, a, out = STEP[state, new[0]], c + 5, a + "I", [*out, new + ":"]
                opened[state] = min(opened.get(state, (10**9, "")), (c, a, out), key=lambda x: x[:2])
        if kind is None:
            cost, audit, out = min((x for s, x in opened.items() if s in (0, 3)), key=lambda x: x[:2])
            break
        following = {}
        more = 5 if kind == "truncated" else 0
        for state, (c, a, out) in opened.items():
            ways = [(state, c + 2, a + "D", out)]
            if kind in ("", "truncated"):
                ways += [(STEP[state, x[0]], c + cost + more, a + e, [*out, f"{x}:{text}"]) for x, cost, e in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")) if (state, x[:1]) in STEP]
            for s, *w in ways:
                following[s] = min(following.get(s, (10**9, "")), tuple(w), key=lambda x: x[:2])
        best = following
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    text = "\n".join(out)
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), text


def hurt(rows):
    out = []
    for conv, turn, role, text, _ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def some(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "", " \t", "What?", "Run! ", "a. b", None, "été.\n", "end.\x0b"]
    rows = []
    for c in [*range(convs), None]:
        for t in range(rng.randint(1, most)):
            turn = rng.choice([t, t, t, t + 1, t // 2, None]) if rng.random() < 0.3 else t
            rows.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.randrange(9**9)}.", "x"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("batch", "fan"), [(1000, 12), (3, 1)])
def test_digests_equal_a_plain_search(spark, monkeypatch, batch, fan):
    monkeypatch.setattr(common, "BATCH_ROWS", batch)
    rows = some(5, 40, 14) + [(77, t, "user" if t % 3 else "assistant", f"Turn {t}.", "x") for t in range(120)] + [(78, 1, "user", "Same.", None)] * 60
    d = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.digests(spark, d, conversations.damaged(d), fan).collect()}
    after = hurt(rows)
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        assert got[conv] == plain(order([r[1:] for r in after if r[0] == conv]))[0], conv


def test_repaired_turns_are_legal_and_say_their_edits(spark, monkeypatch):
    monkeypatch.setattr(common, "BATCH_ROWS", 4)
    rows = some(8, 25, 9)
    d = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for r in conversations.repaired(spark, d).collect():
        out.setdefault(r["conv_id"], []).append(r)
    for conv in {r[0] for r in rows}:
        here = order([(t, " " if a is None else a, " " if b is None else b) for c, t, a, b, _ in rows if c == conv])
        (*_, audit, _), text = plain(here)
        mine = sorted(out.get(conv, []), key=lambda r: r["position"])
        assert "\n".join(f"{r['role']}:{r['text']}" for r in mine) == text
        assert "".join(r["edit"] for r in mine) == audit.replace("D", "")
        assert all((r["turn"] is None and r["text"] == "") or r["edit"] != "I" for r in mine)


def test_products_are_associative_and_audits_least():
    costs, ranks, audits = conversations._kinds()
    rng = np.random.default_rng(3)
    for _ in range(50):
        kinds = rng.integers(0, 16, 9)
        a = conversations.reduced(costs[kinds], ranks[kinds], np.array([0]))[:2]
        left = (costs[kinds[:1]], ranks[kinds[:1]])
        for k in kinds[1:]:
            left = conversations.product(left, (costs[[k]], ranks[[k]]))[:2]
        assert (a[0] == left[0]).all()
        reach = a[0][0] < conversations._FAR
        x, y = a[1][0][reach], left[1][0][reach]
        assert ((x[:, None] < x) == (y[:, None] < y)).all()


def test_a_very_long_text_and_empty_tables(spark):
    long = "word " * 600_000 + "end."
    rows = [(1, 0, "user", long, None), (1, 1, "assistant", long, None), (1, 2, "user", "And?", None), (1, 3, "assistant", "x" * 3_000_000 + "!", None)]
    d = spark.createDataFrame(rows, SCHEMA)
    (r,) = conversations.digests(spark, d, d).collect()
    assert r["audit"] == "KKKK" and r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{t}" for _, _, a, t, _ in rows).encode()).hexdigest()
    none = d.limit(0)
    assert conversations.digests(spark, none, none).collect() == [] and conversations.repaired(spark, none).collect() == []
    (r,) = conversations.digests(spark, d, none).collect()
    assert (r["audit"], r["cost"], r["repaired_sha256"]) == ("", 0, hashlib.sha256().hexdigest())
