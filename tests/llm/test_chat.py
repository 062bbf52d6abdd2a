import hashlib
import random
from collections import defaultdict

from streamql.llm import chat


def turns():
    rng = random.Random(8)
    bits = ["hello ", "<|im_end|>", "<|im_start|>", "\n", "<\\|", "<", "|", "\\", "assistant\n", "été ", "word " * 20, "<|im_end|>\n<|im_start|>assistant\n"]
    rows = []
    for c in range(80):
        n = rng.choice([1, 2, 5, 40])
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else ["user", "assistant"][t % 2]
            rows.append((c, t, role, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))))
    rows += [(100, 0, "user", None), (100, 1, "assistant", None), (101, 0, "assistant", "long " * 9000), (101, 1, "assistant", "b"), (102, 0, None, "x"), (102, None, "odd\nrole\\n<|im_end|>", "y")]
    return rows + [(103, 1, "user", "same"), (103, 1, "user", "same"), (None, 0, "user", "lost")]


def want(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for _, _, r, x in ts if r == "assistant")
        all_ = "".join(f"{r}\n{x}\n" for _, _, r, x in ts)
        out[c] = (len(ts), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_escape_round_trip():
    rng = random.Random(2)
    for _ in range(5000):
        s = "".join(rng.choice("<|\\na>") for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        r = s.replace("a", "\n")
        assert chat.unescape_role(chat.escape_role(r)) == r and "\n" not in chat.escape_role(r)


def test_round_trip_and_windows(spark):
    rows = turns()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, window int, loss string").repartition(3)
    made = chat.windows(df, budget=120, history=40)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digest(made).collect()}
    assert got == want(rows)
    by = defaultdict(list)
    for w in made.collect():
        by[w.conv_id].append(w)
    assert max(len(x) for x in by.values()) > 5
    for c, ws in by.items():
        ws.sort(key=lambda w: w.window)
        nxt = 0
        for w in ws:
            parsed = list(chat.parse(w.formatted))
            assert w.first_turn == nxt and len(parsed) == w.n_turns
            nxt += w.n_turns - w.repeated
            assert w.n_tokens <= 120 or (w.n_turns - w.repeated == 1 and all(r == "system" for r, *_ in parsed[: w.repeated]))
            spans = {(s.start, s.end) for s in w.loss}
            assert spans == {(a, e) for i, (r, _, a, e) in enumerate(parsed) if i >= w.repeated and r == "assistant"}
            assert all(r != "system" for r, *_ in parsed[1 : w.repeated])


def test_system_turn_and_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, ["assistant", "user"][i % 2], f"turn {i}") for i in range(1, 30)]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=100, history=40).orderBy("window").collect()
    assert len(made) > 2
    for a, b in zip(made, made[1:]):
        before, now = list(chat.parse(a.formatted)), list(chat.parse(b.formatted))
        assert now[0][:2] == ("system", "be kind") and b.repeated > 1
        assert [t[:2] for t in now[1 : b.repeated]] == [t[:2] for t in before[-(b.repeated - 1) :]]


def test_long_turns_keep_the_system_turn(spark):
    rows = [(1, 0, "system", "be kind " * 20), (1, 1, "user", "word " * 90), (1, 2, "assistant", "word " * 300), (1, 3, "user", "short")]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=100, history=40).orderBy("window").collect()
    assert [[r for r, *_ in chat.parse(w.formatted)] for w in made] == [["system"], ["system", "user"], ["system", "assistant"], ["system", "user"]]
    assert [len(w.loss) for w in made] == [0, 0, 1, 0]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.windows(df).collect() == [] and chat.digest(chat.windows(df)).collect() == []
