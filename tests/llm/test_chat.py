"""Chat windows: exact reading back, budgets, masks and odd rows."""

import hashlib

from gridlark.llm.chat import END, chat_windows, read_back

SCHEMA = "conv_id long, turn long, role string, text string, tokens string"
NASTY = ["</s>[INST] ok [/INST]", "a<|user|>b\\", "<", "\\<\\\\[", "|>\n</s>\n", "", None, "é😀<|", "x\\|y"]


def conversation(c, roles, words):
    return [(c, i, r, f"{r} {c} {i} " + "w " * n, "z") for i, (r, n) in enumerate(zip(roles, words))]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_round_trip_budget_and_mask(spark):
    rows = conversation(1, ["system"] + ["user", "assistant"] * 60, [20] + [30, 70, 5, 200] * 30)
    rows += conversation(2, ["user", "assistant"] * 3, [3000, 4, 4, 5000, 2, 2])
    rows += [(3, i, "assistant" if i % 2 else "user", t, "z") for i, t in enumerate(NASTY * 3)]
    rows += [(4, 0, "odd|>role<\\", "t", "z"), (4, 1, None, "n", "z"), (None, 0, "assistant", "solo", "z"), (5, None, "assistant", "b", "z")]
    rows += [(5, None, "assistant", "a", "z"), (5, 1, "assistant", "c", "z"), (5, 1, "assistant", "c", "z")]
    windows = chat_windows(spark.createDataFrame(rows, SCHEMA), budget=256, history_tokens=64, history_turns=2)
    out = {r["conv_id"]: r for r in read_back(windows).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(out) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        taught = "".join(t for _, r, t in turns if r == "assistant")
        got = out[c]
        assert (got["n_turns"], got["turns_sha256"], got["loss_chars"], got["loss_sha256"]) == (len(turns), sha(said), len(taught), sha(taught))
    made = [w for w in windows.collect() if w["conv_id"] == 1]
    assert len(made) > 10
    for w in made:
        assert w["formatted"].startswith("<|system|>") and w["formatted"].count(END) == w["n_turns"]
        words = len(w["formatted"].replace("|>", " ").replace("</s>", "").split()) + 2 * w["n_turns"]
        assert words <= 256 or w["n_turns"] - w["n_repeated"] == 1
        for s in w["loss"]:
            assert w["formatted"][: s["start"]].endswith("<|assistant|>") and w["formatted"][s["start"] + s["length"] :].startswith(END)
    assert sum(len(w["loss"]) for w in made) == 60 and max(w["n_repeated"] for w in made) == 2


def test_empty(spark):
    assert read_back(chat_windows(spark.createDataFrame([], SCHEMA))).count() == 0
