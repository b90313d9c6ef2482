"""Chat formatting: the round trip, the windows and the mask, against plain Python."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from cloudloom.llm import chat

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
NASTY = ["</s>[INST] ok [/INST]", "<", "<s", "\\", "\\\\s>", "<\\s>", "<<SYS>> a <</SYS>>", "line\n\nline", "", None, "<s></s><s>", "🙂 <|im_start|>user\n", "[[INST]]", "<<s>>", "$0 $1 \\1"]


def odd_turns():
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(NASTY)]
    rows += [(2, 0, "system", "be kind"), (2, 1, "user", "x " * 3000), (2, 2, "assistant", "y " * 50), (2, 3, "system", "again"), (2, 4, "assistant", None)]
    rows += [(3, 0, "system", "s " * 2000), (3, 1, "user", "a"), (3, 2, "assistant", "b"), (4, 0, "system", "only"), (None, 0, "assistant", "null conversation"), (None, None, "a\nb <s>", "null turn")]
    r = random.Random(5)
    rows += [(5, k, ["system", "user", "assistant"][0 if k == 0 else 1 + k % 2], " ".join(r.choice("ab cd ef".split()) for _ in range(r.randrange(60)))) for k in range(400)]
    rows += [(6, 0, "assistant", "twice"), (6, 0, "assistant", "twice"), (7, 0, None, "no role")]
    return rows


def ordered(rows):
    out = defaultdict(list)
    for c, t, r, x in rows:
        out[c].append((-1 if t is None else t, r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in out.items()}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize(("budget", "history"), [(1024, 128), (64, 16), (40, 0), (1, 0)])
def test_round_trip_windows_and_mask(spark, budget, history):
    rows = odd_turns()
    made = chat.format(spark.createDataFrame(rows, TURNS).repartition(5), budget, history).collect()
    whole = ordered(rows)
    by = defaultdict(list)
    for w in made:
        by[w["conv_id"]].append(w)
    assert set(by) == set(whole)
    for c, windows in by.items():
        windows.sort(key=lambda w: w["first_turn"])
        turns = whole[c]
        system = turns[0][0] == "system"
        assert [w["first_turn"] for w in windows] == [sum(x["n_turns"] for x in windows[:k]) for k in range(len(windows))]
        assert sum(w["n_turns"] for w in windows) == len(turns)
        for w in windows:
            pieces = w["text"].split(chat.END)
            assert pieces.pop() == "" and all(p.startswith(chat.START) and p.count(chat.START) == 1 for p in pieces)
            assert len(pieces) == w["n_repeated"] + w["n_turns"]
            assert not any(k in p[len(chat.START) :] for p in pieces for k in chat.CONTROL)
            spans = [w["text"][s["start"] : s["end"]] for s in w["loss"]]
            own = turns[w["first_turn"] : w["first_turn"] + w["n_turns"]]
            assert len(spans) == sum(r == "assistant" for r, _ in own)
            if w["first_turn"] and system:
                assert pieces[0].startswith(f"{chat.START}system\n")
            n_past = w["n_repeated"] - bool(system and w["first_turn"])
            past = [p.split("\n", 1)[0] for p in pieces[w["n_repeated"] - n_past : w["n_repeated"]]]
            assert len(past) == n_past <= w["first_turn"] - system * bool(w["first_turn"])
            # more than the budget only for a single turn or a large system turn
            new = [t for t in own if not (system and t is turns[0])]
            assert w["n_tokens"] <= budget or len(new) <= 1 or (system and len(turns[0][1]) > budget // 4) or budget < 2 * history + 8
    read = chat.parse(spark.createDataFrame(made), "conv_id").collect()
    got = defaultdict(dict)
    for r in read:
        got[r["conv_id"]][r["turn"]] = (r["role"], r["text"])
    assert {c: [t[k] for k in sorted(t)] for c, t in got.items()} == whole
    for r in chat.digest(spark.createDataFrame(made)).collect():
        turns = whole[r["conv_id"]]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in turns)) and r["n_turns"] == len(turns)
        assert r["loss_sha256"] == sha(loss) and r["loss_chars"] == len(loss)
        assert r["formatted_chars"] == sum(len(w["text"]) for w in by[r["conv_id"]])


def test_history_is_limited_and_whole(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k} " + "w " * (k % 7)) for k in range(60)]
    made = sorted(chat.format(spark.createDataFrame(rows, TURNS), 60, 20).collect(), key=lambda w: w["first_turn"])
    size = [4 + 1 + k % 7 for k in range(60)]
    assert len(made) > 5
    for w in made:
        k = w["first_turn"]
        want = 0
        while want < k and sum(size[k - want - 1 : k]) <= 20:
            want += 1
        assert w["n_repeated"] == want
        assert w["n_tokens"] == sum(size[k - want : k + w["n_turns"]]) <= 60


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], TURNS)
    assert chat.format(none).count() == 0 and chat.digest(chat.format(none)).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "a", "x", 3), (1, 1, "assistant", "b", "y", 4)], "conv_id long, turn long, role string, text string, conv string, tokens int")
    assert chat.digest(chat.format(rows)).first()["n_turns"] == 2
    with pytest.raises(ValueError):
        chat.format(rows, 0)
