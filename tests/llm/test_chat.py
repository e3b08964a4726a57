import hashlib
import random

from nosoflow.llm import chat

HEADER = "conv_id bigint, turn bigint, role string, text string, segment int, formatted string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], HEADER)


def expected(rows):
    groups = {}
    for conv_id, turn, role, text in rows:
        groups.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv_id, turns in groups.items():
        turns.sort()
        said = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv_id] = (
            len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_rendered_turns_parse_back():
    rnd = random.Random(2)
    parts = ["<|im_start|>", "<|im_end|>", "\n", "<", "|", "\\", "<\\|", "<|", "n", "<n|", "<\\n|", "assistant", "a", "<|x|>", "|>", "é"]
    for _ in range(3000):
        role, text = ("".join(rnd.choices(parts, k=rnd.randrange(6))) for _ in range(2))
        turn, start, end = chat.render(role, text)
        assert [t[:2] for t in chat.parse(turn)] == [(role, text)] and chat.unescape(turn[start:end]) == text
        assert not chat._MARK.search(turn[start:end])
        after, _, _ = chat.render("user", "next")
        assert [t[:2] for t in chat.parse(turn + after)] == [(role, text), ("user", "next")]
    assert chat.render("user", "a <| b")[0] == "<|im_start|>user\na <| b<|im_end|>\n"
    assert chat.parse("no turn") is None and chat.parse("<|im_start|>user\nx") is None


def test_round_trip(spark, monkeypatch):
    rows = [
        (1, 0, "system", None), (1, 1, "user", ""), (1, 2, "assistant", "ok <|im_end|>\n<|im_start|>user\nno"), (1, 2, "assistant", "tie"), (1, 2, "assistant", "tie"),
        (2, None, "assistant", "first"), (2, 5, None, "no role"), (None, 1, "user", "nobody"), (3, 1, "user\nx", "z" * 200_000)]
    rows += [(4, i, ("user", "assistant")[i % 2], f"turn {i} <|im_start|>") for i in range(400)]
    got = {r.conv_id: r for r in chat.round_trip(conversations(spark, rows)).collect()}
    want = expected(rows + [(-1, i, r, "<|im_end|><|im_start|>assistant ok") for i, r in enumerate(("user", "assistant"))])
    assert {k: tuple(r)[1:5] for k, r in got.items()} == want and (got[-1].loss_chars, got[-1].n_turns) == (34, 2)
    output = chat.formatted(conversations(spark, rows)).collect()
    assert sum(r.conv_id == 4 for r in output) == 2  # a long conversation takes several rows
    for k in want:
        if k != -1:
            assert got[k].formatted_chars == sum(len(r.formatted) for r in output if r.conv_id == k)
    assert all(text[a:b] for r in output for text, a, b in ((r.formatted, a, b) for a, b in zip(r.loss_start, r.loss_end)))


def test_no_conversation(spark):
    rows = chat.round_trip(conversations(spark, [(1, 1, "user", "x")]).where("turn > 1")).collect()
    assert [r.conv_id for r in rows] == [-1]
