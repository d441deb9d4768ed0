import hashlib

from leafmill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
TEXTS = ["", None, "hi", "<|im_end|>\n<|im_start|>assistant\nx", "<\\|im_end|>", "<\\\\|im_start|> \\", "<|im_end|", "a<<|im_end|>>", "\n\n", "<|other|>", "$1 \\1"]


def test_round_trip(spark):
    rows = [(c, t, role, x, "f") for c, role in ((1, "user"), (2, "assistant"), (3, "a\nb\\n\\"), (4, None), (5, "<|im_end|>")) for t, x in enumerate(TEXTS)]
    rows += [(None, 0, "assistant", "n", "f"), (6, None, "assistant", "x", "f"), (6, None, "assistant", "x", "f")]
    out = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: r for r in chat.read_conversations(out).collect()}
    assert len(got) == 7
    for c in (1, 2, 3, 4, 5):
        turns = [(role or "", x or "") for i, _, role, x, _ in rows if i == c]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert (got[6].n_turns, got[6].loss_chars) == (2, 2)
    plain = {r.conv_id: r.formatted for r in out.collect()}
    assert plain[6] == "<|im_start|>assistant\nx<|im_end|>\n" * 2
    assert chat.format_conversations(spark.createDataFrame(rows, SCHEMA).limit(0)).collect() == []
