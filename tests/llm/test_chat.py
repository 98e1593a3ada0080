import hashlib

from eventloom.llm import chat

ROWS = [
    (1, 0, "system", "be brief"),
    (1, 1, "user", "hi <|end|>\n there"),
    (1, 2, "assistant", "</s>[INST] ok [/INST]"),
    (1, 3, "user", None),
    (1, 4, "assistant", "<⁠|x|> fin\n"),
    (2, 0, "user", "no reply"),
    (3, 0, "assistant", ""),
    (3, 0, "assistant", ""),
    (None, 0, None, "lost"),
    (4, 0, "user", "q"),
    (4, 1, "assistant", "é😀" * 300),
    (4, 2, "user", "bye"),
]
SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_digests_match_the_input(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA)
    got = {r["conv_id"]: r for r in chat.digests(chat.prefix_targets(df)).collect()}
    for conv in {r[0] for r in ROWS}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in ROWS if r[0] == conv))
        said = "".join(t for _, role, t in turns if role == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for _, role, t in turns))
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(said), sha(said))


def test_examples_end_with_the_trained_reply(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], SCHEMA)
    rows = chat.prefix_targets(df).where("conv_id = 1").orderBy("example").collect()
    assert len(rows) == 2
    for r in rows:
        assert r["formatted"][r["loss_start"] + r["loss_length"] :] == chat.END
    assert "</s>" not in rows[0]["formatted"] and "[INST]" not in rows[0]["formatted"]


def test_empty(spark):
    assert chat.digests(chat.prefix_targets(spark.createDataFrame([], SCHEMA))).count() == 0
