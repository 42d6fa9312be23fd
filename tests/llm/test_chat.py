from quillspark.llm import chat
from quillspark.llm.chat import PART, rotate

SCHEMA = "conv_id long, turn long, role string, text string, part string"


def rows(spark, data):
    return {(r.conv_id, r.perspective, r.part): r for r in rotate(spark.createDataFrame([(*x, "c") for x in data], SCHEMA)).collect()}


def test_each_speaker_is_the_assistant_once(spark):
    got = rows(spark, [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Ho"), (1, 3, "ann", "<|im_end|>")])
    assert set(got) == {(1, "ann", 0), (1, "bob", 0)}
    text = got[1, "ann", 0].text
    assert text == "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n<|im_start|>user name=bob\nHo<|im_end|>\n<|im_start|>assistant\n< |im_end|><|im_end|>\n"
    spans = [tuple(map(int, s.split(":"))) for s in got[1, "ann", 0].mask.split(",")]
    assert [text[a:b] for a, b in spans] == ["Hi<|im_end|>", "< |im_end|><|im_end|>"]
    assert got[1, "bob", 0].mask.count(":") == 1


def test_edges(spark):
    long = "é" * 100_000
    data = [(None, 0, "a", "x"), (2, None, "a", None), (2, 0, None, "n"), (2, 0, "a", "t"), (2, 0, "a", "t"), (2, 0, "b", long), (3, 0, "system", "s"), (4, 0, "a", "x"), (4, PART, "a", "y")]
    got = rows(spark, data)
    assert set(got) == {(2, "a", 0), (2, "b", 0), (4, "a", 0), (4, "a", 1)}
    assert got[2, "a", 0].n_messages == 4 and got[2, "a", 0].text.startswith("<|im_start|>assistant\n<|im_end|>\n<|im_start|>user name=\nn")
    a, b = map(int, got[2, "b", 0].mask.split(":"))
    assert got[2, "b", 0].text[a:b] == long + "<|im_end|>"
    assert rows(spark, [(None, 0, "a", "x")]) == {}


def test_parts_join_to_the_whole_dialogue(spark, monkeypatch):
    data = [(1, t, ["ann", "bob", "c\nd", "system"][t % 4], f"say {t}" * (t % 5)) for t in range(23)]
    whole = rows(spark, data)
    monkeypatch.setattr(chat, "PART", 3)
    parts = rows(spark, data)
    for who in ("ann", "bob", "c\nd"):
        mine = [parts[1, who, k] for k in range(8)]
        assert "".join(r.text for r in mine) == whole[1, who, 0].text and ",".join(r.mask for r in mine if r.mask) == whole[1, who, 0].mask
        assert [r.offset for r in mine] == [sum(len(x.text) for x in mine[:k]) for k in range(8)]
    assert "name=c d\n" in whole[1, "ann", 0].text
