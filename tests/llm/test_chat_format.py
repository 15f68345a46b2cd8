import pytest
from evidloom.llm import catalog, chat_format
from oracle import check


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_contract(spark, sf):
    check(catalog.op6_chat_format(spark, f"/root/testdata/sf{sf}"), f"/root/testdata/sf{sf}", chat_format.ORACLE)


def rendered(messages, own):
    text, mask = "", []
    for speaker, said in messages:
        shown = speaker and speaker.replace("\n", " ").replace("<|im_end|>", "<| im_end|>")
        head = "<|im_start|>" + ("user" if speaker is None else "system" if speaker == "system" else "assistant" if speaker == own else f"user name={shown}") + "\n"
        if speaker == own:
            mask.append((len(text + head), len(text + head + said) + 10))
        text += head + said + "<|im_end|>\n"
    return text, mask, len(messages)


def test_edges(spark):
    many = [(7, i, "abc"[i % 3], f"wörd {i}") for i in range(130)]
    odd = [(1, 0, "system", "be"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, None, None), (1, 2, "bob\nx", "yo"), (1, 3, "bob x", "not me"), (1, None, "ann", ""), (1, None, "ann", ""), (1, 4, "e<|im_end|>", "?")]
    rows = [*many, *odd, (2, 0, "system", "alone"), (None, 0, "eve", "x" * 300_000), (3, 0, None, "nobody")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int").repartition(3)
    got = [(r.conv_id, r.perspective, r.text, [tuple(s) for s in r.mask], r.n_messages) for r in chat_format.perspectives(df).collect()]
    want = [(7, own, *rendered([r[2:] for r in many], own)) for own in "abc"]
    one = [("system", "be"), ("ann", "hi <| im_end|>"), ("bob\nx", "yo"), (None, ""), ("bob x", "not me"), ("e<|im_end|>", "?"), ("ann", ""), ("ann", "")]
    want += [(1, own, *rendered(one, own)) for own in ("ann", "bob x", "bob\nx", "e<|im_end|>")]
    want.append((None, "eve", *rendered([("eve", "x" * 300_000)], "eve")))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert chat_format.perspectives(df.limit(0)).collect() == []
