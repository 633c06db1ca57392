import random

import pytest
from pyspark.sql import functions as F

from pairloom.constants import BASELINE_PREFIX, RESPONSE_MARKER, SYSTEM_PROMPT
from pairloom.functions import chat as C
from pairloom.functions import tokens as K

EMPTY = [("user", ""), ("assistant", "")]


@pytest.fixture
def pairs(spark):
    rows = [(0, "int a;", "fn a() {}"), (1, None, "fn b() {}"), (2, "int c;", None), (3, "", "")]
    return spark.createDataFrame(rows, "i INT, c STRING, r STRING")


def turns(df, messages):
    rows = df.select("i", messages.alias("m")).collect()
    return {r["i"]: [tuple(m) for m in r["m"]] for r in rows}


def test_message_forms(pairs):
    c, r = F.col("c"), F.col("r")
    base = turns(pairs, C.messages_baseline(c, r))
    assert base[0] == [("user", BASELINE_PREFIX + "int a;"), ("assistant", "fn a() {}")]
    full = turns(pairs, C.messages_instructed(c, r))
    assert full[0] == [("system", SYSTEM_PROMPT), ("user", "int a;"), ("assistant", "fn a() {}")]
    assert full[3] == [("system", SYSTEM_PROMPT), ("user", ""), ("assistant", "")]
    for got in (base, full):
        assert got[1] == got[2] == EMPTY
    prompt = turns(pairs, C.prompt_only(C.messages_instructed(c, r)))
    assert prompt[0] == full[0][:-1] and prompt[1] == EMPTY[:1]
    infer = turns(pairs, C.messages_inference(c, "S"))
    assert infer[0] == [("system", "S"), ("user", "int a;")]


def test_by_model(pairs):
    df = pairs.withColumn("m", F.lit("Proposed"))
    c, r, m = F.col("c"), F.col("r"), F.col("m")
    assert turns(df, C.messages_by_model(m, c, r)) == turns(df, C.messages_instructed(c, r))
    other = df.withColumn("m", F.lit("Baseline"))
    assert turns(other, C.messages_by_model(m, c, r)) == turns(df, C.messages_baseline(c, r))


def test_render(pairs):
    messages = C.messages_baseline(F.col("c"), F.col("r"), "> ")
    text = pairs.select(C.render_chat(messages, add_generation_prompt=True)).first()[0]
    assert text == (
        "<|im_start|>user\n> int a;<|im_end|>\n<|im_start|>assistant\nfn a() {}<|im_end|>\n"
        "<|im_start|>assistant\n"
    )


def test_completion_text(evaluate):
    m = RESPONSE_MARKER
    cases = ["none", f"a{m}b", f"a{m}b{m}c", m]
    assert evaluate(cases, C.completion_text) == ["", "b", "c", ""]


def test_tokens_join_back_to_the_text(evaluate):
    rng = random.Random(5)
    parts = ["abc", " ", "\n", "é", "<|im_end|>", "<|", "|>", "_", "\U0001f600", "7", "\x0b", " "]
    texts = ["".join(rng.choices(parts, k=30)) for _ in range(300)]
    assert evaluate(texts, lambda t: K.decode(K.encode(t))) == texts


def test_truncate_and_mask(evaluate):
    (ids,) = evaluate(["a b c"], lambda t: K.encode_truncate(t, 3))
    assert ids == ["a", " ", "b"]
    (mask,) = evaluate(["a b c"], lambda t: K.attention_mask(K.encode_truncate(t, 3)))
    assert mask == [1, 1, 1]


def python_labels(ids, marker):
    cut = len(ids)
    for i in range(len(ids)):
        if ids[i : i + len(marker)] == marker:
            cut = i + len(marker)
    return [-100 if i < cut else x for i, x in enumerate(ids)]


def test_completion_labels(spark):
    rng = random.Random(9)
    rows = [([rng.randint(0, 2) for _ in range(rng.randint(0, 12))],) for _ in range(300)]
    df = spark.createDataFrame(rows, "ids ARRAY<INT>")
    marker = F.array(F.lit(1), F.lit(2))
    for r in df.select("ids", K.completion_labels(F.col("ids"), marker).alias("l")).collect():
        assert r["l"] == python_labels(r["ids"], [1, 2])


def test_slice_and_decode(spark):
    df = spark.createDataFrame([(["p", "q", "x", "<s>", "y"], 2)], "o ARRAY<STRING>, n INT")
    out = df.select(K.slice_completion(F.col("o"), F.col("n")).alias("o"))
    assert out.first()[0] == ["x", "<s>", "y"]
    assert out.select(K.decode(F.col("o"), ("<s>",))).first()[0] == "xy"
    whole = df.select(K.slice_completion(F.col("o"), F.size("o"))).first()[0]
    assert whole == []
