import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import tokenize as T


@pytest.fixture(scope="module")
def reference():
    with open(T.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_token_sequences(reference):
    rnd, coder = random.Random(1), T.encoder()
    pool = list(coder.transducer.ranks)
    for _ in range(4000):
        text = b"".join(rnd.choice(pool) for _ in range(rnd.randint(1, 6))).decode("utf-8", "ignore")
        assert coder.encode(text) == reference.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_and_back(text):
    coder = T.encoder()
    assert coder.decode(coder.encode(text)) == text


@pytest.mark.parametrize("text", ["", " ", "a" * 100_000, "ab" * 30_000, " " * 20_000, "-" * 5_000, "日本語" * 2_000, "é" * 2_000, "<|endoftext|>", "\r\n\t​👩‍💻"])
def test_long_runs(reference, text):
    coder = T.encoder()
    ids = coder.encode(text)
    assert ids == reference.encode_ordinary(text) and coder.decode(ids) == text


def test_memo_limits_do_not_matter(reference, monkeypatch):
    monkeypatch.setattr(T, "PIECES", 5)
    monkeypatch.setattr(T, "TRANSITIONS", 20)
    coder = T.Encoder()
    text = "The lint finds a SELECT * in of_import_sensor, line 886, but the columns are fixed there. " * 20
    assert coder.encode(text) == reference.encode_ordinary(text)


def test_frame(spark, reference):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", None), (4, "Hello world", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in T.encode_texts(df).collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t, _ in rows}
    counts = {r.doc_id: r.n for r in T.encode_texts(df.select("doc_id", "text"), ids="n", count_only=True).collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert T.roundtrip(df).where("not exact").count() == 0
    assert T.encode_texts(df.limit(0)).count() == 0


def test_the_table_is_bounded_within_a_piece(monkeypatch):
    import random

    from lodestone.llm import tokenize as K

    rnd = random.Random(6)
    text = "".join(rnd.choice("abcdefghijklmnop") for _ in range(6000))
    coder = K.Encoder()
    want = coder.encode(text)
    monkeypatch.setattr(K, "TRANSITIONS", 500)
    small = K.Encoder()
    assert small.encode(text) == want and small.decode(want) == text
    assert len(small.transducer.table) <= 500 and len(small.transducer.states) <= 502
