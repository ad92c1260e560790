from tokenizers import Tokenizer

from pageloom.llm import tokens
from pageloom.llm.tokens import decode_ids, encode_texts


def reference(texts):
    import public_tokenizers

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_public_library_and_decode_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = {r.doc_id: r.text for r in docs.collect()}
    encoded = encode_texts(docs).cache()
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == dict(zip(held, reference([x or "" for x in held.values()])))
    assert {r.doc_id: r.text for r in decode_ids(encoded).collect()} == {k: v or "" for k, v in held.items()}


def test_odd_texts_nulls_and_repeats(spark):
    texts = ["", None, "a", "a", "  two  blanks\t\n\n x", "don't I'll <|endoftext|>", "é́​　字😀", "\x1c\x85 x", "ab" * 5000, "1234 ½ ²"]
    df = spark.createDataFrame([(i if i else None, t, 1, 2) for i, t in enumerate(texts)] + [(3, "a", 1, 2)], "doc_id long, text string, ids int, word int")
    out = sorted((str(r.doc_id), r.ids) for r in encode_texts(df).collect())
    want = sorted((str(i if i else None), ids) for i, ids in [*enumerate(reference([t or "" for t in texts])), (3, reference(["a"])[0])])
    assert out == want
    assert encode_texts(df.limit(0)).count() == 0


def test_runs_of_known_words_around_unknown_ones():
    import numpy as np
    import pyarrow as pa

    words = pa.array([["x"], ["a", "b", "y", "a", "x", "y"], [], ["a"], ["y", "y"]]).slice(1)
    runs, rare = tokens._runs(words, pa.array(["a", "b"]), np.array([1, 2]), np.array([5, 6, 7], np.int32))
    assert runs.to_pylist() == [[[5, 6, 7], [5], [], []], [[]], [[5]], [[], [], []]] and rare.to_pylist() == [["y", "x", "y"], [], [], ["y", "y"]]


def test_hot_and_cold_words_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"the pump the valve {i} the the") for i in range(1500)], "doc_id long, text string")
    whole = {r.doc_id: r.ids for r in encode_texts(df).collect()}
    monkeypatch.setattr(tokens, "HOT", 1.0)
    assert {r.doc_id: r.ids for r in encode_texts(df).collect()} == whole
