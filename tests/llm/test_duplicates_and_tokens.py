import random

import pytest
from pyspark.sql import functions as F

from codestrata.llm import format_duplicates as D, tokenization as K

SCHEMA = "id string, name string, type string, mentions long, attrs string"


def copies(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.lit(1)).withColumn("hot", F.lit(True)).withColumn("salt", F.lit(1))
    return {tuple(r) for r in D.entity_copies(d).collect()}


def test_spelling_order_and_nulls(spark):
    rows = [("e2", "Ab-c Größe", "X y", 1, "b=2; a=1"), ("e1", "ab C größe!", "(xy)", 1, "A = 1;B=2;"), ("e3", "abcgröße", "xy", 2, "a=1;b=2"), ("e4", "abcgröße", "xy", 1, None), ("e5", "ABCGRÖSSE".replace("SS", "ß"), "XY", 1, None), ("e6", "abcgröße", "xy", 1, ""), ("e7", None, None, None, None), ("e8", None, None, None, None), (None, "a", "b", 1, None), ("e1", "ab C größe!", "(xy)", 1, "A = 1;B=2;")]
    assert copies(spark, rows) == {("e1", "e2"), ("e4", "e5"), ("e7", "e8")}
    u = {r.keep_id: (r.n_rows, r.n_ids) for r in D.unique_entities(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert u["e1"] == (3, 2) and u["e3"] == (1, 1)
    assert copies(spark, []) == set()


def test_field_and_value_do_not_run_together(spark):
    assert copies(spark, [("a", "n", "t", 1, "ab=c"), ("b", "n", "t", 1, "a=bc"), ("c", "x|y", "t", 1, "z"), ("d", "x", "yt", 1, "z")]) == set()


def test_hot_keys_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_HOT", 3)
    rng = random.Random(2)
    rows = [(f"i{rng.randrange(3000):05d}", rng.choice(["Hot Name", "hot-name"] * 3 + [f"n {k}" for k in range(9)]), "t", rng.randrange(2), None) for _ in range(4000)]
    want, groups = set(), {}
    for i, n, t, m, _ in rows:
        groups.setdefault((n.lower().replace(" ", "").replace("-", ""), m), set()).add(i)
    for g in groups.values():
        want |= {(min(g), x) for x in g if x != min(g)}
    assert copies(spark, rows) == want


def test_round_trip_and_empty(spark):
    texts = ["", None, "  \n", "don't <|endoftext|> stop", "日本語 नमस्ते 🙂 e\u0301", "a" * 3000, "x " * 30_000, "1a" * 20_000, "\u00a0\u2003 x"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    e = K.encode_column(d, "doc_id", "text")
    ids = {r.doc_id: list(r.ids) for r in e.collect()}
    assert ids[0] == [] and ids[1] == [] and ids[2]
    back = {r.doc_id: r.text for r in K.decode_column(e, "doc_id").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    n = {r.doc_id: r.n_tokens for r in K.encode_column(d, "doc_id", "text", counts_only=True).collect()}
    assert n == {i: len(x) for i, x in ids.items()}
    assert K.encode_column(d.limit(0), "doc_id", "text").count() == 0


def test_pieces_give_the_ids_of_the_whole():
    enc, rng = K.encoder(), random.Random(4)
    for _ in range(60):
        t = "".join(rng.choice(["don't", " the", "  ", "\n", "'s", "12", "é", "漢", "!?", " x", "'", "ll", "\t", "\u00a0"]) for _ in range(300))
        assert K.encode(enc, t, 20) == enc.encode_ordinary(t)
        assert "".join(K.pieces(t, 20)) == t


def test_same_ids_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    import os

    path = os.path.join(os.path.dirname(K.RANKS), "byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    enc = K.encoder()
    for x in ["Hello  world's\n\n<|endoftext|> été 漢字 12 345", " a", "\r\n\t x"]:
        assert t.encode(x, add_special_tokens=False).ids == K.encode(enc, x)
