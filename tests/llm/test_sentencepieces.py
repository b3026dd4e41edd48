import random

import sentencepiece
from pyspark.sql import functions as F

from terrasol.llm.sentencepieces import MODEL, SPACE, Coder, decode, encode, op10_sentencepieces, read_model
from tests.conftest import DATA

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_are_those_of_the_library():
    coder, rng = Coder(read_model(MODEL)), random.Random(1)
    parts = ["the", "ing", " ", "  ", "     ", "x", "é", "日本", "🙂", "aaa", "\n", "123", "<s>", SPACE, "tion", "\x00"]
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 120)))
        ids = coder.encode(text)
        assert ids == LIBRARY.encode(text)
        assert coder.decode(ids) == text.replace(SPACE, " ")
    assert coder.encode("a" * 5000) == LIBRARY.encode("a" * 5000)


def test_chunks_give_the_same_ids(spark):
    rng = random.Random(2)
    texts = [None, "", "short", "x" * 2100, " " * 700, "\n" * 300, "one\ttwo\r\n" * 60]
    texts += ["".join(rng.choice(["the", "ing", " ", "er", "é", "日", "\n", "Q", "  "]) for _ in range(400)) for _ in range(20)]
    texts += ["".join(rng.choice("abcdethingon") for _ in range(700)) for _ in range(10)]  # no break anywhere
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[8])]
    frame = spark.createDataFrame(rows, "ids long, text string").repartition(3)
    for chunk in (20, 100):  # 20: matrices are multiplied in two levels
        got = encode(frame.withColumnRenamed("ids", "decoded"), chunk=chunk)
        assert sorted((str(r.decoded), list(r.ids)) for r in got.collect()) == sorted((str(d), LIBRARY.encode(t or "")) for d, t in rows)
    back = decode(encode(frame.withColumn("decoded", F.lit(1)), chunk=64)).collect()
    assert sorted((list(r.ids), r.decoded) for r in back) == sorted((LIBRARY.encode(t or ""), t or "") for _, t in rows)  # columns called as the results give way
    assert encode(frame.limit(0)).count() == 0


def test_query_round_trips(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    got = op10_sentencepieces(spark, f"{DATA}/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.round_trip and r.n_tokens == len(r.ids) and list(r.ids) == LIBRARY.encode(texts[r.doc_id])
