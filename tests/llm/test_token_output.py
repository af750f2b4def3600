import dataclasses
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")

from quern.llm import common, queries, token_output  # noqa: E402


def hashed(text):
    """What Spark's ``xxhash64`` gives."""
    return int.from_bytes(xxhash.xxh64((text or "").encode(), seed=42).digest(), "big", signed=True)


def brute(rows):
    tok = tokenizers.Tokenizer.from_file(queries.default_tokenizer())
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1]))):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def run(spark, df):
    path = common.new_path(spark, "t")
    token_output.write_tokens(df, path, queries.default_tokenizer())
    return [tuple(r) for r in token_output.read_tokens(spark, path).orderBy("start").collect()]


def test_odd_texts(spark):
    rows = [(5, " lead and trail "), (1, None), (2, ""), (3, "a  b\n c\td e  f"), (4, "it's 12,000 cafés \U0001f600 ok"), (4, "it's 12,000 cafés \U0001f600 ok"), (None, "no id"), (9, "x " * 30000), (10, "<|endoftext|> 　 ​ y"), (11, "\n\n  \n a\x1cb\x85 c")]
    df = spark.createDataFrame([(i, t, 7, "z") for i, t in rows], "doc_id long, text string, n_tokens int, start string")
    assert run(spark, df) == brute(rows)


def test_table(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    assert run(spark, df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_empty(spark):
    assert run(spark, spark.createDataFrame([], "doc_id long, text string")) == []


def whole(coder, texts):
    return [[*x.ids, 2] for x in coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_small_cache_gives_the_same_ids():
    coder = token_output.PieceEncoder(queries.default_tokenizer(), cache_bytes=400)
    texts = ["the cat saw the dog and the cat ran to the other dog", "", "a dog, a cat."]
    assert coder.encode_all(pa.array(texts), (2,)).to_pylist() == whole(coder, texts) == coder.encode_all(pa.array(texts), (2,)).to_pylist()


def test_random_texts_encode_as_the_library_does():
    signs = [*"aB'é×÷ñ,.!? \n\t 0９②中か\u3000\u2009\u200b😀sßʷΩ<|end", "<|endoftext|>", "'s ", "don't ", "a,b", "\r\n", "  ", "\n\n"]
    draw, coder = random.Random(5), token_output.PieceEncoder(queries.default_tokenizer())
    for _ in range(100):
        texts = ["".join(draw.choices(signs, k=draw.randint(0, 30))) for _ in range(60)]
        assert coder.encode_all(pa.array(texts), (2,)).to_pylist() == whole(coder, texts)


def test_hashes_that_clash_are_noticed(monkeypatch):
    coder, texts = token_output.PieceEncoder(queries.default_tokenizer()), ["one two three", "four five one"]
    cut = token_output.cut_pieces
    monkeypatch.setattr(token_output, "cut_pieces", lambda raw, offsets: dataclasses.replace(p := cut(raw, offsets), key=p.key % np.uint64(2)))
    assert coder.encode_all(pa.array(texts), (2,)).to_pylist() == whole(coder, texts)


def test_slices_are_bounded_by_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (5, 5, 30, 1, 1, 1, 9)]})
    assert [b.num_rows for b in common.slices([batch], "text", 3, 10)] == [2, 1, 3, 1]


def test_one_hot_id(spark):
    df = spark.createDataFrame([(7, f"text {i % 50} {i}") for i in range(2000)] + [(None, "n")] * 3, "doc_id long, text string")
    assert run(spark, df) == brute([(r.doc_id, r.text) for r in df.collect()])


def scanned(df):
    """Rows that the ORC reader hands on."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "Scan" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())] + ([node.executedPlan()] if "Adaptive" in node.nodeName() else [])
    return sum(found)


def test_lookups_skip_by_index_and_bloom_filter(spark, tmp_path):
    path = str(tmp_path / "o")
    df = spark.range(0, 40000, 2).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))
    token_output.write_tokens(df, path, queries.default_tokenizer())
    assert [r.doc_id for r in token_output.lookup_tokens(spark, path, [1234, 31000]).orderBy("doc_id").collect()] == [1234, 31000]
    # A stride has 1,000 rows; an id between two stored ones passes every index, and only the Bloom filters know that it is not there.
    assert scanned(token_output.lookup_tokens(spark, path, [1234])) == 1000
    missing = [i for i in range(1, 40000, 400)]
    assert sum(scanned(token_output.lookup_tokens(spark, path, [i])) for i in missing[:20]) <= 2000
