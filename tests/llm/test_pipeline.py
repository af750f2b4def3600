import re
from collections import Counter

import corpus_pipeline
from quern.llm import decontaminate, near_dup


def odd_docs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "", None, None, 0), (10_003, "12 34", "en", None, 5), (None, "Words of the one and the other document are here.", "en", "s", 9), (10_004, "q" * 3000 + " the end of the and", "en", "s", 9)], docs.schema)
    return docs.unionByName(extra).unionByName(docs.limit(3)).withColumn("spans", docs.doc_id * 2).withColumn("node", docs.lang).withColumn("row", docs.n_chars).withColumn("score", docs.lang).withColumn("lang_pred", docs.doc_id)


def test_stages_one_by_one(spark, small):
    docs = odd_docs(spark, small)
    columns = docs.columns
    rows = docs.collect()

    said = corpus_pipeline.identify_language(spark, docs, small)
    assert said.columns == columns
    kept = said.collect()
    gone = Counter(r.doc_id for r in rows) - Counter(r.doc_id for r in kept)
    assert {10_001, 10_002, 10_003} <= set(gone) and len(gone) <= 6

    near = corpus_pipeline.drop_near_duplicates(spark, said, small)
    assert near.columns == columns
    left = near.collect()
    like = near_dup.Likeness()
    sets = {r.doc_id: set(near_dup.shingle_set(r.text, like.shingle).tolist()) for r in kept if r.doc_id is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in sorted(sets):
        for y in sorted(sets):
            if x < y and 100 * len(sets[x] & sets[y]) >= like.percent * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == sorted(i for i in sets if find(i) == i)
    assert sum(r.doc_id is None for r in left) == 1

    clean = corpus_pipeline.remove_benchmark(spark, near, small)
    assert clean.columns == columns
    items = [(r.item_id, decontaminate.bench_words(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    windows = decontaminate.windows_of(items)
    hit = lambda w: any(tuple(w[i : i + m]) in windows for m in {len(k) for k in windows} for i in range(len(w) - m + 1))
    stay = clean.collect()
    assert sorted(map(str, stay)) == sorted(str(r) for r in left if not hit(decontaminate.bench_words(r.text)))

    mixed = corpus_pipeline.mix_sources(spark, clean, small)
    assert mixed.columns == columns
    text = {r.doc_id: r.text for r in stay}
    count, size = Counter(), lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    for r in mixed.collect():
        words, taken = text[r.doc_id].split(), r.text.split()
        assert taken and set(taken) <= set(words)
        count[r.doc_id] += size(r.text)
    assert all(n <= 3 * size(text[i]) for i, n in count.items())
    total = sum(size(r.text) for r in stay)
    assert abs(sum(count.values()) - total) <= 0.05 * total

    ids = corpus_pipeline.write_token_ids(spark, mixed, small).orderBy("start").collect()
    assert len(ids) == mixed.count()
    assert [r.start for r in ids] == [sum(x.n_tokens for x in ids[:k]) for k in range(len(ids))]


def test_empty_tables_pass(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.count() == 0
    assert corpus_pipeline.write_token_ids(spark, docs, small).count() == 0
