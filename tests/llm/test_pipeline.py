"""The pipeline against a plain version of it, and against odd tables."""

import hashlib
from itertools import combinations

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from opportune.llm import decontaminate, pii, queries, simhash, toxicity

DATA = "/root/testdata/sf0.001"


def plain_run(spark, rows, sf_dir):
    """(doc_id, text) pairs through the stages, each by brute force; the lexicon is the stage's own."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = queries.toxicity_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [(d, t) for d, t in rows if lexicon.score(*lexicon.features(t)[:2]) < toxicity.THRESHOLD]
    prints = [int(p) for p in simhash.fingerprints([t for _, t in rows])]
    root = list(range(len(rows)))
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(order, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            if x != y:
                lo, hi = sorted((x, y), key=lambda i: rows[i][0])
                root[hi] = lo
    rows = [rows[i] for i in order if find(i) == i]
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def leaks(text):
        words = decontaminate.words_of(text)
        number = {w: k for k, w in enumerate(dict.fromkeys(words + sum(items, [])))}
        arrays = [np.array([number[w] for w in i]) for i in items]
        best, _ = decontaminate.align([np.array([number[w] for w in words] or [-9])] * len(arrays), arrays)
        return any(b >= len(i) for b, i in zip(best, items))  # half of all points, two a word

    rows = [(d, t) for d, t in rows if not leaks(t)]
    s = pii.Surrogates(queries.pii_key())
    return {d: pii.replace(t, s)[0] for d, t in rows}


def test_run_equals_the_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = plain_run(spark, rows, DATA)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(want) and 0 < len(want) < len(rows)
    for r in got:
        ids = library.encode(want[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.token_ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_keep_columns_and_odd_rows(spark):
    base = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    extra = [(9001, None), (9002, ""), (9003, "same words in this short text"), (9003, "same words in this short text"), (None, "no id but some words here"), (9004, "word " * 60_000)]
    odd = spark.createDataFrame(extra, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs = base.unionByName(odd).withColumns({c: F.lit(1) for c in ("__toxicity", "__pii", "__id", "__rows", "__key", "token_ids", "component_id")})
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert None in ids and 9004 in ids and ids.count(9003) in (1, 2) and (9001 in ids or 9002 in ids)
        assert out.where("token_ids <> 1").count() == 0
        assert stage(spark, docs.limit(0), DATA).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == docs.count() and last.where("doc_id = 9001").first().n_tokens == 0


def test_every_operator_has_one_query():
    names = [*queries.queries()]
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert {*queries.oracle_sql()} <= {*names}
