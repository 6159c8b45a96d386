"""Encoding, decoding, counting and packing against the libraries and brute force."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from opportune.llm import bpe, packing, queries, token_counts
from opportune.llm.merging import PairTable, merge_one, merge_words

WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def codec():
    return bpe.BpeCodec(WORD)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PieceCounter(PIECE)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


ODD = ["", " ", "Hello <|endoftext|>x", "<|startoftext|><|endoftext|>", "a\x1cb \x1f", "ΣΑΣ Σ", "İstanbul ﬁ ½ 123", "it's 'LL we'll", "x" * 500, "é" * 90 + "é", "日本語テキスト", "😀😀👨‍👩‍👧", "​﻿", "a\u0085b c d", "<|endoftext|", "\x00\x01", "a</w>b", "...!?", "  a  b ", "\n\n a\n", "▁x▁▁y", "<s> </s> <unk> <0x41>"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(codec, library, counter, pieces, text):
    ids = codec.encode([text])[0]
    want = library.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want and codec.decode(ids) == library.decode(want, skip_special_tokens=False)
    assert counter.count([text])[0] == len(pieces.encode(text))


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60) | st.text("abcdehilnorst '.,é1\n ÜßΩ<|>▁", max_size=120))
def test_any_text(codec, library, counter, pieces, text):
    text = text.encode("utf-8", "ignore").decode()
    assert codec.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert counter.count([text])[0] == len(pieces.encode(text))


PIECES = ["<|startoftext|>", "<|endoftext|>", "<|STARTOFTEXT|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|endoftext", "|>", "<|", " ", "a", "É", "it's", "\n"]


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.sampled_from(PIECES), max_size=12))
def test_special_strings_count_only_as_they_are(codec, library, parts):
    text = "".join(parts)
    ids = codec.encode([text])[0]
    want = library.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want and codec.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_unsupported_added_tokens_are_refused(tmp_path):
    spec = json.load(open(WORD))
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.BpeCodec(str(tmp_path / "v.json"))


def test_pairs_are_compatible_exactly_if_merging_keeps_them(codec):
    random.seed(2)
    proposable = sorted({int(t) for t in codec.token_at if t >= 0 and not codec.strings[t].endswith("</w>")})
    pairs = [(random.choice(proposable), random.choice(proposable)) for _ in range(3000)]
    spell = {}

    def bytes_of(t):
        if t not in spell:
            spell[t] = [t] if codec.rank[t] < 0 else bytes_of(int(codec.left[t])) + bytes_of(int(codec.right[t]))
        return spell[t]

    known = codec.table.as_dict()
    want = [merge_one(bytes_of(a) + bytes_of(b), known) == [a, b] for a, b in pairs]
    a, b = np.array(pairs).T.astype(np.int32)
    assert codec.compatible(a, b).tolist() == want and 0 < sum(want) < len(want)


def test_lockstep_merging_equals_plain_merging():
    random.seed(3)
    merges = {}
    while len(merges) < 40:
        a, b = random.randrange(10 + len(merges)), random.randrange(10 + len(merges))
        merges.setdefault((a, b), (len(merges), 10 + len(merges)))
    table = PairTable(*map(np.array, zip(*[(a, b, r, p) for (a, b), (r, p) in merges.items()])))
    words = [[random.randrange(10) for _ in range(random.randrange(0, 70))] for _ in range(400)]

    def plain(w):
        while True:
            best = min(((merges[p][0], i) for i in range(len(w) - 1) if (p := (w[i], w[i + 1])) in merges), default=None)
            if best is None:
                return w
            i = best[1]
            w = w[:i] + [merges[w[i], w[i + 1]][1]] + w[i + 2 :]

    flat, sizes = merge_words(np.array(sum(words, []), np.int32), np.array([len(w) for w in words]), table)
    got = [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
    assert got == [plain(w) for w in words]


def test_table_reset_changes_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(codec, "word_table", 50)
    texts = [" ".join(f"w{i}x{j}. yes" for j in range(20)) for i in range(20)]
    for t in texts:
        assert codec.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def odd_table(spark):
    long = "lorem ipsum " * 40_000
    rows = [(1, "Hello there", "x"), (1, "Hello there", "x"), (2, "", "x"), (3, None, "x"), (None, "null id", "x"), (2**60 + 1, long, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_encoding_tables_with_odd_rows(spark, library):
    got = bpe.encode(odd_table(spark), WORD, decoded_col="decoded").collect()
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.token_ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
    again = bpe.decode(bpe.encode(odd_table(spark), WORD), WORD).collect()
    assert sorted(r.decoded for r in again) == sorted(r.decoded for r in got)
    assert bpe.encode(odd_table(spark).limit(0), WORD).count() == 0
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(odd_table(spark), PIECE).collect()}[3] == 0


def test_registered_queries_equal_the_libraries(spark, library, pieces):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op1_bpe_round_trip(spark, DATA).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in queries.op6_token_counts(spark, DATA).collect():
        n = len(pieces.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 4096, len(texts[r.doc_id].encode()))


@settings(max_examples=150, deadline=None)
@given(sizes=st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_decreasing_equals_a_plain_scan(sizes):
    rows, free = [], []
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [f for f in free if f >= sizes[piece]]
        if fits:
            k = free.index(min(fits))
            rows[k].append(piece)
            free[k] -= sizes[piece]
        else:
            rows.append([piece])
            free.append(20 - sizes[piece])
    got = packing.best_fit_decreasing(sizes, 20)
    assert sorted(sum(got, [])) == list(range(len(sizes))) and all(sum(sizes[p] for p in r) <= 20 for r in got)
    # rows of equal free space are alike, so how full the rows are doesn't depend on which of them is taken
    assert sorted(sum(sizes[p] for p in r) for r in got) == sorted(sum(sizes[p] for p in r) for r in rows)


def test_packing_loses_nothing(spark, library):
    packed = packing.pack(odd_table(spark), WORD, length=64, window=500)
    docs = {}
    for r in packing.documents_of(packed, 64).orderBy("part").collect():
        docs.setdefault(r.doc_id, []).append((r.part, np.frombuffer(r.ids, "<u2").tolist()))
    for r in odd_table(spark).where("doc_id is null or doc_id > 1").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert sum((p for _, p in sorted(docs.get(r.doc_id, []))), []) == ids
    assert len(docs[1]) == 2
    for r in packed.collect():
        ids, place = np.frombuffer(r.input_ids, "<u2").reshape(r.n_rows, 64), np.frombuffer(r.position_ids, "<u2").reshape(r.n_rows, 64)
        assert r.n_tokens == sum(c[-1] for c in r.cu_seqlens)
        for k, cuts in enumerate(r.cu_seqlens):
            assert cuts[0] == 0 and cuts == sorted(cuts) and (ids[k, cuts[-1] :] == 49407).all()
            for a, b in zip(cuts, cuts[1:]):
                assert place[k, a:b].tolist() == list(range(b - a))
    assert packing.pack(odd_table(spark).limit(0), WORD).count() == 0


def test_packing_is_dense(spark):
    r = queries.op4_packed_ids(spark, DATA).selectExpr("sum(n_tokens) as t", "sum(n_rows) as n").first()
    assert r.t / (r.n * packing.LENGTH) > 0.9


def plain_fills(sizes, length):
    """Tokens of each row of best-fit decreasing, looking at every open row."""
    fills = []
    for size in sorted(sizes, reverse=True):
        fit = [k for k, f in enumerate(fills) if f + size <= length]
        if fit:
            best = max(fit, key=lambda k: fills[k])
            fills[best] += size
        else:
            fills.append(size)
    return sorted(fills)


def test_registered_packing_equals_plain_packing_of_the_librarys_ids(spark, library):
    packed = queries.op4_packed_ids(spark, DATA)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got, by_task = {}, {}
    for r in packed.collect():
        ids = np.frombuffer(r.input_ids, "<u2").reshape(r.n_rows, packing.LENGTH)
        place = np.frombuffer(r.position_ids, "<u2").reshape(r.n_rows, packing.LENGTH)
        for k, (cuts, docs, parts) in enumerate(zip(r.cu_seqlens, r.doc_ids, r.parts)):
            assert cuts[0] == 0 and cuts[-1] <= packing.LENGTH
            by_task.setdefault(r.matrix_id >> 32, []).append(cuts)
            for doc, part, a, b in zip(docs, parts, cuts, cuts[1:]):
                assert place[k, a:b].tolist() == list(range(b - a)) and (doc, part) not in got
                got[doc, part] = ids[k, a:b].tolist()
    want = {}
    for doc, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        want |= {(doc, k): ids[at : at + packing.LENGTH] for k, at in enumerate(range(0, len(ids), packing.LENGTH))}
    assert got == want
    for rows in by_task.values():
        sizes = [b - a for cuts in rows for a, b in zip(cuts, cuts[1:])]
        assert sum(sizes) < packing.WINDOW  # one window
        assert sorted(cuts[-1] for cuts in rows) == plain_fills(sizes, packing.LENGTH)


def test_write(spark, tmp_path):
    packing.write(packing.pack(odd_table(spark), WORD, length=64), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() > 0
