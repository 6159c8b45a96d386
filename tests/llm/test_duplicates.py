"""SimHash, components, nearest neighbours and decontamination against brute force."""

import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from opportune.llm import ann, common, components, decontaminate, queries, simhash

DATA = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in combinations(nodes, 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["", "one", "one two", "A b C d", "x\ty\nz\x0bw", "Éa éA  ", "a a a a a", "w " * 3000])
def test_fingerprint(text):
    assert int(simhash.fingerprints([text])[0]) == brute_fingerprint(text)


def test_close_pairs_equal_all_pairs():
    random.seed(1)
    base = [random.getrandbits(64) for _ in range(20)]
    prints = list({b ^ sum(1 << random.randrange(64) for _ in range(random.randrange(4))) & (2**64 - 1) for b in base for _ in range(12)})
    bucket = np.sort(np.array([random.randrange(3) for _ in prints]))
    a, b = simhash.close_pairs(np.array(prints, np.uint64), bucket)
    want = {(i, j) for i, j in combinations(range(len(prints)), 2) if bucket[i] == bucket[j] and (prints[i] ^ prints[j]).bit_count() <= 2}
    assert {*zip(a.tolist(), b.tolist())} == want and want


def test_components_of_random_graphs(spark):
    random.seed(4)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {tuple(sorted(e)) for e in edges}
    want = brute_components(sorted({x for e in edges for x in e}), lambda a, b: (a, b) in linked)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bucket", [2048, 3])
def test_links_survive_hot_buckets(spark, bucket):
    """With tiny buckets the second dealing does all the work."""
    random.seed(6)
    base = [random.getrandbits(64) for _ in range(15)]
    prints = sorted({(b ^ sum({1 << random.randrange(64) for _ in range(random.randrange(5))})) for b in base for _ in range(25)})
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fingerprint long"), bucket)
    got = {r.node: r.root for r in components.components(links).collect()}
    want = brute_components([s for s, in sorted(signed)], lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    assert {s: got.get(s, s) for s, in signed} == want and len({*want.values()}) < len(want)


def odd_docs(spark):
    words = [f"w{k}" for k in range(400)]
    long = " ".join(words)
    near = " ".join(words[:-1])
    rows = [(5, long, "a"), (7, near, "b"), (7, near, "b"), (9, None, "c"), (11, "", "d"), (None, long, "e"), (None, "alone here now", "f"), (20, "quite another text of its own", "g"), (21, "x", "h")]
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")


def test_near_duplicates_of_odd_rows(spark):
    rows = odd_docs(spark).collect()
    got = sorted(str((r.doc_id, r.component_id)) for r in simhash.near_duplicates(odd_docs(spark)).collect())
    prints = [brute_fingerprint(r.text) for r in rows]
    group = brute_components(range(len(rows)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    least = {}
    for i, r in enumerate(rows):
        ids = [x for x in (least.get(group[i]), r.doc_id) if x is not None]
        least[group[i]] = min(ids, default=None)
    want = sorted(str((r.doc_id, least[group[i]])) for i, r in enumerate(rows))
    assert got == want
    kept = simhash.keep_one_each(odd_docs(spark))
    assert kept.columns == ["doc_id", "text", "fingerprint"]
    ids = [r.doc_id for r in kept.where("doc_id is not null").collect()]
    assert len(ids) == len({*ids}) and {5, 9, 20, 21} <= {*ids} and 11 not in ids
    assert kept.where("text = 'alone here now'").count() == 1
    assert simhash.near_duplicates(odd_docs(spark).limit(0)).count() == 0


def test_rows_of_one_id_are_told_apart(spark):
    words = [f"w{k}" for k in range(300)]
    rows = [(1, "one text of its own about the sea"), (1, "and quite another one about mountains"), (1, "one text of its own about the sea"), (1, " ".join(words)), (2, " ".join(words)), (None, " ".join(words)), (None, "no id here"), (None, "no id here"), (None, "no id there at all")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n int")
    kept = sorted((str(r.doc_id), r.text[:12]) for r in simhash.keep_one_each(df).collect())
    assert kept == sorted([("1", "one text of "), ("1", "and quite an"), ("1", "w0 w1 w2 w3 "), ("None", "no id here"), ("None", "no id there ")])
    again = sorted((str(r.doc_id), r.text[:12]) for r in simhash.keep_one_each(df.orderBy(F.desc("n")).repartition(5)).collect())
    assert again == kept


def test_rows_are_told_apart_by_a_bitmap(spark):
    df = spark.range(5000).select("id", F.xxhash64("id").alias("h"), F.lit("x").alias("__bit"))
    keys = df.where("id % 37 = 0").select(F.col("h").alias("key"))
    stay, maybe = common.possibly_in(df, F.col("h"), keys, "key")
    kept, rest = ({r.id for r in part.collect()} for part in (stay, maybe))
    assert stay.columns == df.columns and not kept & rest and len(kept) + len(rest) == 5000
    assert {k for k in range(0, 5000, 37)} <= rest and len(rest) < 145
    assert common.possibly_in(df, F.col("h"), keys.limit(0), "key")[0].count() == 5000


def test_registered_simhash_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    prints = {d: brute_fingerprint(t) for d, t in texts.items()}
    want = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    for r in queries.op3_simhash_duplicates(spark, DATA).collect():
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


# ---- nearest neighbours


def test_search_equals_sql_on_small_tables(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{DATA}/embeddings.parquet')")
    want = con.execute(queries.oracle_sql()["op2_nearest_vectors"]).fetchall()
    got = queries.op2_nearest_vectors(spark, DATA).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_recall_with_a_third_of_equal_vectors(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(3000, 24))
    x[1000:1900] = x[0]
    x[2000:] = x[1] + 0.05 * draw.normal(size=(1000, 24))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "label") for i, v in enumerate(x)], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in ann.search(df, "vec_id % 50 = 0", k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(0, 3000, 50):
        s = ann.inner_products(x[q].astype(float)[None], x.astype(float))
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:20]
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, 21)) and all(v == pytest.approx(s[i], abs=0) for _, i, v in mine)
        assert [m[1:] for m in mine] == sorted((m[1:] for m in mine), key=lambda m: (-m[1], m[0]))
        hits += len({i for _, i, _ in mine} & {*want.tolist()})
    assert hits / (60 * 20) >= 0.95


def test_recall_holds_over_many_lists(spark, monkeypatch):
    """Vectors without clusters in 375 lists, of which 48 hold too few of the neighbours."""
    monkeypatch.setattr(ann, "LIST", 32)
    x = np.random.default_rng(2).normal(size=(12_000, 32))
    x = (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(df, "vec_id % 40 = 0", k=20).toPandas()
    s = x[::40].astype(float) @ x.T.astype(float)
    s[np.arange(300), np.arange(0, 12_000, 40)] = -np.inf
    want = {(q * 40, int(v)) for q, best in enumerate(np.argsort(-s, 1)[:, :20]) for v in best}
    assert len(got) == 6000 and len(want & {*zip(got.query_id, got.vec_id)}) / 6000 >= 0.9


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.search(df, "vec_id >= 0", k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (1, 1, 0, 0.5)]
    assert ann.search(df.limit(0), "true").count() == 0


def test_rows_that_share_an_id_are_queries_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [1.0, 1.0]), (20, [1.0, 0.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in ann.search(df, "vec_id = 0", k=2).collect())
    assert got == [(0, 1, 1, 2.0), (0, 1, 2, 3.0), (0, 2, 3, 1.0), (0, 2, 3, 1.0)]
    every = sorted(tuple(r) for r in ann.search(df, "vec_id = 0", k=9).collect())
    assert len(every) == 10 and sum(r[2] == 0 for r in every) == 2  # each of the two is a neighbour of the other


# ---- decontamination


def brute_align(passage, item):
    h, best = [[0] * (len(item) + 1) for _ in range(len(passage) + 1)], 0
    for i in range(1, len(passage) + 1):
        for j in range(1, len(item) + 1):
            d = h[i - 1][j - 1] + (decontaminate.MATCH if passage[i - 1] == item[j - 1] else -decontaminate.MISMATCH)
            h[i][j] = max(0, d, h[i - 1][j] - decontaminate.SKIP, h[i][j - 1] - decontaminate.SKIP)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_plain_table():
    random.seed(8)
    pairs = [([random.randrange(6) for _ in range(random.randrange(1, 40))], [random.randrange(6) for _ in range(random.randrange(1, 30))]) for _ in range(80)]
    best, _ = decontaminate.align([np.array(p) for p, _ in pairs], [np.array(i) for _, i in pairs])
    assert best.tolist() == [brute_align(p, i) for p, i in pairs]


def leak_tables(spark):
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(40)] for _ in range(6)]
    fill = lambda n: [word() for _ in range(n)]
    edited = [w if random.random() > 0.2 else word() for w in items[1]]
    dropped = [w for k, w in enumerate(items[2]) if k % 6]
    docs = [
        (0, " ".join(fill(50) + items[0] + fill(50))), (1, " ".join(fill(9) + edited + fill(70)).upper()), (2, ", ".join(fill(30) + dropped)), (3, " ".join(fill(200))), (4, " ".join(fill(30) + items[3][:6] + fill(30))),
        (5, " ".join(items[4][:25] + fill(20))), (6, None), (7, ""), (None, " ".join(items[0])), (0, " ".join(items[5])), (2**60 + 1, " ".join(fill(60_000) + items[5] + fill(10))),
    ]
    bench = [(k, " ".join(i)) for k, i in enumerate(items)] + [(90, None), (91, "too short"), (None, " ".join(items[5]))]
    return spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(bench, "item_id long, text string")


@pytest.mark.parametrize("block, few", [(decontaminate.BLOCK, decontaminate.FEW), (50, 0)])
def test_leaks_equal_full_alignment(spark, monkeypatch, block, few):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    monkeypatch.setattr(decontaminate, "FEW", few)
    docs, bench = leak_tables(spark)
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(docs, bench).collect()}
    want = {}
    for d in docs.collect():
        words = decontaminate.words_of(d.text or "")
        for b in bench.collect():
            item = decontaminate.words_of(b.text or "")
            if len(item) >= 4 and len(words) < 5000:
                score = brute_align(words, item) / (2 * len(item))
                if score >= 0.5:
                    want[d.doc_id, b.item_id] = max(score, want.get((d.doc_id, b.item_id), 0))
    want |= {(2**60 + 1, 5): 1.0, (2**60 + 1, None): 1.0}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert {k[0] for k in got} == {0, 1, 2, 5, None, 2**60 + 1}
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 6, 7]
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("change", ["third word", "fourth word", "put in after every second", "left out every third", "one of a short item"])
def test_edited_copies_have_seeds(spark, change):
    random.seed(11)
    item = [f"i{k}x" for k in range(15)]
    edited = {
        "third word": [f"z{k}" if k % 3 == 2 else w for k, w in enumerate(item)],
        "fourth word": [f"z{k}" if k % 4 == 3 else w for k, w in enumerate(item)],
        "put in after every second": [x for k, w in enumerate(item) for x in ([w, f"z{k}"] if k % 2 else [w])],
        "left out every third": [w for k, w in enumerate(item) if k % 3 != 2],
        "one of a short item": item[:4],
    }[change]
    item = item[:4] if change == "one of a short item" else item
    fill = [f"w{random.randrange(500)}" for _ in range(400)]
    docs = spark.createDataFrame([(k, " ".join(fill[:at] + edited + fill[at:])) for k, at in enumerate((0, 200, 400))] * 70, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(item)) for k in range(6)], "item_id long, text string")  # many documents and items hold the seeds
    got = decontaminate.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in range(3) for i in range(6)} and len(got) == 18
    assert all(r.score == pytest.approx(brute_align(edited, item) / (2 * len(item))) for r in got)


def test_long_passages_are_cut_in_stretches_that_lose_nothing(spark):
    item = [f"i{k}" for k in range(20)]
    text = [w for k in range(300) for w in (*item[k % 5 : k % 5 + 6], f"z{k}", f"y{k}")]  # seeds of the item everywhere, copies nowhere
    text[1200:1200] = item
    docs = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.score, r.first_word, r.last_word) for r in got] == [(1.0, 1200, 1219)]


def test_characters_are_words_where_no_spaces_are_written():
    assert [w.decode() for w in decontaminate.words_of("私は Go，学校へ")] == ["私", "は", "go，", "学", "校", "へ"]


def test_registered_leaks_equal_full_alignment(spark):
    items = {r.item_id: decontaminate.words_of(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    texts = {r.doc_id: decontaminate.words_of(r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    number = {w: k for k, w in enumerate({w for ws in [*items.values(), *texts.values()] for w in ws})}
    arrays = [np.array([number[w] for w in ws]) for ws in items.values()]
    want = {}
    for d, ws in texts.items():
        have = {*ws}
        if any(sum(w in have for w in i) * 2 >= len(i) for i in items.values()):  # else no item can reach half of its points
            best, _ = decontaminate.align([np.array([number[w] for w in ws])] * len(arrays), arrays)
            want |= {(d, i): b / (2 * min(len(a), 80)) for i, a, b in zip(items, arrays, best.tolist()) if b >= len(a) and b >= 16}
    got = {(r.doc_id, r.item_id): r.score for r in queries.op5_decontamination(spark, DATA).collect()}
    assert want and got == {k: pytest.approx(min(1.0, v)) for k, v in want.items()}


def test_a_seed_that_thousands_of_items_share_costs_little(monkeypatch):
    import tracemalloc

    random.seed(12)
    word = lambda: f"w{random.randrange(40_000)}"
    opening = "which of the following statements best describes the role of".split()
    items = [opening + [word() for _ in range(12)] for _ in range(3000)]
    seeds = decontaminate.Seeds(items, [np.unique(decontaminate.seed_hashes([w.encode() for w in i])[0]).view(np.int64).tolist() for i in items], 0.5)
    words = [w for _ in range(500) for w in (*opening, *(word() for _ in range(10)))]
    words[6000:6000] = items[77]
    words = [w.encode() for w in words]
    h, places = decontaminate.seed_hashes(words)
    at = np.flatnonzero(np.isin(h, seeds.hashes))
    seed = np.searchsorted(seeds.hashes, h[at])
    found = []
    for cells, few in ((decontaminate.CELLS, decontaminate.FEW), (1000, 0)):
        monkeypatch.setattr(decontaminate, "CELLS", cells)
        monkeypatch.setattr(decontaminate, "FEW", few)
        tracemalloc.start()
        found.append([*seeds.passages(words, places[at], seed)])
        assert tracemalloc.get_traced_memory()[1] < 40e6  # all places of all items: 15 million
        tracemalloc.stop()
    assert found[0] == found[1] and any(lo <= 6000 and hi >= 6022 and 77 in mine for lo, hi, mine in found[0])
    # every item that has enough of its words near its seeds is there
    step = 3 * seeds.margin
    for start in range(0, 20 * step, step):
        own = slice(*np.searchsorted(places[at], [start, start + 2 * step]))
        want = set()
        for item, ws in enumerate(items):
            mine = places[at][own][np.isin(seed[own], np.searchsorted(seeds.hashes, decontaminate.seed_hashes([w.encode() for w in ws])[0]))]
            edges = [0, *(np.flatnonzero(np.diff(mine) > seeds.margin) + 1), len(mine)]
            for a, b in zip(edges[:-1], edges[1:]):
                lo, hi = max(0, mine[a] - seeds.margin), mine[b - 1] + 4 + seeds.margin
                if len({w.encode() for w in ws} & {*words[lo:hi]}) >= seeds.least[item]:
                    want.add(item)
        got = {i for lo, hi, mine in decontaminate.Seeds.passages(seeds, words[: start + 2 * step + 200], places[at][own], seed[own]) for i in mine}
        assert want <= got
