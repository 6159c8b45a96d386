"""Archives, vector codes and source divergences on small tables, against brute force and SQL."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from opportune.llm import codes, common, divergence, queries, warc

DATA = "/root/testdata/sf0.001"
NAMES = ["op11_warc_index", "op12_vector_codes", "op13_source_divergence"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got = queries.queries()[name](spark, DATA)
    want = con.execute(queries.oracle_sql()[name])
    order = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, got.select(order).collect()))) == sorted(map(repr, want.fetchall()))


# ---- archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, __key int, digest string").repartition(3)


ODD = [
    (1, "http://a/é?x y", "x" * 100, "p", 1, "d"), (2, "http://a/2\r\nWARC-Type: fake", "x" * 100, "p", 1, "d"), (3, None, "x" * 100, None, None, None), (4, "u", "x" * 99, "p", 1, "d"), (5, "u", "x" * 99, "p", 1, "d"),
    (6, "u", None, "p", 1, "d"), (7, "u", "", "p", 1, "d"), (None, "u", "y" * 200, "p", 1, "d"), (None, "u", "y" * 200, "p", 1, "d"), (None, "t", "y" * 200, "p", 1, "d"), (9, "u", "é\r\n\r\n" * 50, "p", 1, "d"),
    (9, "u", "é\r\n\r\n" * 50, "p", 1, "d"), (9, "u", "é\r\n\r\n" * 50, "p", 1, "d"), (10, "u", "é\r\n\r\n" * 50, "p", 1, "d"), (11, "long", "long é " * 500_000, "p", 1, "d"), (9, "other", "z" * 300, "p", 1, "d"),
]


def plain_types(rows, least=warc.LEAST_REVISIT):
    """What each row's record is, one by one in the order of ids (nulls last) and URLs."""
    holder, out = {}, []
    for page_id, url, html, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        again = digest in holder and len(data) >= least
        out.append((None if page_id is None else str(page_id), url, "revisit" if again else "response", holder[digest] if again else None, len(data), digest))
        holder.setdefault(digest, None if page_id is None else str(page_id))
    return sorted(map(repr, out))


@pytest.mark.parametrize("hot", [4096, 0, 1])
def test_archives_come_back_whole(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    folder = warc.archive_folder(spark)
    index = warc.write_archives(pages(spark, ODD), folder, most=2000)
    back = warc.read_records(index, folder)
    assert sorted(map(repr, map(tuple, back.select("row_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest").collect()))) == plain_types(ODD)
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in back.where("record_type = 'response'").collect())
    assert back.where("record_type = 'revisit' and payload is not null").count() == 0
    some = index.where("row_id in ('2', '9', '10', '11', '7')")
    got = Counter((r.row_id, bytes(r.payload).decode()) for r in warc.payloads(index, some, folder).collect())
    assert got == Counter((str(r[0]), r[2] or "") for r in ODD if r[0] in (2, 9, 10, 11, 7))


def test_any_reader_of_archives_can_read_them(spark):
    import gzip

    from pyarrow import fs

    folder = warc.archive_folder(spark)
    index = warc.write_archives(pages(spark, ODD), folder)
    store, root = fs.FileSystem.from_uri(folder)
    seen = []
    for name in {r.file for r in index.collect()}:
        with store.open_input_file(f"{root}/{name}") as f:
            data = gzip.decompress(f.read())
        while data:  # records one after the other, by their own lengths
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
            seen.append(fields["WARC-Type"])
            data = rest[size + 4 :]
    assert Counter(seen) - Counter(["warcinfo"] * 99) == Counter(r.record_type for r in index.collect())


def test_a_torn_archive_is_found(spark):
    folder = warc.archive_folder(spark)
    index = warc.write_archives(pages(spark, ODD), folder)
    with pytest.raises(Exception, match="not the record that the index names"):
        warc.read_records(index.withColumn("digest", F.lit("0" * 64)), folder).collect()
    empty = warc.write_archives(pages(spark, ODD).limit(0), folder)
    assert empty.count() == 0 and warc.read_records(empty, folder).count() == 0


def test_ranges_are_read_at_once():
    assert warc.runs([(0, 10), (10, 10), (25, 5), (100, 50), (150, 1)], gap=5, most=40) == [(0, 3, 0, 30), (3, 4, 100, 150), (4, 5, 150, 151)]
    assert warc.runs([]) == []


# ---- vector codes


def plain_nearest(x, book):
    d = ((x[:, None, :] - book) ** 2).sum(2)
    return d.argmin(1), d.min(1)


@pytest.mark.parametrize("seed", range(8))
def test_partial_distances_find_the_nearest(seed):
    random_ = np.random.default_rng(seed)
    width, entries = int(random_.integers(1, 9)), int(random_.integers(1, 65))
    most = 3 if seed % 2 else 500
    x, book = (random_.integers(-most, most + 1, (n, width)) for n in (5000, entries))
    for a, b in zip(codes.nearest(x, book), plain_nearest(x, book)):
        assert (a == b).all()


def plain_codes(rows, parts, entries, rounds):
    """Codes and errors by all distances, in plain integers."""
    rows = sorted(((r[0] is None, r[0] or 0, r[1]), r) for r in rows)
    x = [[math.floor(256 * c) for c in r[1]] for _, r in rows]
    width = len(x[0]) // parts
    books = [[v[p * width : (p + 1) * width] for v in x[:entries]] for p in range(parts)]

    def assign():
        out = []
        for v in x:
            code = []
            for p in range(parts):
                d = [sum((a - b) ** 2 for a, b in zip(v[p * width : (p + 1) * width], e)) for e in books[p]]
                code.append((d.index(min(d)), min(d)))
            out.append(code)
        return out

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p * width : (p + 1) * width] for v, code in zip(x, got) if code[p][0] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    got = assign()
    by_label = Counter()
    for (_, r), code in zip(rows, got):
        by_label[r[2]] += sum(d for _, d in code)
    return sorted(repr((r[0], r[2], "".join(f"{e:02x}" for e, _ in code), sum(d for _, d in code), by_label[r[2]])) for (_, r), code in zip(rows, got)), books


@pytest.mark.parametrize("hot", [4096, 1])
def test_codes_of_odd_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    random.seed(5)
    good = [(k if k % 9 else None, [round(random.uniform(-1, 1), 2) for _ in range(8)], k % 3 if k % 4 else None) for k in range(60)]
    good += good[:5] + [(7, [0.0] * 8, 1), (7, [-0.001] * 8, 1)]
    bad = [(1, None, 0), (2, [], 0), (3, [1.0] * 7 + [None], 0), (4, [1.0] * 7 + [float("nan")], 0), (5, [1.0] * 7 + [float("inf")], 0), (6, [1.0] * 4, 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in good + bad], "vec_id long, embedding array<double>, label int, code string, __size int").repartition(5)
    out, books = codes.compress(df, parts=4, entries=10)
    want, plain_books = plain_codes(good, 4, 10, codes.ROUNDS)
    assert books.tolist() == plain_books
    assert sorted(map(repr, map(tuple, out.select("vec_id", "label", "code", "error", "label_error").collect()))) == want
    none, books = codes.compress(df.limit(0))
    assert none.count() == 0 and books is None and codes.digest(books) is None
    with pytest.raises(ValueError):
        codes.compress(df, parts=3)
    with pytest.raises(Exception, match="too large for exact distances"):
        codes.compress(spark.createDataFrame([(1, [1e30] * 16, 0)], "vec_id long, embedding array<double>, label int"))


# ---- divergence


def plain_audit(rows, least, top):
    rows = [tuple(v or "" for v in r) for r in rows]
    terms = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    docs, counts = Counter(), Counter()
    for text, lang, source in rows:
        docs.update({(lang, w) for w in terms(text)})
        counts.update((lang, source, w) for w in terms(text))
    out = []
    for lang in {r[1] for r in rows}:
        kept = sorted(w for (g, w), n in docs.items() if g == lang and n >= least)
        sources = sorted({r[2] for r in rows if r[1] == lang})
        count = {s: {w: counts[lang, s, w] for w in kept} for s in sources}
        share = lambda own: {w: 1 + math.floor(Fraction(10**9 * (n + 2), sum(own.values()) + 2 * len(kept))) for w, n in own.items()}
        p = {s: share(count[s]) for s in sources}
        q = share({w: sum(count[s][w] for s in sources) for w in kept})
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][w], p[t][w]) for w in kept), t.encode()) for t in sources if t != s]
            own = [(-f(p[s][w], q[w]), w.encode()) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(own)[:top])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(items)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("block, tile", [(2048, 128), (3, 2)])
def test_divergences_of_odd_rows(spark, monkeypatch, block, tile):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TILE", tile)
    random.seed(3)
    words = ["Straße", "STRASSE", "über", "x", "Ünï", "naïve", "日本", "ab", "AB", "long" * 50, "zß", "é"]
    rows = [(" ".join(random.choices(words[: 4 + k % 9], k=k % 12)) + random.choice(["", "1a-b_c", "\x00q", "日本x"]), random.choice(["en", "de", None, ""]), random.choice(["s1", "s2", "ß", None, "s5"])) for k in range(150)]
    rows += [(None, "lone", "one"), ("", "none", "a"), ("12 34", "none", "b"), ("x " * 30_000, "en", "s1")] + rows[:10]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, n int, term string").repartition(4)
    want = plain_audit(rows, 4, 3)
    assert sorted(map(repr, map(tuple, divergence.audit(df, least_docs=4, top=3).collect()))) == want
    assert divergence.audit(df.limit(0)).count() == 0


def test_slices_of_one_hash_are_told_apart():
    data = b"abc abd abc xx abd"
    starts, ends = divergence.slices_of(np.frombuffer(data, np.uint8), np.array([0, 4, 4, len(data)]))
    number, terms = divergence.grouped(data, starts, ends, digest=lambda b: len(b))
    assert [terms[k] for k in number] == data.split() and len(set(terms)) == len(terms) == 3


def test_texts_do_not_run_into_each_other():
    data = np.frombuffer(b"abcd", np.uint8)
    assert [x.tolist() for x in divergence.slices_of(data, np.array([0, 0, 2, 2, 4, 4]))] == [[0, 2], [2, 4]]


def test_shares_are_exact_for_large_counts(spark):
    n, total, terms = 6 * 10**14 + 7, 8 * 10**15 + 11, 12345
    want = 1 + 10**9 * (n + 2) // (total + 2 * terms)
    assert divergence.share(np.array([n]), np.array([total]), terms)[0] == want
    assert spark.range(1).select(divergence.share_of(f"{n}L", f"{total}L", f"{terms}L")).first()[0] == want
