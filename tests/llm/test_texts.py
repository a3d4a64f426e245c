"""Fill-in-the-middle, decontamination and spelling variants against brute force and DuckDB, and odd tables."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import decontaminate, fill_middle, queries, spelling

SF = "/root/testdata/sf0.001"
LONG = "Long " * 30000 + "tail\n"
ODD = [(1, "Hello world, hello!  "), (2, None), (3, ""), (4, "a <P> b"), (4, "a <P> b"), (5, "  \n\t "), (6, LONG), (7, "don't WE'LL ＡＢ é é ﬁ　x  y z"), (None, "Hello world, hello!  "), (-3, "日本語 текст 123"), (8, "<<P <S< <M M>")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, columns with clashing names."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    clash = {n: F.lit(1) for n in ("n", "form", "output", "digest", "spans", "items", "word", "band", "key", "forest", "root", "id")}
    return df.select("*", F.lit(None).cast("string").alias("source"), *(c.alias(n) for n, c in clash.items()))


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_decontamination", "op13_spelling_variants"])
def test_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    answer = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(answer.fetchall(), key=repr)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == want
    assert len(want) == (861 if name.startswith("op13") else 200)


UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute_middle(i, text):
    text = text or ""
    units, h = UNIT.findall(text), hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark, odd, none):
    rng = random.Random(5)
    more = spark.createDataFrame([(i, "".join(rng.choice("ab é\n\t<PSM>日") for _ in range(rng.choice([0, 1, 2, 3, 8, 30])))) for i in range(500)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    got = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((i, *brute_middle(i, t), t or "")) for i, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    wide = fill_middle.fill_in_middle_report(odd).collect()
    assert sorted(repr((r["doc_id"], r["n"], r["restored_sha256"])) for r in wide) == sorted(repr((i, len(UNIT.findall(t or "")), hashlib.sha256((t or "").encode()).hexdigest())) for i, t in ODD)
    assert fill_middle.fill_in_middle_report(none).collect() == []


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_passages(texts, items, window):
    of = {}
    for i, t in items:
        w = WORDS.findall(lowered(t))
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            of.setdefault(tuple(w[j : j + k]), set()).add("" if i is None else str(i))
    out = []
    for i, t in texts:
        w, hit, seen = WORDS.findall(lowered(t)), set(), set()
        for k in {len(x) for x in of}:
            for j in range(len(w) - k + 1):
                if (g := tuple(w[j : j + k])) in of:
                    hit |= set(range(j, j + k))
                    seen |= of[g]
        out.append((i, len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit)))
    return out


def made_up(seed):
    rng = random.Random(seed)
    line = lambda n: "".join(rng.choice(["a", "b", "é", "C", "日x", "unseen"]) + rng.choice([" ", "-", "\n"]) for _ in range(n))
    items = [(rng.choice([None, 2, 10, k]), line(rng.choice([0, 1, 2, 5, 12, 60]))) for k in range(12)] + [(3, None), (4, "?!")]
    texts = [(k, line(rng.choice([0, 3, 20, 100, 900]))) for k in range(30)] + [(None, items[0][1]), (1, None)]
    return texts + [texts[4], texts[-2]] + [(100 + k, f"{line(3)}{t}{line(9)}") for k, (_, t) in enumerate(items)], items


@pytest.mark.parametrize(("window", "block"), [(3, 10**6), (5, 40), (10, 60)])
def test_passages_equal_brute_force(spark, window, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "LANE", 16)
    texts, items = made_up(window)
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination_report(docs, bench, window, block)
    assert decontaminate.automata(bench, window=window, block_words=block).count() > (1 if block < 100 else 0)
    assert sorted(map(repr, (tuple(r)[:6] for r in got.collect()))) == sorted(map(repr, brute_passages(texts, items, window)))


def test_words_with_one_hash(monkeypatch):
    real = decontaminate.span_hashes
    monkeypatch.setattr(decontaminate, "span_hashes", lambda buf, a, b: real(buf, a, b) % np.uint64(3))
    items = [("1", "a b c d e".split(), False), ("2", "b d".split(), True)]
    text = "x a b c d f e. c d e b d a"
    a = decontaminate.build(items, 3)
    buf = np.frombuffer(text.encode(), np.uint8)
    count, spans, found = decontaminate.passages(a, buf, np.array([0, len(buf)]))
    assert count.tolist() == [13] and a.repeats > 1
    assert [(text.split()[r[1]], r[2] - r[1]) for r in spans.tolist()] == [("a", 4), ("c", 5)]
    assert [a.ids[k] for _, k in found.tolist()] == ["1", "2"]


def test_passages_of_odd_tables(spark, odd, none):
    bench = spark.createDataFrame([(1, "Hello world, HELLO!", "x"), (1, "hello world hello", "x"), (None, "текст", "y"), (2, "long " * 11, "z")], "item_id long, text string, spans string")
    rows = decontaminate.contamination_report(odd, bench).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in rows))) == sorted(map(repr, brute_passages(ODD, [(i, t) for i, t, _ in bench.collect()], 10)))
    assert decontaminate.contamination_report(none, bench).collect() == []
    assert {r["contaminated"] for r in decontaminate.contamination_report(odd, bench.limit(0)).collect()} == {False}


def test_removal(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, f"Ünder {item.upper()}, over " + "clean words here " * 5), (2, item), (3, None), (4, "nothing known")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = {r["doc_id"]: (r["text"], r["n_removed"]) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert rows == {1: ("Ünder , over " + "clean words here " * 5, 12), 3: (None, 0), 4: ("nothing known", 0)}
    assert {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, least_words=13, most_coverage=1.0).collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}


def brute_counts(docs):
    out = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= 6:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= 5}


def brute_variants(n):
    letters, out = sorted({c for w in n for c in w}), {}
    for w in n:
        cuts = [(w[:k], w[k:]) for k in range(len(w) + 1)]
        edits = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
        near = [v for v in edits if v in n and v != w]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = (best if best and n[best] >= 5 * n[w] else None, len(near))
    rows = []
    for w, (form, many) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n[w], many, n[form] if form else None))
    return rows


@pytest.mark.parametrize("most", [20_000, 12])
def test_variants_equal_brute_force(spark, most):
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.choice([5, 6, 7, 9, 14]))) for _ in range(12)]

    def changed(w):
        k = rng.randrange(len(w) + 1)
        return rng.choice([w, w, w, w[:k] + rng.choice("aéÿ") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("bÿZ") + w[k + 1 :]])

    docs = [(i, " ".join(changed(changed(s) if rng.random() < 0.3 else s) for s in rng.choices(stems, weights=range(1, 13), k=300))) for i in range(60)]
    docs += [(900 + k, "aaaaaaaaa aaaaaaaaaa aaaaaaaaaaa " * (1 + 30 * (k == 0))) for k in range(6)] + [(None, "Straße straßen straßens " * 6), (5, None), (6, "")]
    got = spelling.variant_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), trie_words=most).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = brute_variants(brute_counts(docs))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert len(want) > 300 and len({r[2] for r in want}) < len(want)


def test_variants_of_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_spelling_variants(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_variants(brute_counts(docs))))


def test_variants_of_odd_tables(spark, odd, none):
    assert spelling.variant_groups(none).collect() == []
    assert sorted(r["word"] for r in spelling.variant_groups(odd).collect()) == sorted(brute_counts(ODD))
    long_ = "q" * 60_000
    rows = spelling.variant_groups(spark.createDataFrame([(i, f"{long_} {long_}q {long_[1:]}z") for i in range(7)], "doc_id long, text string")).collect()
    assert {(len(r["word"]), r["n_near"]) for r in rows} >= {(60_000, 2), (60_001, 1)}


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(21)], "word string, form string")
    assert {r["root"] for r in spelling.roots(forms).collect()} == {"w21"}
