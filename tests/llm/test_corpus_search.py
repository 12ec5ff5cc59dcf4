"""Phrases, benchmark overlaps and lexical search against brute force: edge rows, hot groups, every bound crossed."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from segmentflow.llm import collocations, decontaminate, lexical_search
from segmentflow.llm.queries import ORACLE_SQL, QUERIES

ODD = "doc_id long, text string, lang string, item string, n long, `own.text` string, score string, rank string"
RNG = random.Random(11)
WORDS = ["the", "The", "of", "a1", "ñandú", "中文", "x", "deep", "learning", "zz", "q-r", "it's", "9"]
BREAKS = [" ", " ", " ", "  ", "\t", ". ", "\n", ", ", "; ", "! ", "\x0b", "?", ":"]


def prose(n):
    return "".join(RNG.choice(WORDS) + RNG.choice(BREAKS) for _ in range(n))


TEXTS = [None, "", " \t ", "...", "word", "The the THE of", "x" * 30_000, "deep learning " * 6_000, "a\x00b c\x7fd", "🙂 ok 🙂"]
TEXTS += [prose(RNG.randint(1, 60)) for _ in range(120)] + ["one and the same text here"] * 40


def frame(spark, texts, ids=None):
    langs = [None, "en", "de", "und"]
    rows = [(i if ids is None else ids[i], t, langs[i % 4], "a", 1, "b", "c", "d") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ODD).repartition(3)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 11 phrases


def brute_phrases(rows, least, most, k, absorbed=100):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            own = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(own)
            for size in range(1, most + 1):
                for i in range(len(own) - size + 1):
                    f[lang, tuple(own[i : i + size])] += 1
    wanted = [(lang, p, a) for (lang, p), a in f.items() if len(p) > 1 and a >= least]
    out = []
    for lang, p, a in wanted:
        inside = any(
            x == lang and len(q) > len(p) and 100 * b >= absorbed * a and any(q[i : i + len(p)] == p for i in range(len(q)))
            for x, q, b in wanted
        )
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:c]] * f[lang, p[c:]]), c) for c in range(1, len(p))]
            score, c = min(cuts)
            out.append((lang, " ".join(p), a, f[lang, p[:c]], f[lang, p[c:]], n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    seen = Counter()
    ranked = []
    for x in out:
        seen[x[0]] += 1
        if seen[x[0]] <= k:
            ranked.append((x[0], seen[x[0]], *x[1:]))
    return ranked


@pytest.mark.parametrize("block, least, absorbed", [(2_000_000, 5, 100), (50, 5, 100), (50, 3, 60)])
def test_phrases_equal_brute_force(spark, monkeypatch, block, least, absorbed):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block)
    monkeypatch.setattr(collocations, "OPEN_WORDS", 2 * block)
    docs = frame(spark, TEXTS)
    got = collocations.collocations(docs, least=least, most_words=5, absorbed=absorbed, k=40).collect()
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert sorted(map(tuple, got)) == sorted(brute_phrases(rows, least, 5, 40, absorbed))


def test_phrases_of_no_rows_and_of_rare_words(spark):
    docs = frame(spark, TEXTS)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs, least=10**6).count() == 0


# 12 benchmark overlaps


def brute_overlaps(texts, items, width=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for name, text in items:
        own = find(text)
        for i in range(max(1, len(own) - width + 1) if own else 0):
            windows.setdefault(tuple(own[i : i + width]), set()).add("" if name is None else str(name))
    out = []
    for text in texts:
        own, hit, found = find(text), set(), set()
        for w, names in windows.items():
            for i in range(len(own) - len(w) + 1):
                if tuple(own[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found |= names
        out.append((len(own), len(hit), sorted(found)))
    return out


ITEMS = [
    (1, prose(30)), (2, "one and the same text here"), (3, None), (4, "..."), (5, "deep LEARNING"), (None, "ñandú ñandú"), (5, "a1 中文"), (2, prose(12)),
    (10, "one and the same text here"), (7, "deep learning " * 20),
]


@pytest.mark.parametrize("held", [500_000, 0])
def test_overlaps_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", held)
    texts = TEXTS + [f"Start {ITEMS[0][1]} end", ITEMS[0][1][:40], "x ñandú... ÑANDÚ ñandú, ñandú y", "deep", "learning deep"]
    docs, items = frame(spark, texts), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.overlaps(docs, items).collect()}
    for i, (t, want) in enumerate(zip(texts, brute_overlaps(texts, ITEMS))):
        assert (got[i].n_words, got[i].n_hit, got[i].items) == want, t
        spans = [t.encode()[s.start : s.end].decode() for s in got[i].spans]
        assert bool(spans) == bool(want[1]) and (not spans or sum(len(re.findall(decontaminate.WORD, lower(s))) for s in spans) == want[1])
    clean = decontaminate.without_hits(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i in got if not got[i].n_hit}
    cut = decontaminate.without_hits(docs, items, remove="spans")
    assert cut.columns == docs.columns
    for r in cut.collect():
        raw = (texts[r.doc_id] or "").encode()
        for s in reversed(got[r.doc_id].spans):
            raw = raw[: s.start] + raw[s.end :]
        assert (r.text or "") == raw.decode()


@pytest.mark.parametrize("held", [500_000, 0])
def test_overlaps_of_no_rows_and_no_items(spark, monkeypatch, held):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", held)
    docs, items = frame(spark, TEXTS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.overlaps(docs.limit(0), items).count() == 0
    assert decontaminate.overlaps(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.overlaps(docs, items.limit(0)).count() == len(TEXTS)


# 13 lexical search


def brute_search(docs, items, k):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    own = [(i, Counter(find(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n, total = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for name, text in items:
        q, scored = Counter(find(text)), []
        for i, c, size in own:
            m = 75 + 25 * size * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in q.items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(name, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("terms, postings, seek", [(200_000, 4_000_000, 100_000), (7, 40, 1)])
def test_search_equals_brute_force(spark, monkeypatch, terms, postings, seek):
    for name, value in (("QUERY_TERMS", terms), ("BLOCK_POSTINGS", postings), ("SEEK_FIRST", seek), ("SEEK_SHARE", 3)):
        monkeypatch.setattr(lexical_search, name, value)
    ids = [*range(len(TEXTS) - 3), 5, 5, None]  # repeated and null ids
    docs, items = frame(spark, TEXTS, ids), spark.createDataFrame([*ITEMS, (20, "nothingknown"), (21, "The the")], "item_id long, text string")
    got = lexical_search.search(docs, items, k=15)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute_search(list(zip(ids, TEXTS)), [*ITEMS, (20, "nothingknown"), (21, "The the")], 15)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_search_of_no_rows(spark):
    docs, items = frame(spark, TEXTS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs, items.where("item_id = 4")).count() == 0


# the registered queries


@pytest.mark.parametrize("name", ["op12_decontaminate", "op13_search"])
def test_query_equals_sql(spark, views, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    assert got == sorted(views.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall(), key=str)


def test_phrases_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").select("text", "lang").collect()]
    assert sorted(map(tuple, QUERIES["op11_phrases"](spark, folder).collect())) == sorted(brute_phrases(rows, 100, 5, 2000))


def test_digest_of_items_is_by_string_order(spark, tmp_path):
    docs = spark.createDataFrame([(1, "p q r s")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "p q"), (9, "q r"), (100, "s")], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    row = QUERIES["op12_decontaminate"](spark, str(tmp_path)).first()
    assert (row.n_hit, row.n_items, row.items_sha256) == (4, 3, hashlib.sha256(b"10,100,9").hexdigest())
