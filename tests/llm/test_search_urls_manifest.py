"""Ranked search, URL filters and the Merkle manifest against brute force and odd input."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256
from itertools import combinations

import pytest

from slotlog.llm import merkle, queries, ranked_search, url_filter
from slotlog.llm.url_filter import Rule

DOCS = "doc_id long, text string, lang string, source string, n_chars long, place long, n long, tree string, digest string, rank int, score long"
ODD = [None, "", " ", "...", "a", "A a", "Käse käse KÄSE", "x" * 50_000, "one two three", "wort " * 30_000, "mot " * 400_000]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", 3, 1, 2, "t", "d", 1, 5) for d, t, lang in rows], DOCS)


# ------------------------------------------------------------------ ranked search

def terms_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def brute_search(docs, items, k=10):
    bags = [(d, Counter(terms_of(t))) for d, t, _ in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    total, df = sum(n for *_, n in bags), Counter()
    for _, b, _ in bags:
        df.update(b.keys())
    out = []
    for item_id, text in items:
        ranked = []
        for d, b, n in bags:
            m = 100 - 75 + 75 * n * len(bags) // total
            score = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * m))
                        for t in terms_of(text) if b[t])
            if score > 0:
                ranked.append((-score, d is None, d if d is not None else 0, d))
        out += [(item_id, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(ranked)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("seed_docs", [20_000, 40])
def test_ranked_search(spark, monkeypatch, seed_docs):
    monkeypatch.setattr(ranked_search, "SEED_DOCS", seed_docs)
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    some = lambda n: " ".join(rng.choice(vocabulary[:rng.choice([20, 300])]) + rng.choice(["", ",", "\n"]) for _ in range(n))
    docs = [(i, some(rng.randint(1, 120)), "en") for i in range(700)]
    docs += [(i + 2000, t, None) for i, t in enumerate(ODD)] + [(None, docs[3][1], "en"), (7, docs[3][1], "en"), *[(5000 + i, docs[9][1], "en") for i in range(30)]]
    items = [(i, some(rng.randint(1, 40))) for i in range(37)] + [(1, "käse one"), (None, docs[3][1]), (90, None), (91, ""), (92, "nowhere found"), (93, docs[9][1])]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    want = brute_search(docs, items)
    assert found(ranked_search.search(frame(spark, docs).repartition(5), table)) == want
    # Several blocks of items give the same.
    assert found(ranked_search.search(frame(spark, docs), table, block_chars=900)) == want


def test_ranked_search_leaves_out_what_cannot_win():
    rng = random.Random(1)
    import numpy as np

    items = [{t: 100 for t in range(10 * i, 10 * i + 10)} for i in range(64)]
    searcher = ranked_search.Searcher(items, 640, 2, [1] * 64)
    importance = np.full(640, 100)
    for start in range(0, 4000, 1000):
        rows = [(r, t) for r in range(1000) for t in sorted(rng.sample(range(10 * (r % 64), 10 * (r % 64) + 10), 5))]
        row, term = np.array(rows).T
        searcher.block(np.arange(start, start + 1000), np.zeros(1000, np.int64), row, term, np.full(len(row), 7), importance)
    item, _, ids, score = searcher.result()
    assert sorted(item.tolist()) == sorted(list(range(64)) * 2) and set(score.tolist()) == {3500}
    assert all(d % 1000 % 64 == i for i, d in zip(item.tolist(), ids.tolist(), strict=True))
    assert searcher.scored < 4000 * 64 / 8  # a document shares terms with one of 64 items


def test_ranked_search_of_empty_tables(spark):
    none, table = frame(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert found(ranked_search.search(none, table)) == []
    assert found(ranked_search.search(frame(spark, [(1, "a", "x")]), table.limit(0))) == []
    assert found(ranked_search.search(frame(spark, [(1, None, "x"), (2, "", "x")]), table)) == []


def test_long_texts_are_split_in_stretches(monkeypatch):
    text = ("Ab1 ä-b " * 500).encode()
    whole = ranked_search.term_counts(text)
    monkeypatch.setattr(ranked_search, "STRETCH", 13)
    assert ranked_search.term_counts(text) == whole == (1500, Counter({b"ab1": 500, "ä".encode(): 500, b"b": 500}))


# ------------------------------------------------------------------ URL filters

PAGES = "page_id long, url string, html string, host string, rule string, verdict string, row long, tokens string"


def brute_parts(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path, rules):
    fit = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: (len(r.text), len(r.host), r.verdict), default=None)


def brute_tokens(url):
    host, path = brute_parts(url)
    labels = [x for x in host.split(".") if x]
    out = {"h:" + x for x in labels} | ({"t:" + host.split(".")[-1]} if host.split(".")[-1] else set())
    out |= {"p:" + s for s in re.sub("[0-9]+", "0", "".join(c.lower() if c.isascii() else c for c in path)).split("/") if s}
    query = re.match(r"(?s).*?://[^?#]*\?([^#]*)", url or "")
    return out | ({"q:" + q.split("=")[0] for q in query.group(1).split("&") if q.split("=")[0]} if query else set())


def brute_verdicts(pages, rules, labelled=None):
    parts = [brute_parts(u) for _, u in pages]
    listed = [brute_rule(h, p, rules) for h, p in parts]
    known = [(brute_tokens(u), r.verdict) for (_, u), r in zip(pages, listed, strict=True) if r] if labelled is None else [(brute_tokens(u), v) for u, v in labelled]
    made, n = [], len(known)
    if n:
        least = math.ceil(max(0.01, 3 / n) * n)
        rows = {}
        for i, (ts, _) in enumerate(known):
            for t in ts:
                rows.setdefault(t, []).append(i)
        same = {}
        for t, held in rows.items():
            if least <= len(held) < n:
                same.setdefault(tuple(held), []).append(t)
        kept = {min(ts) for ts in same.values()}
        both, each = Counter(), Counter()
        for ts, v in known:
            for size in range(1, len(ts & kept) + 1):
                for part in combinations(sorted(ts & kept), size):
                    both[part, v] += 1
                    each[part] += 1
        made = [(-c / each[part], -c, len(part), part, v) for (part, v), c in both.items() if c >= least and c / each[part] >= 0.8]
    out = []
    for (i, u), (h, p), r in zip(pages, parts, listed, strict=True):
        best = min((m for m in made if set(m[3]) <= brute_tokens(u)), default=None)
        out.append((i, h, p, r.text if r else None, r.verdict if r else best[4] if best else "allow"))
    return sorted(out, key=str)


def judged(df):
    return sorted((tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict").collect()), key=str)


def some_pages(rng, n):
    out = []
    for i in range(n):
        host = rng.choice(["www.", "m.", "", "a.b."]) + rng.choice(["example", "shop", "Example"]) + "." + rng.choice(["com", "net", "org", "co.uk"])
        path = "/" + rng.choice(["en", "es", "fr", "EN", "news/x"]) + rng.choice(["", "/", f"/{i}", f"/{i}.html"])
        out.append((i, rng.choice(["http", "https"]) + "://" + host + path + rng.choice(["", "?page=2&ref=x", "#top", "?q"])))
    return out


ODD_URLS = [None, "", "://", "http://", "example.com/en/", "http://example.com", "http://EXAMPLE.com/en/a://b", "x://net", "x://net/", "x://.net/es/", "x://a..net/es/",
            "http://example.com?x=/en/", "http://example.com#/en/", "http://www.example.com/en/?a", "http://evilexample.com/en/", "http://u:p@example.com:80/en/",
            "http://net/es/\nx", "ü://Ünet.net/fr/ß", "http://a.com/" + "/".join(f"s{chr(97 + i % 26)}{i}" for i in range(3000))]


def test_url_verdicts(spark):
    rng = random.Random(3)
    pages = some_pages(rng, 900) + [(None if i % 2 else 5, u) for i, u in enumerate(ODD_URLS * 2)]
    table = spark.createDataFrame([(i, u, "h", "x", "y", "z", 1, "t") for i, u in pages], PAGES).repartition(4)
    want = brute_verdicts(pages, queries.URL_RULES)
    assert judged(url_filter.judge(table, queries.URL_RULES)) == want
    assert {v for *_, rule, v in want if rule is None} == {"allow", "block"}


def test_url_verdicts_from_labels(spark):
    rng = random.Random(8)
    pages, seen = some_pages(rng, 200), some_pages(rng, 300)
    labelled = [(u, "block" if "shop" in u and "fr" in u else "allow") for _, u in seen] + [(None, "block")]
    table = spark.createDataFrame([(i, u, "h", "x", "y", "z", 1, "t") for i, u in pages], PAGES)
    got = judged(url_filter.judge(table, [], spark.createDataFrame(labelled, "url string, verdict string")))
    assert got == brute_verdicts(pages, [], labelled)
    assert "block" in {r[-1] for r in got}


def test_url_verdicts_of_empty_tables(spark):
    table = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert judged(url_filter.judge(table.limit(0), queries.URL_RULES)) == []
    assert judged(url_filter.judge(table, queries.URL_RULES)) == [(1, "a.org", "/x", None, "allow")]
    assert judged(url_filter.judge(table, [])) == [(1, "a.org", "/x", None, "allow")]


def test_longest_rule_wins():
    assert brute_rule("a.example.com", "/en/1", queries.URL_RULES).text == "example.com/en/"
    assert Rule("net", "/es/", "block").text == "net/es/"


# ------------------------------------------------------------------ Merkle manifest

def h(text):
    return sha256(text.encode()).hexdigest()


def brute_tree(nodes, fanout):
    """Root and, for each leaf, its (left, right) siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
        for leaf, place in enumerate(at):
            run, slot = runs[place // fanout], place % fanout
            paths[leaf].append(("".join(run[:slot]), "".join(run[slot + 1:])))
        at = [p // fanout for p in at]
        nodes = [h("".join(r)) for r in runs]
    return nodes[0], paths


def brute_manifest(rows, fanout=8):
    def leaf(r, low=False):
        d, t, lang = r
        if low and t is not None:
            t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, "s", lang, 3, t)))

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in langs}
    built = {lang: brute_tree([leaf(r) for r in trees[lang]], fanout) for lang in langs}
    root, tops = brute_tree([built[lang][0] for lang in langs], fanout)
    out = []
    for i, lang in enumerate(langs):
        for r, path in zip(trees[lang], built[lang][1], strict=True):
            whole = path + tops[i]
            acc = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for left, right in whole:
                acc = h(left + acc + right)
            out.append((r[0], leaf(r), built[lang][0], root, h("".join(x + y for x, y in whole)), acc, acc == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_manifest(spark, fanout):
    rng = random.Random(fanout)
    rows = [(i, rng.choice(["Ab c", "ab C", "x", "Ä"]) + str(i % 7), rng.choice(["en"] * 5 + ["de", "", "ä", "Z"])) for i in rng.sample(range(10_000), 150)]
    rows += [(i + 20_000, t, None) for i, t in enumerate(ODD)] + [(None, "A", "en"), (None, None, "en"), (7, "same", "en"), (7, "same", "en"), (7, "Other", "en")]
    rows += [(30_000, "Alone", "one"), (40_000, "copy", "hot")] + [(40_000, "Copy", "hot")] * 90
    got = merkle.manifest(frame(spark, rows).repartition(3), fanout=fanout).select(*COLUMNS)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_manifest(rows, fanout)


def test_manifest_of_small_tables(spark):
    assert merkle.manifest(frame(spark, [])).collect() == []
    one = [(1, "Text", "en")]
    assert [tuple(r) for r in merkle.manifest(frame(spark, one)).select(*COLUMNS).collect()] == brute_manifest(one)


def test_many_groups(spark):
    rows = [(i, f"T{i}", f"g{i % 70}") for i in range(200)]
    got = merkle.manifest(frame(spark, rows)).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_manifest(rows)
