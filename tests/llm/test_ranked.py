"""Ranked search, divergence audit and language codes against plain Python versions, on odd rows and empty tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import compare
from conftest import SF_DIR

from httploom.llm import divergence, fptree, langcodes, queries

ASKED = [(1, "the and the of"), (2, None), (3, ""), (4, "zzzz nowhere"), (4, "word1 word2 é"), (None, "a and word5"), (6, "word7 x" * 500), (7, "THE ab")]


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_source_divergence"])
def test_matches_sql(spark, con, name):
    assert compare(spark, con, name, queries.QUERIES[name], queries.ORACLE[name], SF_DIR) == ""


def ranked(docs, items, top):
    """Every document scored for every item."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    bags = [(k, Counter(words(t))) for k, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        scored = []
        for key, bag in bags:
            m = 50 + 50 * sum(bag.values()) * n_docs // n_terms
            parts = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * bag[w] // (1000 * bag[w] + 20 * m)) for w in set(words(text)) & set(bag)]
            if sum(parts) > 0:
                scored.append((-sum(parts), key is None, key or 0, key))
        out.extend((item, rank, key, -score) for rank, (score, _, _, key) in enumerate(sorted(scored)[:top], 1))
    return out


@pytest.mark.parametrize("top,limits", [(50, {}), (3, {"block_bytes": 100, "slice_bytes": 50_000, "tree_terms": 2_000})])
def test_ranked_search(frame, odd_docs, top, limits):
    docs = odd_docs + [(20_000 + i, f"the word{i % 7} and" + " of" * (i % 5)) for i in range(500)]
    items = frame(ASKED, "item_id long, text string").drop("doc_id")
    got = fptree.search(frame(docs), items, top=top, **limits)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == Counter(ranked(docs, ASKED, top))
    assert fptree.search(frame(docs).limit(0), items).count() == 0 and fptree.search(frame(docs), items.limit(0)).count() == 0


def test_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 12, 3_000)
    sizes[:500] = 6
    place = np.concatenate([np.arange(6) if i < 500 else np.sort(rng.choice(400, s, replace=False)) for i, s in enumerate(sizes)]).astype(np.int64)
    starts, tf, m = np.r_[0, np.cumsum(sizes)], rng.integers(1, 9, len(place)), rng.integers(50, 400, len(sizes))
    tree, weights = fptree.Tree(starts, place, tf, m, 400), rng.integers(1, 9000, 400)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    assert sorted(tree.order) == list(range(len(sizes))) and len(tree.low) < 400
    visited = 0
    for _ in range(20):
        wanted = np.sort(rng.choice(400, 8, replace=False))
        total = np.zeros(len(sizes), np.int64)
        hit = np.isin(place, wanted)
        np.add.at(total, doc[hit], fptree.scores(weights[place[hit]], tf[hit], m[doc[hit]]))
        order = np.lexsort((np.arange(len(sizes)), -total))[:10]
        found, score = tree.search(wanted, weights, np.arange(len(sizes)), 10)
        assert sorted(zip(-score, found)) == [(-total[d], d) for d in order if total[d] > 0]
        bound = fptree.scores(weights[wanted], tree.peak[:, wanted].astype(np.int64), tree.floor[:, None]).sum(axis=1)
        assert all(bound[n] >= total[tree.order[tree.low[n] : tree.high[n]]].max() for n in range(len(tree.low)))
        visited += (bound >= score.min()).sum()
    assert visited < 20 * len(tree.low)


def audited(docs, min_docs, top):
    """All shares of all kept terms, all differences."""
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    df, cells, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((a or "", b or "", c) for a, b, c in docs):
        groups[lang].add(source)
        df[lang].update(set(words(text)))
        cells[lang, source].update(words(text))
    out = []
    for lang, sources in groups.items():
        kept = [w for w, n in df[lang].items() if n >= min_docs]

        def shares(bags):
            count = {w: sum(b[w] for b in bags) for w in kept}
            return {w: 1 + 10**9 * (n + 5) // (sum(count.values()) + 5 * len(kept)) for w, n in count.items()}

        q = shares([cells[lang, s] for s in sources])
        p = {s: shares([cells[lang, s]]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(p[s][w] - q[w], w) for w in kept if cells[lang, s][w] and p[s][w] > q[w]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                order = sorted(found, key=lambda f: (-f[0], f[1].encode()))[:limit]
                out.extend((lang, s, part, item, value, rank) for rank, (value, item) in enumerate(order, 1))
    return out


@pytest.mark.parametrize("limits", [{}, {"first_level": 1, "slice_bytes": 20_000, "tile_size": 3, "block_terms": 50}])
def test_divergence(spark, rows, odd_docs, limits):
    docs = [(lang, source, text) for lang, source, text in rows("documents", "lang", "source", "text")]
    docs += [("xx", None, t) for _, t in odd_docs[-18:]] + [(None, "s", "bé bé bé bé"), (None, "t", None), ("empty", "a", "1 2"), ("empty", "b", None)]
    docs += [("long", f"s{i % 2}", f"{'y' * 70} {'y' * 70}{'z' * (i % 2)} y") for i in range(12)]
    df = spark.createDataFrame(docs, "lang string, source string, text string").selectExpr("*", "1 as n", "2 as prefix", "3 as term", "4 as number", "5 as value")
    got = divergence.audit(df, min_docs=5, top=7, **limits)
    assert Counter(map(tuple, got.collect())) == Counter(audited(docs, 5, 7))
    assert divergence.audit(df.limit(0)).count() == 0


def test_filter_never_loses_a_prefix(spark):
    found = [("en", bytes([65 + i % 20, 65 + i // 20, 66])) for i in range(300)]
    passed = divergence._filter(spark.createDataFrame(found, "lang string, prefix binary"), len(found))
    assert passed.passed("en", [p for _, p in found]).all() and passed.passed("de", [p for _, p in found]).mean() < 0.2


def test_codewords():
    for n in (1, 2, 4, 6, 7, 40):
        code = langcodes.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
        if n > 1:
            assert (np.abs(code.sum(axis=0)) < n).all()  # each bit splits the languages
            apart = (code.shape[1] - code @ code.T) // 2
            assert apart[~np.eye(n, dtype=bool)].min() >= {2: 1, 4: 4, 6: 16, 7: 12, 40: 20}[n]


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = "Ein längerer Text, über 7 Dinge! " * 40
    whole = langcodes.counts(text)
    monkeypatch.setattr(langcodes, "PIECE", 64)
    assert (langcodes.counts(text) == whole).all() and langcodes.letters("12 -- ½") == b"" == langcodes.letters(None)


def test_language_id(spark, frame, rows):
    """Held-out accuracy, a plain decoding of the same model, labels that are not inputs, and rows without letters."""
    known = rows("documents", "doc_id", "lang", "text")
    odd = [(None, "en", known[0][2]), (70_001, None, known[1][2]), (70_002, "en", None), (70_003, "de", "12 !! ½"), (70_004, "fr", ""), (70_005, "en", known[2][2] * 400)]
    df = frame(known + odd, "doc_id long, lang string, text string")
    held = "pmod(doc_id, 4) = 2"
    got = langcodes.identify(df, queries.F.expr(held)).collect()
    lang = {k: v for k, v, _ in known}
    tested = [r for r in got if r.held_out]
    assert len(got) == len(known) + len(odd) and len(tested) > 40
    assert sum(r.lang_pred == lang.get(r.doc_id, "en") for r in tested if r.doc_id < 70_000) >= 0.97 * sum(r.doc_id < 70_000 for r in tested)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 and by_id[k].ambiguous for k in (70_002, 70_003, 70_004))
    assert not by_id[None].held_out and all(0 <= r.score <= 1 for r in got)
    changed = df.selectExpr("doc_id", f"if({held}, 'xx', lang) as lang", "text")
    assert {r.doc_id: r.lang_pred for r in langcodes.identify(changed, queries.F.expr(held)).collect()} == {r.doc_id: r.lang_pred for r in got}

    model = langcodes.fit(df.where(f"lang is not null and text is not null and not ({held})").selectExpr("doc_id as id", "lang", "text"))
    for _, _, text in known[:20]:
        features = Counter(f for part in langcodes.features(langcodes.letters(text)) for f in part.tolist())
        size = sum(features.values()) + langcodes.SHORT
        margins = [sum(n * int(model.weights[f, j]) for f, n in features.items()) / size / 65536 for j in range(model.code.shape[1])]
        loss = [
            sum(model.trust[k, j] * math.log1p(math.exp(-model.code[k, j] * 4 * m / model.scale[j])) for j, m in enumerate(margins)) for k in range(len(model.langs))
        ]
        best, score, _ = model.decode(np.array([model.margins(text)]))
        assert best[0] == int(np.argmin(loss)) and math.isclose(score[0], 1 / sum(math.exp(-len(margins) * (v - min(loss))) for v in loss), rel_tol=1e-6)


def test_language_id_of_few_or_no_languages(spark):
    df = spark.createDataFrame([(1, "en", "some words"), (2, None, "other words"), (3, None, "3")], "doc_id long, lang string, text string")
    assert [(r.lang_pred, r.score) for r in langcodes.identify(df, queries.F.lit(False)).orderBy("doc_id").collect()] == [("en", 1.0), ("en", 1.0), ("und", 0.0)]
    assert {r.lang_pred for r in langcodes.identify(df.where("lang is null"), queries.F.lit(False)).collect()} == {"und"}
    assert langcodes.identify(df.limit(0), queries.F.lit(False)).count() == 0


def test_sample_bound(spark):
    df = spark.range(20_000).selectExpr("id", "if(id % 10 = 0, 'b', 'a') as lang", "'x' as text")
    n = {r[0]: r[1] for r in langcodes.sample(df, 500).groupBy("lang").count().collect()}
    assert 400 < n["a"] < 600 and 400 < n["b"] < 600
