"""Near-duplicates by verified similarity."""

import brute
import numpy as np
import pytest
from conftest import SF_DIR

import corpus_pipeline
from httploom.llm import near, simhash


def plain(text, size=5):
    words = brute.WORD.findall(brute.lower(text or ""))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)] if words else [])


def close(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


def kept_ids(docs):
    roots = brute.components([(k, plain(t)) for k, t in docs], close)
    return sorted(k for (k, _), r in zip(docs, roots) if k == r)


def test_pairs_around_the_limit(spark):
    """Similarities from 0.74 to 0.92 in many pairs: those of 0.8 and more go, no others do."""
    docs, high = [], set()
    for n in range(300):
        words = [f"w{n}x{i}" for i in range(104)]
        other = words[: 4 + 74 + n % 19] + [f"v{n}x{i}" for i in range(26 - n % 19)]
        docs += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(other))]
        if close(plain(docs[-1][1]), plain(docs[-2][1])):
            high.add(2 * n + 1)
    assert 50 < len(high) < 250
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()}
    assert kept == {k for k, _ in docs} - high


@pytest.mark.parametrize("all_pairs", [24, 2])
def test_stage_matches_exact_similarity(spark, odd_docs, all_pairs):
    docs = [(k, t) for k, t in dict((k, t) for k, t in odd_docs if k is not None).items()]
    found = near.keep_one(spark.createDataFrame(docs, "doc_id long, text string"), **corpus_pipeline.SIMILAR, all_pairs=all_pairs)
    assert sorted(r.doc_id for r in found.collect()) == kept_ids(docs)
    assert near.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spanning_connects_chains():
    rng = np.random.default_rng(7)
    sets = []
    for family in range(5):
        current = set(range(family * 1000, family * 1000 + 60))
        for step in range(20):
            sets.append(current)
            current = current - {min(current), max(current)} | {family * 1000 + 500 + step * 2 + k for k in range(2)}
    order = rng.permutation(len(sets))
    sets = [sets[i] for i in order]
    links = near.spanning([np.array(sorted(s), np.uint64) for s in sets], 0.8)
    joined = {frozenset(p) for p in links}
    items = list(enumerate(sets))
    wanted = brute.components(items, close)
    assert brute.components([(i, i) for i in range(len(sets))], lambda a, b: frozenset((a, b)) in joined) == wanted
    assert all(close(sets[a], sets[b]) for a, b in links) and len(links) < len(sets)


INSIDE = ["_node", "_keys", "_digest", "_id", "_n", "_first", "_fp0", "root", "node", "c0", "_recurring", "_lines", "_quality", "_quality_raw", "_found", "label", "key"]


@pytest.mark.parametrize("stage", [near.keep_one, simhash.keep_one, *(f for _, f in corpus_pipeline.STAGES[:4])])
def test_columns_may_have_any_name(spark, rows, stage):
    """Rows, ids and texts are as without the other columns, and those come back as they were."""
    docs = spark.createDataFrame(rows("documents", "doc_id", "text", "lang", "source", "n_chars")[:60], "doc_id long, text string, lang string, source string, n_chars long")
    clashing = docs.selectExpr("*", *(f"concat('{name}', doc_id) as {name}" for name in INSIDE))
    run = (lambda df: stage(spark, df, SF_DIR)) if stage not in (near.keep_one, simhash.keep_one) else stage
    got = run(clashing)
    assert got.columns == clashing.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted((r.doc_id, r.text) for r in run(docs).collect())
    assert got.where(" or ".join(f"{name} <> concat('{name}', doc_id)" for name in INSIDE)).count() == 0


@pytest.mark.parametrize("keep_one", [near.keep_one, simhash.keep_one])
def test_ids_do_not_make_copies(spark, keep_one):
    """Different texts with no id, or with one id, all stay; copies go whatever their ids."""
    texts = [" ".join(f"w{n}x{i}" for i in range(100)) for n in range(5)]
    docs = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[2]), (None, texts[0])]
    found = keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in found) == sorted([(0, texts[0]), (0, texts[1]), (8, texts[2]), (7, texts[3]), (7, texts[4])])


def test_close_fingerprints_meet_and_are_verified(spark, monkeypatch):
    """SimHash finds pairs without any band; those below the limit are not joined."""
    words = [f"w{i}" for i in range(400)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:-1] + ["other"])), (3, " ".join(f"v{i}" for i in range(400)))]
    fps = [int(simhash.fingerprint(t, 5)[0]) for _, t in docs]
    assert (fps[0] ^ fps[1]).bit_count() <= simhash.DISTANCE < (fps[0] ^ fps[2]).bit_count()
    frame = spark.createDataFrame(docs, "doc_id long, text string")

    def no_bands(batches, all_pairs):
        for batch in batches:
            pass
        return
        yield

    monkeypatch.setattr(near, "_meet", no_bands)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()) == [1, 3]
    assert near.keep_one(frame, similar=0.999).count() == 3
