"""Groups of many rows: one leaf of many lines, one window of many items."""

import pickle
import time

import brute
import numpy as np

from httploom.llm import decontaminate, lines


def test_leaf_of_many_templates():
    """10^5 lines of one leaf with tails of their own; a shared token does not join lines that differ in too many tokens."""
    rows = [f"a b c d x{i} y{i} z{i} w{i % 50}" for i in range(100_000)]
    started = time.perf_counter()
    found = lines.Leaf(0.7).place(rows, list(range(len(rows))))
    assert found == list(range(len(rows))) and time.perf_counter() - started < 60


def test_leaf_finds_the_first_similar_template():
    rng = np.random.default_rng(3)
    for size in (1, 3, 4, 5, 6, 10, 17):
        rows = [" ".join(["h"] * min(4, size) + rng.choice(list("pqrs"), max(0, size - 4)).tolist()) for _ in range(300)]
        firsts, wanted = [], []
        for number, row in enumerate(rows):
            near = [f for f in firsts if sum(a == b for a, b in zip(row.split(), rows[f].split())) / size >= 0.7]
            if not near:
                firsts.append(number)
            wanted.append(near[0] if near else number)
        assert lines.Leaf(0.7).place(rows, list(range(len(rows)))) == wanted


class Block:
    def __init__(self, items):
        self.id, self.value = str(id(items)), pickle.dumps(decontaminate.Tests(items, 10))


def test_window_of_many_items():
    """A window that thousands of items share and that stands thousands of times in a document is spelled out for neither."""
    window = " ".join(f"w{i}" for i in range(10))
    items = [(f"i{k:05d}", window if k % 2 else f"{window} tail{k}") for k in range(10_000)]
    started = time.perf_counter()
    counts, hits, found, _ = decontaminate._shard([" ".join([window] * 10_000), "w1 w2"], [Block(items)], False)
    assert counts == hits[:1] + [2] == [100_000, 2] and found[0] == [name for name, _ in items] and found[1] == []
    assert time.perf_counter() - started < 30


def test_shared_windows_give_all_matches():
    words = [f"w{i}" for i in range(30)]
    items = [("a", " ".join(words[:12])), ("b", " ".join(words[2:14])), ("c", " ".join(words[:12])), ("d", "w3 w4"), ("e", "w3 w4")]
    docs = [(1, " ".join(words)), (2, " ".join(words[:12] * 2)), (3, "w3 w4 w3 w4")]
    counts, hits, found, matches = decontaminate._shard([t for _, t in docs], [Block(items)], True)
    assert [(k, n, h, tuple(f)) for (k, _), n, h, f in zip(docs, counts, hits, found)] == list(brute.contamination(docs, items))
    assert {(m["item_id"], m["item_start"], m["doc_start"], m["n_words"]) for m in matches[2]} == {(i, 0, p, 2) for i in "de" for p in (0, 2)}
