"""Each operator against its plain Python version on odd rows, and on an empty table."""

from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from httploom.llm import bpe, chat, decontaminate, lines, quality, queries, simhash, suffixes, tokens, urls, warc

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def same(df, columns, wanted):
    got = Counter(tuple(r) for r in df.select(*columns).collect())
    wanted = Counter(map(tuple, wanted))
    assert got == wanted, (list((got - wanted).items())[:2], list((wanted - got).items())[:2])


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts(frame, odd_docs, name):
    path = public_tokenizers.path(name)
    counted = tokens.token_counts(frame(odd_docs), path, slice_bytes=20_000, piece_chars=500)
    same(counted, ["doc_id", "n_bytes", "n_tokens"], brute.token_counts(odd_docs, path))


def test_pieces_join_to_the_text():
    text = "one two  three four\nfive six"
    assert "".join(tokens.pieces(text, 4, True)) == text
    assert " ".join(tokens.pieces(text, 4, False)) == text
    assert list(tokens.pieces("x" * 100, 4, True)) == ["x" * 100]


def test_url_filter(spark):
    found = [
        (1, "http://a.Example.com/en/7x?q"), (2, "https://example.com/en/1"), (3, "ftp://com/en/"), (4, "http://net/de"), (5, "http://x.net/de/"),
        (6, "http://example.net/de/8#f"), (7, None), (8, ""), (9, "no scheme"), (10, "http://a.org?/es/"), (11, "a://b://org/es/1"), (12, "http://notexample.com/en/7"),
        (None, "http://org/es/2"), (5, "http://x.net/de/"), (13, "http://" + "a." * 200 + "org/es/" + "p" * 5000), (14, "http://both.test/x"), (15, "http:///en/"),
    ]
    rules = [*queries.URL_RULES, ("both.test", "", "allow"), ("both.test", "", "block"), ("test", "/x", "allow"), (None, "/", "block"), ("x", None, "block")]
    plain = [r for r in rules if None not in r and r != ("both.test", "", "allow")]
    pages = spark.createDataFrame(found, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for limit in (1 << 20, 0):  # broadcast and shuffle
        judged = urls.judge(pages, table, broadcast_bytes=limit, prefix_digits=1)
        same(judged, ["page_id", "host", "path", "rule", "verdict"], brute.url_verdicts(found, plain))
    assert urls.judge(pages, table.limit(0), default="block").where("verdict = 'block' and rule is null").count() == len(found)
    assert urls.judge(pages.limit(0), table).count() == 0


def test_byte_bpe(frame, odd_docs):
    ids = brute.bpe_ids([t for _, t in odd_docs], RANKS, PATTERN)
    wanted = [(k, len(i), brute.sha(np.array(i, "<u4").tobytes()), brute.sha(t or "")) for (k, t), i in zip(odd_docs, ids)]
    same(bpe.round_trip(frame(odd_docs), RANKS, PATTERN, slice_bytes=30_000), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], wanted)
    encoded = bpe.encode(frame(odd_docs[:20] + [(1, None)]), RANKS, PATTERN)
    decoded = bpe.decode_ids(encoded, RANKS, PATTERN)
    same(decoded.select("doc_id", F.col("bytes").cast("string")), ["doc_id", "bytes"], [(k, t or "") for k, t in odd_docs[:20] + [(1, None)]])


def test_merge_replay_on_dense_words():
    vocab = bpe.vocabulary(open(RANKS, "rb").read(), PATTERN)
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abestrinoäß中 '"), 300)) for _ in range(200)] + ["a" * n for n in range(40)] + ["\x1c\x85\xa0x ª²½"]
    got = [np.frombuffer(i, "<u4").tolist() for i in bpe.encode_slice(texts, vocab)]
    assert got == brute.bpe_ids(texts, RANKS, PATTERN)
    assert bpe.replay([], vocab) == []


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and runs away from it all"), (2, "only four words here"), (2, "Zwei"), (None, "quick brown fox"), (3, None), (4, "...")]
TESTED = [
    (1, "He saw the QUICK brown fox jumps over the lazy dog and runs."), (2, "quick brown fox; quick, brown: fox"), (3, "only four words\nhere only four words here"),
    (4, "nothing"), (5, None), (6, ""), (7, "zwei zwei"), (None, "zwei"), (7, "zwei zwei"), (8, "fox jumps over the lazy dog and runs away from"),
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 10])
def test_contamination(frame, spark, rows, odd_docs, block_bytes):
    def digest(df):
        return df.select("doc_id", "n_words", "n_hit", "items")

    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.contamination(frame(TESTED), items, block_bytes=block_bytes)
    got = sorted(((r[0], r[1], r[2], tuple(r[3])) for r in digest(found).collect()), key=str)
    assert got == sorted(brute.contamination(TESTED, ITEMS), key=str)
    longest = {(r.doc_id, m.item_id, m.item_start, m.doc_start, m.n_words) for r in found.collect() for m in r.matches}
    assert {(1, "1", 0, 2, 11), (8, "1", 3, 0, 10), (3, "2", 0, 0, 4), (3, "2", 0, 4, 4)} <= longest
    if block_bytes > 10:
        benchmark = rows("benchmark", "item_id", "text")
        found = decontaminate.contamination(frame(odd_docs), spark.createDataFrame(benchmark, "item_id long, text string"), with_matches=False, slice_bytes=50_000)
        got = sorted(((r[0], r[1], r[2], tuple(r[3])) for r in digest(found).collect()), key=str)
        assert got == sorted(brute.contamination(odd_docs, benchmark), key=str)
    assert decontaminate.contamination(frame(TESTED), items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.marked(frame(TESTED), items).columns == frame(TESTED).drop("_found").columns + ["_found"]


def test_warc(spark, rows):
    pages = rows("pages", "page_id", "url", "html")
    html = pages[0][2]
    pages += [(9001, None, None), (9002, "http://x/ y\r\nZ: 1", ""), (9003, "u", html), (-3, "u", html), (-3, "v", html), (None, "w", html), (9004, "u", "short"), (9005, "u", "short"), (9006, "big", html * 300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("id", F.lit(0))
    archives = warc.write(spark, warc.pack(df, frame_bytes=4096, bundle_bytes=20_000))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    same(warc.read(archives), columns, brute.warc_rows([(k, h) for k, _, h in pages]))
    wanted = spark.createDataFrame([("<urn:page:9006>",), ("<urn:page:9004>",), ("<urn:page:none>",)], "record_id string")
    fetched = {r.record_id: r.record for r in warc.fetch(archives, wanted).collect()}
    assert set(fetched) == {"<urn:page:9006>", "<urn:page:9004>"}
    assert fetched["<urn:page:9004>"].endswith(b"\r\n\r\nshort\r\n\r\n") and fetched["<urn:page:9006>"].count(html.encode()) == 300
    import zstandard

    one = archives.first().archive
    whole = b"".join(zstandard.ZstdDecompressor().decompressobj().decompress(one[s : s + n]) for s, n, _ in warc.frames(one))
    assert whole.startswith(b"WARC/1.1\r\n") and len(warc.frames(one)) > 1
    assert zstandard.ZstdDecompressor().stream_reader(one, read_across_frames=True).read() == whole  # any reader skips the table
    assert warc.read(warc.write(spark, warc.pack(df.limit(0)))).count() == 0


def test_suffix_array_dedup(frame, odd_docs):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for chunk_bytes in (1 << 20, 20_000):
        same(suffixes.remove_repeats(frame(odd_docs), chunk_bytes=chunk_bytes), columns, brute.repeats(odd_docs))
    with_kept = suffixes.remove_repeats(frame(odd_docs), with_kept=True)
    assert with_kept.where("kept_sha256 <> sha2(kept, 256)").count() == 0


def test_two_stage_sorting():
    rng = np.random.default_rng(5)
    for size in (1, 2, 60, 2000):
        for letters in (b"a", b"ab", b"a\x00\xff", bytes(range(97, 123))):
            text = rng.choice(np.frombuffer(letters, np.uint8), size)
            order = suffixes.suffix_array(text, 50).tolist()
            keys = [text[i : i + 50].tobytes().ljust(50, b"\0") for i in order]
            assert sorted(order) == list(range(size)) and keys == sorted(keys)
    data = np.frombuffer(b"abcdefghij" * 6 + b"abcdefghiX" + b"\0" * 80, np.uint8)
    left, right = np.array([0, 0, 50]), np.array([10, 1, 60])
    assert suffixes.common_prefixes(data, left, right, 50).tolist() == [50, 0, 9]


def test_slices_do_not_change_removals(monkeypatch, odd_docs):
    import pyarrow as pa

    docs = [(k, t or "") for k, t in odd_docs if k is not None]
    table = pa.table({"id": [k for k, _ in docs], "text": [t for _, t in docs]})
    whole = suffixes.chunk_of(table)
    monkeypatch.setattr(suffixes, "_SLICE", 777)
    cut = suffixes.chunk_of(table)
    for chunk in (whole, cut):
        windows = np.zeros(len(chunk.data), bool)
        for a, b in zip(chunk.first.tolist(), chunk.last.tolist()):
            assert not windows[a : b + 1].any()
            windows[a : b + 1] = True
        assert windows.sum() == sum(max(0, len(t.encode()) - 49) for _, t in docs)


def test_quality_measures(frame, odd_docs):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    docs = odd_docs + [(9100, "a b c d e a b c d e f"), (9101, "x\nx\n \n \ny\ny "), (9102, "a " * 40)]
    scores = quality.scores(frame(docs))
    same(scores, columns, brute.measures(docs))
    rows = quality.judged(frame(docs))
    assert rows.count() == len(docs) and rows.where("_quality.base_failed and _quality.kept").count() == 0
    assert quality.scores(frame([])).count() == 0


def test_weak_supervision_finds_rare_junk():
    good, caps, symbols = (1, 1, 1, 1), (1, -1, -1, 0), (1, 1, 1, -1)
    patterns = [(good, 9000), (caps, 600), (symbols, 400), ((0, 0, 0, 0), 10)]
    prior, chances = quality.estimate(patterns)
    p = {v: quality.posterior(v, prior, chances) for v, _ in patterns}
    assert p[good] > 0.9 and p[(0, 0, 0, 0)] > 0.5 and p[caps] < 0.5 and p[symbols] < 0.5
    assert quality.estimate([]) == (0.5, [])


def test_quality_against_labels(spark):
    """Labelled good documents stay, but those that fail the base rules; most labelled bad ones go."""
    sf = "/root/testdata/sf0.1"
    scores = queries.op8_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    found = {(r.quality, r.kept): r["count"] for r in scores.where("not base_failed").groupBy("quality", "kept").count().collect()}
    assert found[1, True] > 0.999 * (found[1, True] + found.get((1, False), 0))
    assert found[0, False] > 0.98 * (found[0, False] + found.get((0, True), 0))


TURNS = [
    (1, 0, "user", "hi <|im_end|> <\\|x|> <|"), (1, 1, "assistant", "<|im_start|>assistant ok"), (1, 2, "assistant", ""), (2, None, None, None), (2, 1, "assistant", "ünï\n\n中"),
    (2, 1, "assistant", "ünï\n\n中"), (2, 1, "assistant", "a"), (None, 3, "we\\ird\nrole<|", "x" * 100_000), (3, 1, "tool", "\\<|"), (3, 0, "assistant", "y"),
]


def test_chat_format(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("clash"))
    formatted = chat.format_turns(df, RANKS, PATTERN)
    decoded = chat.decode_turns(formatted, RANKS, PATTERN)
    same(decoded, ["id", "turn", "role", "text"], [(c, t, r or "", x or "") for c, t, r, x in TURNS])
    digests = chat.conversation_digests(decoded)
    same(digests, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"], brute.conversations(TURNS))
    vocab = bpe.vocabulary(open(RANKS, "rb").read(), PATTERN)
    marks = set(chat.reserved(vocab))
    for row in formatted.collect():
        ids = np.frombuffer(row.tokens.ids, "<u4").tolist()
        assert sum(i in marks for i in ids) == 2 and ids[0] in marks and ids[-2] in marks
    assert chat.conversation_digests(chat.decode_turns(chat.format_turns(df.limit(0), RANKS, PATTERN), RANKS, PATTERN)).count() == 0


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|a|>", "<<||", "\\", "<|im_end|>" * 3])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text + "\n\\n")) == text + "\n\\n"


@pytest.mark.parametrize("options", [{"distance": 4, "shingle": 4}, {"distance": 20, "shingle": 5, "n_parts": 2, "block_distance": 8}])
def test_near_duplicates(frame, odd_docs, options):
    found = simhash.near_duplicates(frame(odd_docs), **options)
    same(found, ["doc_id", "fingerprint", "component_id"], brute.near_duplicates(odd_docs, **options))


def test_keep_one(frame, odd_docs):
    kept = simhash.keep_one(frame(odd_docs))
    groups = {root for _, _, root in brute.near_duplicates(odd_docs)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(g for g in groups)
    assert kept.columns == frame(odd_docs).columns
    assert simhash.keep_one(frame([])).count() == 0


@pytest.mark.parametrize("count", [10, 10**6, 10**9, 10**12])
def test_block_plans_miss_nothing(count):
    rng = np.random.default_rng(1)
    masks = simhash.plan_blocks(count)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flips & mask == 0 for mask in masks)


def test_spanning_links_connect_what_chains_connect():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    noise = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(600)], np.uint64)
    fps = np.unique(np.repeat(centre, 50) ^ noise)
    for group in (fps, fps[:40]):
        a, b = simhash.spanning_links(group[:, None], 4)
        items = [(i, int(v)) for i, v in enumerate(group)]
        linked = set(zip(a.tolist(), b.tolist())) | set(zip(b.tolist(), a.tolist()))
        wanted = brute.components(items, lambda x, y: (x ^ y).bit_count() <= 4)
        places = [(i, i) for i, _ in items]
        assert brute.components(places, lambda x, y: (x, y) in linked) == wanted and len(a) < len(group)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 30)] + [(500, 499), (499, 498), (7, 7)]
    roots = simhash.components(spark, spark.createDataFrame(edges, "a long, b long"))
    found = {r.node: r.root for r in roots.collect()}
    assert {found[n] for n in range(100, 161)} == {100} and {found[n] for n in range(1, 30)} == {1} and found[500] == found[498] == 498


def noted(key, name, day, body):
    return key, f"{body}\nPosted on 2024-01-{day:02d} by {name} at the usual place\nShare this page now"


def test_line_dedup(frame, odd_docs):
    body = [f"text {chr(97 + i)} holds its own long line of words {chr(97 + i) * 5} that nobody else has and that goes on" for i in range(12)]
    docs = odd_docs + [noted(8000 + i, f"user{'abc'[i % 3]}", i + 1, body[i]) for i in range(12)]
    docs += [(8100 + i, "One short form\nShare this page now") for i in range(11)] + [(8200, "Share this page now\n\n " + body[0])]
    stripped = lines.drop_recurring(frame(docs))
    got = stripped.select("doc_id", "_lines.text", "_lines.n_lines", "_lines.n_dropped", "_lines.n_recurring")
    same(got, got.columns, brute.line_dedup(docs))
    texts = {r.doc_id: r["text"] for r in got.where("doc_id between 8000 and 8300").collect()}
    assert texts[8003] == body[3] and texts[8100] == "One short form" and texts[8200] == "\n " + body[0]
    assert lines.drop_recurring(frame([])).count() == 0


def test_leaf_streams_lines_in_pieces(monkeypatch):
    rows = [f"a b c d {x} {y} z" for x in "pqr" for y in "stuv"]
    at_once = lines.Leaf(0.7)
    all_names = at_once.place(rows, list(range(len(rows))))
    in_pieces = lines.Leaf(0.7)
    names = [n for i in range(0, len(rows), 5) for n in in_pieces.place(rows[i : i + 5], list(range(i, min(len(rows), i + 5))))]
    assert len(set(names)) == len(set(all_names)) == 1
