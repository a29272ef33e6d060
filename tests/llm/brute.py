"""Plain Python versions of the operators, quadratic where that is the clearest."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(value):
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def url_verdicts(urls, rules, default="allow"):
    for key, url in urls:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = lower(host)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        yield key, host, path, best and best[2], best[3] if best else default


def token_counts(docs, path):
    if path.endswith(".model"):
        import sentencepiece

        count = lambda t, p=sentencepiece.SentencePieceProcessor(model_file=path): len(p.encode(t))
    else:
        from tokenizers import Tokenizer

        count = lambda t, p=Tokenizer.from_file(path): len(p.encode(t, add_special_tokens=False).ids)
    for key, text in docs:
        yield key, len((text or "").encode()), count(text or "")


def bpe_ids(texts, path, pattern):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return [encoding.encode_ordinary(t or "") for t in texts]


def contamination(docs, items, window=10):
    cut = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    windows = defaultdict(set)
    for name, text in items:
        words = cut(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            windows[tuple(words[k : k + size])].add("" if name is None else str(name))
    sizes = sorted({len(w) for w in windows})
    for key, text in docs:
        words, hit, found = cut(text), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                names = windows.get(tuple(words[k : k + size]))
                if names:
                    found |= names
                    hit.update(range(k, k + size))
        yield key, len(words), len(hit), tuple(sorted(found))


def warc_rows(pages, least=100):
    first = {}
    for key, html in pages:
        payload = (html or "").encode()
        if len(payload) >= least and key is not None:
            first[payload] = min(key, first.get(payload, key))
    for key, html in pages:
        payload = (html or "").encode()
        known = first.get(payload)
        revisit = known is not None and key is not None and known != key
        yield key, len(payload), sha(payload), "revisit" if revisit else "response", known if revisit else None


def repeats(docs, window=50):
    first = {}
    for key, text in docs:
        data = (text or "").encode()
        if key is not None:
            for i in range(len(data) - window + 1):
                piece = data[i : i + window]
                first[piece] = min(key, first.get(piece, key))
    for key, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1 if key is not None else 0):
            if first[data[i : i + window]] < key:
                gone[i : i + window] = b"\1" * window
        kept = bytes(c for c, g in zip(data, gone) if not g)
        yield key, len(data), sum(gone), len(re.findall(rb"\x01+", gone)), sha(kept)


def measures(docs):
    for key, text in docs:
        text = text or ""
        words = WORD.findall(text)
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = set()
        for i in range(len(words) - 4):
            if grams[tuple(words[i : i + 5])] > 1:
                covered.update(range(i, i + 5))
        lines = [line for line in text.split("\n") if WORD.search(line)]
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        symbols = sum(c in "#*$%&|<>" for c in text)
        yield key, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def conversations(turns):
    grouped = defaultdict(list)
    for key, turn, role, text in turns:
        grouped[key].append((turn is not None, turn or 0, role or "", text or ""))
    for key, rows in grouped.items():
        rows.sort()
        loss = "".join(text for _, _, role, text in rows if role == "assistant")
        yield key, len(rows), sha("".join(f"{r}\n{t}\n" for _, _, r, t in rows)), len(loss), sha(loss)


def fingerprint(text, shingle=4, seed=42, n_parts=1):
    import xxhash

    words = WORD.findall(lower(text or ""))
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    counts = [0] * (64 * n_parts)
    for gram in grams:
        raw = xxhash.xxh3_128_digest(gram.encode(), seed) if n_parts == 2 else xxhash.xxh64_intdigest(gram.encode(), seed).to_bytes(8, "little")
        value = int.from_bytes(raw, "little")
        for bit in range(64 * n_parts):
            counts[bit] += value >> bit & 1
    return sum(1 << bit for bit in range(64 * n_parts) if 2 * counts[bit] > len(grams))


def components(items, close):
    """``items`` (key, value): smallest key reachable over values for which ``close`` holds."""
    parent = list(range(len(items)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (_, a) in enumerate(items):
        for j in range(i):
            if close(a, items[j][1]):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(items):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return [least.get(root(i)) for i in range(len(items))]


def near_duplicates(docs, distance=4, shingle=4, n_parts=1, block_distance=64):
    prints = [(key, fingerprint(text, shingle, n_parts=n_parts)) for key, text in docs]

    def close(a, b):
        bits = a ^ b
        parts = [(bits >> 64 * k & (1 << 64) - 1).bit_count() for k in range(n_parts)]
        return sum(parts) <= distance and min(parts) <= block_distance

    roots = components(prints, close)
    return [(key, f"{value:0{16 * n_parts}x}", root) for (key, value), root in zip(prints, roots)]


def recurring_lines(docs, min_docs, depth=4, similar=0.7):
    """Template of each generalised line whose template recurs, by placing distinct lines in order, template by template."""
    general = lambda line: tuple("<*>" if re.search("[0-9]", t) else t for t in line.split())
    holders = defaultdict(set)
    reached = defaultdict(int)
    for number, (key, text) in enumerate(docs):
        lines = {g for g in map(general, (text or "").split("\n")) if g}
        for line in lines:
            holders[line].add(key)
        for leaf in {(len(g), g[:depth]) for g in lines}:
            reached[leaf] += 1
    leaves = defaultdict(list)
    for line in holders:
        leaves[len(line), line[:depth]].append(line)
    out = {}
    for leaf, lines in leaves.items():
        if reached[leaf] < min_docs:
            continue
        rest = sorted(lines, key=" ".join)
        while rest:
            template = rest[0]
            members = [x for x in rest if x is rest[0] or sum(a == b for a, b in zip(x, template)) / len(x) >= similar]
            rest = [x for x in rest if x not in members]
            if len(set().union(*(holders[x] for x in members))) >= min_docs:
                out.update(dict.fromkeys(members, template))
    return out, general


def line_dedup(docs, min_docs=10):
    """A template that is held mostly by copies (8/9 of their characters are recurring lines) is not boilerplate."""
    templates, general = recurring_lines(docs, min_docs)
    copies = defaultdict(list)
    for text in {text or "" for _, text in docs}:
        size = defaultdict(int)
        for line in text.split("\n"):
            if general(line) in templates:
                size[general(line)] += len(line)
        copy = 9 * sum(size.values()) >= 8 * sum(map(len, text.split("\n")))
        for line in size:
            copies[templates[line]].append(copy)
    gone = {line for line, template in templates.items() if 2 * sum(copies[template]) <= len(copies[template])}
    for key, text in docs:
        lines = [] if text is None else text.split("\n")
        marks = [general(line) in gone for line in lines]
        kept = None if text is None else "\n".join(line for line, m in zip(lines, marks) if not m)
        yield key, kept, sum(bool(line.split()) for line in lines), sum(marks), sum(marks)
