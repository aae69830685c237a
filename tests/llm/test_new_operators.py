"""Templates of url paths, phrases and prefix tries against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from skeinlake.llm import collocations as K
from skeinlake.llm.prefix_trie import prefix_trie
from skeinlake.llm.queries import labelled_pages
from skeinlake.llm.url_filter import judge_urls, path_templates

TURNS = "conv_id bigint, turn int, role string, text string, base string, node string, depth int"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children = Counter(n[:-1] for n in nodes if n)
    out = []
    for n, members in nodes.items():
        below = [x for x in nodes if x[: len(n)] == n]
        ends = ",".join(map(str, sorted(c for c in members if built[c] == n)))
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x)
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), children[n], sum(not children[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], TURNS)
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie(df.repartition(3)).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_matches_a_plain_one(spark, seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 30), *range(200, 212), *range(305, 330), -5, -105]:
        for t in range(r.randint(1, 7)):
            rows.append((c, r.choice((t, t, None)), r.choice(("user", "bot", None)), r.choice(("a", "bé", "", None, "long " * 9))))
    rows += r.sample(rows, 8) + [(None, 1, "user", "x")]
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_of_a_long_and_of_equal_conversations(spark):
    rows = [(7, t, "user", str(t % 2)) for t in range(400)] + [(c, t, "bot", "same") for c in range(1000, 1300) for t in range(3)]
    assert trie(spark, rows) == plain_trie(rows)
    assert trie(spark, []) == []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert trie(spark, rows[350:450]) == plain_trie(rows[350:450])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plain_collocations(docs, least, longest, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(_LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    out = defaultdict(list)
    for (lang, *w), a in found.items():
        around = [b for (x, *v), b in found.items() if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= 100 * a for b in around):
            continue
        score, cut = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[(lang, *w[:cut])], f[(lang, *w[cut:])]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


def phrases(spark, docs, **k):
    df = spark.createDataFrame([(i, t, x, "s", 1) for i, (x, t) in enumerate(docs)], "doc_id bigint, text string, lang string, phrase string, n bigint")
    return sorted(map(tuple, K.collocations(df.repartition(3), **k).collect()))


def prose(seed, n=60):
    r = random.Random(seed)
    words = ["the", "The", "of", "é", "a-b", "x", "new", "york", "\u00a0", "\x1c", "ß"]
    text = lambda: "".join(r.choice(words) + r.choice((" ", " ", " ", "  ", "\t", ". ", "\n", "; ", "\r\n")) for _ in range(r.randint(0, 60)))
    docs = [(r.choice(("en", "de", None, "und", "")), text()) for _ in range(n)]
    return docs + [("en", None), ("en", ""), ("fr", "..;"), ("en", "new york " * 400), ("de", "x" * 300_000), *docs[:10]]


@pytest.mark.parametrize("how", [{}, {"part": 64}, {"bytes_a_cell": 1 << 40}, {"top": 3}])
def test_collocations_match_a_plain_count(spark, how, monkeypatch):
    monkeypatch.setattr(K, "CELLS", (10, 27))
    docs = prose(5, 400)
    got = phrases(spark, docs, least=12, **how)
    assert got == plain_collocations(docs, 12, 5, how.get("top", K.TOP)) and len(got) >= (8 if "top" in how else 20)


def test_chunks_lose_no_phrase(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(K, "CHUNK", 50)
    docs = prose(7)
    batch = pa.RecordBatch.from_pydict({"lang": ["" if x is None else x for x, _ in docs], "text": pa.array([t for _, t in docs], pa.string())})
    names, seeds = K._languages(batch)
    got, want, whole = Counter(), Counter(), np.zeros(len(docs), int)
    for data, offsets, rows in K._chunks(batch):
        words = K._Words(data, offsets, seeds[rows])
        for k in (1, 3):
            got.update((rows[words.text[i]], words.phrase(i, k)) for i in np.flatnonzero(words.whole(k)).tolist())
        whole[rows] += 1
    for row, (_, text) in enumerate(docs):
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(_LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            want.update((row, " ".join(w[i : i + k])) for k in (1, 3) for i in range(len(w) - k + 1))
    assert got == want and whole.max() > 3


def test_automata_run_over_words_and_are_built_once(monkeypatch):
    """Each word of a key is three nodes at most, however long; tasks of one scan in a worker share an automaton."""
    import numpy as np
    import pyarrow as pa

    docs = [("en" if x is None else x, t) for x, t in prose(11, 200)]
    held = Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(_LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            held.update((lang, " ".join(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    keys = [*sorted(held)[::3], ("en", "never " * 4 + "met"), ("xx", "the")]
    built, phrases = [], K._Phrases
    monkeypatch.setattr(K, "_Phrases", lambda some: built.append(phrases(some)) or built[-1])
    monkeypatch.setattr(K, "_built", {})
    sent = type("Sent", (), {"value": keys})
    total = np.zeros(len(keys), np.int64)
    for at in range(0, len(docs), 70):
        batch = pa.RecordBatch.from_pydict({"lang": [x for x, _ in docs[at : at + 70]], "text": pa.array([t for _, t in docs[at : at + 70]], pa.string())})
        for made in K._matched(sent, "part")(iter([batch])):
            for r, counts in zip(made.column(0).to_pylist(), made.column(1).to_pylist()):
                total[r * K.KEYS : (r + 1) * K.KEYS] += np.frombuffer(counts, np.int64)
    assert dict(zip(keys, total.tolist())) == {k: held.get(k, 0) for k in keys} and total.max() > 100
    words = sum(len(p.split(" ")) for _, p in keys)
    assert len(built) == 1 and built[0].automaton.get_stats()["nodes_count"] <= 3 * words + 1


def test_collocations_of_little(spark):
    assert phrases(spark, []) == [] and phrases(spark, [("en", "one two three")]) == []
    assert phrases(spark, [(None, "one two"), (None, "One two")], least=2) == [("und", 1, "one two", 2, 2, 2, 4, 2000)]


def test_packed_ranges_come_back():
    r = random.Random(1)
    import numpy as np

    for size in (4, 1 << 16, 1 << 18):
        cells = np.array(sorted(r.sample(range(size), min(size, 3000))), np.int64)
        n = np.array([r.choice((1, 2, 254, 255, 256, 10**12)) for _ in cells], np.int64)
        back = K._unpacked(K._packed(cells, n, size), size)
        assert (back[0] == cells).all() and (back[1] == n).all()
    tally = K._Tally()
    tally.add(np.array([5, 1, 5], np.uint64))
    tally.settle()
    tally.add(np.array([5, 9], np.uint64))
    assert [x.tolist() for x in tally.settle()] == [[1, 5, 9], [1, 3, 1]]


URLS = [
    ("http://A.Example.com/DE/x", "a.example.com", "/DE/x", None), ("https://b.example.com/de/1?q=/x", "b.example.com", "/de/1", "example.com/de/"),
    ("http://example.com/de/", "example.com", "/de/", "example.com/de/"), ("http://notexample.com/de/", "notexample.com", "/de/", None),
    ("http://x.net", "x.net", "", None), ("http://x.net/", "x.net", "/", "net/"), ("http://x.example.net/en/2#top", "x.example.net", "/en/2", "example.net/en/"),
    ("http://x.example.net/en", "x.example.net", "/en", "net/"), ("ftp://q.org/fr/", "q.org", "/fr/", "org/fr/"), ("http://org/fr/a", "org", "/fr/a", "org/fr/"),
    ("no scheme", "", "", None), (None, "", "", None), ("", "", "", None), ("a://b://c/d", "b:", "//c/d", None), ("http://h?x/y", "h", "", None), ("http://ÄB.com/\n", "Äb.com", "/\n", None),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i if i else None, u, "h", "p") for i, (u, *_) in enumerate(URLS)] + [(3, URLS[3][0], "h", "p")], "page_id bigint, url string, host string, path string")
    got = judge_urls(df).collect()
    want = [(i if i else None, *w) for i, (_, *w) in enumerate(URLS)] + [(3, *URLS[3][1:])]
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=repr) == sorted(want, key=repr)
    assert {(r.rule, r.verdict) for r in got if r.rule} == {("example.com/de/", "block"), ("net/", "block"), ("example.net/en/", "allow"), ("org/fr/", "allow")}
    assert judge_urls(df.where("false")).count() == 0


def plain_verdicts(urls, support=5, share=0.05, alpha=0.05, weight=10.0, purity=0.7):
    """(template, labelled, bad, verdict) of each (host, path, bad)."""
    segs = [p.split("/")[1:] for _, p, _ in urls]
    reach, full, mask = Counter(), Counter(), Counter()
    for (h, _, _), s in zip(urls, segs):
        for d, x in enumerate(s):
            reach[h, d] += 1
            full[h, d, x] += 1
            mask[h, d, re.sub("[0-9]+", "#", x)] += 1
    often = lambda n, h, d: n >= support and n >= share * reach[h, d]
    templates = []
    for (h, _, _), s in zip(urls, segs):
        t = []
        for d, x in enumerate(s):
            m = re.sub("[0-9]+", "#", x)
            t.append("=" + x if often(full[h, d, x], h, d) else "~" + m if often(mask[h, d, m], h, d) else "*")
        flat = []
        for x in t:
            if x == "*" and flat and flat[-1] in ("*", "**"):
                flat[-1] = "**"
            else:
                flat.append(x)
        templates.append(tuple(flat or [""]))
    m, b = Counter(), Counter()
    for (h, _, bad), t in zip(urls, templates):
        if bad is not None:
            for k in range(1, len(t) + 1):
                m[h, t[:k]] += 1
                b[h, t[:k]] += bad
    nodes = {(h, t[:k]) for (h, _, _), t in zip(urls, templates) for k in range(1, len(t) + 1)}
    slack, keep = math.sqrt(math.log(2 / alpha) / 2), set()
    for h, t in nodes:
        near = [x for x in nodes if x[0] == h and x[1][:-1] == t[:-1] and len(x[1]) == len(t)]
        ms, bs = sum(m[x] for x in near), sum(b[x] for x in near)
        if m[h, t] and abs(b[h, t] / m[h, t] - bs / ms) > slack * (1 / math.sqrt(m[h, t]) + 1 / math.sqrt(ms)):
            keep |= {(h, t[:k]) for k in range(1, len(t) + 1)}
    merged = [tuple(x if (h, t[: i + 1]) in keep else "*" for i, x in enumerate(t)) for (h, _, _), t in zip(urls, templates)]
    tm, tb, hm, hb = Counter(), Counter(), Counter(), Counter()
    for (h, _, bad), t in zip(urls, merged):
        if bad is not None:
            tm[h, t] += 1
            tb[h, t] += bad
            hm[h] += 1
            hb[h] += bad
    overall = (sum(hb.values()) + 1) / (sum(hm.values()) + 2)
    out = []
    for (h, _, _), t in zip(urls, merged):
        of_host = (hb[h] + weight * overall) / (hm[h] + weight)
        good = 1 - (tb[h, t] + weight * of_host) / (tm[h, t] + weight)
        out.append(("/".join(t), tm[h, t], tb[h, t], "block" if good < purity else "allow"))
    return out


def test_templates_match_a_plain_tree(spark):
    r = random.Random(3)
    urls = []
    for i in range(900):
        host = r.choice(("a.x", "a.x", "b.x", "c.x"))
        kind = r.choice(("tag", "user", "p", "shop"))
        path = r.choice((f"/{kind}/{i}", f"/{kind}/{i}.html", f"/{kind}/item-{i}/", f"/{r.random()}/{kind}/{i}", f"/{kind}/x/{r.getrandbits(40):x}/{r.getrandbits(40):x}/{i}", "", "/"))
        bad = None if r.random() < 0.3 else r.random() < (0.95 if kind == "tag" and host == "a.x" else 0.9 if host == "c.x" else 0.1)
        urls.append((host, path, bad))
    df = spark.createDataFrame([(i, f"http://{h}{p}", bad) for i, (h, p, bad) in enumerate(urls)], "page_id int, url string, bad boolean")
    got = {x.page_id: (x.template, x.labelled, x.n_bad, x.verdict) for x in judge_urls(df, bad="bad").collect()}
    want = plain_verdicts(urls)
    assert [got[i] for i in range(len(urls))] == want
    assert {v for *_, v in want} == {"allow", "block"} and any("=tag" in t for t, *_ in want) and any("**" in x.template for x in path_templates(
        df.selectExpr("page_id as key", "'h' as host", "parse_url(url, 'PATH') as path")).collect())


def test_labels_of_pages_go_by_the_last_number(spark, tmp_path):
    spark.createDataFrame([(1, 0, 0), (2, 1, 0), (2, 1, 1), (3, 1, None), (None, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pages = [(10, "http://h/en/1.html"), (11, "http://h/9/2/?page=1"), (12, "http://h/3"), (13, "http://h/4"), (14, None), (15, "http://h/99999999999999999999")]
    spark.createDataFrame(pages, "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: r.bad for r in labelled_pages(spark, str(tmp_path)).collect()} == {10: True, 11: True, 12: None, 13: None, 14: None, 15: None}
