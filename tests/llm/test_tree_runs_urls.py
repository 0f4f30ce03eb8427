"""The trie of conversations, periodic runs and URL filters against brute force and SQL."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from searchops.llm import periodic_runs, prefix_trie, queries, url_filter

SF1 = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_url_filter"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("conversations", "pages", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF1}/{table}.parquet'")
    got, want = queries.queries()[name](spark, SF1), con.sql(queries.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, want.select(*cols).fetchall()))


def brute_trie(turns, shared):
    convs = collections.defaultdict(list)
    key = lambda t: (t[1] is not None, t[1] or 0, hashlib.sha256(f"{len((t[2] or '').encode())}:{t[2] or ''}{t[3] or ''}".encode()).digest())
    for t in sorted((t for t in turns if t[0] is not None), key=key):
        convs[t[0]].append((t[2] or "", t[3] or ""))
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4 if shared else 0
        built[c] = convs.get(c - c % 20, [])[:h] + own[h:] if shared else own
    members = collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    members.setdefault((), [])
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        words = (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += words
    smallest = {k: min(m, default=None) for k, m in members.items()}
    return sorted(
        (str((smallest[k], len(k), smallest[k[:-1]] if k else None, len(m), children[k], leaves[k], saved[k],
         hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(k)).encode()).hexdigest())) for k, m in members.items())
    )


def test_trie_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    turns = []
    for c in list(range(130)) + [205, 219, 380, 383]:
        start = rnd.choice([0, 0, 0, 1, 2, c])
        for k in range(rnd.randrange(1, 7)):
            turns.append((c, k, rnd.choice(["user", None]) if start == c else "user", f"turn {start} {k} {rnd.randrange(2)}" if rnd.random() < 0.9 else None))
    turns += [(7, None, "x", "first"), (7, 2, "user", "twice"), (7, 2, "user", "twice"), (8, 3, "user", ""), (8, 3, "a", "tie"), (None, 1, "user", "nobody")]
    turns += [(600, k, "user", f"long {k % 3}") for k in range(300)] + [(601, k, "user", "w " * 5000) for k in range(5)]
    rnd.shuffle(turns)
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, shard string").repartition(5)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    for shared in (True, False):
        for entries in (prefix_trie.QUEUE_ENTRIES, 2):  # all in memory, and spilling all the time
            args = (F.col("conv_id") - F.col("conv_id") % 20, prefix_trie.shared_beginnings) if shared else (None, prefix_trie.own_turns)
            got = prefix_trie.prefix_trie(df, *args, entries)
            assert sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == brute_trie(turns, shared)
    got = prefix_trie.prefix_trie(df.limit(0)).collect()
    assert [tuple(r[c] for c in cols) for r in got] == [(None, 0, None, 0, 0, 1, 0, hashlib.sha256(b"").hexdigest())]


def test_queue_spills_and_keeps_order():
    rnd, queue, want = random.Random(1), prefix_trie.SpillingQueue(7), collections.defaultdict(list)
    for time in range(50):
        assert sorted(queue.pop_at(time)) == sorted(want[time])
        for k in range(20):
            later = time + rnd.randrange(1, 9)
            want[later].append((k, time))
            queue.push(later, (k, time))


def brute_runs(w):
    ids = np.array([hash(x) for x in w])
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        same = np.concatenate([[0], ids[q:] == ids[:-q], [0]]).astype(int)
        edges = np.diff(same)
        for i, j in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
            s = w[i : j + q]
            if j - i + q >= max(24, 3 * q) and all(s[d:] != s[:-d] for d in range(1, q)):
                out.append((int(i), int(j - i + q), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_op12(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_equal_brute_force(spark, tmp_path):
    rnd = random.Random(2)
    for k in (1, 2, 3):
        for _ in range(60):
            w = [rnd.randrange(k) for _ in range(rnd.randrange(120))]
            assert periodic_runs.runs_of(w) == brute_runs(w)
    for q in range(1, 30):  # the shortest runs of each period, between other words
        w = [f"a{i}" for i in range(40)] + ([f"p{i}" for i in range(q)] * 30)[: max(24, 3 * q)] + [f"b{i}" for i in range(40)]
        ((_, runs, _),) = periodic_runs.scan_texts([" ".join(w).encode()])
        assert runs == [(40, max(24, 3 * q), q)]
        ((_, runs, _),) = periodic_runs.scan_texts([" ".join(w[: 39 + max(24, 3 * q)]).encode()])
        assert runs == []
    texts = [None, "", " \n", "x", "a b " * 40, "é\x85ü z " * 50 + "tail", "w " * 3_000, " ".join(str(i % 700) for i in range(2500))]
    rows = [(i, t) for i, t in enumerate(texts * 8)] + [(None, "a b c " * 9), (3, "x"), (3, "x")]
    rows += [(1000 + i, " ".join(rnd.choice("ab") for _ in range(200))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'r' runs", "1 words", "2 h").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(brute_op12(*r)) for r in rows)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.read.parquet(f"{SF1}/documents.parquet").where("length(text) < 4000").collect()
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, SF1).collect()}
    assert len(got) == 1000 and all(got[r.doc_id] == brute_op12(r.doc_id, r.text) for r in docs)


def brute_verdict(url, rules, listed):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url or "")
    low = lambda h: re.sub("[A-Z]+", lambda x: x[0].lower(), h)
    host, path, query = (low(m[1]), m[2], m[3] or "") if m else ("", "", "")
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    parts = sorted(q for q in query.split("&") if q and not q.startswith("utm_"))
    own = re.sub(":(80|443)$", "", host) + path.rstrip("/") + ("?" + "&".join(parts) if parts else "")
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if own in listed else "allow"


def test_url_verdicts_equal_brute_force(spark, monkeypatch):
    urls = [
        None, "", "no scheme", "http://", "http://Example.ORG", "http://example.org/", "https://a.b.example.org/es/x?y#z", "https://example.org/en/17", "https://badexample.org/en/1",
        "x://m.com/fr/?q=://net/", "http://m.com/de/", "http://m.com/es/", "http://l.net/a/?utm_source=f&b=2&a=1", "http://L.net:80/a?a=1&b=2", "http://l.net/a?a=1", "http://u@l.net/#x", "http://a\nb.org/c\nd",
        "http://" + "a." * 3000 + "org/" + "p" * 5000,
    ]
    rows = [(i, u, "allow") for i, u in enumerate(urls * 3)] + [(None, "http://example.org/es/", "block")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    rules = [*queries.URL_RULES, ("org", "/", "block"), ("l.net", "/a/b", "allow")]
    listed = ["ftp://l.net/a/?a=1&b=2#x", "http://m.com/es", "http://m.com/es"]
    canonical = {"l.net/a?a=1&b=2", "m.com/es"}
    of = spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame([(u,) for u in listed], "url string")
    want = sorted(str((i, *brute_verdict(u, rules, canonical))) for i, u, _ in rows)
    for most in (url_filter.MAX_BLOCKS, 1):  # one block lets nearly all pass: the exact join still decides
        monkeypatch.setattr(url_filter, "MAX_BLOCKS", most)
        assert sorted(str(tuple(r)) for r in url_filter.verdicts(pages, *of).drop("listed").collect()) == want
    assert url_filter.verdicts(pages.limit(0), *of).count() == 0
    assert {r.verdict for r in url_filter.verdicts(pages, of[0].limit(0), of[1].limit(0)).collect()} == {"allow"}


def test_bloom_passes_all_listed_and_few_others(spark):
    keys = spark.range(20_000).selectExpr("concat('k', id) key")
    blocks = url_filter.n_blocks(20_000)
    blooms = url_filter.bloom(keys, blocks)
    assert url_filter.possible(keys, blooms, blocks).count() == 20_000
    assert url_filter.possible(spark.range(20_000).selectExpr("concat('other', id) key"), blooms, blocks).count() < 400
