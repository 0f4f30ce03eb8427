import base64
import collections
import gzip
import hashlib
import os
import random
import re
import urllib.parse
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from searchops.llm import (
    crf_language,
    decontaminate,
    exact_dedup,
    license_scan,
    near_dedup,
    pu_quality,
    queries,
    secret_scan,
    sentencepiece_codec,
    subword_toxicity,
    token_counts,
    unigram,
)

SF = "/root/testdata/sf0.001"
SF1 = "/root/testdata/sf0.01"
UP = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, ids string, row long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "a b c"), (4, "a b c"), (None, "a  b c"), (None, None), (5, long), (6, long + " x"), (7, "☃ 12"), (8, "x" * 900)]
    return spark.createDataFrame([(i, t, None, None, None, "c", "x", 3) for i, t in rows], SCHEMA)


def docs_of(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_exact_dedup_equals_brute_force(spark, odd):
    for docs in (docs_of(spark, SF1).union(docs_of(spark, SF1).where("doc_id < 5")).repartition(7), odd):
        got = exact_dedup.exact_duplicates(docs).collect()
        groups = collections.defaultdict(list)
        for r in docs.collect():
            groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()].append(r.doc_id)
        assert len(got) == sum(map(len, groups.values()))
        for r in got:
            ids = [i for i in groups[r.text_sha256] if i is not None]
            assert (r.keep_id, r.group_size) == (min(ids, default=None), len(groups[r.text_sha256]))
        assert sum(r.kept for r in got) == len(groups)


def test_runs_fold_across_arrow_batches(spark):
    rows = spark.createDataFrame([(i, f"text {i % 37}") for i in range(400)], "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = exact_dedup.exact_duplicates(rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r.keep_id == r.doc_id % 37 and r.kept == (r.doc_id < 37) for r in got) and len(got) == 400


def brute_components(rows, percent):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(UP))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    low = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {i: (len(sets[i]), low[i]) for i in sets}


def test_near_dedup_equals_brute_force(spark, odd, monkeypatch):
    rnd = random.Random(5)
    base = [f"t{rnd.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(160):  # chains and stars of edits around one text
        w = list(rnd.choice(rows)[1].split() if rows and rnd.random() < 0.4 else base)
        for _ in range(rnd.randrange(0, 5)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += [(r.doc_id + 1000, r.text) for r in docs_of(spark).collect()]
    for percent, earlier in ((80, 64), (85, 2)):
        monkeypatch.setattr(near_dedup, "EARLIER", earlier)
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    monkeypatch.setattr(near_dedup, "SMALL_PAIRS", 0)  # only stars
    monkeypatch.setattr(near_dedup, "MAX_BROADCAST_IDS", 0)  # only shuffled joins
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 85)
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count() and {r.doc_id: r.component_id for r in got}[6] == 5
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_near_dedup_of_repeated_ids(spark):
    b, o = " ".join(f"b{i}" for i in range(60)), " ".join(f"o{i}" for i in range(60))
    rows = [(1, b), (2, o), (2, b + " x"), (3, o + " y"), (4, "lone words"), (5, ""), (5, "some other words of it"), (None, b)]
    for parts in (1, 2, 5):
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (5, 5), (5, 5)]


def test_near_dedup_of_repeated_rows(spark, monkeypatch):
    b = " ".join(f"b{i}" for i in range(60))
    rows = [(1, b), (1, b), (2, b + " x"), (2, "other words"), (3, b + " y"), (3, b + " y"), (4, "lone words")]
    for most in (near_dedup.MAX_BROADCAST_IDS, 0):
        monkeypatch.setattr(near_dedup, "MAX_BROADCAST_IDS", most)
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (2, 1), (3, 1), (3, 1), (4, 4)]


def test_near_dedup_shuffles_few_sets(spark, monkeypatch):
    plans, kept, write = {}, {}, near_dedup.Tables.write

    def spy(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        folder = self.folder.removeprefix("file://")
        kept[name] = os.listdir(folder) if os.path.isdir(folder) else []
        write(self, df, name)

    monkeypatch.setattr(near_dedup.Tables, "write", spy)
    assert near_dedup.near_duplicates(docs_of(spark, SF1), 85).count() == docs_of(spark, SF1).count()
    assert "Exchange hashpartitioning" not in plans["sets"]
    assert not {"sketches", "banded"} & set(kept["sets"])  # no bands lie beside the sets
    assert "LeftSemi" in plans["tested/round=0"]  # sets of others than the pairs' members stay where they are


def test_decontamination(spark, odd):
    items = [r.text for r in spark.read.parquet(f"{SF1}/benchmark.parquet").collect()]
    docs = docs_of(spark, SF1)
    flat = lambda t: " " + " ".join((t or "").translate(UP).split()) + " "
    want = {(r.doc_id, k) for r in docs.collect() for k, t in enumerate(items) if flat(t) in flat(r.text)}
    got = {(r.doc_id, r.item_id): r.edits for r in queries.op2_decontamination(spark, SF1).collect()}
    assert want <= set(got) and all(got[p] == 0 for p in want)
    rnd, index = random.Random(2), decontaminate.build_index(list(range(len(items))), items)
    found = 0
    for n in range(150):  # a tenth of the words edited
        k = rnd.randrange(len(items))
        w = items[k].split()
        for _ in range(len(w) // 10):
            w[rnd.randrange(len(w))] = f"z{n}"
        text = " ".join(["filler"] * rnd.randrange(90) + w + ["more"] * 30)
        found += any(x[1] == k for _, h, at in decontaminate.words_of(pa.array([text])) for x in decontaminate.leaks_of(index, h, at))
    assert found >= 0.9 * 150
    benchmark = spark.createDataFrame([(1, None), (2, ""), (None, "a b c")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, benchmark).collect()} == {(4, None), (None, None)}
    assert decontaminate.contaminated(odd, benchmark.limit(0)).count() == 0


def test_decontamination_finds_edits_anywhere_in_the_item():
    rnd = random.Random(4)
    words = " ".join(r for r in pq.read_table(f"{SF1}/documents.parquet")["text"].to_pylist() if r).split()
    piece = lambda n: words[(a := rnd.randrange(len(words) - n)) : a + n]
    for n in (9, 12, 23, 24, 47, 48, 59, 300, 700):
        items, e = [piece(n) for _ in range(12)], n // 5
        index = decontaminate.build_index(list(range(12)), [" ".join(x) for x in items])
        for place in ("head", "middle", "tail", "all over"):
            found = 0
            for k, x in enumerate(items):
                gone = set(rnd.sample(range(n), e)) if place == "all over" else set(range(e)) if place == "head" else set(range(n - e, n)) if place == "tail" else set(range(n // 2 - e // 2, n // 2 - e // 2 + e))
                for put in ([], ["zz"]):  # deleted, replaced
                    text = " ".join(piece(rnd.randrange(1, 90)) + [y for i, w in enumerate(x) for y in (put if i in gone else [w])] + piece(40))
                    found += any(r[1] == k for _, h, at in decontaminate.words_of(pa.array([text])) for r in decontaminate.leaks_of(index, h, at))
            assert found >= 0.95 * 24, (n, place)


def test_span_distance_is_exact():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 15))
        assert decontaminate.span_distance(a, b)[0] == slow(list(a), list(b))


def test_unigram_segmentation_equals_the_library(spark):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, models

    sp = SentencePieceProcessor(model_file=unigram.MODEL)
    own = unigram.load()
    special = {i for i in range(sp.get_piece_size())} - set(own.ids)
    lib = Tokenizer(models.Unigram([(sp.id_to_piece(i) if i not in special else f"\0{i}", sp.get_score(i)) for i in range(sp.get_piece_size())], 0, False))
    words = sorted({w for r in docs_of(spark).collect() for w in r.text.split()})[:6000] + ["the", "日本語", "a" * 700]
    a = unigram.automaton(own)
    got = encoded(a, words)
    known = [k for k, g in enumerate(got) if not set(g) & set(own.byte_ids)]
    assert len(known) > 0.8 * len(words)
    for k in known:
        assert got[k] == lib.encode("▁" + words[k]).ids, words[k]


def encoded(a, texts, region=None):
    return [x for _, _, ids in unigram.encode(a, pa.array(texts, pa.string()), region) for x in ids.to_pylist()]


def viterbi(v, data):
    """The whole table of one text, without chunks, regions or commits."""
    pieces = {p: (i, s) for p, i, s in zip(v.pieces, v.ids, v.scores, strict=True)}
    best = {0: (0.0, 0, [])}
    for end in range(1, len(data) + 1):
        head = end - 1
        while data[head] & 0xC0 == 0x80:
            head -= 1
        ways = [(best[k][0] + pieces[data[k:end]][1], k, [pieces[data[k:end]][0]]) for k in range(max(0, end - 64), end) if k in best and data[k:end] in pieces]
        if data[head:end] not in pieces and head in best and (end == len(data) or data[end] & 0xC0 != 0x80):
            ways.append((best[head][0] + v.unknown, head, [v.byte_ids[b] for b in data[head:end]]))
        if ways:
            best[end] = max(ways, key=lambda w: (w[0], -w[1]))
    out, end = [], len(data)
    while end:
        out, end = best[end][2] + out, best[end][1]
    return out


def test_streaming_viterbi_equals_the_whole_table(monkeypatch):
    v = unigram.load()
    a, rnd = unigram.automaton(v), random.Random(1)
    docs = [t for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist() if t]
    texts = ["".join(rnd.choice("abcdeé☃") for _ in range(rnd.randrange(1, 400))) for _ in range(30)]
    texts += [t.replace(" ", "")[:900] for t in docs[:12]] + [t[:1500] for t in docs[:6]] + ["a" * 2000, " " * 90, "x", "  two  spaces "]
    want = [viterbi(v, (" " + t).encode()) for t in texts]
    assert encoded(a, texts) == want == encoded(a, texts, 10_000)
    monkeypatch.setattr(unigram, "SLICE", 100)
    monkeypatch.setattr(unigram, "PLACES", 60)
    assert encoded(a, [*texts, "", None]) == [*want, [], None]
    table = unigram.byte_table(v)
    ids = pa.array([*want, [], None, [10**6, -1, *want[0]], [v.byte_ids[0xE9]], [None, want[0][0]]], pa.list_(pa.int32()))
    back = unigram.decode(table, ids).to_pylist()
    assert back[: len(texts)] == texts and back[len(texts) : -1] == ["", None, texts[0], "\ufffd"]


def test_codec_and_counts(spark, odd):
    rows = queries.op10_sentencepiece(spark, SF1).collect()
    assert all(r.round_trip for r in rows)
    counts = {r.doc_id: r.n_tokens for r in queries.op3_token_counts(spark, SF1).collect()}
    assert counts == {r.doc_id: r.n_ids for r in rows}
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(odd))
    assert all(r.decoded == r.text and (r.ids is None) == (r.text is None) for r in out.collect())
    assert token_counts.token_counts(odd).where("n_tokens = 0").count() == 3
    assert all(r.round_trip and r.row == 3 for r in sentencepiece_codec.transcode(odd.withColumn("round_trip", F.lit("x"))).collect())
    assert sentencepiece_codec.encode(odd.limit(0)).count() == 0 and token_counts.token_counts(odd.limit(0)).count() == 0


def test_secret_scan(spark, odd):
    s = "x password=abcdef1234567890 y"
    z = base64.b64encode(zlib.compress(s.encode())).decode()
    spans = lambda t: secret_scan.joined(secret_scan.scan(t)[1])
    assert spans("k " + urllib.parse.quote("token = " + "q" * 13, safe="")) == "assign:2:29"
    assert spans("u \\u0070assword=abcdefabcdefabcd") == "assign:2:32,hex:16:32"
    assert spans(f"aa {z} bb") == f"assign:3:{3 + len(z)},hex:3:{3 + len(z)}"
    assert spans("%2541KIAABCDEFGHIJKLMNOPQRS") == "access:0:27"
    nested = base64.b64encode(base64.b64encode(z.encode())).decode()
    assert f"assign:0:{len(nested)}" in spans(nested)
    assert spans("é password = 'Abc/def+123=' ") == "assign:2:26"
    assert spans("tokeN=abc token=abcdefghijkl") == "assign:10:28" and spans("") == ""
    assert secret_scan.secrets(odd).count() == odd.count() and secret_scan.secrets(odd.limit(0)).count() == 0
    for r in queries.op9_secret_scan(spark, SF).collect():
        assert r.n_assign + r.n_access + r.n_hex <= len([x for x in r.spans.split(",") if x])


def test_base_secrets_equal_brute_force(spark, odd):
    kinds = (
        ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    )
    texts = ["token=abc token = 'Abc/def+123=' é", "AKIA" * 6, "0123456789abcdef" * 2 + "g" + "0" * 16, "tokentoken=aaaaaaaaaaaaaaaa", "ſecret=aaaaaaaaaaaaaa", None, ""]
    rows = [(r.doc_id, r.text) for r in docs_of(spark, SF1).collect()] + [(10**6 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.secrets(df).collect()}
    n_found = 0
    for i, t in rows:
        want = sorted((m.start(), k, m.end(), name) for k, (name, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, t or "", re.ASCII) if ok(m))
        assert [(s.start, s.kind, s.end) for s in got[i].base] == [(a, name, b) for a, _, b, name in want]
        assert {(s.kind, s.start, s.end) for s in got[i].base} <= {(s.kind, s.start, s.end) for s in got[i].all}
        n_found += len(want)
    assert n_found > 10


def test_secret_scan_ends_on_archives_that_hold_themselves():
    data = b"x password=abcdef1234567890 y"
    for _ in range(80):
        data = zlib.compress(data)
    run = base64.b64encode(data).decode()
    base, found, layers, refused = secret_scan.scan(run)
    assert found and layers >= 1
    stream = secret_scan.ByteStream(0)
    stream.feed(data)
    stream.close()
    assert stream.refused == 1


def test_secret_scan_refuses_no_layer(monkeypatch):
    for name, size in (("MAX_LAYER", 1 << 20), ("BLOCK", 1 << 18), ("OVERLAP", 1 << 16)):
        monkeypatch.setattr(secret_scan, name, size, raising=False)
    s = b"x password=abcdef1234567890 y\n"
    b64 = lambda data: base64.b64encode(data).decode()
    zipped = lambda data: b64(zlib.compress(data, 1))
    kinds = lambda t: {(a, b) for a, b, _ in secret_scan.scan(t)[1]}
    small, large, filler = b64(s), zipped(b"-" * (17 << 16)), b"lorem ipsum " * (3 << 15)
    text = f"{large} {small}"
    assert kinds(text) == {(len(large) + 1, len(text))} and secret_scan.scan(text)[3] == 0
    for inner in (s, small.encode() + b"\n", zipped(s).encode(), zlib.compress(filler + s)):
        run = zipped(filler + b"\n" + inner + b"\n" + filler) if inner[:1] != b"x" or inner == s else b64(zlib.compress(inner))
        assert kinds(run) == {(0, len(run))}, inner[:20]
    noise = random.Random(1).randbytes(13 << 16).translate(bytes(33 + i % 14 for i in range(256)))
    run = zipped(b"," + base64.b64encode(noise + s))  # a layer whose one run is longer than a block
    assert kinds(run) == {(0, len(run))}
    several = b64(gzip.compress(b"nothing") + gzip.compress(s))
    assert kinds(several) == {(0, len(several))}


def test_secrets_behind_names_and_paths():
    found = lambda t: {(a, b) for a, b, _ in secret_scan.scan(t)[1]}
    secret = b"x password=abcdefghijkl0123 and more text behind it, that is not any secret at all"
    deflate = lambda x: (c := zlib.compressobj(9, zlib.DEFLATED, -15)).compress(x) + c.flush()
    packed = {"plain": secret, "zlib": zlib.compress(secret), "gzip": gzip.compress(secret), "deflate": deflate(secret)}
    for prefix in ("", "/", "p/", "api/v1/", "https://h.io/p/", "id-", "run_", "a-b_c/", "s3/key_7/x-", "k8s/prod/eu-west-1/db/"):
        for name, data in packed.items():
            for coded in (base64.b64encode(data).decode(), base64.urlsafe_b64encode(data).decode().rstrip("=")):
                spans = found(f"see {prefix}{coded} end")
                assert spans and all(4 <= a < b <= 4 + len(prefix + coded) for a, b in spans), (prefix, name)
    hide = lambda form: "".join(form.format(ord(c)) for c in "password")
    for form in ("%{:02X}", "\\u{:04x}", "\\x{:02x}", "\\U{:08X}"):
        text = f"a {hide(form)}=abcdefghijkl0123 b"
        assert found(text) == {(2, len(text) - 2)}, form
    text = "a " + "".join(f"\\u{{{ord(c):x}}}" for c in "password") + "=abcdefghijkl0123 b"
    assert found(text) == {(2, len(text) - 2)}
    for coding in ("utf-16-le", "utf-16-be", "utf-16"):
        assert found("q " + base64.b64encode(secret.decode().encode(coding)).decode() + " r")
    plain = "Donaudampfschifffahrtsgesellschaft /usr/local/share/doc/packages/README_first-of-all some-long_name/with/parts 0123456789abcdeX"
    assert found(plain) == set()


def test_secret_scan_opens_every_layer():
    s = "x password=abcdef1234567890 y"
    b64 = lambda data: base64.b64encode(data).decode()
    got = lambda t: {(a, b) for a, b, _ in secret_scan.scan(t)[1]}
    run, zipped = b64(s.encode()), b64(gzip.compress(s.encode() + random.Random(3).randbytes(150).hex(":").encode()))
    for name in ("data=", "?payload=", "KEY%3D", "a=b=="):
        assert got(name + zipped) == {(len(name), len(name + zipped))}, name
    assert got(f"%E9%20{urllib.parse.quote('token=' + 'q' * 13, safe='')}".replace("token", "%74oken")) == {(6, 29)}
    assert got("%E9%74%6Fken=abcdefabcdef12") == {(3, 27)}
    assert got("\\ud800\\u0074oken=abcdefabcdef12") == {(6, 31)}
    for data in (b"\x00\xff" + s.encode(), b"\xe9 " + run.encode(), zlib.compress(b"\x01" + s.encode())):
        assert got("k " + b64(data)) == {(2, 2 + len(b64(data)))}
    for width, end in ((76, "\n"), (64, "\r\n"), (40, "\n  ")):
        wrapped = end.join(zipped[i : i + width] for i in range(0, len(zipped), width))
        for before, after in (("see:\n\n", "\n\nbye"), ("data=", ""), ("one\n", "\nRegards\n")):
            ((a, b),) = got(before + wrapped + after)
            assert a == len(before) and b >= len(before + wrapped)
        short = "key: " + zipped[:36] + end + end.join(zipped[36:][i : i + width] for i in range(0, len(zipped) - 36, width))
        assert got(short) == {(5, len(short))}
    many = b64(b"".join(gzip.compress(b"nothing") for _ in range(3000)) + gzip.compress(s.encode()))
    assert got(many) == {(0, len(many))}
    stream = secret_scan.ByteStream(0)
    stream.feed(base64.b64decode(many))
    stream.close()
    assert stream.kinds == {0, 2} and stream.refused == 0


def template_windows(words, template, size):
    """The most distinct words of the template in any window of so many words, by sliding."""
    t, inside, most = set(template), collections.Counter(), 0
    for i, w in enumerate(words):
        if w in t:
            inside[w] += 1
        if i >= size and words[i - size] in t:
            inside[words[i - size]] -= 1
            inside += collections.Counter()
        most = max(most, len(inside))
    return most


def test_license_scan(spark, odd):
    phrases = {tuple(p.split()): label for p, label in license_scan.PHRASES.items()}
    texts = ["MIT License. mit license", "the GNU\nGeneral public-license v3", "cc by cc BY", "Kcc by K", "licensed under the apache software license version 2 0", None, "", "İ mit license"]
    rnd, every = random.Random(3), license_scan._texts()
    for _, t in every:  # grants amid other words, whole, with words lost, and torn apart
        w = list(t)
        for _ in range(rnd.randrange(0, 3)):
            w.pop(rnd.randrange(len(w)))
        texts += [" ".join(["x"] * rnd.randrange(80) + w + ["y"] * 9), " ".join(v for x in t for v in (x, *["z"] * rnd.randrange(4)))]
    docs = docs_of(spark, SF1).select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = {r.doc_id: r for r in license_scan.license_places(docs).collect()}
    n_found = 0
    for r in docs.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(UP))
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        g = got[r.doc_id]
        want = (len(w), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == want
        labels = set(g.labels.split(",")) - {""} - {x for _, x in at}
        must, may = set(), set()
        for label, t in every:
            need, step = license_scan.THRESHOLD * len(set(t)), license_scan.block_step(len(t))
            must |= {label} if template_windows(w, t, step) >= need else set()
            may |= {label} if template_windows(w, t, 2 * step) >= need else set()
        assert must - {x for _, x in at} <= labels <= may
        n_found += len(must)
    assert n_found >= len(every)
    assert license_scan.license_places(odd).count() == odd.count() and license_scan.license_places(odd.limit(0)).count() == 0


def test_license_filters_leave_few_pairs(spark):
    docs = docs_of(spark, SF1)
    frequency = license_scan.frequencies(license_scan._spaced(docs))
    templates = license_scan.ranked_templates(frequency, license_scan.THRESHOLD)
    rows = license_scan._places(docs, templates)
    blocks = license_scan._blocks(rows, templates, frequency)
    assert license_scan._candidates(blocks, templates).count() < rows.select(F.sum(F.size("hits"))).first()[0]


def test_language_id(spark, odd):
    truth = {r.doc_id: r.lang for r in docs_of(spark, SF1).collect()}
    rows = queries.op6_language_id(spark, SF1).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert {r.lang_pred for r in crf_language.languages(odd).collect()} == {"und"}
    mixed = docs_of(spark, SF1).select("doc_id", "text", "lang").union(odd.select(F.col("doc_id") + 10**7, "text", "lang")).union(odd.select("doc_id", "text", "lang").where("doc_id is null"))
    got = {r.doc_id: r for r in crf_language.languages(mixed).where("doc_id is null or doc_id > 1000000").collect()}
    assert {i: got[10**7 + i].lang_pred for i in (1, 2, 3, 7)} == dict.fromkeys((1, 2, 3, 7), "und")
    assert all(got[10**7 + i].lang_pred in set(truth.values()) and got[10**7 + i].score > 0 for i in (4, 5, 6, 8))
    even = crf_language.Model(["b", "a"], np.zeros((crf_language.BUCKETS, 2), np.float32), np.zeros((2, 2)), np.zeros(2))
    post, _ = crf_language.label_words(even, np.frombuffer(b"one two ", np.uint8), np.array([0, 8]))
    assert np.allclose(post, 0.5)


def test_samples_are_bounded(spark):
    from searchops.llm import samples
    from searchops.llm.scratch import Tables

    docs = spark.createDataFrame([(i % 4, f"text {i} " + "x" * 90) for i in range(200)] + [(9, None)], "doc_id long, text string")
    ids = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a"), (3, "b"), (9, "b")], "doc_id long, kind string")
    some = samples.first_of_each(ids, "kind", 3)
    assert some.count() == 3 and {r.kind for r in some.collect()} == {"a", "b"}
    for most, n in ((10**6, 5), (250, 2), (0, 0)):
        got = samples.texts_of(docs, samples.first_of_each(ids, "kind", 5), most, Tables(spark, "t")).collect()
        assert len({r.doc_id for r in got}) == len(got) and sum(len(r.text) for r in got) <= most and abs(len(got) - n) <= 1


def test_toxicity_scores_equal_windows_one_by_one(spark, odd, monkeypatch):
    weights = np.random.default_rng(0).normal(size=subword_toxicity.BUCKETS).astype(np.float32)
    monkeypatch.setattr(subword_toxicity, "train", lambda bags: (weights, 0.1))
    docs = docs_of(spark).select("doc_id", "text").union(odd.select(F.col("doc_id") + 10**6, "text"))
    labels = spark.createDataFrame([(10**8, 0)], "doc_id long, toxic int")  # no document: no bags, so the bias stays
    got = {r.doc_id: r.score for r in subword_toxicity.toxicity(docs, labels).collect()}
    for r in docs.where("doc_id is not null").collect():
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (r.text or "").encode())
        best = -np.inf
        for i in range(0, max(1, len(words)), subword_toxicity.WINDOW):
            raw = np.frombuffer(b" ".join(words[i : i + subword_toxicity.WINDOW]) + b" ", np.uint8)
            buckets = np.concatenate([b for b, *_ in subword_toxicity.grams(raw, np.array([0, len(raw)]))])
            best = max(best, weights[buckets].astype(float).mean() if len(buckets) else 0.0)
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-best - 0.1))) < 1e-5, r.doc_id


def test_quality_sums_and_scores_equal_numpy(spark, odd, monkeypatch):
    docs = docs_of(spark).select("doc_id", "text").union(odd.select(F.col("doc_id") + 10**6, "text")).where("doc_id is not null")
    texts = {r.doc_id: r.text for r in docs.collect()}
    each = {i: pu_quality.measures(pa.array([t], pa.string()))[0] for i, t in texts.items()}
    table = docs.repartition(5).mapInArrow(pu_quality._measure, "doc_id long, m array<double>")
    x = np.array([each[r.doc_id] for r in docs.collect()])
    assert np.allclose(pu_quality._sums(table, lambda m: m.sum(0)), x.sum(0))
    net = pu_quality.Net(x.mean(0), x.std(0) + 1e-3, np.random.default_rng(1))
    monkeypatch.setattr(pu_quality, "train", lambda positive, sample, table: (net, 0.5))
    labels = spark.createDataFrame([(i, 1) for i in list(texts)[:40]], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in pu_quality.quality(docs, labels).collect()}
    for i, m in each.items():
        assert abs(got[i] - pu_quality.sigmoid(net.logit(m[None]))[0]) < 1e-9
    # the risk's gradient, by differences
    positive, unlabelled = x[:20], x[20:60]

    def risk() -> float:
        zp, zu = net.logit(positive), net.logit(unlabelled)
        return 0.3 * np.logaddexp(0, -zp).mean() + np.logaddexp(0, zu).mean() - 0.3 * np.logaddexp(0, zp).mean()

    d, up = pu_quality.risk_step(net, 0.3, net.logit(positive), float(np.logaddexp(0, net.logit(unlabelled)).mean()))
    net.logit(positive)
    g = net.gradient(d)
    zu = net.logit(unlabelled)
    g = [a + b for a, b in zip(g, net.gradient(pu_quality.sigmoid(zu) / len(zu)), strict=True)]
    if up:
        before = risk()
        net.w[2][3] += 1e-6
        assert abs((risk() - before) / 1e-6 - g[2][3]) < 1e-4


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    em, tr, st = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    weight = {p: np.exp(st[p[0]] + sum(em[0, i, y] for i, y in enumerate(p)) + sum(tr[a, b] for a, b in zip(p, p[1:], strict=False))) for p in itertools.product(range(3), repeat=4)}
    want = np.array([[sum(w for p, w in weight.items() if p[i] == y) for y in range(3)] for i in range(4)]) / sum(weight.values())
    post, _ = crf_language.forward_backward(em, np.ones((1, 4), bool), tr, st)
    assert np.allclose(post[0], want)
    assert np.allclose(crf_language.posteriors(em[0], np.array([4]), tr, st), want, atol=1e-5)


def test_classifiers(spark, odd):
    labels = spark.read.parquet(f"{SF1}/labels.parquet")
    rows = queries.op8_quality(spark, SF1).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    big = "/root/testdata/sf0.1"
    rows = queries.op1_toxicity(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean(np.array(good)[:, None] > np.array(bad)) >= 0.95
    assert np.mean([r.predicted for r in rows if r.toxic]) >= 0.9 and np.mean([1 - r.predicted for r in rows if not r.toxic]) >= 0.95
    none = labels.limit(0)
    for got in (pu_quality.quality(odd, labels), subword_toxicity.toxicity(odd, labels), pu_quality.quality(odd, none), subword_toxicity.toxicity(odd, none)):
        assert all(0 <= r.score <= 1 for r in got.collect()) and got.count() == odd.count()
    assert pu_quality.quality(odd.limit(0), labels).count() == 0


def test_pipeline_equals_brute_force(spark, odd):
    docs = {r.doc_id: r.text for r in docs_of(spark).collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {i: t for i, t in docs.items() if re.search(r"[^\W\d_]", t or "")}
    first = {}
    for i, t in sorted(docs.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    docs = {i: docs[i] for i in first.values()}
    near = brute_components(docs.items(), 80)
    docs = {i: t for i, t in docs.items() if near[i][1] == i}
    flat = lambda t: " " + " ".join((t or "").translate(UP).split()) + " "
    docs = {i for i, t in docs.items() if not any(flat(x) in flat(t) for x in items)}
    got = queries.pipeline(spark, SF)
    assert {r.doc_id for r in got.where("round_trip").collect()} == docs
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() >= 1 and stage(spark, odd.limit(0), SF).count() == 0
    out = corpus_pipeline.exact_dedup_stage(spark, odd, SF)
    assert out.where("doc_id = 4").count() == 1 and out.columns == odd.columns
    clash = odd.selectExpr("doc_id", "text", "lang", "'a' lang_pred_", "'b' lang_shares", "'c' digest", "'d' decoded", "'e' _digest", "'f' bands", "'g' kept")
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, clash, SF)
        assert set(clash.columns) <= set(got.columns) and {tuple(r) for r in got.select(clash.columns[3:]).collect()} == {tuple("abcdefg")}


def test_toxicity_cut_is_found_on_texts_the_model_did_not_see():
    z, y = np.array([3.0, 2.0, 2.0, 1.0, 0.0, -1.0]), np.array([1, 1, 0, 1, 0, 0])
    j = lambda c: (z[y == 1] >= c).mean() - (z[y == 0] >= c).mean()
    cut = subword_toxicity.best_cut(z, y)
    assert cut == 0.5 and all(j(cut) >= j(c) for c in z)
    rng = np.random.default_rng(4)
    bags = [(k % 2, np.append(rng.integers(0, 50, 20), 60 + rng.integers(0, 3) if k % 2 else 50).astype(np.int32), np.array([21], np.int32)) for k in range(240)]
    model = subword_toxicity.calibrated(bags[:180])
    score = 1 / (1 + np.exp(-subword_toxicity.log_odds(model, bags[180:])))
    assert np.mean((score >= subword_toxicity.CUT) == np.array([b[0] for b in bags[180:]])) > 0.95
    few = bags[:180:2] + bags[1:5:2]  # two toxic ones: the bias stays
    assert subword_toxicity.calibrated(few)[1] == subword_toxicity.train(few)[1]
