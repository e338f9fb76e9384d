"""Operators over odd small tables, against plain models."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from haplomill.llm import ann, chat_format, line_dedup, minhash, near_copies, packing, pieces, quality, simhash, sstable, url_filter
from haplomill.llm.common import cut, scratch_path
from haplomill.llm.tokens import vocabulary
from haplomill.plans.components import roots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n long"
LONG = " ".join(f"w{i % 977}x" for i in range(40_000))
ROWS = [(1, "Hello world. Hello again.\nfooter", "en", "a", 5, "s", 1), (2, None, None, None, None, None, None), (3, "", "en", "a", 0, "", 0), (None, "no id here\tat all", "en", "b", 3, "", 0),
        (4, "Hello world. Hello again.\nfooter", "en", "a", 5, "s", 1), (4, "Hello world. Hello again.\nfooter", "en", "a", 5, "s", 1), (5, LONG, "en", "b", len(LONG), "", 0), (6, "é日本 <|endoftext|>  x\n\n", "ja", "b", 2, "", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, docs, none, tokenizer):
    got = packing.pack(docs, vocabulary(), parts=2).collect()
    assert sum(r.length for r in got) == sum(len(tokenizer(t[1])) + 1 for t in ROWS)
    whole = sorted((r for r in got if r.doc_id == 5), key=lambda r: r.start)
    assert b"".join(bytes(r.ids) for r in whole) == np.array(tokenizer(LONG) + [1], "<u2").tobytes()
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack(none, vocabulary()).count() == 0


def test_mixture_follows_rates():
    from collections import deque

    w = packing._Windows(0, 2048)
    packing.round_robin({s: deque(((s, i), 500) for i in range(400)) for s in "ab"}, {"a": 3.0, "b": 1.0}, {"a": 900.0, "b": -900.0}, w, 64)
    w.close()
    for seq in range(3, 100):  # the debt of 900 tokens is paid in the first windows
        mine = sum(n for doc, _, n, s, _ in w.done if s == seq and doc[0] == "a")
        assert abs(mine / 2048 - 0.75) < 0.05
    assert sum(n for _, _, n, _, _ in w.done) == 400_000


def window_mixtures(got):
    rows = {}
    for r in got:
        rows.setdefault(r.sequence_id, []).append(r)
    full = [x for _, x in sorted(rows.items()) if sum(r.length for r in x) == 2048]
    return [{s: sum(r.length for r in x if r.source == s) / 2048 for s in {r.source for r in x}} for x in full]


def off(mixture, target):
    return sum(abs(mixture.get(s, 0) - target.get(s, 0)) for s in {*mixture, *target}) / 2


def test_windows_keep_the_mixture_across_parts(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    rows = docs.select("doc_id", "source", "text").collect()
    ids = {r.doc_id: tokenizer(r.text) + [1] for r in rows}
    share = {}
    for r in rows:
        share[r.source or ""] = share.get(r.source or "", 0) + len(ids[r.doc_id]) / sum(map(len, ids.values()))
    for parts, weights in ((8, None), (64, None), (64, share)):
        got = packing.pack(docs, vocabulary(), parts=parts, weights=weights).collect()
        assert np.median([off(m, share) for m in window_mixtures(got)]) <= 0.05
        at = {}
        for r in sorted(got, key=lambda r: (r.doc_id, r.start)):  # every id once
            assert r.start == at.get(r.doc_id, 0) and r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])
            at[r.doc_id] = r.start + r.length
        assert at == {d: len(x) for d, x in ids.items()}


def test_weights_hold_until_a_source_is_dry(spark):
    docs = spark.createDataFrame([(i, " word" * 400, "abcd"[i % 4]) for i in range(800)], "doc_id long, text string, source string")
    got = packing.pack(docs, vocabulary(), parts=7, weights={"a": 0.6, "b": 0.3, "c": 0.1, "never": 1.0}).collect()
    kinds = [set(m) for m in window_mixtures(got)]
    assert sum(off(m, {"a": 0.6, "b": 0.3, "c": 0.1}) <= 0.02 for m in window_mixtures(got)[:60]) >= 57
    assert {"d"} in kinds and not any("d" in k and len(k) > 1 for k in kinds[:100])
    assert sum(r.length for r in got) == 800 * 401


def test_stretches_equal_a_walk_over_tokens():
    rng = np.random.default_rng(8)
    for _ in range(60):
        size, parts, grain, shift = int(rng.integers(1, 3000)), int(rng.integers(1, 40)), 64, int(rng.integers(0, 1 << 20))
        schedule = packing.Schedule(size * 3, None)
        whole = packing.stretches(0, size, size, grain, shift, 0.0, size, schedule, parts)
        assert whole[0][1] == 0 and whole[-1][2] == size and all(a[2] == b[1] and a[0] < b[0] for a, b in zip(whole, whole[1:]))
        of = {t: p for p, s, e in whole for t in range(s, e)}
        x = 0
        while x < size:  # any cut into documents gives the same parts
            n = int(min(size - x, rng.integers(1, 700)))
            assert {x + t: p for p, s, e in packing.stretches(x, n, size, grain, shift, 0.0, size, schedule, parts) for t in range(s, e)} == {t: of[t] for t in range(x, x + n)}
            x += n
        assert all(abs(t / size * parts - p) <= 1 + 2 * grain * parts / size for t, p in of.items())


def test_shards(spark, docs, none, tokenizer, tmp_path):
    manifest = sstable.write_shards(docs, vocabulary(), f"file://{tmp_path}/s", shards=3)
    got = sorted(sstable.read_shards(manifest).collect(), key=lambda r: r.start)
    want = sorted(((t[0] is not None, t[0] or 0, np.array(tokenizer(t[1]) + [0], "<u2").tobytes()) for t in ROWS))
    at = 0
    for r, (_, doc, ids) in zip(got, want):
        wide = np.frombuffer(ids, "<u2")
        assert (r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(wide), crc(wide))
        at += len(wide)
    assert len(got) == len(ROWS)
    found = []
    for m in manifest.collect():
        with open(m.path.removeprefix("file://"), "rb") as f:
            shard = sstable.Reader(f, m.bytes)
            found += shard.get(sstable.key_of(4))
            assert shard.get(sstable.key_of(987)) == []
    assert len(found) == 2
    assert sstable.read_shards(sstable.write_shards(none, vocabulary(), scratch_path(spark, "x"))).count() == 0


def test_minhash(spark, docs, none):
    got = minhash.with_edits(docs).collect()
    assert len(got) == len(ROWS)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (r[0], len(t), hashlib.sha256(edited.encode()).hexdigest()) in [(x.doc_id, x.n_chars, x.edited_sha256) for x in got]
    assert len({x.fingerprint for x in got if x.doc_id in (1, 4)}) == 1
    assert minhash.with_edits(none).count() == 0


def test_lines(spark, none):
    rows = [(i, f"line {i}\nfooter\n", "h") for i in range(9)] + [(9, None, "h"), (10, "footer", None), (None, "footer\nfooter", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("h", F.lit(1)).withColumn("n", F.lit(2))
    for limit in (1000, 0):
        got = {r.doc_id: r for r in line_dedup.drop_lines(docs, ratio=0.3, broadcast_lines=limit).collect()}
        assert got[0].text == "line 0\n" and got[0].n_dropped == 1 and got[9].text is None and got[10].text == "footer" and got[None].text == "" and got[0].h == 1
    clash = docs.withColumns({c: F.lit("own") for c in ("_host", "_bad", "_own", "_kept", "row", "host", "n_lines", "n_dropped", "a b")})
    for limit in (1000, 0):
        got = line_dedup.cleaned(clash, ratio=0.3, broadcast_lines=limit)
        assert got.columns == clash.columns and {r._bad + r.n_lines + r["a b"] for r in got.collect()} == {"ownownown"}
        assert {r.n_dropped for r in line_dedup.drop_lines(clash, ratio=0.3, broadcast_lines=limit).collect()} == {0, 1, 2}
    assert line_dedup.drop_lines(none).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a\\<|im_end|>\n<|im_start|>b"), (1, 1, "assistant", "<\\|x"), (1, 2, "user", None), (2, 0, None, "only"), (None, 0, "assistant", ""), (3, 0, "assistant", LONG), (3, 0, "assistant", LONG), (4, None, "we\nird", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(0))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(turns)).collect()}
    said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows[:3])
    assert (got[1].n_turns, got[1].turns_sha256) == (3, hashlib.sha256(said.encode()).hexdigest())
    assert got[1].loss_sha256 == hashlib.sha256(b"<\\|x").hexdigest() and got[3].loss_chars == 2 * len(LONG)
    assert got[2].loss_chars == 0 and got[4].turns_sha256 == hashlib.sha256(b"we\nird\nx\n").hexdigest() and got[None].n_turns == 1
    assert chat_format.read_back(chat_format.format_conversations(turns.limit(0))).count() == 0


def test_urls(spark):
    urls = ["http://A.Example.org/es/x", "https://example.org/en/123?q", "example.org/es/", None, "ftp://notexample.org/es/", "x://com/fr/", "x://a.com", "", "http://fr.com/de/é" + "y" * 5000, "http://fr.com/de/é" + "y" * 5000]
    pages = spark.createDataFrame(list(enumerate(urls[:-1])) + [(8, urls[-1])], "page_id long, url string").withColumn("rule", F.lit("x"))
    got = sorted(((r.page_id, r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark, url_filter.RULES)).collect()))
    assert got == [(0, "example.org/es/", "block"), (1, "example.org/en/1", "block"), (2, None, "allow"), (3, None, "allow"), (4, "org/", "allow"), (5, "com/fr/", "allow"), (6, None, "allow"), (7, None, "allow"), (8, "com/de/", "block"), (8, "com/de/", "block")]


def test_url_prefixes_that_meet_by_chance(spark):
    """Two rules with equal 4-byte prefixes of their digests: a URL of one is no match of the other."""
    seen, pair = {}, None
    for i in range(400_000):
        short = hashlib.sha256(f"h{i}.com\n/".encode()).digest()[:4]
        if short in seen:
            pair = seen[short], i
            break
        seen[short] = i
    a, b = (f"h{i}.com" for i in pair)
    pages = spark.createDataFrame([(0, f"http://{a}/x"), (1, f"http://{b}/x"), (2, f"http://www.{b}/")], "page_id long, url string")
    for rules, want in (([(a, "/", "block")], ["block", "allow", "allow"]), ([(a, "/", "block"), (b, "/", "allow"), (b, "/x", "block")], ["block", "block", "allow"])):
        got = url_filter.filter_urls(pages, url_filter.rules_frame(spark, rules))
        assert [r.verdict for r in got.orderBy("page_id").collect()] == want
    assert [r.verdict for r in url_filter.filter_urls(pages.limit(1).selectExpr("page_id", "cast(null as string) url"), url_filter.rules_frame(spark, [("", "", "block")])).collect()] == ["block"]
    assert url_filter.filter_urls(pages.limit(0), url_filter.rules_frame(spark, url_filter.RULES)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(0)
    v = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 340)]
    odd = [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [None] * 8), (None, [1.0] * 8), (404, [1.0])]
    df = spark.createDataFrame(v + odd, "vec_id long, embedding array<double>").withColumn("label", F.lit(0))
    got = {}
    for r in ann.nearest(df, every=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    x = {i: np.array(a) for i, a in v}
    hit = total = 0
    for q in (i for i in x if i % 20 == 0):
        want = sorted((float(np.sqrt(((x[i] - x[q]) ** 2).sum())), i) for i in x if i != q)[:10]
        hit, total = hit + len({i for _, i in want} & {i for _, i in got[q]}), total + 10
    assert hit / total >= 0.95 and [i for _, i in got[300]] == list(range(301, 311))
    assert ann.nearest(df.limit(0)).count() == 0


def test_equal_queries(spark):
    """A third of all rows, and of the queries, are copies of one vector."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8))
    x[::3] = x[0]
    got = {}
    for r in ann.nearest(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>"), every=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    y = x.astype(np.float32).astype(float)
    copies = list(range(0, 300, 3))
    for q, found in got.items():
        assert len(found) == 10 and [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert all(s == np.sqrt(((y[i] - y[q]) ** 2).sum()) for _, i, s in found)
        if q % 3 == 0:
            assert [i for _, i, _ in sorted(found)] == [i for i in copies if i != q][:10]
    assert len(got) == 30


def test_nearest_on_a_table_above_the_sample(spark):
    x = np.random.default_rng(3).normal(size=(20_000, 64))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, every=400).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, len(x), 400):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert len(got) == 50 and hit / 500 >= 0.9


def test_fingerprints_equal_brute_force(spark):
    """op2 and op8 over the smallest tables: every text, against plain Python."""
    import xxhash

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    order = sorted(docs)
    rows = {r.doc_id: r for r in minhash.op2_minhash(spark, "/root/testdata/sf0.001").collect()}
    assert sorted(rows) == order
    words = lambda t: {tuple(t.encode().split()[i : i + 5]) for i in range(max(1, len(t.encode().split()) - 4))} if t.split() else set()
    wrong = []
    for i, d in enumerate(order):
        t, following = docs[d], docs[order[(i + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert rows[d].n_chars == len(t) and rows[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = words(t), words(edited)
        wrong.append(abs(rows[d].near_edited - (len(a & b) / len(a | b) if a | b else 1.0)))
        assert (docs[d] != following) or rows[d].near_next == 1.0
    assert np.mean(wrong) < 0.05 and max(wrong) < 0.25
    prints, near = {}, {}
    for d, t in docs.items():
        parts = [w for w in t.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split() if w]
        k = min(3, len(parts))
        h = [xxhash.xxh64_intdigest(b" ".join(parts[i : i + k]), 42) for i in range(len(parts) - k + 1)] if parts else []
        prints[d] = sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h))
    for d in order:  # components by repeated search
        if d in near:
            continue
        todo, near[d] = [d], d
        while todo:
            x = todo.pop()
            for y in order:
                if y not in near and bin(prints[x] ^ prints[y]).count("1") <= 3:
                    near[y] = d
                    todo.append(y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: (f"{prints[d]:016x}", near[d]) for d in order}


def test_quality_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = quality.op10_quality(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    known = [r.predicted == labels[r.doc_id] for r in got if r.held_out and labels.get(r.doc_id) is not None]
    assert len(known) > 50 and np.mean(known) >= 0.95


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS) and {r.component_id for r in got if r.doc_id in (1, 4)} == {1} and {r.component_id for r in got if r.doc_id in (2, 3)} == {2}
    assert simhash.near_duplicates(none).count() == 0


def test_golay_keys_meet():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a.copy()
    for k in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)
    for x, y in zip(a, b):
        assert set(simhash.fuzzy_keys(np.array([x]))[0]) & set(simhash.fuzzy_keys(np.array([y]))[0])


def test_forest_connects():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    prints = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for _ in range(6)]))
    a, b = simhash.forest(prints)
    node, root = roots(a, b)
    found = {int(n): int(r) for n, r in zip(node, root)}
    for i in range(len(prints)):
        for j in range(i):
            if bin(int(prints[i] ^ prints[j])).count("1") <= 3:
                assert found.get(int(prints[i]), int(prints[i])) == found.get(int(prints[j]), int(prints[j]))


def test_near_copies(spark, docs, none):
    kept = near_copies.keep_one(docs).collect()
    assert sorted((r.doc_id for r in kept), key=lambda x: x or 0) == [None, 1, 2, 5, 6]
    assert near_copies.keep_one(none).count() == 0
    clash = docs.withColumns({c: F.lit("own") for c in ("node", "_node", "keep", "least", "h1", "h2", "row", "id", "component", "fp", "a b")})
    got = near_copies.keep_one(clash)
    assert got.columns == clash.columns and sorted((r.doc_id, r.keep + r.node) for r in got.collect() if r.doc_id) == [(i, "ownown") for i in (1, 2, 5, 6)]


def test_pieces(spark, docs, none):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in pieces.encode(docs, path).collect():
        text = next(t[1] for t in ROWS if t[0] == r.doc_id) or ""
        assert r.ids == model.encode(text) and r.round_trip
    assert pieces.encode(none, path).count() == 0


def test_quality(spark, docs, none):
    rows = [(i, "good plain words in a row here " * 5 if i % 2 else "$$$ bad ### $$$ " * 9) for i in range(200)]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    labels = many.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = quality.score(many, labels).collect()
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in got)
    odd = quality.score(docs, labels.limit(0)).collect()
    assert len(odd) == len(ROWS) and {r.score for r in odd} == {0.5}
    assert quality.score(none, labels).count() == 0


def test_words_of_one_bucket_score_apart(spark):
    seen, pair = {}, None
    for i in range(2_000):
        word = "w" + "".join(chr(97 + int(c)) for c in str(i))
        bucket = int(quality.word_ids(word.encode())[0] >> np.uint64(40)) % 8192  # as many buckets as words once shared
        if bucket in seen:
            pair = word, seen[bucket]
            break
        seen[bucket] = word
    many = spark.createDataFrame([(i, f"{pair[i % 2]} " * (3 + i % 7)) for i in range(200)], "doc_id long, text string")
    got = quality.score(many, many.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))).collect()
    assert len(got) == 200 and all((r.score >= 0.5) == bool(r.doc_id % 2) for r in got)


def test_features_equal_brute_force(spark, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{chr(97 + int(i) % 26)}{chr(97 + int(i) // 26)}" for i in rng.zipf(1.4, int(n)) % 300) for n in rng.integers(0, 120, 60)] + ["", "one", None, "one"]
    monkeypatch.setattr(quality, "CHUNK", 70)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = quality.tokenised(docs, ("doc_id",), vocabulary())
    dtype = quality.encoder(vocabulary()).dtype
    ids = {r.id: np.frombuffer(bytes(r.ids), dtype).tolist() for r in found.collect()}
    index = quality.index_vectors(50257).astype(int)
    context = np.zeros((50257, quality.WIDTH), int)
    for t in ids.values():
        for i, w in enumerate(t):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(t):
                    context[w] += index[t[j]]
    vectors = quality.word_vectors(found, vocabulary())
    assert (vectors == quality.in_steps(context, index[:-1])).all() and context.any()
    order = sorted(ids)
    got = quality.pooled(pa.array([np.array(ids[i], dtype).tobytes() for i in order], pa.binary()), pa.array([quality.repeats((texts[i] or "").encode()).astype("<i4").tobytes() for i in order], pa.binary()), vectors, dtype)
    for i, x in zip(order, got):
        words = quality.drawn_vectors(quality.word_ids((texts[i] or "").encode())).astype(int)
        mean = vectors[ids[i]].astype(int).sum(axis=0) / quality.STEPS / max(len(ids[i]), 1)
        near = sum((words[j] * words[j + d] for d in (1, 2) for j in range(len(words) - d)), np.zeros(quality.WIDTH)) / max(len(words), 1)
        assert np.allclose(x, np.concatenate((mean, near)))


def test_quality_with_clashing_columns(spark):
    rows = [(i, "good plain words in a row here " * 5 if i % 2 else "$$$ bad ### $$$ " * 9, 7, -i, "own", "x") for i in range(120)]
    many = spark.createDataFrame(rows, "doc_id long, text string, _id int, _y int, score string, `a b` string")
    labels = many.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit("clash").alias("text"), F.lit(1).alias("_id"))
    kept = quality.accepted(many, labels)
    assert kept.columns == many.columns and kept.schema["score"].dataType.simpleString() == "string"
    assert {r.doc_id for r in kept.collect()} == set(range(1, 120, 2)) and {r.score for r in kept.collect()} == {"own"}
    got = quality.score(many, labels).collect()
    assert len(got) == 120 and all(r._id == 7 and r._y == -r.doc_id and isinstance(r.score, float) for r in got)


def shingles(text, k=5):
    w = (text or "").split()
    return {tuple(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)} if w else set()


def smallest_of_copies(rows, similarity=0.8):
    """Ids that stay when every pair of texts is compared."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if (rows[i][1] or "") == (rows[j][1] or "") or both and both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
            root[top(i)] = top(j)
    return sorted({top(i): min(r[0] for k, r in enumerate(rows) if top(k) == top(i)) for i in range(len(rows))}.values())


def test_near_copies_equal_brute_force_around_the_limit(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5_000, 150)]
        rows.append(" ".join(base))
        for edits in (1, 2, 3, 4, 5):
            copy = list(base)
            for at in rng.choice(150, edits, replace=False):
                copy[at] = f"x{at}"
            rows.append(" ".join(copy))
    rows = [(i, t) for i, t in zip(rng.permutation(len(rows)).tolist(), rows)]
    sets = [shingles(t) for _, t in rows]
    alike = [len(a & b) / len(a | b) for a, b in itertools.combinations(sets, 2)]
    assert sum(0.75 <= x < 0.8 for x in alike) > 5 and sum(0.8 <= x < 0.85 for x in alike) > 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(df).collect()) == smallest_of_copies(rows)
    banded = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert sorted(set(banded.values())) == smallest_of_copies(rows) and sorted(banded) == sorted(i for i, _ in rows)


def test_banded_copies_of_odd_rows(spark, docs, none):
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got >= {(1, 1), (4, 1), (2, 2), (3, 2), (5, 5), (6, 6), (None, None)}
    assert minhash.near_duplicates(docs).count() == len(ROWS) and minhash.near_duplicates(none).count() == 0


def test_hashes_of_long_texts(monkeypatch):
    from haplomill.llm import common

    text = " ".join(f"w{i * i % 977}" for i in range(3000)).encode() + b"x" * 5000 + b" end"
    whole = common.word_hashes(text)
    monkeypatch.setattr(common, "STRETCH", 700)
    assert (common.word_hashes(text) == whole).all() and (quality.word_ids(text) == quality.word_ids(text)).all() and len(whole) == 3001


def test_pipeline_stages_equal_brute_force(spark):
    import corpus_pipeline as pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {}
    for name, stage in pipeline.STAGES:
        got[name] = docs = cut(stage(spark, docs, sf_dir), "stage")
    clean, lines, alone = ({r.doc_id: r for r in got[n].collect()} for n in [n for n, _ in pipeline.STAGES][:3])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    known = [(i in clean, q) for i, q in labels.items() if q is not None]
    assert sum(a == bool(q) for a, q in known) >= 0.9 * len(known)
    total, on = {}, {}
    for r in clean.values():
        total[r.source] = total.get(r.source, 0) + 1
        for x in set((r.text or "").split("\n")) - {""}:
            on[r.source, x] = on.get((r.source, x), 0) + 1
    bad = {k for k, n in on.items() if n >= line_dedup.LEAST_PAGES and n > total[k[0]] * line_dedup.RATIO}
    want = {i: None if r.text is None else "\n".join(x for x in r.text.split("\n") if (r.source, x) not in bad) for i, r in clean.items()}
    assert {i: r.text for i, r in lines.items()} == want
    assert sorted(alone) == smallest_of_copies([(i, r.text) for i, r in lines.items()])
    assert {r.doc_id for r in got["packing"].select("doc_id").distinct().collect()} == set(alone)
    whole = pipeline.run(spark, sf_dir)
    assert sorted(r[:8] for r in whole.drop("ids").collect()) == sorted(r[:8] for r in got["packing"].drop("ids").collect())


def test_pipeline_stages_on_odd_tables(spark, docs, none):
    import corpus_pipeline as pipeline

    clash = docs.withColumns({c: F.lit("own") for c in ("_id", "_y", "node", "keep", "_bad", "_host", "n_lines", "row", "a b")})
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, clash, "/root/testdata/sf0.001")
        assert kept.columns == clash.columns and {r.node + r.keep + r._id for r in kept.collect()} <= {"ownownown"}, name
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0
    assert pipeline.STAGES[-1][1](spark, clash, "").agg(F.sum("length")).first()[0] > 40_000
