"""The training-data operators against brute force, and on odd input: nulls, empties, ties, repeats, clashing columns."""

import hashlib
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.llm import components, decontaminate, mixing, near_copies, quality_rules, sharding, simhash, substring_dedup, suffix_array, token_counts, toxicity, warc

from veldt.llm.winnow import Words, gram_hashes, seeds_in

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _size int, fp int, _key string"


def documents(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", len(t or ""), k, k, "x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def odd_texts(seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 40)}" for _ in range(260)]
    out = ["a " * 400, "b c " * 200, " ".join(base), " ".join([*base[40:120], "x", *base[200:240]]), None, "", " \t\n", "x", " ".join(base[:36]), " ".join(base[100:160] * 2)]
    out += [" ".join([*rng.choices("uvwq", k=5), *base[10 : 46 + rng.randint(-3, 20)], *rng.choices("uvwq", k=7)]) for _ in range(60)]
    out += [" ".join(rng.choices("pq", k=rng.randint(0, 90))) for _ in range(25)]
    return [*out, out[2], out[3], "é" * 150]


def repeated(tokens, span):
    """Which tokens of each sequence lie in a window that also starts elsewhere."""
    count = Counter(tuple(t[i : i + span]) if not isinstance(t, bytes) else t[i : i + span] for t in tokens for i in range(len(t) - span + 1))
    out = []
    for t in tokens:
        cover = [False] * len(t)
        for i in range(len(t) - span + 1):
            if count[tuple(t[i : i + span]) if not isinstance(t, bytes) else t[i : i + span]] > 1:
                cover[i : i + span] = [True] * span
        out.append(cover)
    return out


# ---- 1 mixing ------------------------------------------------------------------------


def water_fill(sizes, weights, budget, cap):
    got, fixed = {}, set()
    while True:
        left = budget - sum(cap * sizes[s] for s in fixed)
        free = [s for s in sizes if s not in fixed]
        total = sum(weights[s] for s in free)
        got = {s: left * weights[s] / total for s in free} if total else {}
        over = {s for s in free if got[s] > cap * sizes[s]}
        if not over:
            return got | {s: float(cap * sizes[s]) for s in fixed}
        fixed |= over


def test_mixing_hits_its_targets(spark):
    rng = random.Random(4)
    texts = [" ".join(["w"] * rng.choice([0, 1, 5, 30, 200])) for _ in range(300)]
    d = documents(spark, texts)
    rows = mixing.plan(d).collect()
    assert len(rows) == 300 and mixing.plan(d).exceptAll(mixing.plan(d)).count() == 0
    source = {r["doc_id"]: r["source"] for r in d.collect()}
    sizes = Counter()
    taken = Counter()
    target = {}
    for r in rows:
        assert r["size"] == len((texts[r["doc_id"]]).split()) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 1


def test_mixture_is_what_the_plan_says(spark):
    d = documents(spark, [" ".join(f"w{i}" for i in range(n)) for n in (3, 40, 7, 0, 90, 12, 55)])
    plan = {r["doc_id"]: r["taken"] for r in mixing.plan(d).collect()}
    out = mixing.materialise(d)
    assert out.columns == d.columns
    got = Counter()
    for r in out.collect():
        got[r["doc_id"]] += len(r["text"].split())
    assert {k: v for k, v in plan.items() if v} == dict(got)


# ---- 2 and 3 repeats -----------------------------------------------------------------


@pytest.mark.parametrize("crowd", [1024, 8, 1])
def test_suffix_array_dedup_matches_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_array, "CROWD", crowd)
    texts = odd_texts()
    raw = [(t or "").encode() for t in texts]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_array.dedup(documents(spark, texts)).collect()}
    for i, cover in enumerate(repeated(raw, 200)):
        kept = bytes(b for b, c in zip(raw[i], cover, strict=True) if not c)
        spans = sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover))
        assert got[i] == (len(raw[i]), sum(cover), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("crowd", [1024, 8, 1])
def test_substring_dedup_matches_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    texts = odd_texts()
    words = [(t or "").encode().split() for t in texts]
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.dedup(documents(spark, texts)).collect()}
    for i, cover in enumerate(repeated(words, 35)):
        kept = b" ".join(w for w, c in zip(words[i], cover, strict=True) if not c)
        assert got[i] == (len(words[i]), sum(cover), hashlib.sha256(kept).hexdigest())


def test_many_seeds_at_once_find_what_pairs_find():
    rng = random.Random(12)
    unit = Words(35, 12)
    for _ in range(40):
        core = rng.choices("abc", k=12)
        texts = [[*rng.choices("xy", k=rng.randint(0, 3)), *["q"] * rng.randint(0, 20), *core, *["r"] * rng.randint(0, 20), *rng.choices("xy", k=rng.randint(0, 3))] for _ in range(30)]
        contents = [" ".join(t).encode() for t in texts if len(t) >= 35]
        anchor = int(gram_hashes(unit.parse(" ".join(core).encode())[0], 12)[0])
        seeds = [seeds_in(c, anchor, unit).tolist() for c in contents]
        counts = [1] * len(contents)
        assert substring_dedup.solve(contents, counts, seeds, unit, few=0) == substring_dedup.solve(contents, counts, seeds, unit, few=10_000)


@pytest.mark.parametrize("dedup, span", [(suffix_array.dedup, 200), (substring_dedup.dedup, 35)])
def test_repeats_of_odd_rows(spark, dedup, span):
    """Null ids, identical rows, an empty table, and a text of one short period whose pieces stay small."""
    text = " ".join(f"w{i}" for i in range(300))
    rows = documents(spark, [text, text, None, text[:703], "other"], [None, None, None, 4, 5])
    got = Counter(tuple(r)[:3] for r in dedup(rows.union(rows.where("doc_id = 5"))).collect())
    size = len if span == 200 else lambda t: len(t.split())
    part = size(text[:703]) - (span == 35)  # the last word is cut, so it differs
    assert got == Counter({(None, size(text), size(text)): 2, (None, 0, 0): 1, (4, size(text[:703]), part): 1, (5, size("other"), 0): 2})
    assert dedup(rows.limit(0)).count() == 0
    long = documents(spark, ["ab " * 400_000, "abc " * 100_000 + "end"])
    assert [tuple(r)[1:3] for r in dedup(long).orderBy("doc_id").collect()] == ([(1_200_000, 1_200_000), (400_003, 400_000)] if span == 200 else [(400_000, 400_000), (100_001, 100_000)])


def test_suffix_array_sorts():
    rng = random.Random(3)
    for _ in range(1500):
        s = [rng.randint(0, rng.randint(1, 4)) for _ in range(rng.randint(0, 40))]
        assert suffix_array.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    for s in ([1] * 500, [1, 2] * 300, [2, 1] * 300):
        assert suffix_array.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


# ---- 4 archives ----------------------------------------------------------------------


def test_archives_round_trip(spark):
    pages = [(1, "http://a\r\nb", "x"), (2, None, None), (3, "u", ""), (None, "u", "x"), (5, "ü", "x"), (5, "ü", "x"), (9, "", "é" * 200_000), (None, None, "zz")]
    d = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload int")
    folder, n = warc.write_archives(d)
    rows = warc.read_archives(spark, folder, payloads=True).collect()
    assert n == len(rows) == len(pages)
    assert Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows) == Counter(
        [(1, 1, "response", None), (2, 0, "response", None), (3, 0, "revisit", 2), (None, 1, "revisit", 1), (5, 1, "revisit", 1), (5, 1, "revisit", 1), (9, 400_000, "response", None), (None, 2, "response", None)]
    )
    assert all(warc.digest(bytes(r["payload"])) == r["payload_digest"] for r in rows if r["record_type"] == "response")
    folder, n = warc.write_archives(d.limit(0))
    assert n == 0 and warc.read_archives(spark, folder).count() == 0


def test_broken_archives_are_refused():
    import io

    import zstandard

    good = warc.record(7, "u", b"abc", None, False, warc.digest(b"abc"), "2024-01-01T00:00:00Z")
    assert warc.read_record(good)[:2] == (7, 3)
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"Content-Length: 3\r\n", b"Content-Length: 4\r\n"), good.replace(b"abc", b"abd"), good.replace(b"WARC-Date", b"WARC-Time")):
        with pytest.raises(warc.WarcError):
            warc.read_record(bad)
    zdict = b"dictionary of some bytes"
    head = struct.pack("<II", warc.DICT_MAGIC, len(zdict)) + zdict
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(zdict)).compress(good)
    assert list(warc.frames(io.BytesIO(head + frame + frame))) == [good, good]
    for bad in (b"", frame, head[:12], head + frame[:-3], head + b"junk"):
        with pytest.raises(warc.WarcError):
            list(warc.frames(io.BytesIO(bad)))


def test_archives_of_other_writers_are_read():
    import io

    import zstandard

    def made(*fields, block=b"", version=b"WARC/1.0"):
        return version + b"\r\n" + b"".join(f + b"\r\n" for f in (*fields, b"content-length: %d" % len(block))) + b"\r\n" + block + b"\r\n\r\n"

    ids = (b"warc-record-id: <urn:uuid:b92e8444-34cf-472f-a86e-07b7845ecc05>", b"WARC-DATE: 2016-09-19T17:20:24Z")
    info = made(b"WARC-Type: warcinfo", *ids, block=b"software: some")
    plain = made(b"Warc-Type: response", *ids, b"Content-Type: application/http;", b" msgtype=response", block=b"HTTP/1.0 200 OK\r\nServer \xff\r\n\r\nabc")
    again = made(b"warc-type: revisit", *ids, b"warc-profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", b"content-type: application/http", block=b"HTTP/1.1 200 OK\r\n\r\n")
    assert warc.read_record(info) is None
    assert warc.read_record(plain) == (None, 3, warc.digest(b"abc"), "response", None, b"abc")
    assert warc.read_record(again) == (None, None, None, "revisit", None, None)
    zip_ = zstandard.ZstdCompressor()
    skip = struct.pack("<II", 0x184D2A51, 4) + b"meta"
    assert list(warc.frames(io.BytesIO(zip_.compress(info) + skip + zip_.compress(plain)))) == [info, plain]
    for bad in (made(b"warc-type: response", *ids, b"Content-Length: 0"), made(b"warc-type: \xff", *ids), made(b"warc-type: response", *ids, version=b"WARC/2.0"), made(b"warc-type: response", *ids, b"content-type: application/http", block=b"none")):
        with pytest.raises(warc.WarcError):
            warc.read_record(bad)


# ---- 5 toxicity ----------------------------------------------------------------------


def test_fit_is_what_dense_matrices_give():
    """The model by an independent, dense computation: every gradient in full, n-gram vectors and outputs together."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps"], k=rng.randint(1, 9))) for _ in range(40)]
    labels = [int("delta" in t) for t in texts]
    buckets, dim, batch, rate, decay = 64, 3, 16, 0.05, 1e-3
    got = toxicity.fit(texts, labels, 0.3, buckets=buckets, dim=dim, epochs=200, batch=batch, rate=rate, decay=decay, seed=4)
    x = np.zeros((len(texts), buckets))
    for i, t in enumerate(texts):
        for w in t.split():
            g = toxicity.grams(w, buckets)
            for b in g:
                x[i, b] += 1 / len(g) / len(t.split())
    y = np.eye(2)[labels]
    weight = np.where(y[:, 1] > 0, 0.3 / y[:, 1].mean(), 0.7 / y[:, 0].mean())
    r = np.random.default_rng(4)
    p = [r.uniform(-1 / dim, 1 / dim, (buckets, dim)), r.normal(0, 0.5, (dim, 2)), np.array([0, np.log(0.3 / 0.7)])]
    m, v, step = [0 * q for q in p], [0 * q for q in p], 0
    for epoch in range(200):
        order = r.permutation(len(y))
        for at in range(0, len(y), batch):
            k = order[at : at + batch]
            z = np.exp(x[k] @ p[0] @ p[1] + p[2])
            e = (z / z.sum(1, keepdims=True) - y[k]) * weight[k, None] / len(k)
            grad = [x[k].T @ e @ p[1].T + decay * p[0], (x[k] @ p[0]).T @ e, e.sum(0)]
            step += 1
            for j, g in enumerate(grad):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g**2
                p[j] = p[j] - rate * (1 - epoch / 200) * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-9)
    model = toxicity.Model(p[0] @ (p[1][:, 1] - p[1][:, 0]), p[2][1] - p[2][0])
    want = 1 / (1 + np.exp(-(x @ model.pull + model.bias)))
    assert np.abs(np.array([toxicity.score(t, got, {}) for t in texts]) - want).max() < 0.02


def test_toxicity_learns_misspellings(spark):
    rng = random.Random(8)
    plain = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(400)]
    bad = ["worthless", "pathetic", "moronic"]

    def text(toxic, words):
        w = rng.choices(plain, k=60)
        for _ in range(3 * toxic):
            w[rng.randrange(60)] = rng.choice(words)
        return " ".join(w)

    rows = [(i, text(i % 3 == 0, bad), int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, 9) for i, t, _ in rows], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (10**9, 0), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    new = [(0, text(1, ["worthlless", "patheticc", "moronnic"]), 1) for _ in range(40)] + [(0, text(0, bad), 0) for _ in range(40)]
    scores = [(toxicity.score(t, model, {}), y) for _, t, y in new]
    above = [a > b for a, y in scores if y for b, z in scores if not z]
    assert sum(above) / len(above) > 0.9  # area under the curve, on words never seen
    assert sum((a >= 0.5) == bool(y) for a, y in scores) >= 64
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (4, "idiot " * 5000)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in toxicity.classify(odd, model).collect()}
    assert len(out) == 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    assert out[1]["score"] == out[2]["score"]
    none = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.classify(odd, none).collect()} == {0.0}


# ---- 6 token counts ------------------------------------------------------------------


def test_token_trees_follow_edits():
    enc = token_counts.Encoder(token_counts.TOKENIZER)
    rng = random.Random(5)
    parts = ["'", "r", "e", " ", "  ", "\n", "a", "bc", "1", "!", "é", "　", "'re", "ll", "\t", "x y", "🙂"]
    for n in range(400):
        tree = token_counts.TokenTree("".join(rng.choices(parts, k=rng.randint(0, 400 if n % 10 == 0 else 30))), enc)
        for _ in range(5):
            tree.edit(rng.randint(0, len(tree.text) + 1), rng.choice([0, 1, 2, 5, 50]), "".join(rng.choices(parts, k=rng.choice([0, 1, 3, 8]))))
            assert [m for leaf in tree.leaves for m, _ in leaf] == [len(p) for p in enc.cut.findall(tree.text)]
            assert tree.total == enc.whole(tree.text) and tree.chars[1] == len(tree.text)


def test_counts_as_a_table(spark):
    texts = ["the cat sat on the mat " * 50, None, "", "x"]
    d = documents(spark, texts)
    enc = token_counts.Encoder(token_counts.TOKENIZER)
    rows = {r["doc_id"]: r for r in token_counts.count(d, token_counts.seeded_edits(F.col("doc_id"), F.col("text"))).collect()}
    assert {i: r["n_tokens"] for i, r in rows.items()} == {i: enc.whole(t or "") for i, t in enumerate(texts)}
    assert rows[0]["n_reencoded"] < 30 < rows[0]["n_pieces"]
    none = token_counts.count(d, F.lit(None).cast("array<struct<pos:int,n:int,text:string>>"))
    assert all(r["n_tokens"] == r["n_tokens_edited"] for r in none.collect())


# ---- 7 sharding ----------------------------------------------------------------------


@pytest.mark.parametrize("texts", [[f"t{i} " * (i % 50 + 1) for i in range(700)], ["same"] * 500 + [f"t{i}" * 9 for i in range(200)] + [None, ""]])
def test_shards_are_even_and_gapless(spark, texts):
    d = documents(spark, texts)
    rows = sharding.shard(d, 8).collect()
    assert len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
        assert abs(sum(r["size"] for r in rs) - total / 8) <= 2 * largest
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["text_crc32"] // (2**32 // 4096) for r in ordered] == sorted(r["text_crc32"] // (2**32 // 4096) for r in rows)


def test_groups_stay_whole(spark):
    """Only a group of more than 4 % of a shard may be cut, and sizes stay near."""
    rng = random.Random(8)
    texts = [rng.randbytes(rng.randint(1, 300)).hex() for _ in range(400)]
    rows = sharding.shard(documents(spark, texts * 5), 8).collect()
    size, shards = Counter(), defaultdict(set)
    for r in rows:
        size[r["text_crc32"]] += r["size"]
        shards[r["text_crc32"]].add(r["shard"])
    each = sum(size.values()) / 8
    assert all(len(s) == 1 for c, s in shards.items() if size[c] <= 0.04 * each)
    of = Counter()
    for r in rows:
        of[r["shard"]] += r["size"]
    assert max(abs(x - each) for x in of.values()) <= 0.04 * each
    one = sharding.shard(documents(spark, ["the same"] * 800), 8).collect()  # one group of all: cut
    assert max(Counter(r["shard"] for r in one).values()) <= 101


def test_sharding_keeps_columns_and_takes_empty_tables(spark):
    d = documents(spark, ["a", None, "b", "b"], [1, None, 2, 2])
    out = sharding.shard(d, 2, carry=True)
    assert set(d.columns) <= set(out.columns) and out.count() == 4
    assert sharding.shard(d.limit(0), 8).count() == 0


# ---- 8 near duplicates ---------------------------------------------------------------


def test_index_links_what_brute_force_links(spark):
    rng = np.random.default_rng(0)
    base = np.uint64(0xF0F0123456789ABC)
    cloud = [int(base) ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (300, 3))]
    fps = np.unique(np.array([*cloud, *rng.integers(0, 2**64, 300, dtype=np.uint64)], dtype=np.uint64))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    want = np.arange(len(fps))
    while not np.array_equal(want, n := np.where(near, want[None, :], len(fps)).min(1)):
        want = n
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    for most in (2048, 16, 4):
        up = list(range(len(fps)))

        def root(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for r in simhash.links(table, 2, most).collect():
            up[root(at[r["a"]])] = root(at[r["b"]])
        groups = lambda lab: sorted(sorted(np.flatnonzero(lab == c).tolist()) for c in set(lab.tolist()))
        assert groups(np.array([root(i) for i in range(len(fps))])) == groups(want)


def test_fingerprints_match_an_independent_majority(spark):
    """Spark's own xxhash64 is XXH64 with seed 42; bits are counted one by one."""
    rng = random.Random(17)
    texts = ["Ab  c\td e", "one", "one TWO", None, "É ß É ß É", " ".join(rng.choices(["a", "B", "c", "ü"], k=400))]
    got = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(documents(spark, texts)).collect()}
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
    for i, t in enumerate(texts):
        w = low(t)
        grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hashes = [r[0] % 2**64 for r in spark.createDataFrame([(g,) for g in grams], "g string").select(F.xxhash64("g")).collect()]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[i] % 2**64 == want


def test_classes_and_survivors(spark):
    texts = ["A b c d", "a B c d", "a b c d e f g", None, "", " ", "Zz", "a b c d"]
    ids = [5, 3, 7, 11, 10, None, 20, 3]
    d = documents(spark, texts, ids)
    rows = simhash.classes(d).collect()
    fp = {t: simhash.fingerprint(t) for t in texts}
    assert len(rows) == len(texts)
    assert fp[None] == fp[""] == fp[" "] == 0 and fp["A b c d"] == fp["a B c d"]
    comp = {(r["doc_id"], r["fp"]): r["component_id"] for r in rows}
    assert {v for (i, _), v in comp.items() if i in (5, 3)} == {3}
    assert {v for (i, _), v in comp.items() if i in (10, 11, None)} == {10}
    kept = near_copies.keep_one(d)
    assert kept.columns == d.columns
    assert kept.count() == len(set(comp.values()))
    assert near_copies.keep_one(documents(spark, ["q w e"] * 6, [1] * 6)).count() == 1
    assert simhash.classes(d.limit(0)).count() == 0


def test_components_of_hot_stars_among_pairs(spark):
    """Two star centres hold most ends of edges, thousands of pairs the rest; a few ties join them."""
    rng = random.Random(12)
    e = [(5000, i) for i in range(6000, 9000)] + [(20, i) for i in range(9000, 10500)]
    e += [(20000 + 2 * i, 20001 + 2 * i) for i in range(3000)]
    e += [(rng.choice(range(20000, 26000)), rng.choice(range(6000, 10500))) for _ in range(30)]
    root = {v: v for pair in e for v in pair}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in e:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {v: find(v) for v in root if find(v) != v}


def test_components_of_a_chain_and_a_star(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}}


# ---- 9 decontamination ---------------------------------------------------------------


def test_leaks_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choices("abcdefghijklmno", k=rng.randint(3, 8))) for _ in range(3000)] + ["the", "of", "and"] * 200
    say = lambda n: rng.choices(vocab, k=n)
    items = [(i, " ".join(say(rng.randint(16, 70))) + ". " + " ".join(say(8)) + ".") for i in range(40)]
    docs, leaked = [], set()
    for i, text in items:
        w = text.split()
        for kind in range(2):
            told = [f"new{rng.randint(0, 9999)}" if kind and rng.random() < 0.15 else x for x in w]
            pad = say(200)
            at = rng.randint(0, 200)
            docs.append((1000 + 2 * i + kind, " ".join(pad[:at] + told + pad[at:])))
            leaked.add((1000 + 2 * i + kind, i))
    docs += [(i, " ".join(say(250))) for i in range(200)] + [(500, None), (501, ""), (None, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b).collect()}
    verbatim = {(x, i) for x, i in leaked if x % 2 == 0}
    assert verbatim <= found <= leaked and len(found) >= 0.9 * len(leaked)
    kept = {r["doc_id"] for r in decontaminate.drop_leaks(d, b).collect()}
    assert kept == {x for x, _ in docs} - {x for x, _ in found}
    assert decontaminate.leaks(d.limit(0), b).count() == 0
    assert decontaminate.leaks(d, b.limit(0)).count() == 0


def test_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = rng.choices(range(5), k=rng.randint(1, 12)), rng.choices(range(5), k=rng.randint(0, 12))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(decontaminate.places(a), len(a), b) == t[-1][-1]


# ---- 10 quality rules ----------------------------------------------------------------


def measured(text):
    w = (text or "").encode().split()
    w = [x.decode() for x in w]
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_counts_match_brute_force(spark):
    texts = [*odd_texts(), "a\nb\na\n \n\n", "### the of | and", "the cat of the hat " + "is a good one " * 3 + "\n" + " ".join(f"v{i} the" for i in range(60)), "x y z"]
    d = documents(spark, texts).select("doc_id", quality_rules.metrics(F.col("text")).alias("m"))
    for r in d.collect():
        m = r["m"]
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == measured(texts[r["doc_id"]])
    kept = quality_rules.apply(documents(spark, texts))
    assert kept.columns == documents(spark, texts).columns
    assert len(texts) - 2 in {r["doc_id"] for r in kept.collect()}
    assert quality_rules.apply(documents(spark, texts).limit(0)).count() == 0
