"""The ten operators on small fixtures against brute force, with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import html
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import brown_lm, chat, components, decontam, fingerprint, html_wrap, jaccard_join, mixing, pii, pii_model, quality, tokens, url_trust

WORD = r"[^\x20\x09-\x0D]+"
fold = lambda t: (t or "").translate({i: i + 32 for i in range(65, 91)})
words = lambda t: re.findall(WORD, fold(t))
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def corpus():
    r = random.Random(3)
    vocab = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    base = [[r.choice(vocab) for _ in range(60)] for _ in range(6)]
    docs = []
    for k, b in enumerate(base):
        for c in range(12):
            t = list(b)
            for _ in range(c % 5):
                t[r.randrange(60)] = r.choice(vocab)
            docs.append(" ".join(t))
    docs += [docs[0]] * 40 + [docs[0].upper()] + [None, "", " \n ", "one", "ONE", "one two three", LONG, LONG + " end", "é ü ñ " * 8]
    return [(i * 3 + 1, t, "src0" if i % 3 else None, "en") for i, t in enumerate(docs)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    rows.append((rows[5][0], rows[5][1], "src1", "en"))  # a repeated id
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


def brute_components(rows):
    s = {i: shingles(t) for i, t in rows}
    ids = sorted(s)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if s[a] and s[b] and 4 * len(s[a] & s[b]) >= 3 * len(s[a] | s[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in ids}


def test_jaccard_join(spark, docs):
    want = brute_components([(r[0], r[1]) for r in corpus()])
    got = jaccard_join.near_groups(docs.withColumn("n", F.lit(1)).withColumn("c", F.lit("x"))).collect()
    assert len(got) == docs.count() and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
    assert jaccard_join.near_groups(empty(spark)).count() == 0


def test_jaccard_join_tiles_and_large_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 4)
    want = brute_components([(r[0], r[1]) for r in corpus()])
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in jaccard_join.near_groups(docs).collect())


@pytest.mark.parametrize("tile", [4, 4096])
def test_jaccard_join_counts_every_link(spark, docs, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    links = Counter(sum(bool(s) and 4 * len(s & t) >= 3 * len(s | t) for t_, (_, t) in enumerate(rows) if t_ != k) * 10_000 + i for k, (i, s) in enumerate(rows))
    got = jaccard_join.near_groups(docs, links=True)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    got = got.collect()
    want = brute_components([(r[0], r[1]) for r in corpus()])
    assert Counter(r.n_links * 10_000 + r.doc_id for r in got) == links and max(r.n_links for r in got) > 40
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)


def test_large_blocks_through_the_tree():
    rng = np.random.default_rng(0)
    pts = rng.integers(0, 4, (300, jaccard_join.COARSE))
    pts[150:] = np.maximum(pts[:150] - (rng.random((150, jaccard_join.COARSE)) < 0.05), 0)
    n = pts.sum(1)
    tree = jaccard_join.CountTree(pts, n)
    for q in range(0, 300, 7):
        over = np.minimum(pts, pts[q]).sum(1)
        want = np.flatnonzero((7 * over >= 3 * (n + n[q])) & (4 * np.minimum(n, n[q]) >= 3 * np.maximum(n, n[q])))
        assert sorted(tree.search(pts[q], int(n[q]))) == want.tolist()


def test_members_out_of_reach_are_never_compared(monkeypatch):
    """A frequent passage makes up 60 of 71 shingles and comes last in their order: too late for any partner."""
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([f"d{k}w{i}" for i in range(15)] + passage) for k in range(40)]  # 56 common shingles of 71
    texts += [" ".join(passage[:50] + [f"e{k}"] * (k % 3)) for k in range(40)]  # these link
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    data, offs = tokens.buffer(batch.column(0))
    folded, s, e, doc = tokens.words(data, offs)
    h, _ = tokens.shingles(tokens.hashes(folded, s, e), doc, len(texts), 5)
    u, c = np.unique(h >> np.uint64(12), return_counts=True)
    frequent = u[c > 12]
    packed = list(jaccard_join._prefixes("text", 1, frequent, np.arange(len(frequent)))([batch]))
    large = [x for b in jaccard_join._blocks(packed) for x in b.to_pylist() if x["h"] is not None]
    assert not [x for x in large if x["na"] == 71] and [x for x in large if x["na"] < 60]
    n, reach = np.array([71] * 40), np.array([70] * 40)
    asked = []
    monkeypatch.setattr(jaccard_join.CountTree, "search", lambda *a: asked.append(a) or np.zeros(0, int))
    x = {"data": [bytes(jaccard_join.COARSE)] * 40, "m": reach}
    assert not list(jaccard_join._joined(x, n, np.zeros(40, int), False)) and not asked


@pytest.mark.parametrize("across", [False, True])
def test_a_family_of_copies_needs_no_look_at_all_pairs(monkeypatch, across):
    """300 sets near one of two, and some in between: the components of brute force, and few bounds."""
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 2**40, 120, dtype=np.uint64)) for _ in range(2)]
    sets = [np.unique(np.append(rng.permutation(base[k % 2])[rng.integers(0, 9) :], rng.integers(0, 2**40, rng.integers(0, 9), dtype=np.uint64))) for k in range(300)]
    sets += [np.unique(rng.integers(0, 2**40, 120, dtype=np.uint64)) for _ in range(20)]
    n, slot = np.array([len(s) for s in sets]), rng.integers(0, 2, len(sets))
    looks, gain = [], jaccard_join._gain
    monkeypatch.setattr(jaccard_join, "_gain", lambda pts, n, i, rest: looks.append(len(rest)) or gain(pts, n, i, rest))
    data = [np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes() for s in sets]
    edges = list(jaccard_join._settled({"data": data}, n, slot, across))
    assert sum(looks) < 10 * len(sets)

    def parts(edges):
        roots = jaccard_join._Roots(len(sets))
        for i, j in edges:
            roots.join(i, j)
        got = {}
        for i in range(len(sets)):
            got.setdefault(roots.find(i), set()).add(i)
        return {frozenset(x) for x in got.values()}

    pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if (not across or slot[i] != slot[j]) and jaccard_join._link(sets[i], sets[j])]
    assert all(jaccard_join._link(sets[i], sets[j]) for i, j in edges) and parts(edges) == parts(pairs) and len(parts(pairs)) == 22


@pytest.mark.parametrize("tile", [16, 4096])
def test_shared_passages_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    r = random.Random(8)
    passages = [[f"p{k}x{i}" for i in range(r.randrange(10, 60))] for k in range(4)]
    texts = []
    for k in range(240):
        t = [*r.choice(passages)] + ([*r.choice(passages)] if k % 3 == 0 else []) + [f"o{k % 60}w{i}" for i in range(r.randrange(0, 25))]
        texts.append(" ".join(t[r.randrange(0, 4) :]))
    rows = [(r.randrange(10**6) * 1000 + i, t) for i, t in enumerate(texts)]
    want = brute_components(rows)
    got = jaccard_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len({c for _, c in want.values()}) > 20


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.label for r in components.components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_word_hashes():
    import pyarrow as pa

    texts = ["a bb a", None, "", LONG, "Ab aB", "x" * (tokens.CHUNK + 10) + " " + "x" * (tokens.CHUNK + 10)]
    data, offs = tokens.buffer(pa.array(texts))
    folded, s, e, doc = tokens.words(data, offs)
    h = tokens.hashes(folded, s, e)
    seen = {}
    for a, b, x in zip(s, e, h):
        assert seen.setdefault(bytes(folded[a:b]), x) == x
    assert len(set(seen.values())) == len(seen) and np.bincount(doc, minlength=6).tolist() == [len(words(t)) for t in texts]


def brute_hits(text, items):
    ws = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    w, hit, found = ws(text), set(), set()
    for i, t in items:
        v = ws(t)
        k = min(10, len(v))
        grams = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if v else set()
        for j in range(len(w) - k + 1 if k else 0):
            if tuple(w[j : j + k]) in grams:
                hit.update(range(j, j + k))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [2_000_000, 30])
def test_decontaminate(spark, block):
    r = random.Random(5)
    w = lambda n: " ".join(r.choice("abcdefgh") + r.choice("uvwxyz") for _ in range(n))
    items = [(1, w(30)), (2, w(12)), (3, "short item here"), (4, ""), (5, None), (10, w(10)), (7, "Short, ITEM-here")]
    rows = [(i, f"{w(i)} {items[i % 3][1][: 20 + i * 3]} {w(5)}") for i in range(30)] + [(30, None), (31, ""), (32, "x short item, here y"), (33, items[0][1].upper().replace(" ", ", ")), (34, LONG + " " + items[1][1])]
    d = spark.createDataFrame([(*x, 1, "q") for x in rows], "doc_id long, text string, n_words int, bucket string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(d, b, block_words=block).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for g in got:
        n, h, f = brute_hits(text[g.doc_id], items)
        assert (g.n_words, sum(y - x for x, y in zip(g.hits[::2], g.hits[1::2])), g["items"]) == (n, h, f)
    assert decontam.decontaminate(d, b.limit(0)).filter("size(hits) > 0").count() == 0
    assert decontam.decontaminate(d.limit(0), b).count() == 0


def test_mixing(spark, docs):
    sources = {(r.doc_id, r.source) for r in docs.collect()}
    got = mixing.taken(docs).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(re.findall(WORD, r.text or ""))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] >= 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in full} if full else {s: share * weight[s] for s in free}
        left -= sum(2 * sizes[s] for s in full)
        free = free - full if full else set()
    of = {sizes[s]: s for s in order}
    total = Counter()
    for r in got:
        s = of[r.source_size]
        assert r.size >= 0 and 0 <= r.taken <= 2 * r.size and (r.doc_id, s) in sources and r.target == pytest.approx(target[s])
        assert (r.finish is None) == (r.taken == 0) and (r.finish or 0) < 1 + 1e-2
        total[s] += r.taken
    budget = math.floor(sum(target.values()) + 1e-6)
    assert sum(total.values()) == budget and all(abs(total[s] - target[s]) <= len(order) for s in order)
    m = mixing.mix(docs.withColumn("mix_words", F.lit("user's")).withColumn("src_key", F.lit(7)).withColumn("size", F.lit(8))).collect()
    assert sum(r.mix_words for r in m) == budget and [r.mix_finish for r in m] == sorted(r.mix_finish for r in m) and {(r.src_key, r["size"]) for r in m} == {(7, 8)}
    by = Counter()
    for r in m:
        by[r.source] += r.mix_words
    assert by == total
    assert mixing.taken(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0
    wordless = spark.createDataFrame([(1, None, "a", "en"), (2, " ", None, "en")], docs.schema)
    assert [r.taken for r in mixing.taken(wordless).collect()] == [0, 0] and mixing.mix(wordless).count() == 0


def test_mixing_goes_by_finish_time(spark):
    # a range of one unit of virtual time has every fragment in it: the cut is found by sorting alone, and is the same
    r = random.Random(8)
    rows = [(i, " ".join("w" * r.randrange(1, 200)), f"s{i % 7}" if i % 11 else None, "en") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.taken(d).collect()
    q = mixing.queue(d).select("doc_id", "src_key", "size", "source_size", "target", "before").collect()
    parts = []
    for x in q:
        for k in range(2):
            start = x.before + x.source_size * k
            early = max(0, min(x["size"], math.floor(x.target) - start))
            parts += [(1.0 if early < x["size"] else (start + early) / x.target, x.src_key, start + early, early, x.doc_id)] * (early > 0)
            parts += [((start + x["size"]) / x.target, x.src_key, start + x["size"], x["size"] - early, x.doc_id)] * (early < x["size"])
    left, want = math.floor(sum({x.src_key: x.target for x in q}.values()) + 1e-6), Counter()
    for _, _, _, words_, i in sorted(parts):
        want[i] += min(words_, left)
        left -= min(words_, left)
    assert {x.doc_id: x.taken for x in got} == {i: want[i] for i, *_ in rows}


def test_fingerprint(spark, docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()))
    got = sorted(fingerprint.edited_fingerprints(docs).collect(), key=lambda r: (r.doc_id, r.edited_sha256))
    edited = []
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        edited.append((i, hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()))
    assert [(r.doc_id, r.edited_sha256) for r in got] == sorted(edited)
    by = {}
    text = dict(rows)
    for r in got:
        assert by.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert fingerprint.edited_fingerprints(empty(spark)).count() == 0
    single = fingerprint.edited_fingerprints(spark.createDataFrame([(None, "ab cd")], "doc_id long, text string")).first()
    assert single.near_next == 1.0 and single.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()


def test_fingerprint_estimates_likeness(spark):
    r = random.Random(1)
    base = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    rows = [(base, base[: int(3000 * s)] + [f"v{r.randrange(10**6)}" for _ in range(3000 - int(3000 * s))]) for s in (0.2, 0.5, 0.9)] + [(base[:4], base[:4]), (base[:4], base[:3])]
    d = spark.createDataFrame([(" ".join(a), " ".join(b)) for a, b in rows], "a string, b string")
    d = fingerprint.fingerprint(fingerprint.fingerprint(d, "a", "x"), "b", "y")
    got = d.select("a", "b", fingerprint.likeness(F.col("x.hashes"), F.col("y.hashes")).alias("l"), fingerprint.containment(F.col("y.hashes"), F.col("x.hashes")).alias("c")).collect()
    for g in got:
        a, b = shingles(g.a), shingles(g.b)
        assert abs(g.l - len(a & b) / len(a | b)) < 0.05 and abs(g.c - len(a & b) / len(b)) < 0.07


def test_fingerprint_merges(spark):
    r = random.Random(6)
    word = lambda: r.choice("abcdefgh") + r.choice("mnopq")
    rows = [([word() for _ in range(a)], [word() for _ in range(b)]) for a, b in [(0, 0), (0, 3), (1, 1), (3, 4), (4, 5), (5, 5), (5, 30), (2000, 7), (2000, 40)] + [(r.randrange(12), r.randrange(12)) for _ in range(60)]]
    # a text without the shingles that would join the two: the union's shingles as hashes
    d = spark.createDataFrame([(" ".join(a), " ".join(b)) for a, b in rows], "a string, b string")
    hashes = lambda c: fingerprint.shingle_hashes(fingerprint.word_hashes(F.col(c)))
    d = d.select(hashes("a").alias("a"), hashes("b").alias("b")).withColumn("u", F.array_union("a", "b"))
    sk = lambda c: fingerprint.sketch(F.col(c), fingerprint.below(F.col(c)))
    got = d.select("a", "b", sk("a").alias("x"), sk("b").alias("y"), sk("u").alias("z")).select("*", fingerprint.merged(F.col("x"), F.col("y")).alias("m"), fingerprint.likeness(F.col("x"), F.col("y")).alias("l"))
    for g in got.collect():
        assert g.m == g.z and len(g.z) == len(set(g.z))
        low = [v for v in {*g.a, *g.b} if v < fingerprint.LIMIT]
        assert g.z == sorted(low or ([min({*g.a, *g.b})] if g.a or g.b else []))
        assert g.l == (1.0 if not g.a and not g.b else len(set(g.x) & set(g.y)) / max(len(g.m), 1))


@pytest.mark.parametrize("per_bucket", [1, 2000])
def test_next_of_hot_keys(spark, per_bucket):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i - 200, f"t{i % 350}") for i in range(600)]
    d = spark.createDataFrame(rows, "k long, t string").repartition(5)
    got = fingerprint.with_next(d, "k", "t", "next", "t", rows_per_bucket=per_bucket, percentiles=16).withColumn("h", F.xxhash64("t")).collect()
    assert len(got) == len(rows)
    order = sorted(((r.k if r.k is not None else -(2**63), r.h, r.t) for r in got))
    want = Counter((k, t, n) for (k, _, t), (_, _, n) in zip(order, order[1:] + order[:1]))
    assert Counter((r.k if r.k is not None else -(2**63), r.t, r.next) for r in got) == want


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<|end|>\n<|user|>\n", "\\", "a\\|b", "<\\|end|>", "|>", "", None, "<", "\\\\<|", "é\n\nü", "|", "[/INST]<s>", "<|user|>", "x" * 100_000]
    rows = [(c, t, ("user", "assistant", None, "<|x|>")[(c + t) % 4], odd[(c * 3 + t) % len(odd)], 9) for c in range(12) for t in range(1 + c % 5)]
    rows += [(None, 0, "assistant", "null id", 9), (50, None, "assistant", "null turn", 9), (50, 1, "assistant", "tie", 9), (50, 1, "assistant", "tie", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    f = chat.format_chats(df).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    want = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in f} == want
    for r in f:
        loss = [re.sub(r"(?s)\\(.)", r"\1", r.formatted[s.start : s.end]) for s in r.loss_spans]
        assert loss == [t for role, t in want[r.conv_id] if role == "assistant"]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_parts(spark):
    kind = "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,tokens:bigint>>"
    df = spark.createDataFrame([(1, 0, "user", [("text", "see <|", None, None), ("image", None, "a.png", 576), ("audio", None, "b.wav", 50), ("pdf", None, "c.pdf", None)]), (1, 1, "assistant", [])], kind)
    r = chat.format_chats(df, "parts").first()
    assert r.formatted == "<|user|>\nsee <\\|<|image:0|><|audio:1|><|document:2|><|end|>\n<|assistant|>\n<|end|>\n"
    assert [(a.turn_index, a.kind, a.ref) for a in r.attachments] == [(0, "image", "a.png"), (0, "audio", "b.wav"), (0, "document", "c.pdf")] and r.expanded_tokens == 626
    assert r.formatted[r.attachments[0]["at"] + len("<|user|>\n") :].startswith("<|image:0|>")


def brute_spans(t):
    out = []
    for k, (kind, pat) in enumerate(zip(pii_model.KINDS, (pii.EMAIL, pii.IP, pii.CARD, pii.PHONE))):
        out += [(m.start(), k, m.end()) for m in re.finditer(pat, t) if pii.passes(kind, m.group())]
    return [(a, b, pii_model.KINDS[k]) for a, k, b in sorted(out)]


def test_base_patterns():
    r = random.Random(2)
    parts = ["a@b.co", "@", ".", "_x@y.zz", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (017) 555-7713", " ", "-", "+", "9", "x", "é", "a@b.co_c@d.ef", "1.2.3.4.5.6.7.8", "00012.1.1.1", "\n"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(1, 9)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_tagger_gradient():
    m = pii_model.Tagger()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(0, pii_model.CLASSES, (2, 7)), np.array([[0, 1, 2, 0, 0, 3, 4], [0, 0, 0, 5, 6, 6, 0]])
    _, g = m.step(x, y)
    for k in m.p:
        at = tuple(0 for _ in m.p[k].shape) if k != "wx" else (0, int(x[0, 0]), 3)
        keep = m.p[k][at]
        m.p[k][at] = keep + 1e-2
        up = m.step(x, y)[0]
        m.p[k][at] = keep - 1e-2
        low = m.step(x, y)[0]
        m.p[k][at] = keep
        assert (up - low) / 2e-2 == pytest.approx(g[k][at], abs=3e-3), k


def test_pii(spark):
    tagger = pii_model.fitted()
    x, y = pii_model.labelled_windows(400, seed=77)
    p = tagger.decode(x)
    assert (p == y)[y > 0].mean() > 0.95 and (p == y).mean() > 0.97  # held out
    glued = "Des +1 (826) 555-4081 190.137.223.204 du"
    rows = [(1, None), (2, ""), (3, "mail a.b@c.example.com now"), (4, glued), (5, "no data at all"), (6, "word " * 30_000 + "a@b.co"), (7, 'token = "4111111111111111aa"'), (8, "é x@y.zz é")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    got = {r.doc_id: [(s.start, s.end, s.kind, s.base) for s in r.spans] for r in pii.find(d).collect()}
    text = {i: t or "" for i, t in rows}
    for i, s in got.items():
        assert [x[:3] for x in s if x[3]] == brute_spans(text[i])
    assert (4, 21, "phone", False) in got[4] and (22, 37, "ip", True) in got[4] and got[5] == []
    masked = {r.doc_id: r.text for r in pii.mask(d.drop("spans")).collect()}
    assert masked[3] == "mail <EMAIL> now" and masked[1] is None and masked[4] == "Des <PHONE> <IP> du" and masked[8] == "é <EMAIL> é"
    assert pii.find(d.limit(0)).count() == 0


def test_tagger_finds_what_no_pattern_matches():
    tagger = pii_model.fitted()
    r = random.Random(12)
    prose = "the of le que der und casa ver ing tion sch ment".split()
    say = lambda n: " ".join(r.choice(prose) for _ in range(n))
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card(sep):
        x = d(15)
        x += next(c for c in "0123456789" if pii_model.luhn(x + c))
        return sep.join(x[i : i + 4] for i in range(0, 16, 4))

    make = {
        "email": lambda: f"{r.choice(prose)}.{r.choice(prose)}{r.choice([' [at] ', '(at)', ' @ ', '[at]'])}mail{r.choice([' [dot] ', '.', '[dot]'])}org",
        "ip": lambda: r.choice(["[.]", "(.)"]).join(str(r.randrange(1, 256)) for _ in range(4)), "card": lambda: card(r.choice([".", "/", "  "])), "phone": lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}"]),
    }
    found, texts, spans = Counter(), [], []
    for kind in pii_model.KINDS * 60:
        head, s = say(r.randrange(3, 12)) + " ", make[kind]()
        texts.append(head + s + " " + say(5))
        spans.append((len(head), len(head) + len(s), kind))
    for t, span, tags in zip(texts, spans, pii.tagged_spans(texts, tagger)):
        base = pii.base_spans(t)
        assert span not in base, t
        found[span[2]] += span in pii.added(t, base, tags)
    assert all(found[k] >= 0.85 * 60 for k in pii_model.KINDS), found
    clean = [say(8) + r.choice([" 2024-05-17 10:30 ", " (1998) ", " 12.5.2001 ", " a @ b ", " [see at] ", " 3,141 592 ", " 10:45-11:30 "]) + say(6) for _ in range(200)]
    assert sum(bool(pii.added(t, [], x)) for t, x in zip(clean, pii.tagged_spans(clean, tagger))) <= 2


def test_pii_query_counts_base_spans(spark, tmp_path):
    rows = [(1, "Des +1 (826) 555-4081 190.137.223.204 du"), (2, None), (3, "a@b.co, 1.2.3.4, 4111 1111 1111 1111 or +1 (555) 123-4567 now"), (4, "la casa (826) 555-4081 und casa ver"), (4, "la casa (826) 555-4081 und casa ver")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in pii.op7(spark, str(tmp_path)).collect())
    for i, (doc_id, t) in enumerate(sorted(rows, key=lambda r: (r[0], r[1] or ""))):
        base = brute_spans(t or "")
        sha = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert got[i][:6] == (doc_id, *(sum(k == x[2] for x in base) for k in pii_model.KINDS), sha)
    assert got[0][6] == "phone:4:21,ip:22:37" and got[0][1:5] == (0, 1, 0, 0)  # the phone is an added one


def test_windows_cover():
    for n in (1, 50, 96, 97, 160, 161, 1000):
        decided = [p for _, a, b in pii.windows(10, 10 + n) for p in range(a, b)]
        assert decided == list(range(10, 10 + n))


def test_brown_lm(spark, docs):
    got = brown_lm.score(docs, n_units=30, classes=6).collect()
    toks = [(r.doc_id, words(r.text) + ["</s>"]) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in toks if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((i, held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for i, t in toks)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.perplexity > 1 for r in got)
    assert brown_lm.score(empty(spark)).count() == 0


def test_exchange_raises_likelihood():
    r = np.random.default_rng(1)
    truth = np.arange(42) % 4
    p = np.array([[0.05, 0.9, 0.03, 0.02], [0.02, 0.05, 0.9, 0.03], [0.03, 0.02, 0.05, 0.9], [0.9, 0.03, 0.02, 0.05]])
    counts = r.poisson(p[truth][:, truth] * 20)
    cls = brown_lm.exchange(counts, classes=4)

    def likelihood(k):
        one = np.eye(k.max() + 1)[k]
        b = one.T @ counts @ one
        x = lambda v: (v[v > 0] * np.log(v[v > 0])).sum()
        return x(b) - x(b.sum(0)) - x(b.sum(1))

    start = np.concatenate([np.arange(40) // 10, [4, 5]])
    assert likelihood(cls) > likelihood(start) + 100


def model_tables(model):
    """Counts, classes and unit classes of a model, by word name."""
    rows = {r.w: r for r in model.words.collect()}
    assert all(rows[w].c == c and rows[w][model.column] == k for w, c, k in zip(model.freq.words.tolist(), model.freq.counts.tolist(), model.cls.tolist()))
    return {w: r.c for w, r in rows.items()}, {w: r[model.column] for w, r in rows.items()}


def names(ws):
    import pyarrow as pa

    data, offs = tokens.buffer(pa.array([" ".join(ws)]))
    folded, s, e, _ = tokens.words(data, offs)
    return brown_lm.word_ids(folded, s, e).tolist()


@pytest.mark.parametrize("frequent", [0, 40, 1 << 17])
def test_brown_scores_against_brute_force(spark, docs, monkeypatch, frequent):
    monkeypatch.setattr(brown_lm, "FREQUENT", frequent)
    monkeypatch.setattr(brown_lm, "SLICE", 300)
    monkeypatch.setattr(brown_lm, "WORDS", 64)
    seen = []
    fit = brown_lm.fit
    monkeypatch.setattr(brown_lm, "fit", lambda *x: seen.append(fit(*x)) or seen[-1])
    got = brown_lm.score(docs, n_units=30, classes=6).collect()
    model, _, big = seen[0]
    assert len(model.freq.words) <= frequent
    count, cls = model_tables(model)
    end, start = int(model.unit_cls[-2]), int(model.unit_cls[-1])
    texts = [(r.doc_id, names(words(r.text)) if words(r.text) else []) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    unit = lambda w: int(model.unit_cls[model.units.own + (w & 63)])
    seq = lambda t: [cls.get(w, unit(w)) for w in t] + [end]
    trans, total, types, c = Counter(), Counter(), Counter(), Counter()
    for i, t in texts:
        if not held(i):
            trans.update(zip([start] + seq(t)[:-1], seq(t)))
            c.update([*t, "end"])
    assert {w: n for w, n in c.items() if w != "end"} == count
    for w, n in c.items():
        k = end if w == "end" else cls[w]
        total[k] += n
        types[k] += 1
    left = Counter()
    for (a, _), n in trans.items():
        left[a] += n
    k = len(big)
    want = []
    for i, t in texts:
        s, before = 0.0, start
        for w, now in zip([*t, "end"], seq(t)):
            s += math.log10((trans[before, now] + 0.5) / (left[before] + 0.5 * (k - 1)) * (c[w] + 0.5) / (total[now] + 0.5 * (types[now] + 1)))
            before = now
        want.append((i, round(s, 6)))
    assert sorted((r.doc_id, round(r.score, 6)) for r in got) == sorted(want)


def test_brown_scores_do_not_depend_on_layout(spark, docs):
    rows = [sorted((r.doc_id, round(r.score, 6)) for r in brown_lm.score(docs.repartition(n), n_units=30, classes=6).collect()) for n in (2, 9)]
    assert rows[0] == rows[1]


def test_every_training_word_is_clustered(spark, monkeypatch):
    # words that end alike and are no units have classes of their own, and the counts are those of all training text
    r = random.Random(5)
    a, b = ([f"{c}{i}zz" for i in range(40)] for c in "pq")
    rows = [(5 * i + 2, " ".join(x for _ in range(30) for x in ("le", r.choice(a), "un", "un", r.choice(b)))) for i in range(40)]
    rows = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(brown_lm, "WORDS", 16)
    model, _, big = brown_lm.fit(d, 2, 4)
    _, cls = model_tables(model)
    assert len(cls) == 82 and big.sum() == sum(len(t.split()) + 1 for _, t in rows)
    assert len({cls[w] for w in names(a + b)}) > 1  # their ending's group is one class


def page(body, n=0):
    return f"<!DOCTYPE html><html><head><title>t{n}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>menu{n}</a></li></ul></nav><div class=\"ad\">buy {n}</div>{body}<aside>side</aside><form>name <input></form><div id='comments'><p>nice {n}</p></div><footer>&copy; x</footer></body></html>"


def test_html(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [
        (1, "http://a.example.com/1", page("<article><h1>Title &amp; more</h1><p><b>Lead<br><p>One  two\n three <i>it</i>alic.</p><p>&lt;b&gt; &#233;</p></article>", 1)),
        (2, "http://a.example.com/2", page("<article><h1>Other</h1><p>Only &amp;&amp;&amp; one.</p></article>", 2)),
        (3, "http://b.example.org/1", page("<div class='content'><p>First text of b which is long.</p><p>Second text here.</p></div>", 3)),
        (4, "http://b.example.org/2", page("<div class='content'><p>Another text of b which is long.</p></div>", 4)),
        (5, None, None), (6, "nohost", ""), (7, "http://a.example.com/3", page(f"<article><p>{long}</p></article>")), (8, "http://c.example.net", "plain text only"),
        (9, "http://a.example.com/4", page("<article></article>")),
    ]
    d = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in html_wrap.extract(d).collect()}
    assert got[1] == "Title & more\n\nLead\n\nOne two three italic.\n\n<b> é" and got[2] == "Other\n\nOnly &&& one."
    assert got[3] == "First text of b which is long.\n\nSecond text here." and got[4] == "Another text of b which is long."
    assert got[5] == "" and got[6] == "" and got[7] == long and got[8] == "plain text only" and got[9] == ""
    assert html_wrap.extract(d.limit(0)).count() == 0


def test_html_nested_deep(spark):
    cell = "<table><tbody><tr><td>cell {0}</td></tr></tbody></table><ul><li>item {0}</li></ul>"
    deep = lambda n: "<section>" * 10 + cell.format(n) + "</section>" * 10
    long = "Long text of the page that is most of it, number "
    rows = [(i, f"http://a.example.com/{i}", page(f"<article><p>{long}{i}</p>{deep(i)}</article>", i)) for i in range(3)]
    rows += [(i, f"http://b.example.com/{i}", page(f"<div><div class='content'><p>{long}{i}</p>{deep(i)}</div></div>", i)) for i in range(3, 6)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_wrap.extract(d).collect():
        assert r.text.split("\n\n") == [f"{long}{r.page_id}", f"cell {r.page_id}", f"item {r.page_id}"]


def test_html_pages_of_another_template(spark):
    rows = [(i, f"http://a.example.com/{i}", page(f"<article><p>Article text number {i}</p></article>", i)) for i in range(4)]
    rows.append((4, "http://a.example.com/4", page("<div class='content'><h1>Other head</h1><p>Other template text</p></div>", 4)))
    rows += [(i, f"http://b.example.com/{i}", page(f"<div class='content'><p>{'Long text of a page. ' * 30}{i}</p></div>", i)) for i in range(5, 9)]
    rows.append((9, "http://b.example.com/9", page("<div class='recipe'><p>A short one.</p></div>", 9)))
    rows += [(i, f"http://c.example.com/{i}", page("<div class='content'><h1>Copy</h1><p>One paragraph.</p></div>")) for i in range(10, 15)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_wrap.extract(d).collect()}
    assert got[0] == "Article text number 0" and got[4] == "Other head\n\nOther template text"
    assert got[9] == "A short one." and got[12] == "Copy\n\nOne paragraph."


NEUTRAL = [
    ("<div class='q1'><ul>{links}</ul></div>", False), ("<div class='q2'><p>We keep some small files on your device.</p></div>", False), ("<div class='q3'><h1>Title {i}</h1><p>{text}</p><p>{more}</p></div>", True),
    ("<div class='q4'><p>Short note of day {i}.</p></div>", False), ("<div class='q5'><div class='q6'><p>Reader {i} says hello there.</p></div><div class='q6'><p>Another one, {i} times.</p></div></div>", False), ("<div class='q7'><p>All rights reserved by the makers of this site, whoever they are.</p></div>", False),
]


def neutral_pages(n, host):
    r = random.Random(host)
    out = []
    for i in range(n):
        text, more = (" ".join(r.choice("abcdefgh") * r.randrange(2, 7) for _ in range(40)) for _ in range(2))
        links = "".join(f"<li><a href='/{k}'>entry {r.randrange(1000)} of {host}</a></li>" for k in range(30))
        out.append((f"http://{host}/{i}", "<html><body>" + "".join(p for p, _ in NEUTRAL).format(i=i, text=text, more=more, links=links) + "</body></html>", f"Title {i}\n\n{text}\n\n{more}"))
    return out


@pytest.mark.parametrize("shipped", [0, 1 << 25])
def test_html_neutral_names_need_alignment(spark, monkeypatch, shipped):
    monkeypatch.setattr(html_wrap, "SHIPPED", shipped)
    rows = [(k, *x) for k, x in enumerate(neutral_pages(8, "n1.example.com") + neutral_pages(5, "n2.example.org"))]
    rows += [(100, *rows[0][1:]), (101, *rows[0][1:])]  # repeated pages
    d = spark.createDataFrame([(i, u, h, "clash", "x") for i, u, h, _ in rows], "page_id long, url string, html string, host string, known string").repartition(3)
    got = {r.page_id: r for r in html_wrap.extract(d).collect()}
    assert all(got[i].text == want and got[i].host == "clash" and got[i].known == "x" for i, _, _, want in rows)
    # alone, a page of a few words does not tell its notices from its article
    short = "<html><body><div class='q2'><p>We keep some small files on your device, and so on and on.</p></div><div class='q3'><p>Tiny {}</p></div></body></html>"
    alone = html_wrap.article(html_wrap.blocks(short.format(0)), html_wrap.learned(html_wrap.stream(html_wrap.blocks(short.format(0)))))
    w = html_wrap.stream(html_wrap.blocks(short.format(0)))
    for i in range(1, 4):
        w = html_wrap.align(w, html_wrap.stream(html_wrap.blocks(short.format(i))))
    assert alone != ["Tiny 0"] and html_wrap.article(html_wrap.blocks(short.format(0)), html_wrap.learned(w)) == ["Tiny 0"]


def test_html_against_brute_force(spark):
    # on the driver's pages: blocks of the article element, by the standard library's parser
    from html.parser import HTMLParser

    class Brute(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.buf, self.inside = [], "", False

        def flush(self):
            if self.inside and self.buf.split():
                self.out.append(" ".join(self.buf.split()))
            self.buf = ""

        def handle_starttag(self, tag, attrs):
            if tag not in ("b", "i", "a", "em", "span"):
                self.flush()
            self.inside = self.inside or tag == "article"

        def handle_endtag(self, tag):
            if tag not in ("b", "i", "a", "em", "span"):
                self.flush()
            self.inside = self.inside and tag != "article"

        def handle_data(self, data):
            self.buf += data

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_wrap.extract(pages).collect()}
    for r in pages.collect():
        p = Brute()
        p.feed(r.html)
        p.close()
        p.flush()
        assert got[r.page_id] == "\n\n".join(p.out)


def test_align_is_bounded():
    w = html_wrap.stream([(f"s{i % 40_000}", False, "x", 0.0, 0) for i in range(60_000)])
    assert len(html_wrap.align(w, w)) == len(html_wrap.squeeze(w))


def test_wrappers_align():
    s = lambda *tags: html_wrap.stream([(t, False, t + str(i), 0.0, 0) for i, t in enumerate(tags)])
    w = html_wrap.align(s("h", "p", "p", "f"), s("h", "x", "p", "f"))
    assert [(p[0], p[1], p[2]) for p in w] == [("h", False, False), ("x", True, False), ("p", False, True), ("f", False, False)]
    assert html_wrap.align(w, s("h", "p", "f"))[1][:2] == ["x", True]


def test_url_trust(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">l</a>' for h in hosts)
    rows = [
        (1, "http://good.org/a?x#y", '<a href="//friend.net/y">l</a>'), (2, "https://FRIEND.net/q", link("friend.net")), (3, "http://www.example.org/es/1", ""), (4, "http://www.example.org/en/12#f", ""),
        (5, "http://bad.example.com/de/1", ""), (6, "http://farm.net/z", link("bad.example.com")), (7, None, None), (8, "no scheme", ""), (9, "http://x.com/fr/", ""), (10, "http://org", ""), (11, "http://notorg/", ""), (11, "http://notorg/", ""),
    ]
    d = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    for rules in (url_trust.RULES, spark.createDataFrame(list(url_trust.RULES), "host string, path string, verdict string")):
        got = {r.page_id: r for r in url_trust.judge(d, rules=rules).collect()}
        assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("good.org", "/a", "org/", "allow")
        assert got[2].host == "friend.net" and got[2].verdict == "allow" and got[2].trust > 0 and got[2].rule is None
        assert (got[3].rule, got[3].verdict) == ("example.org/es/", "block") and (got[4].rule, got[4].verdict) == ("example.org/en/1", "block")
        assert got[5].rule == "com/de/" and got[6].verdict == "block" and got[6].distrust > 0
        assert (got[7].host, got[7].path, got[8].host, got[8].verdict) == ("", "", "", "allow") and got[9].rule == "com/fr/"
        assert got[10].path == "" and got[10].rule is None and got[11].rule is None
    assert url_trust.judge(d).count() == len(rows) and url_trust.judge(d.limit(0)).count() == 0


def test_page_rank_against_brute_force(spark):
    r = random.Random(4)
    e = [(str(a), str(b), float(r.randrange(1, 4))) for a in range(8) for b in range(8) if a != b and r.random() < 0.4]
    edges = spark.createDataFrame(e, "src string, dst string, w double")
    got = {x.host: x["rank"] for x in url_trust.propagate(edges, spark.createDataFrame([("0", 0.5), ("3", 0.5)], "host string, mass double"), rounds=5).collect()}
    out = Counter()
    for a, _, w in e:
        out[a] += w
    rank = {"0": 0.5, "3": 0.5}
    for _ in range(5):
        new = Counter({"0": 0.075, "3": 0.075})
        for a, b, w in e:
            new[b] += 0.85 * rank.get(a, 0) * w / out[a]
        rank = new
    assert all(got[k] == pytest.approx(v) for k, v in rank.items() if v)


def test_quality(spark):
    r = random.Random(9)
    vocab = [f"{a}{b}{c}" for a in "abcdefgh" for b in "lmnopq" for c in "uvwxyz"]
    rows, labels = [], []
    for i in range(900):
        t = [r.choice(vocab) for _ in range(r.randrange(30, 120))]
        kind = i % 6
        if kind == 0:
            t = [w.upper() + "!!" for w in t]
        if kind == 1:
            t[r.randrange(len(t))] = r.choice(["scoundrel", "villain"])
        rows.append((i, " ".join(t), "en", f"src{i % 5}", 1.0))
        if i % 3 != 2 or kind == 1:
            labels.append((i, 0 if kind == 0 else 1, 1 if kind == 1 else 0))
    rows += [(1000, None, None, None, 1.0), (None, "", "en", "src1", 1.0), (1001, LONG, "en", "src2", 1.0), (5, rows[5][1], "en", "src0", 1.0)]
    train = [x for x in labels if x[0] < 600]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, keep double")
    lab = spark.createDataFrame(train, "doc_id long, quality int, toxic int")
    got = quality.classify(d, lab).collect()
    assert len(got) == len(rows)
    test = [(x.doc_id % 6, x.keep) for x in got if x.doc_id is not None and 600 <= x.doc_id < 900]
    clean = [k for c, k in test if c > 1]
    assert sum(clean) >= 0.97 * len(clean) and sum(k for c, k in test if c == 0) == 0 and sum(k for c, k in test if c == 1) <= 5
    assert all(x.keep for x in quality.classify(d, lab.limit(0)).collect()) and quality.classify(d.limit(0), lab).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    import corpus_pipeline

    text = lambda k, last: " ".join(f"{k}{i}" for i in range(60)) + last
    rows = [(3, text("a", " x")), (7, text("a", " y")), (7, text("b", "")), (7, text("c", "")), (7, text("c", "")), (9, text("c", " z")), (None, text("d", "")), (8, None), (8, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, corpus_pipeline.near_duplicates_stage(spark, d, "").collect()))
    assert got == Counter([rows[0], rows[2], rows[3], rows[6], rows[7], rows[8]])


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", s or "none", len(t or "")) for i, t, s, _ in corpus()]
    docs = spark.createDataFrame([*rows, (None, "a b c d e f", "en", "s", 11), (999, "mail me at a.b@c.example.com soon", "en", "s", 33)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "aa bb cc dd ee ff gg hh ii jj kk")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    near = corpus_pipeline.near_duplicates_stage(spark, docs, str(tmp_path)).collect()
    want = brute_components([(r[0], r[1]) for r in rows])
    assert {r.doc_id for r in near} - {None, 999} == {i for i, (_, c) in want.items() if i == c} and any(r.doc_id is None for r in near)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {r.doc_id for r in near} and any("<EMAIL>" in (r.text or "") for r in out) and not any("@" in (r.text or "") for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "pii", "mixing"]
    own = {"keep": "k", "p_quality": 2.0, "n_words": 5, "hits": "h", "items": "i", "spans": 3, "component_id": 4, "_key": "y", "src_key": 6}
    mine = docs.select("*", *[F.lit(v).alias(c) for c, v in own.items()])
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, mine, str(tmp_path))
        assert got.columns == mine.columns and {tuple(r[c] for c in own) for r in got.collect()} == {tuple(own.values())}
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_masking_long_texts_in_one_pass(spark):
    from quillmesh.llm import pii

    unit = "é mail a.b@c.de or call +1 (555) 123-4567 now; "
    long = unit * 3_000
    d = spark.createDataFrame([(1, long, "x"), (2, None, "y"), (3, "", "z"), (4, "clean text", "w"), (5, "a@b.c" * 2, "v")], "doc_id long, text string, lang string")
    spans = {r.doc_id: r.spans for r in pii.find(d.filter("doc_id > 1")).collect()}
    want = {i: t and pii.masked(t, [s.asDict() for s in spans[i]]) for i, t in ((2, None), (3, ""), (4, "clean text"), (5, "a@b.c" * 2))}
    got = {r.doc_id: (r.text, r.lang) for r in pii.mask(d).collect()}
    assert got[1] == ("é mail <EMAIL> or call <PHONE> now; " * 3_000, "x")
    assert {i: got[i][0] for i in want} == want and want[4] == "clean text" and {i: got[i][1] for i in got} == dict(zip(range(1, 6), "xyzwv"))
    assert pii.masked("0123456789", [{"start": 1, "end": 5, "kind": "ip"}, {"start": 3, "end": 7, "kind": "card"}, {"start": 7, "end": 8, "kind": "phone"}]) == "0<IP><PHONE>89"
