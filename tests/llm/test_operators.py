"""Corpus operators: edge rows, brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymesh.llm import decontamination, html_text, labelled, licenses, merkle, piece_sampling, quality, simhash, token_counts, token_store, toxicity
from waymesh.llm.components import connected_components
from waymesh.llm.registry import tokenizer_file

SF = "/root/testdata/sf0.001"
PIECES = tokenizer_file("piece_bpe_32k.model")
BYTES = tokenizer_file("byte_bpe_50k.json")
LONG = "long text of many words " * 4000
ROWS = [
    (1, "One small text.", "x"),
    (2, None, "x"),
    (3, "", None),
    (4, "One small text.", "x"),
    (4, "One small text.", "x"),
    (5, LONG, "y"),
    (None, "A text without an id, worthless trash", "z"),
    (6, " \n \n", "z"),
]
SCHEMA = "doc_id long, text string, source string, score double, fp long, key long, row long, part long, n long, held_out int"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, None, None, None, None, None, None, None) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_edge_rows_keep_every_row(spark, labels, docs):
    bench = spark.createDataFrame([(1, "text of many words long text of many words long text of many words"), (2, None), (None, "x"), (3, "Without an id, worthless t"), (4, "trash")], "item_id long, text string")
    for rows in (ROWS, []):
        d = frame(spark, rows)
        n = len(rows)
        assert token_counts.with_token_counts(d, PIECES).count() == n
        assert simhash.near_duplicates(d).count() == n
        assert licenses.scan_licenses(d).count() == n
        got = merkle.edited_likeness(d).collect()
        assert len(got) == n and all(0 <= r["near_edited"] <= 1 for r in got)
        idx = token_store.token_index(d, BYTES).collect()
        assert len(idx) == n and sorted(r["start"] for r in idx)[:1] == [0][:n]
        assert quality.score_quality(d, labels).where("score between 0 and 1").count() == n
        assert toxicity.score_toxicity(d, labels).where("score between 0 and 1").count() == n
        assert piece_sampling.sampled_pieces(d, PIECES, 1).where("round_trip").count() == n
        leaks = decontamination.leaks(d, bench).collect()
        assert {r["doc_id"] for r in leaks} == ({5, None} if n else set())
        for kept in (quality.keep_quality(d, labels, 0.0), toxicity.drop_toxic(d, labels, 2.0), decontamination.drop_leaks(d, bench), simhash.drop_near_duplicates(d)):
            assert kept.columns == d.columns
            kept.collect()
        merkle.merkle_nodes(d).collect()
    # without labels every score is one constant
    assert quality.score_quality(frame(spark), labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    assert toxicity.score_toxicity(frame(spark), labels.limit(0)).select("score").distinct().count() == 1


def test_held_out(spark):
    got = spark.range(50).select("id", labelled.held_out(F.col("id"), 4, 2).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_token_counts_equal_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(1)
    al = "ab  \n\t▁the ionéß執\U0001f600<>/s;)\r"
    texts = ["", "  ", "a  ", "▁▁x", "</s><s>", "x" * 1200, "ab" * 700, "the" * 2000, "".join(r.choice("etaoinshr") for _ in range(5000))] + ["".join(r.choice(al) for _ in range(r.randint(0, 60))) for _ in range(800)]
    assert token_counts.count_batch(texts, PIECES).tolist() == [len(x) for x in sp.encode(texts)]


def test_token_ids_equal_the_library_and_come_back(spark, docs, tmp_path):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(BYTES)
    r = random.Random(2)
    al = ["a", "b", " ", "\n", "é", "1", "'s", "<|endoftext|>", "!", "\t", "\x1c", "　", "\0", "the"]
    texts = ["".join(r.choice(al) for _ in range(r.randint(0, 25))) for _ in range(800)]
    got = token_store.encode_texts(texts, BYTES, 2)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids + [2] for e in t.encode_batch(texts, add_special_tokens=False)]
    path = f"file://{tmp_path}/tokens"
    token_store.write_tokens(docs, path, BYTES, 2, block_ids=700)
    back = {x["doc_id"]: np.frombuffer(x["ids"], "<u4").tolist() for x in token_store.read_tokens(spark, path, digest=False).collect()}
    assert back == {d["doc_id"]: t.encode(d["text"], add_special_tokens=False).ids + [2] for d in docs.collect()}


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5000])
def test_huffman(n):
    r = np.random.default_rng(n)
    c = r.zipf(1.3, n).clip(1, 10**9)
    lengths = token_store.code_lengths(c, 13)
    assert (2.0**-lengths).sum() <= 1 and lengths.max() <= 13
    code = token_store.Code(np.arange(n), lengths)
    src = [r.choice(n, m, p=c / c.sum()).astype(np.uint32) for m in (1, 127, 128, 129, 3000)]
    out = code.decode([(*code.encode(x), len(x)) for x in src])
    assert all((a == b).all() for a, b in zip(src, out, strict=True))


def test_simhash_against_brute_force(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = {b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(60)} | set(base)
    fps = np.array(sorted(fps), np.uint64)
    for cap in (4, 1000):  # through the variants, and through the pairs
        links = simhash.fingerprint_links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), cap=cap)
        comp = {x["node"]: x["component"] for x in connected_components(links).collect()}
        want = {int(x): {int(x)} for x in fps.view(np.int64)}
        for i, j in itertools.combinations(range(len(fps)), 2):
            if int(fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = want[int(fps.view(np.int64)[i])], want[int(fps.view(np.int64)[j])]
                if a is not b:
                    a |= b
                    for x in b:
                        want[x] = a
        assert all(comp.get(x, x) == min(s) for x, s in want.items())


def test_simhash_fingerprint_is_spark_hashing(spark):
    text = "The the THE quick brown fox É jumps"
    w = "the the the quick brown fox É jumps".split(" ")
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hs = [x[0] & (2**64 - 1) for x in spark.createDataFrame([(g,) for g in grams], "g string").select(F.xxhash64("g")).collect()]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    assert simhash.simhash(text) == want and simhash.simhash("") == simhash.simhash(None) == 0


def _distance(needle, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(needle, 1):
        prev, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            prev, row[j] = row[j], min(prev + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_decontamination_against_brute_force():
    r = random.Random(5)
    item = "".join(r.choice("abcdefgh ") for _ in range(80)).strip().replace("  ", "x ")
    ix = decontamination.GramIndex.build([(7, decontamination.normalise(item))], 80, 5, 10)
    texts = []
    for edits in range(0, 12):
        for _ in range(6):
            t = list(item)
            for _ in range(edits):
                p = r.randrange(len(t))
                t[p : p + 1] = r.choice([[], [r.choice("xyz")], [t[p], r.choice("xyz")]])
            texts.append("noise " * r.randrange(5) + "".join(t) + " more noise" * r.randrange(3))
    got = decontamination._matches(ix, texts)
    budget = int(ix.budgets[0])
    for t, m in zip(texts, got, strict=True):
        d = _distance(decontamination.normalise(item), decontamination.normalise(t))
        assert bool(m) == (d <= budget), (d, m)
        assert not m or min(x[1] for x in m) == d


def test_marginals_against_enumeration():
    m = toxicity.ToxicField()
    m.turn = np.array([[0.0, -1.0], [0.0, 0.5]])
    e = np.random.default_rng(0).normal(0, 2, 7)
    total, z = np.zeros(7), 0.0
    for s in itertools.product((0, 1), repeat=7):
        p = sum(0.5 * math.exp(m.turn[a, s[0]]) for a in (0, 1)) * math.exp(sum(e[i] for i in range(7) if s[i]) + sum(m.turn[s[i], s[i + 1]] for i in range(6)))
        z, total = z + p, total + p * np.array(s)
    got = m.marginals([e, np.zeros(300), np.zeros(0)])
    assert np.abs(got[0] - total / z).max() < 1e-12 and [len(x) for x in got] == [7, 300, 0]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for out, y in ((toxicity.score_toxicity(d, lab), "toxic"), (quality.score_quality(d, lab), "quality")):
        got = out.join(lab, "doc_id").where("held_out").select("predicted", y).collect()
        assert sum(r["predicted"] == r[y] for r in got) / len(got) > 0.9


def test_spans_have_offsets():
    f = toxicity.ToxicField()
    f.weight, f.bias = {"=trash": 9.0}, -5.0
    text = "some Trash, trash here"
    _, m = f.scores([text])
    assert [text[a:b] for a, b in f.spans(text, m[0])] == ["Trash, trash"]


def test_html(spark):
    page = """<html><head><title>t</title><script>var x="</p>"</script></head><body class="has-sidebar"><nav><a>Home</a></nav>
    <div class="ad">buy</div><article><header><h1>T &amp; u</h1></header><p><b>One<br>two&nbsp;
    three<p>Four <i>five</i><ul><li>a<li>b</ul><div class="comments"><article>nice</article></div><form><label>mail</label></form></article><footer>(c)</footer>"""
    rows = [(1, "http://a.com/1", page, 1), (2, None, None, 1), (3, "bad url", "", 1), (4, "http://b.com/", "<p>plain", 1)]
    fixed = [(10 + i, f"https://u:p@C.com:80/{i}", f"<div><p>All rights</p><section><h2>Story {i}</h2>text {i} of it</section></div>", 1) for i in range(6)]
    d = spark.createDataFrame(rows + fixed + rows[:1], "page_id long, url string, html string, tokens int")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(d).collect()}
    assert got[1] == "T & u\n\nOne two three\n\nFour five\n\na\n\nb"
    assert got[2] == got[3] == "" and got[4] == "plain"
    assert got[12] == "Story 2\n\ntext 2 of it"
    assert html_text.main_text(d).count() == 11 and html_text.main_text(d.limit(0)).count() == 0


def test_licences(spark):
    mit = licenses.TEXTS["MIT"].upper().replace("LICENSE", "Licence").replace("\n\n", "\n\nCopyright (c) 2020 Someone\n\n", 1)
    d = spark.createDataFrame([(1, mit, 1), (2, "a\nReleased under the MIT Licence\nb", 1), (3, None, 1), (4, licenses.TEXTS["ISC"], 1)], "doc_id long, text string, digest int")
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in licenses.scan_licenses(d).collect()}
    assert got == {1: ("MIT", ""), 2: (None, "MIT"), 3: (None, ""), 4: ("ISC", "")}


def test_merkle(spark):
    r = random.Random(0)
    texts = {"".join(r.choice("a \n") for _ in range(r.randint(0, 9))) for _ in range(2000)}
    assert len({merkle.fingerprint(t)[:32] for t in texts}) == len(texts)
    rows = [(i, " ".join(str(r.random()) for _ in range(r.randint(0, 60)))) for i in range(97)] + [(5, "tie"), (5, "tie")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda x: (-x[0], x[1]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        n, m = order[(k + 1) % len(order)][1], len(t) // 3
        want[i, hashlib.sha256((t[: len(t) - m] + n[:m]).encode()).hexdigest()] += 1
    for parts in (1, 7):
        got = merkle.edited_likeness(d, parts=parts).collect()
        assert Counter((x["doc_id"], x["edited_sha256"]) for x in got) == want
    a, b = spark.createDataFrame([(1, "x y\nz\n\nq r")], "doc_id long, text string"), spark.createDataFrame([(1, "x y\nz\n\nq s")], "doc_id long, text string")
    diff = {(x["level"], x["section"], x["paragraph"]) for x in merkle.differing_branches(merkle.merkle_nodes(a), merkle.merkle_nodes(b)).collect()}
    assert diff == {(0, None, None), (1, 1, None), (2, 1, 0)}


def test_sampling_follows_the_lattice():
    lat = piece_sampling.PieceLattice(PIECES)

    def ways(w):
        if not w:
            return [((), 0.0)]
        out, single = [], False
        for k in range(1, len(w) + 1):
            i = lat.ids.get(w[:k])
            if i is not None:
                single |= k == 1
                out += [((i, *r), lat.cost[i] + p) for r, p in ways(w[k:])]
        return out if single else out + [((-1 - ord(w[0]), *r), lat.rare * len(w[0].encode()) + p) for r, p in ways(w[1:])]

    words = [ways(w) for w in ("▁the", "▁on", "▁é\U0001f9ff")]
    full = {sum((x[0] for x in c), ()): math.exp(sum(x[1] for x in c)) for c in itertools.product(*words)}
    z = sum(full.values())
    p = {tuple(lat.bytes_of(np.array(k)).tolist()): v / z for k, v in full.items()}
    n = 4000
    got = [r for lo in range(0, n, 500) for r in piece_sampling.sample_batch(lat, ["the on é\U0001f9ff"] * 500, list(range(lo, lo + 500)), 3)]
    ids = [[tuple(x.tolist()) for x, _, _ in r] for r in got]
    assert all(len(set(r)) == 3 for r in ids)
    first, two = Counter(r[0] for r in ids), Counter((r[0], r[1]) for r in ids)
    assert max(abs(first[k] / n - v) for k, v in p.items()) < 0.03
    assert max(abs(two[a, b] / n - p[a] * p[b] / (1 - p[a])) for a in p for b in p if a != b) < 0.03
    assert abs(np.mean([sum(math.exp(lp - q) for _, lp, q in r) for r in got]) - 1) < 0.05
    again = piece_sampling.sample_batch(lat, ["x", "the on é\U0001f9ff"], [9, 3], 3)[1]
    assert [x.tolist() for x, _, _ in again] == [list(x) for x in ids[3]]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7), (None, 3)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(e.limit(0)).count() == 0


def test_pipeline_against_its_operators(spark):
    """run() against the same decisions made row by row on the collected table."""
    import corpus_pipeline

    sf = SF
    d = spark.read.parquet(f"{sf}/documents.parquet")
    lab, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = {r["doc_id"]: r["text"] for r in d.collect()}
    model = quality.fit_quality(d, lab)
    rows = {i: t for i, t in rows.items() if model.score([quality.bag(t)])[0] >= 0.5}
    field = toxicity.fit_toxicity(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), lab)
    rows = {i: t for i, t in rows.items() if field.scores([t])[0][0] < 0.3}

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in rows.items()}
    group = {i: i for i in rows}
    for a, b in itertools.combinations(sorted(rows), 2):
        if group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            lo, hi = sorted((group[a], group[b]))
            group = {i: lo if g == hi else g for i, g in group.items()}
    rows = {i: t for i, t in rows.items() if group[i] == i}
    items = [decontamination.normalise(r["text"]) for r in bench.collect()]
    rows = {i: t for i, t in rows.items() if not any(x in decontamination.normalise(t) for x in items)}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(rows) and all(r["round_trip"] for r in got)
    assert len(corpus_pipeline.STAGES) == 5


def test_large_ids_next_to_a_null_stay_whole(spark):
    a, b = 2**53 + 1, 2**53 + 3
    text = "One text of many words that is in the benchmark too, word for word and no less."
    d = spark.createDataFrame([(a, text), (None, text), (b, "another")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    ids = lambda df: sorted(r["doc_id"] or 0 for r in df.select("doc_id").distinct().collect())
    assert ids(merkle.edited_likeness(d)) == ids(piece_sampling.sampled_pieces(d, PIECES, 1)) == ids(token_store.token_index(d, BYTES)) == [0, a, b]
    assert ids(decontamination.leaks(d, bench)) == [0, a]
    assert ids(decontamination.drop_leaks(d, bench)) == [b]
    assert ids(merkle.merkle_nodes(d)) == [0, a, b]


def test_repeated_rows_are_duplicates(spark):
    rows = [(4, "the same words again"), (4, "the same words again"), (None, "the same words again"), (7, "others altogether"), (None, "a third text"), (None, "a third text")]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, "a third text"), (4, "the same words again"), (7, "others altogether")]


def test_short_benchmark_items_match(spark):
    d = spark.createDataFrame([(1, "It says: Short benchmark answer is 42, or so."), (2, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "short benchmark answer is 42"), (2, "x")], "item_id long, text string")
    assert [r["doc_id"] for r in decontamination.leaks(d, bench).collect()] == [1]
    many = spark.createDataFrame([(i, f"item number {i} of the long benchmark, told in so many words") for i in range(40)], "item_id long, text string")
    e = spark.createDataFrame([(i, f"doc: item number {i} of the long benchmark, told in so many words.") for i in range(0, 40, 7)], "doc_id long, text string")
    for block in (100, 10**6):
        got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(e, many, block_chars=block).where("edits = 0").collect()}
        assert got == {(i, i) for i in range(0, 40, 7)}
        assert decontamination.drop_leaks(e, many, block_chars=block).count() == 0
        # rows without an id, repeats and columns of any name stay, whatever the number of blocks
        clean = spark.createDataFrame([(None, "nothing of the kind", 1), (None, "nothing of the kind", 1), (7, None, 2)], "doc_id long, text string, number int")
        mixed = clean.unionByName(e.select("doc_id", "text", F.lit(3).alias("number")))
        assert sorted(decontamination.drop_leaks(mixed, many, block_chars=block).collect(), key=str) == sorted(clean.collect(), key=str)


def test_every_spelling_of_a_short_word_is_found():
    lat = piece_sampling.PieceLattice(PIECES)

    def ways(w):
        if not w:
            return {()}
        return {(lat.ids[w[:k]], *r) for k in range(1, len(w) + 1) if w[:k] in lat.ids for r in ways(w[k:])}

    for w in ("a", "I", "the", "of", "and"):
        got = piece_sampling.sample_batch(lat, [w], [1], 5)[0]
        every = ways("▁" + w)
        assert len(got) == min(5, len(every)) and {tuple(x.tolist()) for x, _, _ in got} <= every
        assert len(got) < 5 or all(q <= 0 for _, _, q in got)
    for w in ("a", "the"):
        every = sorted(ways("▁" + w))
        weight = {t: math.exp(sum(lat.cost[i] for i in t)) for t in every}
        for n in range(len(every)):
            want = sum(weight[t] for t in every[n:]) / sum(weight.values())
            assert abs(lat.remaining(w, every[:n]) - want) < 1e-12 * max(want, 1e-3)


def test_attention_gradient_and_forward_pass():
    r = np.random.default_rng(1)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "delta!"], r.integers(0, 400))) for _ in range(6)]
    x, starts = quality.stack([quality.bag(t) for t in texts])
    y = np.array([0.0, 1, 0, 1, 1, 0])
    m = quality.AttentionModel()
    f = m._forward(x, starts)["y"]
    for i, t in enumerate(texts):  # each document on its own, passage by passage
        p, e, h = m.p, [], []
        for v in quality.bag(t).astype(float):
            hv = np.tanh(v @ p["W"] + p["b"])
            h.append(hv)
            e.append(float((np.tanh(hv @ p["V"]) / (1 + np.exp(-(hv @ p["U"])))) @ p["w"]))
        a = np.exp(np.array(e) - max(e))
        a /= a.sum()
        z = sum(w * v for w, v in zip(a, h, strict=True))
        assert abs(f[i] - 1 / (1 + math.exp(-(z @ p["c"] + p["d"][0])))) < 1e-9
    # words matter: the same letters and marks in other words give other vectors
    assert not np.allclose(quality.bag("alpha beta")[0][quality.N_SURFACE :], quality.bag("betaa alph")[0][quality.N_SURFACE :])

    def loss(model):
        q = model._forward(x, starts)["y"]
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    grad = m.gradient(x, starts, y)
    for k in m.p:
        at = tuple(r.integers(0, n) for n in m.p[k].shape)
        old, d = m.p[k][at], 1e-6
        m.p[k][at] = old + d
        up = loss(m)
        m.p[k][at] = old - d
        down = loss(m)
        m.p[k][at] = old
        assert abs((up - down) / (2 * d) - grad[k][at]) < 1e-5, k


def test_toxic_scores_are_those_of_single_texts(spark, docs, labels):
    field = toxicity.fit_toxicity(docs, labels)
    out = toxicity.score_toxicity(docs, labels).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out[::7]:
        t = texts[r["doc_id"]]
        p, m = field.scores([t])
        tokens = list(toxicity._TOKEN.finditer(t or ""))
        assert abs(r["score"] - p[0]) < 1e-9 and len(tokens) == len(m[0])
        inside = {w.start() for w, v in zip(tokens, m[0], strict=True) if v >= 0.5}
        covered = {w.start() for w in tokens if any(s["start"] <= w.start() < s["end"] for s in r["spans"])}
        assert inside == covered
        x = field.summary(m[0])
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30, min(30, float(np.dot(x, field.doc))))))) < 1e-9


def test_template_classes_against_brute_force(spark):
    pages = [(i, "http://a.com/x", f"<html><body><div class='top'><p>Fixed words</p></div><article><h1>Head {i}</h1><p>Text {i}.</p><p>More {i}.</p><div class='box'>Always this</div></article><footer>End</footer></body></html>") for i in range(6)]
    rows = spark.createDataFrame(pages + [(9, "http://b.com/", "<p>lone")], "page_id long, url string, html string")
    got = html_text.classes(html_text.parsed(rows)).collect()
    count = Counter()
    for _, _, h in pages:
        bs, tags = html_text.parse(h)
        for p, (_, n, _, _) in tags.items():
            count[p, None] += n
        by = {}
        for x in bs:
            by.setdefault(x.path, []).append(x.text)
        for p, ts in by.items():
            if len(set(ts)) == 1:
                count[p, ts[0]] += len(ts)
    # every page has each of these as often, so the tokens on all pages with one count are a class
    tags = {p: n for (p, t), n in count.items() if t is None}
    want = {(p, None) for p in tags} | {(p, html_text._token(p, t)) for (p, t), n in count.items() if t is not None and n == tags[p]}
    size = Counter(tags[p] for p, _ in want)
    assert {(r["path"], r["token"]) for r in got} == {(p, t) for p, t in want if size[tags[p]] > 1}
    text = {r["page_id"]: r["text"] for r in html_text.main_text(rows).collect()}
    assert text[2] == "Head 2\n\nText 2.\n\nMore 2.\n\nAlways this" and text[9] == "lone"
    nest = {r["class"]: r["within"] for r in html_text.templates(rows).collect()}
    assert nest and all(w is None or w in nest for w in nest.values())
    # a doubled table has the same texts, twice
    twice = Counter((r["page_id"], r["text"]) for r in html_text.main_text(rows.union(rows)).collect())
    assert twice == {(i, t): 2 for i, t in text.items()}
    copies = spark.createDataFrame([(i, "http://c.com/", pages[0][2]) for i in range(8)], "page_id long, url string, html string")
    assert {r["text"] for r in html_text.main_text(copies).collect()} == {"Head 0\n\nText 0.\n\nMore 0.\n\nAlways this"}


def test_malformed_pages_take_linear_time():
    import time

    n = 90_000
    for bad in ("<ul><li><ul>" + "<b>" * n + "<li></li>" * n, "<b>" * n + "<p></p>y" * n, "<!-" * 300_000, "<script x" * 100_000, "<b>" * 150_000 + "<td>" * 100_000, '<a x="' * 160_000 + ">", "<" * 1_000_000, "<p " + "a" * 1_000_000 + ">"):
        t = time.process_time()
        html_text.parse(bad)
        assert time.process_time() - t < 4
    assert html_text.blocks("<head><title>t</title><p>Body text</p>")[0].text == "Body text"


def test_template_chooses_the_slot(spark):
    """Pages where marks tell nothing, or tell wrongly: the template's slots decide."""
    prose = lambda h, i: " ".join(f"Sentence {j} of story {h} {i} says something of its own." for j in range(3 + i % 2))
    cases = {}

    def site(name, page, want, n=6):
        for i in range(n):
            cases[len(cases)] = (f"http://{name}.com/{i}", page(i, prose(name, i)), want(i, prose(name, i)))

    # an article's byline and closing heading repeat on all its pages
    site("byline", lambda i, p: f"<body><nav>Home</nav><article><h1>Title {i}</h1><p class='by'>By Ann Lee</p><p>{p}</p><h2>Conclusion</h2><p>End {i}</p></article><footer>(c)</footer></body>", lambda i, p: f"Title {i}\n\nBy Ann Lee\n\n{p}\n\nConclusion\n\nEnd {i}")
    # names that say little of the element that holds all text
    for k, name in enumerate(("post tag-python", "article-body hidden-xs", "side-by-side", "legal-news")):
        site(f"name{k}", lambda i, p, name=name: f"<body><div class='menu'><a href='/'>Home {i}</a></div><div class='{name}'><h1>Head {i}</h1><p>{p}</p></div><div class='ad'>Buy {i} now</div></body>", lambda i, p: f"Head {i}\n\n{p}")
    # names that differ by page
    site("differ", lambda i, p: f"<body><div class='post tag-{'abcdef'[i]}'><h1>Head {i}</h1><p>{p}</p></div></body>", lambda i, p: f"Head {i}\n\n{p}")
    # no marks at all: lists of links, short varying lines and fixed words around the running text
    site("plain", lambda i, p: f"<body><div class='x1'><a href='/{i}'>Latest {i}</a> <a href='/'>Home</a></div><div class='x2'><h1>Head {i}</h1><div class='x3'><p>{p}</p><p>{p[::-1]}</p></div></div><div class='x4'>Always the same words</div><div class='x5'>Seen {i} times</div></body>", lambda i, p: f"Head {i}\n\n{p}\n\n{p[::-1]}")
    # text straight in the body, fixed words before, between and behind
    site("bare", lambda i, p: f"<body><div class='top'>Site of stories</div><h1>Head {i}</h1><p>{p}</p><hr><h2>More</h2><p>Second {p}</p><div class='end'>All rights kept</div></body>", lambda i, p: f"Head {i}\n\n{p}\n\nMore\n\nSecond {p}")
    # comments longer than the text
    site("talk", lambda i, p: f"<body><div class='text'><h1>Head {i}</h1><p>{p}</p></div><div class='comments'><p>{(p[::-1] + ' ') * 5}</p></div></body>", lambda i, p: f"Head {i}\n\n{p}")
    # a single page: its own text decides
    site("single", lambda i, p: f"<body><div class='m'><a>One</a><a>Two</a></div><div class='tag-x'><p>{p}</p></div></body>", lambda i, p: p, n=1)
    # a header of the article stands beside its text
    site("head", lambda i, p: f"<body><header>Site</header><main><article><header><h1>Head {i}</h1></header><div><p>{p}</p></div><footer>Filed {i}</footer></article></main></body>", lambda i, p: f"Head {i}\n\n{p}")
    rows = spark.createDataFrame([(k, u, h) for k, (u, h, _) in cases.items()], "page_id long, url string, html string")
    for least in (16_000_000, 0):  # templates broadcast or joined
        got = {r["page_id"]: r["text"] for r in html_text.main_text(rows, broadcast_bytes=least).collect()}
        wrong = {cases[k][0]: (got[k], w) for k, (_, _, w) in cases.items() if got[k] != w}
        assert not wrong, list(wrong.items())[:3]


def test_licence_table_and_neighbouring_spellings(spark):
    d = spark.createDataFrame([(1, "licence licence"), (2, "license license"), (3, licenses.TEXTS["MIT"].replace("MIT License\n", "MIT License\nCopyright Jane Doe\n")), (4, "The long licence"), (5, licenses.HEADERS["Apache-2.0"])], "doc_id long, text string")
    more = spark.createDataFrame([("Long-1.0", "THE LONG LICENSE")], "license_id string, text string")
    got = {r["doc_id"]: (r["digest"], r["license_id"]) for r in licenses.scan_licenses(d, more).collect()}
    assert got[1][0] == got[2][0] and got[3][1] == "MIT" and got[4][1] == "Long-1.0" and got[5][1] == "Apache-2.0"


def test_partitions_of_next_texts_are_even():
    assert merkle._even([5, 5, 5, 5], 2) == [0, 0, 1, 1] and merkle._even([], 3) == [] and merkle._even([100, 1, 1, 1], 2) == [0, 1, 1, 1]


def test_more_symbols_than_short_codes():
    n = 70_000
    lengths = token_store.code_lengths(np.arange(1, n + 1), 16)
    assert (2.0**-lengths).sum() <= 1 and lengths.max() <= 18
    code = token_store.Code(np.arange(n), lengths)
    ids = np.random.default_rng(1).integers(0, n, 1000).astype(np.uint32)
    assert (code.decode([(*code.encode(ids), len(ids))])[0] == ids).all()
