"""The text operators against brute force, on small fixtures with nulls, empty and long texts, ties, repeats."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docketspark.llm import components, htmltext, jaccard, labelled, licenses, minhash, mixing, packing, quality, queries, topk, urls

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"
R = random.Random(4)
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(R.choice(WORDS) for _ in range(30_000))
BASE = " ".join(R.choice(WORDS) for _ in range(120))
TEXTS = [(1, None), (2, ""), (3, "One"), (4, BASE), (5, BASE), (6, BASE.replace(BASE.split()[60], "zz", 1)), (7, LONG), (8, " \t\n"), (9, "é ß " * 30), (9, "é ß " * 30), (None, "no id here"),
         (12, " ".join(BASE.split()[:60]) + " " + " ".join(R.choice(WORDS) for _ in range(60)))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s1" if k % 3 else None, len(t or ""), 0.5) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fingerprint_pairs_with_the_next_document(docs, none):
    out = minhash.fingerprint(docs, lots=3).collect()
    assert len(out) == len(TEXTS)
    order = sorted((i, t or "") for i, t in TEXTS if i is not None)[::-1] + [(None, "no id here")]
    want = defaultdict(set)
    for k, (i, t) in enumerate(order):
        want[i].add(hashlib.sha256(minhash.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest())
    for r in out:
        assert r["edited_sha256"] in want[r["doc_id"]] and 0 <= r["near_next"] <= 1
    by = {r["doc_id"]: r for r in out}
    assert by[4]["fingerprint"] == by[5]["fingerprint"] and by[5]["near_next"] == 1 and by[1]["near_edited"] == 1
    assert minhash.fingerprint(none).count() == 0


def test_signatures_estimate_jaccard():
    a, b = " ".join(WORDS[:200]), " ".join(WORDS[20:220])
    p, q = ({tuple(x.split()[i : i + 5]) for i in range(196)} for x in (a, b))
    s = minhash.signatures([a.encode(), b.encode(), b""])
    assert abs(minhash.likeness(s[0], s[1]) - len(p & q) / len(p | q)) < 0.15 and (s[2] == minhash.EMPTY).all()


def test_near_duplicate_classes(docs):
    out = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert out[5] == out[4] == out[6] == 4 and out[7] == 7 and out[1] == 1 and out[None] is None


def near_classes(rows, width=5, percent=80):
    words = {i: t.lower().split() for i, t in rows}
    sets = {i: {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} for i, w in words.items() if w}
    out = {i: i for i, _ in rows}
    for i in sets:
        for j in sets:
            if i < j and out[i] != out[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                p, q = sorted((out[i], out[j]))
                out = {k: p if v == q else v for k, v in out.items()}
    return out


@pytest.mark.parametrize("options", [{}, {"small": 2}, {"small": 2, "most": 400}])
def test_fingerprint_classes_link_all_members_of_a_band(spark, options):
    rng, rows = random.Random(8), []
    for f in range(6):  # the least id shares bands with all others, but is near none; the others chain up
        own = [f"f{f}x{i}" for i in range(200)]
        rows.append((100 * f, " ".join(own[:110])))
        for k in range(1, 13):
            w = list(own)
            for at in range(0, 6 * k, 6):
                w[120 + at % 72 : 122 + at % 72] = [f"y{f}", f"z{at}"]
            rows.append((100 * f + k, " ".join(w)))
        rows.append((100 * f + 50, rows[-1][1]))
    d = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string").repartition(3)
    want = near_classes(rows)
    assert any(want[100 * f + 2] == 100 * f + 1 and want[100 * f] == 100 * f for f in range(6))
    classes = minhash.classes_of(d, **options)
    assert {r["doc_id"]: r["class_id"] for r in minhash.fingerprint(d, lots=3, classes=classes).collect()} == want


def test_fingerprint_query_gives_classes(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r["class_id"] for r in queries.op1_fingerprint(spark, str(tmp_path)).collect()}
    assert out[4] == out[5] == out[6] == 4 and out[7] == 7 and out[1] == 1 and out[9] == 9 and out[None] is None


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (None, 3)]
    out = dict(components.connected(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(out[i] == 0 for i in range(41)) and all(out[i] == 100 for i in range(100, 140)) and len(out) == 81


def test_license_templates():
    s = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES)
    n, places, found = s.scan(b"x Released under the MIT License. mit-license! Apache License General Public License")
    assert n == 13 and places == [(4, "mit"), (6, "mit"), (8, "apache"), (10, "gpl")] and found == {"mit-statement"}
    a = "under the <<beginOptional>>terms of the<<endOptional>> mit <<var;name=v;max=2>> license"
    t = licenses.Scanner({"t": a}, {})
    for text, want in (("under the terms of the MIT license", True), ("under the mit a b license", True), ("under the mit a b c license", False), ("under the terms mit license", False)):
        assert bool(t.scan(text.encode())[2]) == want
    with pytest.raises(ValueError):
        licenses.compile_template("<<beginOptional>>a<<endOptional>> b")


def test_license_scan_rows(docs, none):
    out = licenses.license_scan(docs)
    assert out.count() == len(TEXTS) and out.where("doc_id = 1").first()["n_words"] == 0 and licenses.license_scan(none).count() == 0
    assert out.where("doc_id = 7").first()["n_words"] == 30_000


def test_packing_is_gapless_exact_and_bounded(docs, none):
    out = packing.pack(docs, capacity=64, rows_each=40).collect()
    slow, _ = packing._encoders(packing.default_tokenizer())
    ids = {i: [*slow.encode(t or "", add_special_tokens=False).ids, 2] for i, t in TEXTS}
    bins = defaultdict(list)
    for r in out:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and len(part) == r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    lengths = np.array([r["length"] for r in out])
    assert packing.bound(lengths, 64) <= len(bins) <= packing.bound(lengths, 64) + 2
    assert packing.pack(none).count() == 0
    assert packing.encode("a <|endoftext|> b", packing.default_tokenizer()) == slow.encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_bounds_and_best_fit():
    rng = np.random.default_rng(0)
    assert packing.bound(np.array([60, 60, 60]), 100) == 3 and packing.bound(np.array([], int), 100) == 0
    for _ in range(20):
        sizes = rng.integers(1, 101, 300)
        bins, places, free = packing.best_fit(sizes, 100)
        assert packing.bound(sizes, 100) <= len(free) and (free >= 0).all() and free.sum() == len(free) * 100 - sizes.sum()


def test_sequences_hold_the_ids(docs):
    out = packing.sequences(docs, capacity=64).collect()
    assert max(len(r["ids"]) for r in out) <= 64 and sum(r["ids"].count(2) for r in out) >= len(TEXTS)


def water(sizes, weights):
    targets, left, open_ = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while left > 1e-9 and open_:
        total, over = sum(weights[s] for s in open_), 0.0
        for s in sorted(open_, key=str):
            targets[s] += left * weights[s] / total
        for s in list(open_):
            if targets[s] >= 3 * sizes[s]:
                over += targets[s] - 3 * sizes[s]
                targets[s] = 3.0 * sizes[s]
                open_.discard(s)
        left = over
    return targets


def test_mix_meets_targets_and_caps(spark, none):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 60)) if i % 50 else None, "en", rng.choice(["a", "a", "a", "b", "c", None]), 0, 0.0) for i in range(3000)] + [(9999, "only one", "en", "tiny", 0, 0.0)]
    d = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix_sources(d, block=16, rows_each=200).collect()
    names = {r[0]: r[3] for r in rows}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        assert r["taken"] <= 3 * r["size"]
        sizes[names[r["doc_id"]]] += r["size"]
        taken[names[r["doc_id"]]] += r["taken"]
        target[names[r["doc_id"]]] = r["target"]
    ranked = sorted([s for s in sizes if s is not None]) + [None]
    want = water(sizes, {s: k % 3 + 1 for k, s in enumerate(ranked)})
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= max(0.03 * want[s], 32)
    assert sorted(map(tuple, mixing.mix_sources(d.repartition(5), block=16, rows_each=200).collect()))[:50] == sorted(map(tuple, out))[:50]
    assert mixing.mix_sources(none).count() == 0
    texts = mixing.mixed_documents(d, block=16, rows_each=200)
    assert texts.columns == d.columns and texts.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(r["taken"] for r in out)


def test_mix_meets_targets_of_small_sources_over_many_shards(spark):
    rows = [(i, "w " * 40, "en", "big", 0, 0.0) for i in range(2000)] + [(5000 + i, "w " * (5 if i < 8 else 80), "en", f"tiny{i:02}", 0, 0.0) for i in range(16)]
    names = {r[0]: r[3] for r in rows}
    taken, target = defaultdict(int), {}
    for r in mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), block=16, slots=64, rows_each=400).collect():
        taken[names[r["doc_id"]]] += r["taken"]
        target[names[r["doc_id"]]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(taken[s] == target[s] == (15 if int(s[4:]) < 8 else 240) for s in target if s != "big")
    assert abs(taken["big"] - target["big"]) <= 16 * 2


def test_held_out_rows(spark):
    out = spark.range(40).select("id", labelled.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in out)


def auc(rows, label):
    pos, neg = [r["score"] for r in rows if r[label] == 1], [r["score"] for r in rows if r[label] == 0]
    return np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])


def test_quality_on_held_out_rows(spark, docs):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(d, lab).where("held_out").join(lab, "doc_id").collect()
    assert auc(rows, "quality") > 0.95
    assert quality.quality(docs, lab.limit(0)).count() == len(TEXTS)


def test_quality_words():
    words, offsets = quality.buckets([b"AB Cd cd ### 12", b"", b"cd"])
    assert list(offsets) == [0, 5, 5, 6] and words[0] == quality.CAPITALS and words[2] == quality.REPEATED and words[1] == words[5] and max(words[3], words[4]) < quality.SIGNS


def brute(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()))
    comp = {i: i for i, _ in sets if i is not None}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((find(i), find(j)))
                comp[q] = p
    return sorted((-1 if i is None else i, len(s), -1 if i is None else find(i)) for i, s in sets)


def family(n, seed):
    rng, out = random.Random(seed), []
    for k in range(n):
        if k % 4 == 0:
            own = [rng.choice(WORDS) for _ in range(rng.randint(3, 80))]
        w = list(own)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append((k, " ".join(w)))
    return out


@pytest.mark.parametrize("options", [{}, {"small": 2}, {"small": 2, "most": 150}])
def test_jaccard_join_equals_brute_force(spark, options):
    rows = TEXTS + [(i + 100, t) for i, t in family(160, 3)] + [(1000 + i, " ".join(["p q r s t u v"] * 9 + [f"x{i % 7}"])) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = jaccard.jaccard_join(d, **options).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in out) == brute(rows)


@pytest.mark.parametrize("most", [3, 1000])
def test_window_blocks_join_all_pairs_within_their_windows(spark, most):
    docs_ = [(i, t) for i, t in family(120, 5)]
    values, offsets = jaccard._sets([t.encode() for _, t in docs_], 4)
    n, sketch = np.diff(offsets).tolist(), jaccard.sketches(values, offsets)
    sets = spark.createDataFrame([(i, n[i], bytearray(sketch[i])) for i, _ in docs_], "id long, n long, sketch binary")
    group = lambda i: int(i % 5 == 0)
    rows = spark.createDataFrame([(7, group(i), i, i) for i, _ in docs_], "region long, `group` int, id long, comp long")
    found = jaccard._window_blocks(rows, sets, 85, most).collect()

    def likely(a, b):
        odd = int(jaccard._odd(np.frombuffer(sketch[a], np.uint8), np.frombuffer(sketch[b], np.uint8)))
        return 100 * min(n[a], n[b]) >= 85 * max(n[a], n[b]) and 185 * odd <= 15 * (n[a] + n[b])

    near = [(a, b) for a in range(120) for b in range(a) if not (group(a) and group(b)) and likely(a, b)]
    assert near and all(likely(*p) and not (group(p[0]) and group(p[1])) for p in found)

    def least(pairs):
        comp = list(range(120))
        for a, b in pairs:
            comp = [min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for c in comp]
        return comp

    assert least(found) == least(near)


def test_jaccard_join_keeps_all_texts_of_a_doc_id(spark):
    cell = lambda t: int(jaccard._sets([t.encode()], 4)[0][0]) >> 40 & 127
    one = "first text"
    two = next(t for t in (f"other text {i}" for i in range(9999)) if cell(t) == cell(one))  # sizes and cell counts agree
    near = " ".join(f"n{i}" for i in range(40))
    rows = [(2, one), (2, two), (3, one), (4, two), (9, ""), (9, near), (5, near), (6, None), (7, "")]
    rows += [(1, " ".join(f"n{i}" for i in range(41)))]
    out = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r[0], r[1], r[2]) for r in out) == brute(rows)


def test_jaccard_join_of_nothing(none):
    assert jaccard.jaccard_join(none).count() == 0


def test_top_k_equals_sorting(spark):
    rng = np.random.default_rng(3)
    v = np.floor(rng.normal(size=(700, 8)) * 3) / 2
    v[100:300] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(701, None), (702, [1.0] * 7 + [float("nan")]), (703, [None] * 8), (None, [1.0] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.top_k(d, shard_rows=64, query_rows=4, shards_each=3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    q = np.floor(v * 256).astype(int)
    for i in range(0, 700, 50):
        want = sorted(((int(q[i] @ q[j]), -j) for j in range(700) if j != i), reverse=True)[:5]
        assert got[i] == [(-j, s) for s, j in want]
    assert topk.top_k(d.limit(0)).count() == 0


@pytest.mark.parametrize("options", [{}, {"shard_rows": 2, "query_rows": 1, "shards_each": 1}])
def test_one_huge_vector_stops_no_query(spark, options):
    v = [[1e12, 1.0], [1.0, 2.0], [1.0, 1.0], [0.5, -1.0], [1.0, 3.0], [2.0, 0.0]] + [[0.25, float(i)] for i in range(60)]
    d = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.top_k(d, every=3, **options).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    q = [[int(256 * x) for x in e] for e in v]
    for i in range(0, len(v), 3):
        want = sorted(((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in range(len(v)) if j != i))[:5]
        assert got[i] == [(j, -s) for s, j in want]
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id long, embedding array<double>")).count()


def test_url_rules_and_link_trust(spark):
    rows = [(1, "http://A.org/x", '<a href="https://good.com/1">'), (2, "https://example.org/es/1?q", "<a href='//worse.com/'>"), (3, "x://good.com/", None), (4, "http://farm.net/z#f", '<a href="http://example.org/es/9">'),
            (5, None, None), (6, "no url", ""), (7, "http://example.org/en/12", None), (8, "http://org", None), (9, "http://farm.net/z", None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    out = {r["page_id"]: r for r in urls.filter_urls(d).collect()}
    assert [out[i]["rule"] for i in range(1, 9)] == ["org/", "example.org/es/", None, None, None, None, "example.org/en/1", None]
    assert out[1]["host"] == "a.org" and out[2]["path"] == "/es/1" and out[8]["path"] == "" and out[5]["host"] == ""
    assert out[3]["trust"] > 0 and out[3]["verdict"] == "allow" and out[4]["distrust"] > 0 and out[4]["verdict"] == out[9]["verdict"] == "block"
    assert urls.filter_urls(d.limit(0)).count() == 0


def test_url_ranks_over_chains_hubs_and_cycles(spark):
    links = defaultdict(list)
    for k in range(12):  # c0 is twelve links from the blocked host
        links[f"c{k}.net"] = [f"c{k + 1}.net"] if k < 11 else ["example.org"]
    for k in range(5):  # each hub passes a 300th part on to the next
        links[f"hub{k}.net"] = [f"hub{k + 1}.net"] + [f"leaf{i}.net" for i in range(299)]
    links["a.org"], links["u.net"], links["v.net"] = ["hub0.net", "u.net"], ["v.net"], ["u.net"]
    pages = [(f"http://{h}/", "".join(f"<a href='http://{x}/'>" for x in to)) for h, to in links.items()] + [("http://example.org/es/1", None), ("http://hub5.net/", None)]
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    out = {r["host"]: r for r in urls.filter_urls(d, follow=0.5).collect()}
    assert out["c0.net"]["distrust"] == pytest.approx(0.5**13, rel=1e-8, abs=0) and out["c0.net"]["verdict"] == "block"
    assert out["hub5.net"]["trust"] == pytest.approx(0.5**8 / 300**5, rel=1e-8, abs=0)
    assert out["u.net"]["trust"] == pytest.approx(0.125 / 0.75, rel=1e-8, abs=0) and out["v.net"]["trust"] == pytest.approx(0.0625 / 0.75, rel=1e-8, abs=0)


def test_sum_product_equals_enumeration():
    nodes = htmltext.parse("<div><p>One two.<ul><li>a<li>b</ul></div><nav>x</nav>")
    rng = np.random.default_rng(0)
    m = htmltext.Model(rng.normal(size=htmltext.WIDTH), rng.normal(size=(len(htmltext.PARENTS), 2, 2)))
    own, n = htmltext.features(nodes) @ m.own, len(nodes)
    total, on = 0.0, np.zeros(n)
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        w = np.exp(sum(s * (v - 0.5) for s, v in zip(own, y, strict=True)) + sum(m.pair[htmltext.parent_kind(nodes[nodes[i].parent])][y[nodes[i].parent]][y[i]] for i in range(1, n)))
        total += w
        on += w * np.array(y)
    assert htmltext.marginals(nodes, m)[0] == pytest.approx(on / total)


def test_html_text(spark):
    m = htmltext.trained()
    page = '<nav><a>Home</a></nav><script>var t="</p>";</script><article><h1>T &amp; U</h1><p>One  two.<br><p>All rights reserved.</article><div class="comments"><p>I liked this so much, thank you!</p></div><footer>Foot &copy;</footer>'
    assert htmltext.extract(page, m) == "T & U One two. All rights reserved."
    d = spark.createDataFrame([(1, None, page), (2, "u", None), (3, "u", ""), (3, "u", "")], "page_id long, url string, html string")
    assert sorted(r["n_chars"] for r in htmltext.extract_text(d, m).collect()) == [0, 0, 0, 35]


def test_html_text_with_an_open_head_and_math():
    m = htmltext.trained()
    story = "<article><h1>T and U</h1><p>One two three, and a sentence that goes on.</p></article>"
    want = "T and U One two three, and a sentence that goes on."
    for head in ("<head><title>x</title>", "<head><title>x", "<head><meta name=a><title>The <p> tag</title>", "<head><title>x</title><noscript><img src=a></noscript>", "<head><noscript><p>No</p></noscript></head>"):
        for body in ("<body>", "<BODY class=a>", ""):
            assert htmltext.extract(f"<html>{head}{body}{story}</html>", m) == want, (head, body)
    assert htmltext.extract(f"<html><head><title>x<body>{story}<svg><title>y</title></svg></html>", m) == want
    assert htmltext.extract(f"<html><head></head><body>{story}<head><p>More words that follow in the article.</p>", m).endswith("More words that follow in the article.")
    assert [x.text for x in htmltext.parse("<head><meta name=a>Words <b>here") if x.text] == ["Words here"]
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be the number of it all.</p></article>"
    assert htmltext.extract(page, m) == "Let x=2 be the number of it all."


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, result = queries.QUERIES[name](spark, DATA), c.execute(queries.SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(result.fetchall())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    d = docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, d, DATA).write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert d.columns == docs.columns and d.count() > 0
        if name == "jaccard_join":
            rows = [(r["doc_id"], r["text"]) for r in d.collect()]
            assert len(rows) == len({c for _, _, c in brute(rows)})
    assert d.count() >= docs.count() // 4


@pytest.mark.parametrize("comments", ["<div id='disqus_thread'><p>I liked this story a lot, thank you for it.</p><p>Me too, what a read.</p></div>", "<section id='discussion'><ol><li><p>I liked this story a lot, thank you for it.</p></li></ol></section>"])
@pytest.mark.parametrize("box", ["article", "main", "div"])
def test_html_text_keeps_lists_of_links_and_drops_threads(comments, box):
    links = "<ul><li><a href='/1'>The first source of it</a></li><li><a href='/2'>Second</a></li><li><a>A third one to read</a></li></ul>"
    story = f"<{box}><h1>A list of links</h1><p>Here are some words about the list that follows, as an introduction.</p>{links}<p>And it goes on after the list, for a while.</p></{box}>"
    page = f"<html><body><nav><ul><li><a>Home</a></li></ul></nav>{story}{comments}<div class='related'><ul><li><a>Another story here</a></li></ul></div><footer><ul><li><a>Imprint</a></li></ul></footer></body></html>"
    want = "A list of links Here are some words about the list that follows, as an introduction. The first source of it Second A third one to read And it goes on after the list, for a while."
    assert htmltext.extract(page, htmltext.trained()) == want


def test_html_text_of_odd_rows(spark):
    rows = [(1, None, None, 5), (2, "u", "", 6), (None, "u", "<p>Only words of a page, without any id, but with a sentence.</p>", 7), (3, "u", "<div>" * 3000 + "<p>" + "long words " * 50_000, 8)] + [(4, "u", "<p>Twice the same row of a table, as it is.</p>", 9)] * 2
    d = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int").withColumn("text", F.lit("clash"))
    out = htmltext.extract_text(d).collect()
    assert len(out) == 6 and {r["page_id"]: r["n_chars"] for r in out if r["page_id"] in (1, 2)} == {1: 0, 2: 0}
    assert all(len(r["text"]) == r["n_chars"] for r in out) and len({r["text"] for r in out if r["page_id"] == 4}) == 1
    assert htmltext.extract_text(d.limit(0)).count() == 0
