"""Small cases and brute-force comparisons of the training-data operators."""

import math
import random
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowloom.llm import classifiers, ctw, decontaminate, embedding_dedup, html_extract, licenses, mixing, near_dedup, setsketch, warc
from rowloom.llm.components import connected_components
from rowloom.llm.workspace import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


def words(rng, n, vocabulary=200):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_components_against_brute_force(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, i) for i in range(400, 460)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["id"]: r["component_id"] for r in connected_components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "c").collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in linked}


def jaccard_groups(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < k else zip(*[w[i:] for i in range(k)], strict=False)))
    comp = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c) and comp[i] != comp[j]:
                a, b = sorted((comp[i], comp[j]))
                comp = [a if x == b else x for x in comp]
    return sets, comp


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup_against_brute_force(spark, k):
    rng = random.Random(k)
    base, texts = words(rng, 120), [None, "", "one", "One", "  two words ", "x" * 20000]
    for n in range(60):  # a chain of copies that drift apart, about the threshold
        base[rng.randrange(len(base))] = f"n{n}"
        texts.append(" ".join(base))
    texts += [" ".join(words(rng, rng.randrange(3, 60))) for _ in range(40)] + [texts[10]] * 3
    sets, comp = jaccard_groups(texts, k, 80)
    got = by_id(near_dedup.near_dedup(docs(spark, *texts), shingle=k))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in range(len(texts))}
    assert near_dedup.near_dedup(docs(spark).limit(0)).count() == 0


def test_near_dedup_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(21)
    one, two, three = (words(rng, 40, 5000) for _ in range(3))
    near = lambda w: " ".join([*w[:-1], "changed"])
    rows = [(5, " ".join(one)), (5, " ".join(two)), (6, near(one)), (7, near(two)), (7, near(two)), (8, " ".join(three)), (None, " ".join(three)), (9, near(three))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("set_key", F.lit("x")).withColumn("first", F.lit(1)).withColumn("items", F.lit(1))
    got = near_dedup.near_dedup(frame, shingle=2).select("doc_id", "component_id", "kept").collect()
    want = [(5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (7, 5, False), (8, 8, True), (None, None, False), (9, 8, False)]
    assert Counter(tuple(r) for r in got) == Counter(want)


def test_near_dedup_recall_at_the_threshold(spark):
    texts = []
    for i in range(300):  # 102 words in either text, 101 pairs of which both have 90, or 89: a similarity of 90 / 112 or 89 / 113
        a = [f"a{i}x{j}" for j in range(102)]
        b = [*a[: 91 - (i % 3 == 0)], *[f"b{i}x{j}" for j in range(11 + (i % 3 == 0))]]
        texts += [" ".join(a), " ".join(b)]
    comp = [i if i % 6 < 2 else i - i % 2 for i in range(600)]
    got = by_id(near_dedup.near_dedup(docs(spark, *texts), shingle=2))
    wrong = [i for i in range(600) if got[i]["component_id"] != comp[i]]
    assert len(wrong) <= 2 and not any(i % 6 < 2 for i in wrong)


def test_sketch_merges_and_estimates():
    spec, rng = setsketch.SketchSpec(bands=64), np.random.default_rng(3)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = x[:2000], x[500:]
    assert (setsketch.merge(setsketch.sketch(a, spec), setsketch.sketch(b, spec)) == setsketch.sketch(x, spec)).all()
    p, q = setsketch.sketch(a, spec), setsketch.sketch(b, spec)
    counts = [np.array([c.sum()]) for c in (p > q, p < q, p == q)]
    j = setsketch.likely_jaccard(*counts, np.array([2000.0]), np.array([2500.0]), spec.base)[0]
    assert abs(j - 1500 / 3000) < 0.1


def test_embedding_dedup_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=24)
    rows = [centre + rng.normal(size=24) * 0.18 for _ in range(60)] + list(rng.normal(size=(60, 24)))
    rows += [rows[0] * 3, rows[0], rows[70]]
    data = [(i, [float(c) for c in v]) for i, v in enumerate(rows)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None, 1.0]), (904, []), (905, [1e308, 1e308])]
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.array([min([comp[i], *comp[near[i]]]) for i in range(len(x))])
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = by_id(embedding_dedup.embedding_dedup(frame, block=16), "vec_id")
    assert {i: (got[i]["n_links"], got[i]["component_id"]) for i in range(len(x))} == {i: (int(near[i].sum()), int(comp[i])) for i in range(len(x))}
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 906))


def test_embedding_dedup_small_cases(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [3.0, 4.0]
    frame = spark.createDataFrame([(5, a), (5, b), (6, a), (7, b), (8, c), (9, c), (None, a), (8, c)], "vec_id long, embedding array<float>")
    got = embedding_dedup.embedding_dedup(frame.withColumn("cid", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("copies", F.lit(2)))
    want = [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False), (8, 2, 8, True), (8, 2, 8, True), (9, 2, 8, False), (None, 0, None, False)]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    assert embedding_dedup.embedding_dedup(frame.limit(0)).count() == 0
    # 20 * 0.95 = 19: the cosine of these two is 0.95 within rounding of one unit either way; of the others it is below.
    tie = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.95, (1 - 0.95**2) ** 0.5 - 1e-9]), (3, [0.95, -((1 - 0.95**2) ** 0.5) - 1e-6])], "vec_id long, embedding array<double>")
    assert {i: r["n_links"] for i, r in by_id(embedding_dedup.embedding_dedup(tie), "vec_id").items()} == {1: 1, 2: 1, 3: 0}


@pytest.mark.parametrize("hashes", [2, 3, 4])
def test_embedding_dedup_recall_at_every_number_of_hashes(spark, monkeypatch, hashes):
    rng, n, d = np.random.default_rng(17), 1500, 64
    a, z = rng.normal(size=(2, n, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    z -= (z * a).sum(axis=1)[:, None] * a
    z /= np.linalg.norm(z, axis=1)[:, None]
    cosine = rng.uniform(0.9501, 0.9510, size=(n, 1))
    x = np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * z])
    near = (x @ x.T >= 0.95) & ~np.eye(2 * n, dtype=bool)
    assert near.sum() == 2 * n
    monkeypatch.setattr(embedding_dedup, "FELLOWS", 2 * n / 128 ** (hashes - 0.5))  # 64 dimensions have 128 signed axes
    seen = []
    monkeypatch.setattr(embedding_dedup, "partial", lambda f, **b: (seen.extend([b["hashes"]] if "hashes" in b else []), partial(f, **b))[1])
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = by_id(embedding_dedup.embedding_dedup(frame), "vec_id")
    assert seen == [hashes]
    wrong = {i % n for i in range(2 * n) if (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) != (int(near[i].sum()), i % n, i < n)}
    assert len(wrong) <= 1  # recall of 0.999, whatever the number of hashes
    assert all(got[i]["n_links"] == got[i + n]["n_links"] == 0 for i in wrong)


def test_license_scan(spark):
    texts = ["The MIT-License, mit license! apache licence", None, "", "GNU General Public License general public license " * 2, "Licensed under CC BY-NC 4.0.", "MİT license",
             "permission is hereby granted, free of all charge, to any person obtaining a copy of this software and associated documentation files"]
    got = by_id(licenses.license_scan(docs(spark, *texts)))
    row = lambda i: tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels"))
    assert row(0) == (7, 2, 1, 3, "mit") and row(1) == row(2) == (0, 0, None, None, "")
    assert row(3) == (14, 4, 1, 11, "gpl")
    assert got[4]["labels"] == "cc-by-nc" and got[4]["score"] == 1.0 and got[1]["score"] == 0.0
    assert got[5]["n_base"] == 0
    assert got[6]["base_labels"] == "" and got[6]["labels"] == "mit"
    kelvin = by_id(licenses.license_scan(docs(spark, "\u212a MIT LICENSE \u00c4", "MIT LICENSE" + " x" * 30_000)))
    assert (kelvin[0]["n_words"], kelvin[0]["first_word"]) == (4, 1) and kelvin[1]["n_words"] == 30_002


def test_license_scan_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(12)
    notices = [t for t, _ in [*licenses.BASE_PHRASES, *licenses.NOTICES]]
    texts = [None, "", "mit", "\u212aMIT License"]
    for i in range(120):
        part = rng.choice(notices).upper().split() if i % 3 else rng.choice(notices).split()
        for _ in range(i % 4):  # words put in, left out or changed
            part[rng.randrange(len(part))] = rng.choice(["", "x y", "changed"])
        texts.append(" ".join([*words(rng, rng.randrange(20)), *part, *words(rng, 3), *(rng.choice(notices).split() if i % 5 == 0 else [])]))
    frame = docs(spark, *texts)
    documents = frame.unionByName(frame.limit(9)).toPandas()  # noqa: F841 - read by the SQL
    got = licenses.license_scan(spark.createDataFrame(documents, DOCS))
    want = duckdb.sql(licenses.sql())
    assert Counter(tuple(r) for r in got.collect()) == Counter(want.select(*got.columns).fetchall())


def test_decontaminate_against_brute_force(spark):
    rng = random.Random(9)
    items = [" ".join(words(rng, n)) for n in (1, 3, 5, 14, 30, 60, 90)] + [None, ""]
    texts = [None, ""]
    for i in range(60):
        t = words(rng, rng.randrange(2, 300))
        part = (items[i % 7]).split()
        for _ in range(i % 3):
            part[rng.randrange(len(part))] = "changed"
        texts.append(" ".join([*t, *part, *words(rng, 5)]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def grams(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = set()
    for j, item in enumerate(items):
        w = (item or "").split()
        s = grams(w, min(5, len(w))) if w else set()
        want |= {(i, j) for i, t in enumerate(texts) if s and 100 * len(s & grams((t or "").split(), min(5, len(w)))) >= 80 * len(s)}
    found = decontaminate.contaminated(docs(spark, *texts), bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    left = decontaminate.decontaminate(docs(spark, *texts), bench)
    assert {r["doc_id"] for r in left.collect()} == set(range(len(texts))) - {i for i, _ in want}


def test_decontaminate_items_without_or_with_a_repeated_id(spark):
    rng = random.Random(10)
    one, two, three = (" ".join(words(rng, 30, 5000)) for _ in range(3))
    bench = spark.createDataFrame([(None, one), (7, two), (7, three), (7, three), (8, None), (None, "")], "item_id long, text string")
    frame = docs(spark, one, f"a {two} b", three.upper(), None, " ".join(words(rng, 50))).withColumn("item", F.lit(1)).withColumn("h", F.lit(2)).withColumn("w", F.lit("x"))
    frame = frame.unionByName(frame.where("doc_id = 1")).unionByName(frame.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))
    found = decontaminate.contaminated(frame, bench)
    assert Counter(tuple(r) for r in found.collect()) == Counter({(0, None, 26, 26, 1.0): 1, (1, 7, 26, 26, 1.0): 1, (2, 7, 26, 26, 1.0): 1})
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(frame, bench).collect()) == [3, 4]
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == decontaminate.contaminated(frame.limit(0), bench).count() == 0


def test_decontaminate_at_the_threshold(spark):
    item = [f"i{n}" for n in range(24)]  # 20 shingles
    most, fewer = [*item[:20], *["x"] * 4], [*item[:19], *["x"] * 5]  # 16 and 15 of them
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    found = decontaminate.contaminated(docs(spark, " ".join(most), " ".join(fewer), " ".join([*["y"] * 60_000, *item])), bench)
    assert {(r["doc_id"], r["n_shared"]) for r in found.collect()} == {(0, 16), (2, 20)}


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng, rng.randrange(5, 40))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b"]), 0) for i in range(400)]
    rows += [(900, None, None, None, 0), (901, "", "en", "a", 0)]
    frame = spark.createDataFrame(rows, DOCS)
    out = [r.asDict() for r in mixing.mix(frame, targets={"source": {"a": 0.5, "b": 0.5}}).collect()]
    weight = Counter()
    for r in out:
        weight[r["source"]] += r["n_tokens"] * r["expected_copies"]
    assert abs(weight["a"] / (weight["a"] + weight["b"]) - 0.5) < 0.01
    total = sum(r["n_tokens"] for r in out)
    assert abs(sum(weight.values()) / total - mixing.BUDGET) < 1e-6
    assert abs(sum(r["n_tokens"] * r["copies"] for r in out) / total - mixing.BUDGET) < 0.1
    assert all(r["copies"] in (math.floor(r["expected_copies"]), math.floor(r["expected_copies"]) + 1) for r in out)
    assert mixing.mix(frame.limit(0)).count() == 0


def test_mixing_meets_all_three_targets(spark):
    rng = random.Random(3)
    tails = ["", " a | b", " see http://x.y", " licence"]
    rows = [(i, " ".join(words(rng, rng.randrange(5, 40))) + rng.choice(tails), rng.choice(["en", "en", "de"]), rng.choice(["a", "a", "b"]), 0) for i in range(400)]
    targets = {"source": {"a": 0.3, "b": 0.6}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"general": 4, "tabular": 2, "contact": 1, "legal": 1}}
    frame = spark.createDataFrame(rows, DOCS)
    frame = frame.select("doc_id", *mixing.described(frame))
    got = mixing.residuals(frame, mixing.mixture(Workspace(spark, "t"), frame, targets=targets), targets).collect()
    assert {(r["marginal"], r["category"]): round(r["target"], 4) for r in got} == {
        (d, c): round(v / sum(targets[d].values()), 4) for d in targets for c, v in targets[d].items()}
    assert max(abs(r["target"] - r["reached"]) for r in got) < 1e-3


def test_html_extraction(spark):
    page = ("<html><head><title>T</title></head><body><nav><a href=/x>Home</a></nav><div class='cookie-notice'>We use cookies</div>"
            "<article><h1>Head &amp; line</h1><p>First <b>bold</b>\n text that goes on.<br>More words here, at length.<p>Second paragraph, unclosed &lt;tag&gt;.</article>"
            "<section id=comments><p>Nice post!</p></section><footer>&copy; me</footer><script>var t='</p>'</script>")
    frame = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", "<p"), (4, "w", "")], "page_id long, url string, html string")
    got = by_id(html_extract.extract(frame), "page_id")
    assert got[1]["text"] == "Head & line\nFirst bold text that goes on. More words here, at length.\nSecond paragraph, unclosed <tag>."
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] == got[4]["text"] == "" and got[3]["n_chars"] == len(got[3]["text"])


def test_html_head_without_end_tag(spark):
    body = "<article><h1>Head line</h1><p>First paragraph of some length that goes on.<p>Second paragraph, with more words in it.</article>"
    open_head = f"<html><head><title>T</title><meta charset=utf-8><style>p {{}}</style>{body}"
    closed = f"<html><head><title>T</title><meta charset=utf-8><style>p {{}}</style></head><body>{body}"
    got = by_id(html_extract.extract(spark.createDataFrame([(1, "u", open_head), (2, "u", closed)], "page_id long, url string, html string")), "page_id")
    assert "Second paragraph" in got[2]["text"] and got[1]["text"] == got[2]["text"]


def test_html_quotes_and_embedded_text():
    def texts(page):
        return [b.text for b in html_extract.blocks(page)]

    assert texts("<p title=it's>Hello world, don't go</p><p>Next</p>") == ["Hello world, don't go", "Next"]
    assert texts("<p title = 'a > b' data-x=\"c > d\" y=>One</p><p 'z>Two</p><p a=b\"c>Three") == ["One", "Two", "Three"]
    assert texts("<p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p><noscript><p>Shown</p></noscript>") == ["If x=2 then", "Shown"]
    assert texts("<p>a<object>b</object><svg><text>c</text></svg></p><template><p>d</p></template>") == ["abc", "d"]
    assert texts("<p>x<select><option>no</option></select><textarea>no</textarea><script>'<p>'</script><style>p{}</style>y</p>") == ["xy"]


def test_html_small_cases(spark):
    long = "<article>" + "".join(f"<p>Paragraph {i} of many that all belong to the text, with some more words.</p>" for i in range(3000)) + "</article>"
    rows = [(1, "u", long), (1, "u", long), (None, None, "<article><p>Some words of a text that goes on for a while.</p></article>"), (2, "u", "<p title='open")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(1))
    got = html_extract.extract(frame).collect()
    assert len(got) == 4 and got[0] == got[1] and got[0]["text"].count("\n") == 2999
    assert got[2]["page_id"] is None and got[2]["text"].startswith("Some words") and got[3]["text"] == ""
    assert html_extract.extract(frame.limit(0)).count() == 0


def test_chain_equals_brute_force():
    from itertools import product

    rng = random.Random(3)
    pages = [([[rng.choice("abc"), rng.choice("de")] for _ in range(n)], [rng.randrange(2) for _ in range(n)]) for n in (1, 2, 4, 5)]
    model = html_extract.fit_chain(pages, steps=60)

    def score(feats, labels):
        own = sum(model.weights[x] for f, y in zip(feats, labels, strict=True) for x in f if y)
        return own + sum(model.pair[2 * a + b] for a, b in zip(labels, labels[1:], strict=False))

    for feats, _ in pages:
        best = max(product((0, 1), repeat=len(feats)), key=lambda y: score(feats, y))
        assert abs(score(feats, model.decode(feats)) - score(feats, best)) < 1e-9


def test_html_held_out_accuracy():
    rng, model, right, total = random.Random(77), html_extract.trained(), 0, 0
    for _ in range(150):
        b, y = html_extract.labelled_page(rng)
        right += sum(p == q for p, q in zip(model.decode(html_extract.block_features(b)), y, strict=True))
        total += len(y)
    assert right / total > 0.98


def test_warc_round_trip(spark):
    big = "é" * 60_000 + "\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [(1, "http://a/\r\nx", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "s"), (6, "u", "s"), (7, "u", "x" * 100), (8, "u", "x" * 100), (0, "u", "x" * 99)]
    got = by_id(warc.warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    from hashlib import sha256

    for i, _, h in rows:
        body = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(body), sha256(body).hexdigest())
    assert {i: r["refers_to"] for i, r in got.items() if r["record_type"] == "revisit"} == {2: 1, 8: 7}


def test_warc_repeated_and_null_ids_above_a_segment(spark):
    from hashlib import sha256

    big, other, third = ("x" * 2 * warc.SEGMENT_BYTES, "y" * 3 * warc.SEGMENT_BYTES, "z" * 2 * warc.SEGMENT_BYTES)
    rows = [(1, "a", big), (1, "a", big), (1, "b", other), (None, "c", big), (None, "c", other), (None, None, third), (None, None, third), (2, "d", big), (3, "e", "s")]
    got = warc.warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = [(i, len(h), sha256(h.encode()).hexdigest(), "revisit" if i == 2 else "response", 1 if i == 2 else None) for i, _, h in rows]
    assert Counter(tuple(r) for r in got) == Counter(want)
    ws = Workspace(spark, "warc")
    warc.write_warc(warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string"), ws), f"{ws.base}/archives")
    read = warc.read_warc(spark, f"{ws.base}/archives").collect()
    ids = {r["record_id"]: r for r in read}
    assert len(ids) == len(rows)
    assert [ids[r["refers_to"]]["page_id"] for r in read if r["refers_to"]] == ["1"]


def test_warc_framing():
    body = bytes(range(256)) * 40
    assert warc.unchunked(warc.chunked(body)) == body and warc.unchunked(warc.chunked(b"")) == b""
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc")


def test_toxicity_and_quality_held_out(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(500):
        w, toxic, poor = words(rng, 60), i % 4 == 0, i % 5 == 0
        if toxic:
            w[rng.randrange(60)] = rng.choice(["vilestem", "vilely", "vileness"]) + rng.choice("abcdef")
        texts.append(" ".join(w).upper() if poor else " ".join(w))
        labels.append((i, 0 if poor else 1, int(toxic)))
    frame, marks = docs(spark, *texts, None, ""), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    tox, qual = by_id(classifiers.toxicity(frame, marks)), by_id(classifiers.quality(frame, marks))
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(tox[i]["held_out"] == (i in held) for i in range(500))
    assert sum(tox[i]["predicted"] == labels[i][2] for i in held) / len(held) > 0.95
    assert sum(qual[i]["selected"] == (labels[i][1] == 1) for i in held) / len(held) > 0.95
    assert tox[500]["score"] == tox[501]["score"] and all(0 <= r["score"] <= 1 for r in tox.values())
    assert len(by_id(classifiers.toxicity(frame, marks.limit(0)))) == 502
    none = marks.limit(0)
    assert len(by_id(classifiers.quality(frame, none))) == 502
    assert classifiers.toxicity(frame.limit(0), marks).count() == classifiers.quality(frame.limit(0), marks).count() == 0


def test_the_sample_is_bounded_by_rows_and_texts_stay_whole(spark):
    ws = Workspace(spark, "t")
    frame = docs(spark, *[f"w{i}" for i in range(40)], "long " * 30_000)
    frame = frame.unionByName(frame.where("doc_id = 3").withColumn("text", F.lit("another"))).unionByName(frame.limit(5)).unionByName(docs(spark, None, start=50))
    marks = spark.createDataFrame([*[(i, 1, int(i % 4 == 0)) for i in range(41)], (3, 1, 1), (999, 1, 1), (None, 1, 1), (50, 1, None)], "doc_id long, quality int, toxic int")
    got = classifiers.labelled_sample(ws, frame, marks, F.col("toxic"), None, 1000).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(41))  # one text a labelled document, whatever its length
    one = {r["doc_id"]: r for r in got}
    assert (one[3]["text"], one[3]["grade"]) == ("another", 1) and len(one[40]["text"]) == 150_000
    assert Counter(r["grade"] for r in classifiers.labelled_sample(ws, frame, marks, F.col("toxic"), None, 10).collect()) == {0: 5, 1: 5}


def test_toxicity_fit_against_brute_force(spark):
    rng = random.Random(14)
    texts = [" ".join([*words(rng, 8, 30), *(["bad" + rng.choice("aeiou")] if i % 3 == 0 else [])]) for i in range(90)]
    frame = docs(spark, *texts).select("doc_id", "text", (F.col("doc_id") % 3 == 0).cast("int").alias("grade"))
    spec = classifiers.NgramSpec(bits=12)
    model = classifiers.toxicity_model(frame, spec)
    held = []  # the features of each text
    for t in texts:
        data = np.frombuffer(t.encode(), dtype=np.uint8)
        starts, ends, _ = classifiers.word_spans(data, np.array([0, len(data)]))
        spans = {bytes(data[a:b]): (a, b) for a, b in zip(starts, ends, strict=True)}
        at = np.array(list(spans.values()))
        held.append(Counter(classifiers.word_ngrams(data, at[:, 0], at[:, 1], spec)[1].tolist()))
    x = np.array([[f in h for f in range(1 << spec.bits)] for h in held], dtype=float)
    toxic = np.arange(90) % 3 == 0
    p, q = ((x[rows] > 0).sum(axis=0) + 1.0 for rows in (toxic, ~toxic))
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(p + q - 2 < classifiers.LEAST_TEXTS) | (abs(ratio) < classifiers.LEAST_RATIO)] = 0
    assert np.flatnonzero(model.weights).tolist() == np.flatnonzero(ratio).tolist()
    assert np.allclose(model.score(pa.array(texts)), 1 / (1 + np.exp(-(x @ model.weights + model.bias))), atol=1e-6)
    # The gradient of the objective vanishes: the fit is its minimum.
    z, weigh = x * ratio, np.where(toxic, 1.5, 0.75) / 90
    w = np.where(ratio != 0, model.weights / np.where(ratio == 0, 1, ratio), 0)
    miss = (1 / (1 + np.exp(-(z @ w + model.bias))) - toxic) * weigh
    assert np.abs(z.T @ miss + 1e-2 * w).max() < 0.01 and abs(miss.sum()) < 0.01


def test_toxicity_of_texts_of_all_lengths(spark):
    rng = random.Random(16)
    texts = [words(rng, 10 ** rng.randrange(1, 4) * rng.randrange(1, 9), 4000) for _ in range(300)] + [words(rng, 20_000, 4000)]
    toxic = [i % 3 == 0 for i in range(len(texts))]
    for t in (t for t, bad in zip(texts, toxic, strict=True) if bad):
        t[rng.randrange(len(t))] = "vile" + rng.choice(["ness", "stem", "ly"])
    marks = spark.createDataFrame([(i, 1, int(bad)) for i, bad in enumerate(toxic)], "doc_id long, quality int, toxic int")
    got = by_id(classifiers.toxicity(docs(spark, *[" ".join(t) for t in texts]), marks))
    assert sum(got[i]["predicted"] == toxic[i] for i in range(len(texts))) >= 0.97 * len(texts)


def test_quality_fit_against_brute_force(spark):
    rng = random.Random(15)
    texts = [" ".join(w.upper() if rng.random() < (i % 3) / 2 else w for w in words(rng, 30)) for i in range(90)]
    spec = classifiers.QualitySpec(bits=8)
    frame = docs(spark, *texts).select("doc_id", "text", (2 - F.col("doc_id") % 3).cast("int").alias("grade"))
    model = classifiers.quality_model(frame, 3, spec)
    r, c, v = classifiers.quality_features(pa.array(texts), spec)
    x = np.zeros((90, 1 << spec.bits))
    np.add.at(x, (r, c), v)
    grades = 2 - np.arange(90) % 3

    def loss(weights, cuts):
        tail = 1 / (1 + np.exp(-(x @ weights)[:, None] + cuts))
        bound = np.column_stack([np.ones(90), tail, np.zeros(90)])
        i = np.arange(90)
        return -np.log(np.maximum(bound[i, grades] - bound[i, grades + 1], 1e-12)).mean()

    assert (np.diff(model.cuts) > 0).all()
    assert np.allclose(model.tails(pa.array(texts)), 1 / (1 + np.exp(-(x @ model.weights)[:, None] + model.cuts)))
    best = loss(model.weights, model.cuts)
    assert best < 0.5 * loss(model.weights * 0, np.log([0.5, 2.0]))
    rs = np.random.default_rng(1)
    for _ in range(20):  # no step aside is much better
        assert loss(model.weights + rs.normal(size=256) * 0.02, model.cuts + rs.normal(size=2) * 0.02) > best - 0.01


def test_context_tree_never_rules_a_byte_out():
    key = np.array([0x6161], dtype=np.uint64)
    tree = ctw.ContextTree.fit(key, np.array([1 << 50]), 1)
    every = np.array([0x6100 | b for b in range(256)] + [0x6200 | b for b in range(256)], dtype=np.uint64)
    value = tree.evaluate(every)
    assert np.isfinite(value).all() and (value <= 0).all()
    assert value[0x61] > -1e-6 and -60 < value[0x60] < -45  # about 2 ** -51 for the other bit


def test_context_tree_is_a_distribution_and_matches_brute_force():
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b"abcab ", dtype=np.uint8), 4000)
    grams, _ = ctw.byte_grams(data, np.array([0, 4000]), 2)
    keys, counts = np.unique(grams, return_counts=True)
    tree = ctw.ContextTree.fit(keys, counts, 2)
    for context in (0x6162, 0x6120, 0xFFFF):
        every = np.array([context << 8 | b for b in range(256)], dtype=np.uint64)
        assert abs(np.exp2(tree.evaluate(every)).sum() - 1) < 1e-6
    # Sequential mixing of one bit's tree, from the definition, for context depth 1.
    one = ctw.ContextTree.fit(*np.unique(grams & np.uint64(0xFFFF), return_counts=True), 1)
    lg = math.lgamma
    kt = lambda a, b: lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi)
    bits = Counter()
    for g in (grams & np.uint64(0xFFFF)).tolist():
        bits[(g >> 8, (g >> 7) & 1)] += 1
    n = [sum(v for (c, b), v in bits.items() if b == k) for k in (0, 1)]
    own = kt(*n)
    both = sum(kt(bits[(c, 0)], bits[(c, 1)]) for c in {c for c, _ in bits})
    assert abs(float(one.nodes[0][0][2][0]) - 1 / (1 + math.exp(min(700, both - own)))) < 1e-6


def test_lm_scores_base(spark, monkeypatch):
    monkeypatch.setattr(ctw, "HEAVY_WORDS", 20)  # most words take the join
    rng = random.Random(8)
    texts = [" ".join(words(rng, rng.randrange(0, 50), 90)) for _ in range(80)] + [None, "", "NEW new w1"]
    got = by_id(ctw.lm_scores(docs(spark, *texts)))
    tokens = [[*(t or "").lower().split(), None] for t in texts]
    c = Counter(w for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(tokens):
        assert abs(got[i]["base_score"] - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-9
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert got[i]["score"] < 0


@pytest.mark.parametrize(("depth", "heavy"), [(5, 300), (4, 1 << 22), (1, 300), (2, 1)])
def test_lm_scores_equal_a_whole_tree(spark, monkeypatch, depth, heavy):
    monkeypatch.setattr(ctw, "HEAVY_GRAMS", heavy)  # the rest of the grams take the join
    monkeypatch.setattr(ctw, "BUCKET_GRAMS", 5)
    rng = random.Random(11)
    texts = [" ".join(words(rng, rng.randrange(0, 40), 60)) for _ in range(60)] + [None, "", "ÄÖ Novel held-out ~ TEXT"]
    got = by_id(ctw.lm_scores(docs(spark, *texts), depth=depth))
    each = []
    for t in texts:
        data = np.frombuffer((t or "").encode(), dtype=np.uint8)
        each.append(ctw.byte_grams(np.where((data > 64) & (data < 91), data + 32, data).astype(np.uint8), np.array([0, len(data)]), depth)[0])
    training = np.concatenate([g for i, g in enumerate(each) if zlib.crc32(str(i).encode()) % 7 != 2])
    tree = ctw.ContextTree.fit(*np.unique(training, return_counts=True), depth)
    for i, g in enumerate(each):
        assert abs(got[i]["score"] - tree.evaluate(g).sum() * math.log10(2)) < 1e-4 * (1 + len(g) / 100)


def test_extra_columns_and_repeated_rows(spark):
    frame = docs(spark, "a b c d e f", "a b c d e f").withColumn("row", F.lit(1)).withColumn("word", F.lit("x")).withColumn("cid", F.lit(2)).withColumn("h", F.lit(3))
    frame = frame.unionByName(frame).unionByName(frame.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert near_dedup.near_dedup(frame).count() == 5
    assert licenses.license_scan(frame).count() == 5
    assert ctw.lm_scores(frame).count() == 5
    assert mixing.mix(frame).count() == 5
    odd = frame.withColumns({c: F.lit(c) for c in ("cell", "e", "doc", "__row", "copies", "expected_copies", "a.b")})
    mixed = mixing.mix_rows(odd)
    assert set(mixed.columns) == set(odd.columns) and mixed.schema["copies"].dataType.simpleString() == "bigint"
    bench = spark.createDataFrame([(1, "a b c d e f", "x")], "item_id long, text string, w string")
    assert decontaminate.decontaminate(odd, bench).columns == odd.columns and decontaminate.decontaminate(odd, bench).count() == 0
    marks = spark.createDataFrame([(0, 1, 0, "x"), (1, 1, 1, "y"), (1, 1, 1, "y")], "doc_id long, quality int, toxic int, text string")
    more = odd.withColumns({c: F.lit(c) for c in ("score", "predicted", "held_out", "grade", "selected")})
    assert classifiers.toxicity(more, marks).columns == ["doc_id", "held_out", "score", "predicted"] and classifiers.toxicity(more, marks).count() == 5
    assert classifiers.quality(more, marks).count() == 5
    pages = spark.createDataFrame([(1, "u", "h", "z", 5, b"p")], "page_id long, url string, html string, row string, digest int, payload binary")
    assert [tuple(r)[:2] for r in warc.warc_round_trip(pages.unionByName(pages)).collect()] == [(1, 1), (1, 1)]
    assert warc.warc_round_trip(pages.limit(0)).count() == 0 and ctw.lm_scores(frame.limit(0)).count() == 0
    assert licenses.license_scan(frame.limit(0)).count() == 0
    assert set(mixing.mix_rows(frame).columns) == {*frame.columns, "copies"}


def test_texts_are_whole():
    from rowloom.llm.textkit import chunks

    texts = pa.array(["a" * 3_000_000, None, "", "b c"])
    got = [(a, b, len(d), o.tolist()) for a, b, d, o in chunks(texts)]
    assert got == [(0, 1, 3_000_000, [0, 3_000_000]), (1, 4, 3, [0, 0, 0, 3])]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    good = [" ".join(words(rng, 60)) for _ in range(120)]
    item = " ".join(words(rng, 30))
    texts = [*good, *[g.upper() for g in good[:30]], *[f"{g} viletox" for g in good[:30]], good[5], f"{good[7]} {item}"]
    labels = [(i, 0 if 120 <= i < 150 else 1, int(150 <= i < 180)) for i in range(180)]
    docs(spark, *texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        kept[name] = {r["doc_id"] for r in frame.select("doc_id").collect()}
    assert not kept["toxicity"] & set(range(150, 180)) and len(kept["toxicity"]) >= 145
    assert not kept["quality"] & set(range(120, 150)) and set(range(120)) <= kept["quality"]
    assert 180 not in kept["near_dedup"] and 5 in kept["near_dedup"]
    assert 181 not in kept["decontaminate"] and kept["mixing"] <= kept["decontaminate"]
    assert set(frame.columns) == {"doc_id", "text", "lang", "source", "n_chars", "copies"}
    odd = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumns({c: F.lit(1) for c in ("row", "doc", "__row")})
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert set(stage(spark, odd, str(tmp_path)).columns) == set(odd.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["mixing"])


def test_pipeline_decides_rows_without_or_with_a_repeated_id(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    good = [" ".join(words(rng, 60)) for _ in range(120)]
    item = " ".join(words(rng, 30))
    named = [*good, *[g.upper() for g in good[:30]], *[f"{g} viletox" for g in good[:30]]]
    alone = " ".join(words(rng, 60))
    extra = [(None, f"{good[1]} viletox"), (None, good[1].upper()), (None, good[5]), (None, f"{alone} {item}"), (None, alone), (None, alone), (7, good[7]), (7, good[7])]
    rows = [(i, t, "en", "s", 0) for i, t in [*enumerate(named), *extra]]
    labels = [(i, 0 if 120 <= i < 150 else 1, int(150 <= i < 180)) for i in range(180)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, kept = spark.createDataFrame(rows, DOCS), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        frame = Workspace(spark, "t").save(stage(spark, frame, str(tmp_path)), name)
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = Counter((r["doc_id"], r["text"]) for r in frame.collect())
    assert (None, extra[0][1]) not in kept["toxicity"] and kept["toxicity"][(None, good[5])] == 1
    assert (None, extra[1][1]) in kept["toxicity"] and (None, extra[1][1]) not in kept["quality"] and kept["quality"][(7, good[7])] == 3
    assert kept["near_dedup"][(7, good[7])] == 1 and kept["near_dedup"][(5, good[5])] == 1 and (None, good[5]) not in kept["near_dedup"]
    assert kept["near_dedup"][(None, alone)] == 1 and (None, extra[3][1]) in kept["near_dedup"] and (None, extra[3][1]) not in kept["decontaminate"]
    blank = spark.createDataFrame([(1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "", "en", "s", 0)], DOCS)
    assert Counter(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, blank, str(tmp_path)).collect()) == Counter([1, 2, None])
