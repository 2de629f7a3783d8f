"""Toxicity, quality, token counts, language identification and the signature tree join."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest

from tidemark.llm import language_crf, quality, signature_join, token_counts, toxicity
from tidemark.llm.common import read
from tidemark.llm.components import components
from tidemark.llm.queries import queries

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1.0
    n = sum(labels)
    return (sum(o for o, y in zip(order, labels, strict=True) if y) - n * (n + 1) / 2) / (n * (len(labels) - n))


def held_out(spark, name, label, sf="/root/testdata/sf0.1"):
    return queries()[name](spark, sf).where("held_out").join(read(spark, sf, "labels"), "doc_id").selectExpr("score", "predicted", f"{label} AS y").collect()


def test_toxicity_held_out(spark):
    rows = held_out(spark, "op4_toxicity_compression", "toxic")
    assert auc([r.score for r in rows], [r.y for r in rows]) > 0.93
    assert all((r.score >= 0.5) == bool(r.predicted) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted for r in rows if not r.y]) < 0.06


def test_quality_held_out(spark):
    rows = held_out(spark, "op5_quality_embeddings", "quality")
    assert auc([r.score for r in rows], [r.y for r in rows]) > 0.99
    assert all((r.score >= 0.7) == bool(r.predicted) for r in rows)
    assert np.mean([r.predicted for r in rows if r.y]) > 0.99


def planted(n=300, seed=0):
    rng = random.Random(seed)
    syllable = ["ka", "to", "mi", "re", "so", "lu", "ne", "di"]
    word = lambda: "".join(rng.choices(syllable, k=rng.randint(1, 3)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(8, 200))]
        if i % 4 == 0:
            for _ in range(max(1, len(w) // 20)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(["horrid", "vile", "loathsome"]))
        rows.append((" ".join(w), int(i % 4 == 0)))
    return rows


def test_toxicity_learns_short_words():
    model = toxicity.train(planted())
    test = planted(200, 1)
    s = toxicity.score_texts(model, [x for x, _ in test])
    assert auc(s, [y for _, y in test]) > 0.99
    assert b"vile" in model.toxic and b"vile" not in model.ordinary
    assert len(model.ordinary) > 500  # trained on ordinary text
    words = b" ".join(x.encode() for x, y in planted() if not y)
    assert all(w in words for w in model.ordinary.split()[1:-1][:50])
    parts = np.concatenate([toxicity.score_texts(model, [x]) for x, _ in test])
    assert np.allclose(s, parts)  # a text's score does not depend on its neighbours


def test_toxicity_late_in_unbroken_text():
    model = toxicity.train(planted())
    rng = random.Random(2)
    run = lambda n: "".join(rng.choice("katomiresolunedi") for _ in range(n))
    c = [toxicity._compressor(x, model.config.search_log) for x in (model.toxic, model.ordinary)]
    for at in (0, 200, 245, 4_000, 19_000):
        clean = run(20_000)
        bad = clean[:at] + "_loathsome_" + clean[at:]
        a, b = toxicity.window_statistics([clean, bad], *c, model.config)
        assert b[-1] > a[-1] and b[-3] > a[-3], at  # the largest gain, windows beyond the last margin but one


def test_labelled_sample(spark):
    """Long texts give a passage, both-way labels nothing, missing documents are replaced, repeats agree."""
    from pyspark.sql import functions as F

    from tidemark.llm.common import labelled_sample

    docs = [(i, f"text {i}") for i in range(100)] + [(100, "x" * 90), (101, None), (102, ""), (7, "a second text")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    label = spark.createDataFrame([(i, i % 2) for i in range(50, 200)] + [(60, 1), (7, 1)], "doc_id long, toxic int")
    rows = labelled_sample(docs, label, "toxic", F.lit(True), 1000, 20)
    assert {x for x, _ in rows} == {f"text {i}" for i in range(50, 100) if i != 60} | {"x" * 20, "a second text"}
    assert rows == labelled_sample(docs.repartition(7), label, "toxic", F.lit(True), 1000, 20)
    assert len(labelled_sample(docs, label, "toxic", F.lit(True), 10, 20)) == 20


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from tidemark.llm.common import shared_dir

    unset = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077")), "x")


def test_models_without_both_labels():
    for m in (toxicity, quality):
        for rows in ([], [("some words", 1)] * 3, [("some words", 0)] * 3):
            s = m.score_texts(m.train(rows), ["some words", ""])
            assert s.shape == (2,) and ((0 <= s) & (s <= 1)).all()


def test_quality_of_batches():
    rows = [(f"clean words number {i} follow each other", 1) for i in range(40)] + [(f"x{i} x{i} x{i} x{i} $$ $$", 0) for i in range(40)]
    model = quality.train(rows)
    s = quality.score_texts(model, [x for x, _ in rows])
    assert auc(s, [y for _, y in rows]) == 1.0
    assert np.allclose(s, np.concatenate([quality.score_texts(model, [x]) for x, _ in rows]))


@pytest.mark.parametrize("m", [toxicity, quality])
def test_scores_odd(m, odd_documents, no_documents):
    model = m.train(planted(80))
    out = m.score(odd_documents.withColumnRenamed("copies", "toxicity"), model)
    assert out.count() == odd_documents.count() and out.columns[:-1] == odd_documents.withColumnRenamed("copies", "toxicity").columns
    assert all(0 <= r[-1] <= 1 for r in out.collect()) and m.score(no_documents, model).count() == 0


def test_fit_without_labels(odd_documents, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for m in (toxicity, quality):
        assert m.score(odd_documents, m.fit(odd_documents, labels)).count() == odd_documents.count()
    some = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (7, 0, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    for m in (toxicity, quality):
        assert m.score(odd_documents, m.fit(odd_documents, some)).count() == odd_documents.count()


# --- token counts ---


def greedy(word, first, later):
    n = at = 0
    pieces = first
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        at, pieces, n = end, later, n + 1
    return n


def test_automaton_equals_greedy():
    rng = random.Random(0)
    for _ in range(200):
        piece = lambda: bytes(rng.choices(b"ab", k=rng.randint(1, 5)))
        first, later = {piece() for _ in range(rng.randint(1, 8))}, {piece() for _ in range(rng.randint(0, 8))}
        m = token_counts.LongestMatch(first, later)
        for _ in range(40):
            w = bytes(rng.choices(b"abc" if rng.random() < 0.1 else b"ab", k=rng.randint(1, 14)))
            assert m.count(w) == greedy(w, first, later), (w, first, later)


def test_counts_on_documents(spark, odd_documents, no_documents):
    first, later = map(set, token_counts.load_vocabulary())
    matcher = token_counts.LongestMatch(first, later)
    docs = read(spark, "/root/testdata/sf0.001", "documents").unionByName(odd_documents.drop("copies"))
    known = {}
    for r in token_counts.count_tokens(docs.select("text"), matcher).collect():
        words = (r.text or "").encode().split()
        counts = [known.setdefault(w, greedy(w, first, later)) for w in words]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(c or 1 for c in counts), sum(not c for c in counts))
    assert token_counts.count_tokens(no_documents, matcher).count() == 0
    clash = token_counts.count_tokens(docs.select("doc_id", "text").withColumnRenamed("doc_id", "n_words"), matcher)
    assert clash.columns == ["n_words", "text", "_n_words", "n_tokens", "n_unknown"]


def test_counts_equal_word_piece_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    first, later = ["un", "a", "b", "ab", "able", "unaff"], ["aff", "able", "a", "b", "ffa", "e", "l"]
    vocab = {x: i for i, x in enumerate(["[UNK]", *first, *["##" + x for x in later]])}
    t = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=1000))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    m = token_counts.LongestMatch([x.encode() for x in first], [x.encode() for x in later])
    rng = random.Random(2)
    for _ in range(500):
        w = "".join(rng.choices(["un", "aff", "able", "a", "b", "l", "e", "q"], k=rng.randint(1, 6)))
        assert (m.count(w.encode()) or 1) == len(t.encode(w).ids)


# --- language ---


def forward_backward(scores, trans):
    a, labels = np.exp(trans), scores.shape[1]
    v, f = np.full(labels, 1.0 / labels), []
    for x in np.exp(scores):
        v = (v @ a) * x
        v = v / v.sum()
        f.append(v)
    b, out = np.ones(labels), np.empty_like(scores)
    for t in range(len(scores) - 1, -1, -1):
        out[t] = f[t] * b / (f[t] @ b)
        b = a @ (np.exp(scores[t]) * b)
        b = b / b.max()
    return out


def test_marginals_equal_plain_recursion():
    rng = np.random.default_rng(0)
    counts = np.array([0, 1, 130, 64, 65, 0, 40])
    scores, trans = rng.normal(size=(300, 3)), rng.normal(size=(3, 3))
    got, pairs = language_crf.marginals(scores, counts, trans)
    at = 0
    for n in counts:
        if n:
            assert np.allclose(got[at : at + n], forward_backward(scores[at : at + n], trans))
        at += n
    assert pairs.sum() == pytest.approx(300)


def test_language_held_out(spark):
    rows = queries()["op9_language_crf"](spark, SF).join(read(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_code_switching(spark):
    docs = read(spark, SF, "documents").select("text", "lang").collect()
    rows = [(r.text, r.lang) for r in docs]
    model = language_crf.train(rows[:600])
    rng, right, total = random.Random(1), 0, 0
    for _ in range(30):
        (a, la), (b, lb) = rng.sample(rows[600:], 2)
        a, b = a.split()[:40], b.split()[:40]
        w, p = language_crf.label_words(model, [" ".join(a + b)])
        got = [model.labels[i] for i in p.argmax(axis=1)]
        right += sum(x == y for x, y in zip(got, [la] * len(a) + [lb] * len(b), strict=True))
        total += len(got)
    assert right / total > 0.93


def test_language_odd(odd_documents, no_documents, spark):
    model = language_crf.train([("the words of one language", "en"), ("die worte einer sprache", "de")] * 20)
    out = {r.doc_id: r for r in language_crf.predict(odd_documents, model).collect()}
    assert all(out[i].lang_pred == "und" for i in (2, 3, 4)) and out[1].lang_pred in ("en", "de")
    assert language_crf.predict(no_documents, model).count() == 0
    assert language_crf.predict(odd_documents, language_crf.fit(no_documents)).where("lang_pred <> 'und'").count() == 0
    assert language_crf.predict(odd_documents, language_crf.fit(odd_documents)).count() == odd_documents.count()


def test_und_without_letters():
    """A letter is a code point of a category L: not digits, number forms, signs or marks."""
    import unicodedata

    model = language_crf.train([("the words of one language", "en"), ("die worte einer sprache", "de"), ("слова одного языка", "ru")] * 20)
    texts = ["½ ²", "①", "Ⅻ", "— … –", "12 34", "٣٤", "😀 ©", "\u0301", "_", "µ", "ª º", "слова", "漢字", "x", "½ a", "Æ", "ʰ"]
    got, score = language_crf.predict_texts(model, texts)
    want = [any(unicodedata.category(c).startswith("L") for c in x) for x in texts]
    assert [g != "und" for g in got] == want and [s > 0 for s in score] == want
    w = language_crf.Words(["½ слова — x1 ② ªb"])
    assert w.has_letter.tolist() == [False, True, False, True, False, True]


def test_language_sample_does_not_depend_on_partitions(spark):
    rows = [(i % 40, f"words number {i} of a text", ["en", "de"][i % 2]) for i in range(400)] + [(None, f"no id {i}", "fr") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = (language_crf.fit(docs.repartition(n), language_crf.CrfConfig(per_language=5, epochs=1)) for n in (1, 7))
    assert a.labels == b.labels == ("de", "en", "fr") and np.array_equal(a.weights, b.weights)


def test_every_language_is_learned(spark):
    rng, rows = random.Random(3), []
    own = {f"l{k:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for k in range(70)}
    for lang, words in own.items():
        # l69 has long documents only
        rows += [(len(rows) + k, " ".join(rng.choices(words, k=7000 if lang == "l69" else 40)), lang) for k in range(12 if lang < "l60" else 8)]
    model = language_crf.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.labels == tuple(sorted(own))
    got, _ = language_crf.predict_texts(model, [" ".join(words) for words in own.values()])
    assert np.mean([a == b for a, b in zip(got, own, strict=True)]) > 0.9 and got[-1] == "l69"


# --- components and the join ---


def union_find(pairs, vertices):
    up = {v: v for v in vertices}

    def root(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {v: root(v) for v in vertices}


def test_components(spark):
    rng = random.Random(0)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    noise = [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(250)]
    pairs = [*chain, *star, *noise, (7, 7), (3, 2)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    vertices = {v for p in pairs for v in p if p[0] != p[1]} | set(got)
    assert got == {v: c for v, c in union_find(pairs, {v for p in pairs for v in p}).items() if v in vertices and v in got}
    assert set(got) >= {v for a, b in pairs if a != b for v in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(None, 1), (2, None)], "a long, b long")).count() == 0


def test_components_of_a_long_chain(spark):
    """Ten thousand links in the order of their ids: rounds are logarithmic."""
    got = components(spark.range(10_000).selectExpr("id AS a", "id + 1 AS b"))
    assert got.count() == 10_001 and got.where("component <> 0").count() == 0


def sets_of(docs):
    out = {}
    for i, text in docs.items():
        w = (text or "").encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def expected_components(docs):
    sets = sets_of(docs)
    having = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    links = []
    for i, s in sets.items():
        common = collections.Counter(j for x in s for j in having[x] if j < i)
        links += [(i, j) for j, n in common.items() if 100 * n >= 75 * (len(s) + len(sets[j]) - n)]
    return sets, union_find(links, sets)


def check_join(spark, docs, cfg=signature_join.JoinConfig()):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    sets, want = expected_components(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_join.linked_components(df, cfg).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in docs}


def test_join_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in read(spark, SF, "documents").select("doc_id", "text").collect()}
    check_join(spark, docs)


def test_join_of_edited_copies(spark):
    """Groups of copies with more and more edits around the threshold, small blocks and leaves."""
    rng = random.Random(4)
    docs, n = {}, 0
    for g in range(12):
        base = [f"g{g}w{rng.randrange(4000)}" for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(rng.choice([3, 25])):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 30) + 1)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            docs[n] = " ".join(w)
            n += 1
    shared = " ".join(f"common{i}" for i in range(60))
    for _ in range(80):
        docs[n] = shared + " " + " ".join(f"u{rng.randrange(10**7)}" for _ in range(rng.randint(1, 90)))
        n += 1
    check_join(spark, docs)
    check_join(spark, docs, signature_join.JoinConfig(block=16, leaf=4))


@pytest.mark.parametrize("cfg", [signature_join.JoinConfig(), signature_join.JoinConfig(block=16, leaf=4), signature_join.JoinConfig(exact=True, block=16), signature_join.JoinConfig(block_shingles=900)])
def test_join_returns_every_link(spark, cfg):
    rng, docs = random.Random(6), {}
    for g in range(3):  # groups of near copies: most links lie inside a component
        for _ in range(30):
            w = [f"g{g}w{k}" for k in range(120)]
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
            docs[len(docs)] = " ".join(w)
    docs[len(docs)] = docs[0]
    sets = sets_of(docs)
    want = {(i, j) for i in sets for j in sets if i < j and sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    out = signature_join.links(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3), cfg)
    rows = out.documents.collect()
    of = collections.defaultdict(list)
    for r in rows:
        of[bytes(r.digest)].append(r.doc_id)
    pairs = [(bytes(r.a), bytes(r.b)) for r in out.pairs().collect()]
    got = {tuple(sorted((x, y))) for a, b in pairs for x in of[a] for y in of[b]}
    assert len(want) > 1000 and got == want and len(pairs) == len(set(pairs))
    classes = collections.Counter(d for p in pairs for d in p)
    assert all(r.n_links == classes[bytes(r.digest)] for r in rows)


def test_traversal_finds_all_pairs():
    rng = np.random.default_rng(0)
    base = [set(rng.integers(0, 2**60, 80).tolist()) for _ in range(10)]
    sets = []
    for s in base:
        for _ in range(12):
            drop = set(rng.choice(sorted(s), int(rng.integers(0, 14)), replace=False).tolist())
            sets.append(np.array(sorted((s - drop) | set(rng.integers(0, 2**60, len(drop)).tolist())), np.uint64))
    cfg = signature_join.JoinConfig()
    bits = np.stack([np.frombuffer(signature_join.sketch(s, cfg)[0], "<u8") for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree = signature_join.SignatureTree(bits, sizes, leaf=4)
    found = {tuple(sorted(p)) for x, y in signature_join.traverse(tree, tree, 75) for p in zip(x.tolist(), y.tolist(), strict=True)}
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert true and true <= found and len(found) < 0.2 * len(sets) ** 2 / 2
    half = len(sets) // 2
    left, right = (signature_join.SignatureTree(bits[p], sizes[p], leaf=4) for p in (slice(0, half), slice(half, None)))
    cross = {(i, j + half) for x, y in signature_join.traverse(left, right, 75) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert {p for p in true if p[0] < half <= p[1]} <= cross


def test_long_sets_are_pruned():
    """Bitmaps grow with the sets: unrelated sets of thousands of shingles are excluded, near ones of
    two bitmap lengths are found."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**62, n).astype(np.uint64)) for n in [*range(3000, 3040), *range(20_000, 20_020)]]
    for n in (2030, 4080):  # copies on either side of a power of two
        base = rng.integers(0, 2**62, n).astype(np.uint64)
        sets += [np.unique(base), np.unique(np.r_[base, rng.integers(0, 2**62, 40).astype(np.uint64)])]
    cfg = signature_join.JoinConfig(leaf=4)
    maps, sizes = [signature_join.sketch(s, cfg)[0] for s in sets], np.array([len(s) for s in sets])
    assert len({len(m) for m in maps}) >= 4
    found = {tuple(sorted((int(i), int(j)))) for x, y in signature_join.survivors(maps, sizes, None, cfg) for i, j in zip(x, y, strict=True)}
    assert found == {(60, 61), (62, 63)}
    side = np.arange(len(sets)) % 2 == 1
    crossing = {tuple(sorted((int(i), int(j)))) for x, y in signature_join.survivors(maps, sizes, side, cfg) for i, j in zip(x, y, strict=True)}
    assert crossing == found


def test_prefixes_are_shared_by_linked_sets():
    """``exact``: no two sets at 75 % can have disjoint keys, whichever shingles differ."""
    cfg = signature_join.JoinConfig(exact=True)
    for n in (1, 2, 3, 4, 5, 7, 8, 100, 101, 102, 103):
        common = -(-75 * n // 100)  # a subset of n with J >= 0.75 lacks the smallest hashes
        s = np.arange(n, dtype=np.uint64)
        assert set(signature_join.sketch(s, cfg)[1]) & set(signature_join.sketch(s[n - common :], cfg)[1])


def test_join_without_ids(spark):
    """Null and repeated ids are found by their sets; every class is verified once."""
    copies = [" ".join(f"w{k}" if k != e else f"x{e}" for k in range(60)) for e in (0, 1, 2)]
    rows = [(None, c) for c in copies] + [(None, f"another text number {i} of six words") for i in range(40)] + [(5, copies[0] + " more"), (5, "one two three four five six seven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = signature_join.links(docs)
    got = collections.Counter((r.doc_id, r.n_links, r.component_id) for r in out.documents.collect())
    assert got == {(None, 3, 5): 3, (None, 0, None): 40, (5, 3, 5): 1, (5, 0, 5): 1}
    members = out.documents.select("digest", "doc_id").groupBy("digest").agg({"doc_id": "min"}).toDF("digest", "first_id")
    assert signature_join._sets(docs, members, signature_join.JoinConfig()).count() == 45


def test_hot_groups(spark):
    """Groups over ``hot_members`` are joined without moving their rows to one task, and give the same links."""
    docs = [(i, " ".join(f"w{k}" if k != i % 59 else f"x{i}" for k in range(60))) for i in range(70)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plain = signature_join.links(df, signature_join.JoinConfig(block=16)).documents
    hot = signature_join.links(df, signature_join.JoinConfig(block=16, hot_members=20)).documents
    exact = signature_join.links(df, signature_join.JoinConfig(block=16, hot_members=20, exact=True)).documents
    order = lambda d: sorted((r.doc_id, r.n_links, r.component_id) for r in d.collect())
    assert order(plain) == order(hot) == order(exact)


def test_join_odd(spark, odd_documents, no_documents):
    rows = signature_join.linked_components(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got[2] == (0, 2) and got[3] == (0, 3) and got[4] == (0, 4) and got[7][1] == 6 and got[9] == (1, 9)
    assert signature_join.linked_components(no_documents).count() == 0
