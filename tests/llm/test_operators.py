"""The training-data operators against plain versions on small tables, with nulls, ties, copies and clashing columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from glyphlake.llm import decontam, jaccard, langid, lm, media, mixing, phrases, quality, repeats, suffix, toxicity

DOCS = "doc_id long, text string, lang string, source string, rid string, spans string"


def frame(spark, texts, lang="en", source=None):
    """Texts as documents, with columns whose names the operators use inside."""
    rows = [(i, t, lang if isinstance(lang, str) else lang[i], source[i] if source else f"s{i % 3}", "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, nulls, blanks, characters of several bytes, one long text."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}é" for i in range(60))
    base = [" ".join(words(rng, rng.randrange(1, 160))) for _ in range(30)]
    out = list(base) + base[:4] + base[:2]
    for t in base[:12]:
        w = t.split()
        w[rng.randrange(len(w))] = "edited"
        out.append(" ".join(w))
    out += [f"{' '.join(words(rng, 20))} {passage} {' '.join(words(rng, rng.randrange(30)))}" for _ in range(6)]
    out += [None, "", " \t\n", "a", "a", "A", "a b c d", "a b c d e", "x" * 500, "x" * 300, " ".join(words(rng, 5000))]
    return out


EMPTY = ["suffix", "phrases", "jaccard", "mixing", "langid", "quality", "toxicity", "lm", "media", "decontam"]


def applied(spark, name, docs, **more):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None)], "item_id long, text string")
    return {
        "suffix": lambda: suffix.dedup(docs),
        "phrases": lambda: phrases.dedup(docs),
        "jaccard": lambda: jaccard.link(docs),
        "mixing": lambda: mixing.mix(docs),
        "langid": lambda: langid.identify(docs),
        "quality": lambda: quality.classify(docs),
        "toxicity": lambda: toxicity.classify(docs, labels),
        "lm": lambda: lm.score(docs, fit=5),
        "media": lambda: media.media_columns(docs),
        "decontam": lambda: decontam.contaminated(docs, items),
    }[name]()


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables(spark, name):
    assert applied(spark, name, frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", EMPTY)
def test_nulls_in_every_column(spark, name):
    rows = [(None, None, None, None, None, None), (1, None, None, None, None, None), (None, "some text here", None, None, None, None), (2, "more text of its own", "en", "a", "x", "y")]
    got = applied(spark, name, spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == (0 if name == "decontam" else 4)


def windows(tokens, width):
    count = collections.Counter(tuple(t[i : i + width]) for t in tokens for i in range(len(t) - width + 1))
    marks = []
    for t in tokens:
        m = [False] * len(t)
        for i in range(len(t) - width + 1):
            if count[tuple(t[i : i + width])] > 1:
                m[i : i + width] = [True] * width
        marks.append(m)
    return marks


def test_suffix_equals_brute_force(spark, corpus):
    got = {r["doc_id"]: r for r in suffix.dedup(frame(spark, corpus)).collect()}
    raw = [(t or "").encode() for t in corpus]
    for i, (t, m) in enumerate(zip(raw, windows(raw, 200))):
        kept = bytes(b for b, gone in zip(t, m) if not gone)
        runs = sum(gone and not before for gone, before in zip(m, [False, *m]))
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), sum(m), runs, hashlib.sha256(kept).hexdigest())


def test_cleaned_text_is_valid(spark, corpus):
    rows = suffix.cleaned(frame(spark, corpus)).collect()
    assert len(rows) == len(corpus) and rows[0].asDict().keys() == {"doc_id", "text", "lang", "source", "rid", "spans"}
    assert all(r["text"] is None or r["text"].encode() is not None for r in rows)


def test_phrases_equal_brute_force(spark, corpus):
    got = {r["doc_id"]: r for r in phrases.dedup(frame(spark, corpus), shard=200, chunk=500).collect()}
    tokens = [(t or "").encode().split() for t in corpus]
    for i, (t, m) in enumerate(zip(tokens, windows(tokens, 35))):
        kept = b" ".join(w for w, gone in zip(t, m) if not gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(t), sum(m), hashlib.sha256(kept).hexdigest())


def shingle_sets(texts):
    out = []
    for t in texts:
        w = tuple((t or "").encode().lower().split())
        out.append({w[i : i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else {w} if w else set())
    return out


def linked(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("cell,pivots", [(4096, 64), (6, 3)])
def test_jaccard_equals_brute_force(spark, corpus, monkeypatch, cell, pivots):
    """Also with cells so small that pivots must divide them."""
    monkeypatch.setattr(jaccard, "CELL_SETS", cell)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    rng = random.Random(9)
    texts = list(corpus)
    for f in range(3):
        base = [f"f{f}_{i}" for i in range(60)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(60)] = f"z{rng.random()}"
            texts.append(" ".join(w))
    sets = shingle_sets(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(frame(spark, texts)).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, linked(sets)))}


def test_one_of_each(spark, corpus):
    kept = sorted(r["doc_id"] for r in jaccard.one_of_each(frame(spark, corpus)).collect())
    sets = shingle_sets(corpus)
    assert kept == sorted({c for c in linked(sets)})


def test_mixing(spark):
    rng = random.Random(2)
    texts = [" ".join(words(rng, rng.randrange(0, 300))) for _ in range(200)] + [None]
    source = [["big", "big", "b", "c", None, "tiny"][0 if i < 120 else i % 6] for i in range(201)]
    docs = frame(spark, texts, source=source)
    rows = mixing.mix(docs, block=64).collect()
    assert rows and sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(3), block=64).collect()))
    size, taken = collections.Counter(), collections.Counter()
    for r in rows:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["size"] == len((texts[r["doc_id"]] or "").split())
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, open_, left = {}, set(names), 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not over:
            goal |= {s: weight[s] * level for s in open_}
            break
        goal |= {s: 2 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        open_ -= over
    for r in rows:
        assert r["target"] == pytest.approx(goal[r["source"]]) and r["source_size"] == size[r["source"]]
    for s in names:
        assert abs(taken[s] - goal[s]) <= 1


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        df = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n), [F.lit(3)]).alias("p"))
        df = df.withColumn("back", mixing.permuted(F.col("p"), F.lit(n), [F.lit(3)], inverse=True))
        rows = df.collect()
        assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)


def test_media_round_trip(spark, corpus):
    got = {r["doc_id"]: r for r in media.media_columns(frame(spark, corpus)).collect()}
    assert len(got) == len(corpus)
    for i, t in enumerate(corpus):
        raw = (t or "").encode()
        payload = raw + b" " * (192 - len(raw) % 192 if len(raw) % 192 or not raw else 0)
        stored = media.to_png(payload)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert media.from_png(stored) == payload and r["position"] == 1 and r["caption"] == f"document {i}"
    with pytest.raises(ValueError):
        media.from_png(stored[:60] + b"\0" + stored[61:])


def test_interleaved_order(spark):
    page = "<p>one<img src='sha256:aa' alt='first'>two</p><figure><img src='sha256:bb'><figcaption>cap <b>two</b></figcaption></figure><script>no</script>three"
    assert media.parse(page) == [["text", "one", None, None], ["media", None, "aa", "first"], ["text", "two", None, None], ["media", None, "bb", "cap two"], ["text", "three", None, None]]
    assert media.parse(None) == []
    pages = spark.createDataFrame([(1, page), (2, None)], "id long, html string")
    store = spark.createDataFrame([("bb", 7)], "digest string, media_bytes int")
    rows = media.resolve(media.references(media.sequences(pages, ["id"])), store).orderBy("id", "position").collect()
    assert [(r["position"], r["kind"], r["media_bytes"]) for r in rows] == [(0, "text", None), (1, "media", None), (2, "text", None), (3, "media", 7), (4, "text", None)]


def test_languages(spark):
    rng = random.Random(3)
    parts = {"aa": ["the", "ing", "er", "tion"], "bb": ["sch", "ung", "keit", "über"], "cc": ["eau", "oi", "è", "que"]}
    texts, lang = [], []
    for k in range(240):
        lang.append(sorted(parts)[k % 3])
        texts.append(" ".join("".join(rng.choices(parts[lang[-1]], k=3)) for _ in range(20)))
    texts += ["123 !!", None]
    rows = {r["doc_id"]: r for r in langid.identify(frame(spark, texts, lang=[*lang, "aa", "aa"])).collect()}
    held = [i for i in range(240) if rows[i]["held_out"]]
    assert held == [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(rows[i]["lang_pred"] == lang[i] for i in held) >= 0.95 * len(held)
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (240, 241))
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_language_batches_agree():
    p, q = langid.Profiles(), langid.Profiles(keep=50)
    texts = ["the quick brown fox", "über straße", "x", "", None, "1 2 3", "été où"]
    a, b = p.vectors(texts), q.vectors(texts)
    assert (a[1] == b[1]).all() and np.allclose(a[0], b[0])


def test_window_search_equals_full_scores():
    rng = np.random.default_rng(1)
    items = [(i, " ".join(f"t{x}" for x in rng.zipf(1.3, 30) % 500)) for i in range(120)] + [(500, "!!"), (501, "solo")]
    index = decontam.Index(items, 0.5)
    for _ in range(200):
        own = np.unique(rng.choice(len(index.terms), rng.integers(1, 80)))
        total = np.zeros(len(items))
        for t in own:
            np.add.at(total, index.item[index.start[t] : index.start[t + 1]], index.impact[index.start[t] : index.start[t + 1]])
        want = {i for i in range(len(items)) if total[i] >= 1 - 1e-9}
        assert {i for i, _ in index.reached(own)} == want


def test_decontamination(spark, monkeypatch):
    rng = random.Random(7)
    items = [(i, " ".join(f"q{i}x{k}" if k % 2 else "the" for k in range(40))) for i in range(30)]
    texts = [" ".join(words(rng, 300)) for _ in range(20)]
    texts[3] = texts[3][:500] + " " + items[5][1].upper() + ". " + texts[3][500:]
    texts[8] = items[9][1]
    texts[9] = " ".join(items[2][1].split()[:14])  # a small part only
    docs = frame(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for lot in (512, 7):
        assert sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench, lot=lot).collect()) == [(3, 5), (8, 9)]
    monkeypatch.setattr(decontam, "INDEX_BYTES", 1)  # a read for each lot
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench, lot=7).collect()) == [(3, 5), (8, 9)]
    monkeypatch.undo()
    kept = decontam.clean(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(20) if i not in (3, 8)] and kept.columns == docs.columns


def test_weak_labels(spark):
    rng = random.Random(1)
    good = [" ".join(words(rng, 60)).capitalize() + "." for _ in range(80)]
    bad = [" ".join(w + "%%%" for w in words(rng, 60)) for _ in range(15)] + [" | ".join(words(rng, 60)) for _ in range(10)]
    rows = {r["doc_id"]: r for r in quality.classify(frame(spark, good + bad + [None, ""])).collect()}
    assert sum(rows[i]["keep"] for i in range(80)) >= 76 and not any(rows[i]["keep"] for i in range(80, 107))


def test_toxicity_learns():
    rng = random.Random(4)

    def text(toxic):
        w = words(rng, 60, 80)
        for _ in range(3 * toxic):
            w[rng.randrange(len(w))] = rng.choice(["idiot", "scum", "Moron!"])
        return " ".join(w)

    labels = np.array([i % 3 == 0 for i in range(240)], int)
    p = toxicity.trained([text(y) for y in labels], labels)
    new = [text(y) for y in labels[:90]] + ["", None]
    score = toxicity.probability(p, toxicity.Words(new, p["known"]), len(new))
    assert ((score[:90] >= 0.5) == labels[:90]).mean() > 0.9 and ((score >= 0) & (score <= 1)).all()


def test_gradients():
    """Against differences of the loss."""
    rng = np.random.default_rng(0)
    texts = ["a b c idiot", "the fox", ""]
    seen = toxicity.Words(texts)
    data = toxicity.Words(texts, np.sort(seen.distinct))
    p = {k: v.astype(np.float64) for k, v in toxicity.start(rng, len(seen.distinct)).items()}
    y, own, one = np.array([1.0, 0.0, 1.0]), np.arange(3), np.ones(3)

    def loss():
        z = toxicity.logits(p, data, own, data.inputs(p)).astype(np.float64)
        return (np.log1p(np.exp(z)) - y * z).mean()

    g, sparse = toxicity.gradients(p, data, own, y, one)
    for k in ("A", "u", "o", "z", "Wf", "Uf", "cf", "Wb", "Ub", "cb"):
        at = tuple(0 for _ in p[k].shape)
        keep, e = p[k][at], 1e-2
        p[k][at] = keep + e
        up = loss()
        p[k][at] = keep - e
        assert (up - loss()) / (2 * e) == pytest.approx(g[k][at], abs=2e-3)
        p[k][at] = keep
    assert set(sparse) == {"word", "tri"}


def test_language_model(spark, corpus):
    rows = {r["doc_id"]: r for r in lm.score(frame(spark, corpus), fit=10).collect()}
    tokens = [[*(t or "").encode().lower().split(), None] for t in corpus]
    train = [i for i in range(len(corpus)) if zlib.crc32(str(i).encode()) % 5 != 1]
    count = collections.Counter(w for i in train for w in tokens[i])
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(tokens):
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in train, len(t), sum(count[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r["score"] < 0


def test_rare_words_meet_their_counts(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 8)
    few = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in lm.score(frame(spark, corpus), fit=5).collect()}
    monkeypatch.undo()
    all_ = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in lm.score(frame(spark, corpus), fit=5).collect()}
    assert few == all_


def test_rare_pairs_and_triples_meet_their_counts(spark, corpus, monkeypatch):
    """Whatever is sent to all executors, every pair and triple counts."""
    docs = frame(spark, [*corpus, *["antidisestablishmentarianism unquestionableness", "counterrevolutionaries"] * 3])
    scored = lambda: {r["doc_id"]: r["score"] for r in lm.score(docs, fit=5).collect()}
    all_ = scored()
    for kept in (0, 300):
        monkeypatch.setattr(lm, "KEPT", kept)
        assert scored() == pytest.approx(all_, rel=1e-6)


def test_each_token_is_scored_once():
    for n in (1, 2, 15, 16, 17, 24, 25, 100):
        bounds = np.array([0, n, n + 3])
        _, goal, scored = lm.windows(np.arange(n + 3), bounds)
        assert sorted(goal[scored].tolist()) == list(range(n + 3))


def small_model(seed=2, n=2000):
    rng, opens = np.random.default_rng(seed), np.arange(lm.IDS) % 3 == 0
    opens[lm.END] = True
    ids = np.append(rng.zipf(1.3, n) % 300, lm.END)
    return lm.trained(ids, np.array([0, len(ids)]), opens, epochs=1), ids, opens


def test_model_is_a_distribution():
    model, _, _ = small_model()
    # all continuations of some contexts, each as a text of its own
    for context in ([5], [6, 7], [3, 7, 8], [3, 1, 2, 4]):
        total, n = 0.0, len(context)
        for part in np.array_split(np.arange(lm.IDS), 20):
            seq = np.concatenate([np.tile(context, (len(part), 1)), part[:, None]], axis=1).ravel()
            first = lm.scores(model, np.array(context), np.array([0, n]))[0]
            total += np.exp(lm.scores(model, seq, np.arange(0, len(seq) + 1, n + 1)) - first).sum()
        assert total == pytest.approx(1, abs=1e-3)


def test_scores_equal_a_plain_model():
    """Token by token: attention over the window, classes, shares, pairs and triples."""
    model, ids, opens = small_model()
    pairs, triples = collections.Counter(), collections.Counter()
    seq = ids.tolist()
    for i, x in enumerate(seq):
        one = seq[i - 1] if i else lm.END
        pairs[one, x] += 1
        if not opens[one]:
            triples[seq[i - 2], one, lm.END if opens[x] else x] += 1
    kind, count_of = model["kind"], np.bincount(ids, minlength=lm.IDS)
    class_of = np.bincount(kind, count_of + 0.02, lm.CLASSES)

    def mixed(n, context, p):
        same = {k[-1]: v for k, v in n.items() if k[:-1] == context}
        if same:
            p = p * len(same)
            for x, v in same.items():
                p[x] += v
            p /= sum(same.values()) + len(same)
        return p

    def plain(text):
        inputs, out = [lm.END, *text[:-1]], 0.0
        for i, x in enumerate(text):
            k = max(0, -(-(i - lm.WINDOW + 1) // lm.STRIDE))  # its window
            own = inputs[k * lm.STRIDE : i + 1]
            s = [float(model["Q"][own[-1]] @ model["K"][j]) + float(model["b"][len(own) - 1 - m]) for m, j in enumerate(own)]
            w = np.exp(np.array(s) - max(s))
            y = model["R"][own[-1]] + (w / w.sum()) @ model["V"][own]
            z = np.exp(y @ model["O"] + model["o"])
            p = z[kind] / z.sum() * (count_of + 0.02) / class_of[kind]
            p = mixed(pairs, (inputs[i],), p)
            if not opens[inputs[i]]:
                events = np.where(opens, 0, p)
                events[lm.END] = p[opens].sum()
                events = mixed(triples, (inputs[i - 1], inputs[i]), events)
                p = np.where(opens, p * events[lm.END] / p[opens].sum(), events)
            out += np.log(p[x])
        return out

    rng = np.random.default_rng(5)
    texts = [[*(rng.zipf(1.3, n) % 320).tolist(), lm.END] for n in (0, 1, 14, 15, 16, 17, 40, 75)]
    got = lm.scores(model, np.concatenate([np.array(t) for t in texts]), np.cumsum([0, *map(len, texts)]))
    assert got == pytest.approx([plain(t) for t in texts], rel=1e-4)


def test_language_model_gradients():
    """Against differences of the loss."""
    rng = np.random.default_rng(4)
    p = {k: v.astype(np.float64) for k, v in lm.start().items()}
    E, src = rng.normal(0, 1, (30, lm.DIM)), rng.integers(0, 30, (3, lm.WINDOW))
    want, use = rng.integers(0, lm.CLASSES, src.shape), rng.random(src.shape) < 0.8

    def loss():
        Q, K, V, R = np.split(E[src] @ p["W"], 4, axis=2)
        A = lm.softmax(Q @ K.transpose(0, 2, 1) * lm.DIM**-0.5 + p["b"][lm._BACK] + lm._MASK)
        D = lm.softmax((R + A @ V) @ p["O"] + p["o"])
        return -(np.log(np.take_along_axis(D, want[..., None], 2)[..., 0]) * use).sum() / use.sum()

    g = lm.gradients(p, E, src, want, use)
    for k, at in [("W", (1, c * lm.DIM + 2)) for c in range(4)] + [("O", (2, 3)), ("o", (1,)), ("b", (2,))]:
        keep = p[k][at]
        p[k][at] = keep + 1e-3
        up = loss()
        p[k][at] = keep - 1e-3
        assert (up - loss()) / 2e-3 == pytest.approx(g[k][at], abs=2e-4)
        p[k][at] = keep


def test_counts_by_code():
    rng = np.random.default_rng(6)
    code, n = np.unique(rng.integers(0, 1 << 40, 5000)), None
    n = rng.integers(1, 99, len(code))
    found = lm.Counts(code, n)
    assert (found.n[found.find(code)] == n).all() and (found.n[found.find(code[1:] - (np.diff(code) > 1))][np.diff(code) > 1] == 0).all()
    assert lm.Counts(code[:0], n[:0]).n[lm.Counts(code[:0], n[:0]).find(code)].sum() == 0


def test_runs_cover_all_windows():
    rng = np.random.default_rng(3)
    grain = repeats.Grain("bytes", 20, 8)
    tokens, bounds = rng.integers(97, 101, 400).astype(np.uint8), np.array([0, 5, 150, 150, 400])
    lo, hi, gram, h, whole = repeats.runs(tokens, bounds, grain)
    got = sorted(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)]).tolist())
    assert got == [i for a, b in zip(bounds, bounds[1:]) for i in range(a, b - 19)]
    assert ((gram >= hi) & (gram + 8 <= lo + 20)).all() and len(h) == len(whole) == len(lo)
