"""What the operators must do on all of their input."""

import collections
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from conftest import DATA
from test_operators import corpus, frame, linked, shingle_sets, words  # noqa: F401

from glyphlake.llm import decontam, jaccard, langid, lm, media, mixing, phrases, quality, suffix, toxicity
from glyphlake.llm.common import least


def test_language_model_learns_from_all_rows(spark, monkeypatch):
    """Also what no start document holds, in several shards, and alike however the rows are dealt."""
    monkeypatch.setattr(lm, "SHARD_WORDS", 500)
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["often", "seen"]) for _ in range(20)) for _ in range(100)] + ["often seen often", "quilt zebra violin"]
    docs = frame(spark, texts)
    few, more = ({r["doc_id"]: r["score"] for r in lm.score(d, fit=0).collect()} for d in (docs, docs.repartition(7)))
    assert few[100] > few[101] + 3 and few == more
    coder = lm.Subwords.at(lm.VOCABULARY)
    ids, bounds = lm.sequences(texts, coder)[:2]
    count, (pairs, triples) = np.bincount(ids, minlength=lm.IDS), lm.followers(ids, bounds, coder.opens)
    seen, x = lm.neighbours(count, *pairs)
    kind, E = lm.classes(seen, x, count), np.random.default_rng(1).normal(0, 1, (lm.IDS, lm.DIM)).astype(np.float32)
    p = lm.start()
    with open(lm.VOCABULARY, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    codes = lm.coded(docs.selectExpr("doc_id", "doc_id as rid", "text", "true as train"), ranks)
    new = lm.averaged(codes, p, E, kind, 3)
    memory = lm.Memory(lm.Counts(*pairs), lm.Counts(*triples), coder.opens)
    first, last = (lm.attended(lm.tables(x, E, kind, count, memory), ids, bounds)[0].sum() for x in (p, new))
    assert last > first


def test_language_model_beats_its_base(spark):
    """On held-out documents, a word, from about four million words on."""
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    r = lm.score(docs).where("held_out").selectExpr("sum(score) / sum(n_tokens)", "sum(base_score) / sum(n_tokens)").first()
    assert r[0] > r[1]


def test_front_bound_holds_for_all_sizes():
    """Linked sets have so many of the first shingles of both in common, however the other shingles fall."""
    for both in range(1, 400):
        for x in range(both // 4 + 1):
            for y in range(both // 4 + 1):
                if 100 * both >= 80 * (both + x + y):
                    a, b = both + x, both + y
                    common = min(both, jaccard.first(a) - x, jaccard.first(b) - y)
                    assert common >= max(jaccard.least_common(a), jaccard.least_common(b)) >= 1, (a, b)


def test_short_texts_are_linked(spark):
    """4 against 5 shingles and 9 against 11, in many hash orders."""
    texts = []
    for n, k in ((9, 1), (15, 2)):
        for i in range(60):
            w = [f"n{n}i{i}w{j}" for j in range(n)]
            texts += [" ".join(w), " ".join(w[:-k])]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link(frame(spark, texts)).collect()}
    assert got == dict(enumerate(linked(shingle_sets(texts)))) == {i: i - i % 2 for i in range(len(texts))}


def test_long_items_are_found(spark):
    rng = random.Random(13)
    items = [(n, " ".join(f"i{n}w{j}" for j in range(n))) for n in (40, 66, 130, 400, 1000)]
    filler = [" ".join(words(rng, 500)) for _ in items]
    texts = [f"{a[:700]} {t} {a[700:]}" for a, (_, t) in zip(filler, items)]
    texts += [" ".join(t.split()[: n // 4]) for n, t in items] + filler
    rows = decontam.contaminated(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(i, n) for i, (n, _) in enumerate(items)]
    assert all(r["question_overlap"] == 1 and r["answer_overlap"] == 1 for r in rows)


def test_language_of_a_text_does_not_depend_on_its_neighbours(spark):
    texts = ["the quick fox", "A.", "1 b", "über", "", "12"]
    all_, some = langid.Profiles().vectors(texts)
    assert some.tolist() == [True, True, True, True, False, False]
    for k, t in enumerate(texts):
        alone, has = langid.Profiles().vectors([t])
        assert np.array_equal(alone[0], all_[k]) and has[0] == some[k]
    docs = frame(spark, ["abc abd"] * 40 + ["A."], lang="en").coalesce(1)
    assert {r["lang_pred"] for r in langid.identify(docs).collect()} == {"en"}


@pytest.mark.parametrize("bad", [0.02, 0.1, 0.3, 0.5])
def test_weak_labels_keep_their_names(bad):
    """Votes drawn from known accuracies: the estimated share and posteriors tell the true classes."""
    rng = np.random.default_rng(int(bad * 100))
    good = rng.random(6000) >= bad
    right, says = np.array([0.9, 0.8, 0.75, 0.85, 0.7, 0.95, 0.5]), rng.random((6000, 7)) < 0.8
    vote = np.where(rng.random((6000, 7)) < right, 1, -1) * np.where(good, 1, -1)[:, None] * says
    patterns, which, n = np.unique(vote, axis=0, return_inverse=True, return_counts=True)
    post, p, share = quality.estimated(patterns, n.astype(float))
    assert abs(share - (1 - bad)) < 0.03 and ((post[which.ravel()] >= 0.5) == good).mean() > 0.95
    assert (p[:, 1, 2] >= p[:, 0, 2] - 1e-9).all() and (p[:, 0, 0] >= p[:, 1, 0] - 1e-9).all()


def test_quality_agrees_with_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs).join(labels.where("quality in (0, 1)"), "doc_id").select("score", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == y] for y in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.classify(docs, labels).where("held_out").join(labels.where("toxic in (0, 1)"), "doc_id").select("score", "toxic").collect()
    toxic, clean = ([r["score"] for r in rows if r["toxic"] == y] for y in (1, 0))
    assert len(toxic) >= 5 and np.mean([a > b for a in toxic for b in clean]) > 0.75 and np.mean(np.array(clean) < 0.5) > 0.9


def test_taken_words_equal_a_plain_mix(spark):
    """Slots are met with streams of words, word by word; each pass over a source takes each block once."""
    rng, block = random.Random(21), 16
    texts = [" ".join(words(rng, rng.randrange(0, 60))) for _ in range(150)] + [None]
    docs = frame(spark, texts + texts[:3], source=[["a", "a", "b", None][i % 4] for i in range(154)])
    docs = docs.unionByName(docs.where("doc_id in (1, 2, 150)"))
    base = mixing.sized(docs)
    stream = mixing.streamed(base).collect()
    slots = mixing.drawn(mixing.targets(base), block).collect()
    want = collections.Counter()
    for key in {r["key"] for r in stream}:
        at = {}
        for r in stream:
            if r["key"] == key:
                for k in range(r["size"]):
                    assert r["off"] + k not in at
                    at[r["off"] + k] = (r["doc_id"], r["off"])
        assert sorted(at) == list(range(len(at)))
        own = sorted((r["slot"], r["blk"], r["take"]) for r in slots if r["key"] == key)
        n = -(-len(at) // block)
        for turn in range(0, len(own), max(1, n)):
            assert len({b for _, b, _ in own[turn : turn + n]}) == len(own[turn : turn + n])
        for _, b, take in own:
            for k in range(b * block, min(b * block + take, len(at))):
                want[at[k]] += 1
    got = collections.Counter()
    for r in mixing.mix(docs, block=block).collect():
        got[r["doc_id"]] += r["taken"]
    each = collections.Counter()
    for (doc_id, _), c in want.items():
        each[doc_id] += c
    assert {k: v for k, v in got.items() if v} == dict(each)


def test_running_sums(spark):
    rng = random.Random(22)
    rows = [("k" + str(k), i, rng.randrange(9)) for k in range(2) for i in range(50) if rng.random() < 0.8]
    got = {(r["key"], r["i"]): r["begin"] for r in mixing.begun(spark.createDataFrame(rows, "key string, i long, v long"), "i", "v", 7).collect()}
    assert got == {(k, i): sum(v for k2, j, v in rows if k2 == k and j < i) for k, i, _ in rows}


FAMILIES = {
    "own tails": lambda rng: [" ".join([f"c{i}" for i in range(60)] + [f"o{k}x{i}" for i in range(40)]) for k in range(300)],
    "mixed parts": lambda rng: [" ".join(w for j in range(10) for w in [f"p{j}v{rng.randrange(3)}x{i}" for i in range(9)]) for _ in range(120)],
    "one head, chosen tails": lambda rng: [" ".join([f"c{i}" for i in range(60)] + [f"t{rng.randrange(4)}x{i}" for i in range(20)] + [f"u{rng.randrange(4)}x{i}" for i in range(20)]) for _ in range(150)],
    "chain": lambda rng: [" ".join(f"w{i}" for i in range(k * 3, k * 3 + 90)) for k in range(100)],
}


@pytest.mark.parametrize("family", FAMILIES)
def test_families_at_middle_distances(spark, monkeypatch, family):
    """Large cells end in few turns, the turns' rows never grow, and no link is lost."""
    monkeypatch.setattr(jaccard, "CELL_SETS", 30)
    monkeypatch.setattr(jaccard, "PIVOTS", 4)
    turns, plain = [], jaccard.all_links
    monkeypatch.setattr(jaccard, "all_links", lambda rows: plain(rows, turns))
    texts = FAMILIES[family](random.Random(31))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link(frame(spark, texts)).collect()}
    assert got == dict(enumerate(linked(shingle_sets(texts))))
    assert all(b <= a for a, b in zip(turns, turns[1:])) and len(turns) <= 16


def test_parts_of_a_cell_are_joined_whole(spark, monkeypatch):
    """The last resort alone, in parts of a few sets."""
    monkeypatch.setattr(jaccard, "CELL_SETS", 7)
    rng = random.Random(33)
    texts = [t for f in FAMILIES.values() for t in f(rng)[:40]]
    sets = [np.unique(s) for s in jaccard.shingles(texts)]
    rows = spark.createDataFrame([(1, k, len(s), bytearray(s.tobytes())) for k, s in enumerate(sets)], "cell long, sig long, n long, shingles binary")
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for r in jaccard.joined(rows).collect():
        a, b = sorted((find(r["u"]), find(r["v"])))
        root[b] = a
    assert [find(i) for i in range(len(texts))] == linked(shingle_sets(texts))


def bm25_by_hand(items, passages, share=0.5):
    """Every passage's score on every item over ``share`` of the item's own, with all words, from the formula alone."""
    terms = [collections.Counter(re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower())) for t in items]
    df, mean = collections.Counter(w for t in terms for w in t), sum(sum(t.values()) for t in terms) / len(terms)
    out = []
    for t in terms:
        n = sum(t.values())
        w = {x: np.log(1 + (len(items) - df[x] + 0.5) / (df[x] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) for x, tf in t.items()}
        out.append([sum(v for x, v in w.items() if x in p) / (share * sum(w.values())) for p in passages])
    return np.array(out).T


def test_search_finds_all_that_full_scores_find():
    """Recall 1 against scores with all words, for items from one template too, in any number of lots."""
    rng = random.Random(41)
    common = [f"c{i}" for i in range(12)]
    items = [" ".join(common + [f"t{rng.randrange(60)}" for _ in range(8)]) for _ in range(60)] + [" ".join(words(rng, 30)) for _ in range(40)] + ["solo", "two words"]
    passages = []
    for _ in range(300):
        own = rng.choice(items).split()
        passages.append({w for w in own if rng.random() < 0.6} | set(words(rng, 40)) | set(rng.sample(common, rng.randrange(13))))
    want = {(p, i) for p, i in zip(*np.nonzero(bm25_by_hand(items, passages) >= 1 - 1e-9))}
    assert len(want) > 100
    rows = list(enumerate(items))
    for size in (len(rows), 9):
        lots = [rows[a : a + size] for a in range(0, len(rows), size)]
        units = [decontam.Units(x) for x in lots]
        all_, got = decontam.Statistics(units), set()
        for lot, u in zip(lots, units):
            index = decontam.Index(lot, 0.5, u, all_)
            for p, own in enumerate(passages):
                n = index.numbers(decontam.word_hashes([" ".join(sorted(own))], lower=True, bare=True)[0])
                got |= {(p, index.ids[k]) for k, _ in index.search(np.unique(n[n >= 0]))}
        assert got == want


def test_items_with_short_questions_are_found(spark):
    rng = random.Random(43)
    items = [(1, "A edonnt.\n" + " ".join(f"a{i}" for i in range(40))), (2, "Why\n" + " ".join(f"b{i}" for i in range(9))), (3, "one two")]
    texts = [f"{' '.join(words(rng, 200))} {t} {' '.join(words(rng, 200))}" for _, t in items] + [" ".join(words(rng, 400))]
    rows = decontam.contaminated(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(0, 1), (1, 2), (2, 3)]


CLASHING = "doc_id long, text string, lang string, source string, rid string, __rid string, __RID_ string, __spans string, __lang string, __score string, spans string"


def test_clashing_names_repeated_rows_and_long_texts(spark):
    """Columns keep their values, rows that stand twice are rows of their own, and a text beyond a batch is read whole."""
    rng = random.Random(45)
    long = " ".join(words(rng, 600_000, 90_000))
    texts = [" ".join(words(rng, 80)) for _ in range(6)] + [long, None, ""]
    rows = [(i, t, "en", f"s{i % 2}", *(f"{c}{i}" for c in "abcdefg")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[1], rows[1]], CLASHING)
    bench = spark.createDataFrame([(1, texts[2]), (2, long[-300:])], "item_id long, text string")
    kept = decontam.clean(docs, bench).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 1, 1, 1, 3, 4, 5, 7, 8] and all(tuple(r) == rows[r["doc_id"]] for r in kept)
    kept = jaccard.one_of_each(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(9)) and all(tuple(r) == rows[r["doc_id"]] for r in kept)
    cut = suffix.cleaned(docs).collect()
    assert len(cut) == 11 and all(tuple(r)[2:] == rows[r["doc_id"]][2:] for r in cut)
    assert [r["text"] for r in cut if r["doc_id"] == 1] == [""] * 3 and [r["text"] for r in cut if r["doc_id"] == 6] == [long]
    assert all(r["n_removed"] == r["n_words"] == 80 for r in phrases.dedup(docs).where("doc_id = 1").collect())
    langs, protos = langid.learn(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name != "benchmark_items":
            assert stage(spark, docs, f"{DATA}/sf0.001").columns == docs.columns


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_stages_of_empty_tables(spark, stage):
    assert stage[1](spark, frame(spark, []), f"{DATA}/sf0.001").count() == 0


def test_automata_locate_the_phrases(spark, corpus, monkeypatch):  # noqa: F811
    """What the automata don't find isn't removed."""
    docs = frame(spark, corpus)
    assert phrases.dedup(docs).where("n_removed > 0").count() > 10
    monkeypatch.setattr(phrases, "compiled", lambda found: ({}, type("Blind", (), {"iter": lambda self, words: iter(())})()))
    assert phrases.dedup(docs).where("n_removed > 0").count() == 0


def test_located_runs_equal_a_plain_search():
    rng = random.Random(51)
    found = [" ".join(words(rng, rng.randrange(2, 6), 6)).encode() for _ in range(30)]
    numbers, automaton = phrases.compiled(found)
    text = [w.encode() for w in words(rng, 400, 8)]
    mark = [False] * len(text)
    for f in found:
        f = f.split(b" ")
        for i in range(len(text) - len(f) + 1):
            if text[i : i + len(f)] == f:
                mark[i : i + len(f)] = [True] * len(f)
    got = [False] * len(text)
    for a, b in phrases.located(text, numbers, automaton):
        got[a : b + 1] = [True] * (b + 1 - a)
    assert got == mark


@pytest.mark.parametrize("most", [0, 2, 1 << 13])
def test_parts_meet_the_store_by_either_way(spark, monkeypatch, most):
    """Media named often by broadcast, others by shuffle; parts without a medium keep their place."""
    monkeypatch.setattr(media, "HOT", most)
    parts = spark.createDataFrame([(i, d) for i, d in enumerate(["a"] * 9 + ["b"] * 3 + ["c", "none", None])], "doc_id long, digest string")
    store = spark.createDataFrame([("a", 1, 9), ("b", 2, 3), ("c", 3, 1), ("unnamed", 4, 1)], "digest string, medium int, copies long")
    got = sorted((r["doc_id"], r["digest"], r["medium"]) for r in media.resolve(parts, store).collect())
    assert got == [(i, d, {"a": 1, "b": 2, "c": 3}.get(d)) for i, d in enumerate(["a"] * 9 + ["b"] * 3 + ["c", "none", None])]


def test_least_hashes_of_each_key(spark):
    rng = random.Random(50)
    rows = [(rng.choice("aab"), rng.getrandbits(64) - 2**63, i) for i in range(4000)] + [("few", 2**63 - 1, 0), ("few", -(2**63), 1), ("ties", 5, 1), ("ties", 5, 2), ("ties", 5, 0), (None, 1, 1)]
    got = least(spark.createDataFrame(rows, "k string, h long, i int"), "k", "h", 2).collect()
    want = [r for k in ("a", "b", "few", "ties") for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:])[:2]]
    assert sorted(map(tuple, got)) == sorted(want)
    assert least(spark.createDataFrame([], "k string, h long"), "k", "h", 2).count() == 0
