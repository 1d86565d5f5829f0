"""Classifiers, sampling: held-out accuracy, distributions, awkward rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import ROWS, documents, ids
from pyspark.sql import functions as F

from crownlake.llm import sampling, toxicity
from crownlake.llm.queries import tokenizer_file
from crownlake.llm.rule_ensemble import fit_quality, fit_rules, keep_quality, score_quality, text_statistics
from crownlake.llm.sampling import SPACE, Decoder, Draws, Sampler, decode_ids, encode_text, sampled_segmentations
from crownlake.llm.toxicity import calibrate, drop_toxic, fit_toxicity, score_toxicity

#: As in real texts, a word stands after many different ones.
WORDS = [a + b for a in "the of re tion ing er ho ri sto wal gre pa nig sev".split() for b in "a en ou ly st ble".split()]


def corpus(n, spoil, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = rng.choices(WORDS, k=rng.randint(20, 80))
        bad = rng.random() < 0.3
        out.append((k, spoil(words, rng) if bad else " ".join(words), int(bad)))
    return out


@pytest.fixture(scope="module")
def quality(spark):
    rows = corpus(400, lambda w, rng: " | ".join(x + "$$$" for x in w), 1)
    docs = documents(spark, [r[:2] for r in rows])
    return docs, spark.createDataFrame([(k, 1 - b, 0) for k, _, b in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"), {k: 1 - b for k, _, b in rows}


@pytest.fixture(scope="module")
def toxic(spark):
    def spoil(words, rng):
        for _ in range(4):
            words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", "moron"])
        return " ".join(words)

    rows = corpus(600, spoil, 2)
    docs = documents(spark, [r[:2] for r in rows])
    return docs, spark.createDataFrame([(k, 0, b) for k, _, b in rows], "doc_id long, quality int, toxic int"), {k: b for k, _, b in rows}


def test_quality_on_held_out_rows(quality):
    docs, labels, truth = quality
    model = fit_quality(docs, labels)
    rows = [r for r in score_quality(docs, model).collect() if r.held_out]
    assert rows and np.mean([r.predicted == truth[r.doc_id] for r in rows]) > 0.95
    kept = keep_quality(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in score_quality(docs, model).collect() if r.predicted}
    # the compiled columns are the model
    names = model.names
    x = docs.select(*(c.alias(n) for n, c in text_statistics(docs["text"]).items()), "doc_id").toPandas().sort_values("doc_id")
    scores = {r.doc_id: r.score for r in score_quality(docs, model).collect()}
    assert np.allclose(model.predict(x[names].to_numpy(float)), [scores[k] for k in x["doc_id"]])


def test_quality_on_awkward_rows(spark, quality):
    docs, labels, _ = quality
    model = fit_quality(docs, labels)
    rows = score_quality(documents(spark), model).collect()
    assert ids(rows) == ids(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert score_quality(documents(spark, []), model).count() == 0
    empty = fit_quality(documents(spark, []), labels.filter("false"))
    assert all(r.score == pytest.approx(0.5) for r in score_quality(documents(spark), empty).collect())


def test_toxicity_of_phrases_and_joined_values(spark, monkeypatch):
    """Expressions of common words, and a rare word in a fixed phrase, count; what is broadcast changes nothing."""

    def spoil(words, rng):
        for _ in range(3):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([["ren", "paly"], ["gutter", "zworm"]])
        return " ".join(words)

    rows = corpus(600, spoil, 3)
    rows = [(k, t if b else t + " ren wallou paly gutter", b) for k, t, b in rows]
    docs = documents(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(k, 0, b) for k, _, b in rows], "doc_id long, quality int, toxic int")
    scores = {}
    for head in (toxicity.HEAD, 3):
        monkeypatch.setattr(toxicity, "HEAD", head)
        model = fit_toxicity(docs, labels)
        assert (model.live is None) == (head > 3)
        scores[head] = {r.doc_id: r.score for r in score_toxicity(docs, model).collect()}
    plain, joined = scores.values()
    assert plain == pytest.approx(joined, abs=1e-12)
    held = [(plain[k] >= 0.3) == bool(b) for k, _, b in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert held and np.mean(held) > 0.95
    # words and bigrams of all training folds are in the model, the rare ones too
    assert {"zworm", "gutter", "ren"} <= set(model.words)
    names = {r.name for r in model.entries.collect()}
    assert "ren paly" in names


def test_rules_are_sparse_and_exact():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.3)).astype(float)
    model = fit_rules(x, y, list("abcde"))
    assert np.mean((model.predict(x) > 0.5) == y) > 0.98 and len(model.rules) < 150


def test_toxicity_on_held_out_rows(toxic):
    docs, labels, truth = toxic
    model = fit_toxicity(docs, labels)
    rows = [r for r in score_toxicity(docs, model).collect() if r.held_out]
    assert rows and np.mean([r.predicted == truth[r.doc_id] for r in rows]) > 0.95
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.filter("mean = 'm'").count() == kept.count()
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in score_toxicity(docs, model).collect() if not r.predicted}
    # probabilities of each level are a distribution over its words
    stem = np.array([w.startswith("\x00") for w in sorted(model.words)])
    assert (model.p[~stem].sum(axis=0) <= 1 + 1e-9).all()


def brute_kneser_ney(rows):
    """The model's formulas over (words, label) rows, in plain Python: a function from (before, word) to the log ratio."""
    kinds = (1, 0)
    contexts = {y: {} for y in kinds}
    for words, y in rows:
        for u, v, w in zip(["", "", *words], ["", *words], words, strict=False):
            contexts[y].setdefault((v, w), set()).add(zlib.crc32(u.encode()) % toxicity.CONTEXTS)
    n = {y: {g: len(c) for g, c in contexts[y].items()} for y in kinds}
    grams = set(n[0]) | set(n[1])
    both = Counter(w for _, w in grams)
    stem_both = Counter()
    for w, k in both.items():
        stem_both[w[: toxicity.STEM]] += k
    word = {y: Counter(w for _, w in n[y]) for y in kinds}
    stem = {y: Counter() for y in kinds}
    for y in kinds:
        for w, k in word[y].items():
            stem[y][w[: toxicity.STEM]] += k
    size = {y: sum(word[y].values()) for y in kinds}
    grow = {y: max(1.0, size[y] / min(size.values())) for y in kinds}

    def p(y, v, w):
        s, total = w[: toxicity.STEM], size[y]
        d = toxicity.STEM_DISCOUNT * grow[y]
        ps = max(stem[y][s] - d, 0) / total + sum(min(k, d) for k in stem[y].values()) / total * stem_both[s] / (sum(both.values()) + 1)
        d = toxicity.WORD_DISCOUNT * grow[y]
        pw = max(word[y][w] - d, 0) / total + sum(min(k, d) for k in word[y].values()) / total * ps * both[w] / (stem_both[s] + 1)
        after = [k for (x, _), k in n[y].items() if x == v]
        if not after:
            return pw
        d = toxicity.BIGRAM_DISCOUNT
        return max(n[y].get((v, w), 0) - d, 0) / sum(after) + sum(min(k, d) for k in after) / sum(after) * pw

    return lambda v, w: math.log(p(1, v, w) / p(0, v, w))


@pytest.mark.parametrize(("head", "late"), [(toxicity.HEAD, False), (5, True)])
def test_ratios_equal_brute_force(spark, monkeypatch, head, late):
    """On a small vocabulary, where all levels have counts beyond their discounts."""
    monkeypatch.setattr(toxicity, "HEAD", head)
    rng = random.Random(9)
    few = "the of ation ating her hero hers on onto wall walled green greens paper night sever idiot scum".split()
    rows = []
    for k in range(160):
        bad = int(k % 4 == 0)
        rows.append((k, rng.choices(few if bad else few[:-2], k=rng.randint(5, 60)), bad))
    labelled = spark.createDataFrame([(" ".join(w), y, 0) for _, w, y in rows], "t string, y int, late int").withColumn("late", F.col("late") + (F.length("t") % 2 if late else F.lit(0)))
    grams = toxicity.count_bigrams(labelled)
    model = toxicity.build_model(grams, toxicity.count_words(grams), late)
    assert model.entries.filter("name not like '\\0%'").count() > 20
    ratio = brute_kneser_ney([(w, y) for _, w, y in rows])
    texts = documents(spark, [(k, " ".join(w)) for k, w, _ in rows])
    for r in toxicity.evidence(texts, model, "doc_id").collect():
        words = rows[r.k][1]
        x = [ratio(v, w) for v, w in zip(["", *words], words, strict=False)]
        over = [max(v - toxicity.EXCESS, 0) for v in x]
        halves = [sum(over[a : a + toxicity.HALF]) for a in range(0, len(over), toxicity.HALF)] + [0]
        window = max(a + b for a, b in zip(halves, halves[1:], strict=False)) / (2 * toxicity.HALF)
        expected = [np.mean(x), math.log1p(toxicity.SCALE * np.mean(over)), math.log1p(toxicity.SCALE * window), math.log1p(len(x))]
        assert [r[f] for f in toxicity.FEATURES] == pytest.approx(expected, abs=1e-6) and r.ratio == pytest.approx(np.mean(x), abs=1e-8)


@pytest.mark.parametrize("keys", [toxicity.TASK_KEYS, 7])
def test_all_contexts_of_a_bigram_count(spark, monkeypatch, keys):
    monkeypatch.setattr(toxicity, "TASK_KEYS", keys)
    rows = [(f"w{k} red fox", k % 3 == 0, k % 2) for k in range(60)] + [("w3 red fox", 0, 0), ("w0 red fox", 1, 1), ("red fox", 1, 1)]
    labelled = spark.createDataFrame([(t, int(y), late) for t, y, late in rows], "t string, y int, late int").repartition(3)
    got = {(r.v, r.w): r for r in toxicity.count_bigrams(labelled).collect()}
    for late in (0, 1):
        for y, x in ((1, "toxic"), (0, "ordinary")):
            own = {t.removesuffix("red fox") for t, label, at in rows if label == y and at <= late}
            assert got["red", "fox"][f"{x}{late}"] == len(own) > 9
    assert got["", "red"].toxic0 == 0 and got["", "red"].toxic1 == 1 and len(got) == 122


def test_contexts_are_told_apart_by_their_words(spark):
    """These two have the same blake2b hash modulo 2 ** 48."""
    labelled = spark.createDataFrame([("w14920866 red fox", 1, 0), ("w20473729 red fox", 1, 0)], "t string, y int, late int")
    (row,) = toxicity.count_bigrams(labelled).filter("v = 'red' and w = 'fox'").collect()
    assert (row.toxic0, row.ordinary0, row.toxic1, row.ordinary1) == (2, 0, 2, 0)


def test_counting_with_few_numbers_and_buckets(spark, monkeypatch):
    """A task passes on what it holds when it has no numbers left, within a text too."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"v{k}é" for k in range(40)], k=rng.randint(0, 90))) for _ in range(60)]
    labelled = spark.createDataFrame([(t, k % 2, k % 3 // 2) for k, t in enumerate(texts)], "t string, y int, late int")
    whole = sorted(toxicity.count_bigrams(labelled).collect())
    contexts = {}
    for t in texts:
        words = t.split()
        for u, v, w in zip(["", "", *words], ["", *words], words, strict=False):
            contexts.setdefault((v, w), set()).add(u)
    assert {(r.v, r.w) for r in whole} == set(contexts) and all(max(r.toxic1, r.ordinary1) <= len(contexts[r.v, r.w]) <= r.toxic1 + r.ordinary1 for r in whole)
    monkeypatch.setattr(toxicity, "NUMBER_BITS", 6)
    monkeypatch.setattr(toxicity, "TASK_KEYS", 50)
    monkeypatch.setattr(toxicity, "BUCKET_BYTES", 1000)
    assert sorted(toxicity.count_bigrams(labelled).collect()) == whole


def test_words_and_bigram_hashes_by_arrays():
    texts = ["".join(map(chr, range(128))), "A_b-C9 d", "", "Ünï_cödé İx"]
    assert [toxicity.words_of(t) for t in texts] == [toxicity._WORD.findall(t.lower()) for t in texts]
    words = ["", "a", "é日", "x" * 63, "x" * 64, "ß" * 40, "y" * 300]
    head = toxicity.Head.of(pa.table({"name": pa.array([], pa.string()), "value": pa.array([], pa.int64())}))
    lexicon = toxicity._Lexicon(head, np.full(toxicity.FILTER_BITS // 8, 255, np.uint8), 0)
    lexicon.learn(words[1:])
    v, w = (x.ravel() for x in np.meshgrid(range(len(words)), range(len(words))))
    assert lexicon.pair_crc(v, w).tolist() == [zlib.crc32(f"{words[a]} {words[b]}".encode()) for a, b in zip(v, w, strict=True)]


def test_toxicity_on_awkward_rows(spark, toxic):
    docs, labels, _ = toxic
    model = fit_toxicity(docs, labels)
    rows = score_toxicity(documents(spark), model).collect()
    assert ids(rows) == ids(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert score_toxicity(documents(spark, []), model).count() == 0
    blank = fit_toxicity(documents(spark, []), labels.filter("false"))
    assert all(0 <= r.score <= 1 for r in score_toxicity(documents(spark), blank).collect())


def test_calibration_separates():
    x = np.array([[0.0, 0, 1], [0.1, 0, 2], [2.0, 1, 1], [2.2, 1, 2]] * 10)
    w = calibrate(x, np.array([0, 0, 1, 1.0] * 10))
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert (p[2::4] > 0.9).all() and (p[0::4] < 0.1).all()


# ---- sampled segmentations --------------------------------------------------------------------------


def word_paths(sampler, word):
    """All segmentations of a word and their probabilities, from the pieces alone."""
    ends = [[((), 0.0)]] + [[] for _ in word]
    for i in range(len(word)):
        arcs = [(j, (sampler.pieces[word[i:j]][0],), sampler.theta * sampler.pieces[word[i:j]][1]) for j in range(i + 1, len(word) + 1) if word[i:j] in sampler.pieces]
        if word[i] not in sampler.pieces:
            raw = word[i].encode()
            arcs.append((i + 1, tuple(int(sampler.bytes[b]) for b in raw), sampler.theta * sampler.byte_score * len(raw)))
        for j, more, s in arcs:
            ends[j] += [(p + more, lp + s) for p, lp in ends[i]]
    total = math.log(sum(math.exp(lp) for _, lp in ends[-1]))
    return {p: math.exp(lp - total) for p, lp in ends[-1]}


def paths(sampler, text):
    """All segmentations and their probabilities."""
    out = {(): 1.0}
    for word in sampler.words(text):
        out = {p + q: a * b for p, a in out.items() for q, b in word_paths(sampler, word).items()}
    return out


def test_long_texts_follow_the_model():
    """500 characters, whose segmentations have probabilities far below e**-45: each of the k has the model's words."""
    sampler = Sampler(tokenizer_file("piece_bpe_32k.model"), 0.5)
    text = " ".join("tionhe wasand theing 日本 lyer oning".split() * 16)
    words = sampler.words(text)
    exact = {w: word_paths(sampler, w) for w in set(words)}
    n, k = 150, 3
    seen = [Counter() for _ in range(k)]
    for got in sampler.sample_all([text] * n, k, [Draws(seed, "long") for seed in range(n)]):
        assert len({i.tobytes() for i, _, _ in got}) == k and max(lp for _, lp, _ in got) < -45
        for turn, (ids, log_p, inclusion) in enumerate(got):
            assert 0 < inclusion <= 1
            ids, at, total = tuple(ids.tolist()), 0, 0.0
            for w in words:  # the word's segmentation is the one that the ids go on with and that spells it
                size = next(m for m in range(1, len(ids) - at + 1) if ids[at : at + m] in exact[w])
                seen[turn][w, ids[at : at + size]] += 1
                total += math.log(exact[w][ids[at : at + size]])
                at += size
            assert at == len(ids) and total == pytest.approx(log_p, rel=1e-9)
    for counts in seen:
        chi, free = 0.0, 0
        for w, share in exact.items():
            size = n * words.count(w)
            cells = [(counts[w, p], size * q) for p, q in share.items() if size * q >= 5]
            cells.append((size - sum(c for c, _ in cells), size - sum(e for _, e in cells)))
            chi += sum((c - e) ** 2 / e for c, e in cells if e > 1)
            free += sum(e > 1 for _, e in cells) - 1
        assert chi < free + 5 * math.sqrt(2 * free)


def test_sampling_follows_the_model():
    sampler = Sampler(tokenizer_file("piece_bpe_32k.model"), 1.0)
    text, n, k = "ab cd", 3000, 2
    exact = paths(sampler, text)
    first, weight = Counter(), Counter()
    for seed in range(n):
        got = sampler.sample(text, k, Draws(seed, "x"))
        assert len({tuple(i) for i, _, _ in got}) == len(got) == k
        first[tuple(got[0][0])] += 1
        for path, lp, inc in got:
            assert math.exp(lp) == pytest.approx(exact[tuple(path)], rel=1e-6)
            weight[tuple(path)] += exact[tuple(path)] / inc
    for path, p in exact.items():
        if p > 0.05:
            assert first[path] / n == pytest.approx(p, abs=0.04)
            assert weight[path] / n == pytest.approx(p, abs=0.06)
    everything = sampler.sample("ab", 10_000, Draws(1, "x"))
    assert {tuple(i) for i, _, _ in everything} == set(paths(sampler, "ab")) and all(inc == 1 for _, _, inc in everything)


def test_likely_paths_come_in_the_order_of_their_sampling():
    """With one segmentation near probability 1, the others still come out, all of them, each once."""
    sampler = Sampler(tokenizer_file("piece_bpe_32k.model"), 8.0)
    for text in ("the", "and the", "é日x"):
        exact = paths(sampler, text)
        got = sampler.sample(text, len(exact) + 5, Draws(3, text))
        assert {tuple(i) for i, _, _ in got} == set(exact) and len(got) == len(exact)
        assert [math.exp(lp) for _, lp, _ in got] == pytest.approx([exact[tuple(i)] for i, _, _ in got], rel=1e-6)


def test_plain_encoding_and_decoding(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    model = Sampler(path, 1.0).model
    got = decode_ids(encode_text(documents(spark), path), path).collect()
    assert ids(got) == ids(ROWS) and all(r.ids == model.encode(r.text or "") and r.decoded == model.decode(r.ids) for r in got)
    assert decode_ids(encode_text(documents(spark, []), path), path).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([264, None],)], "ids array<int>")
    assert [r.decoded for r in decode_ids(odd, path).collect()] == [None, "", model.decode([264])]
    with pytest.raises(ValueError, match="decoded"):
        decode_ids(odd.selectExpr("ids", "1 as decoded"), path)


def test_samples_decode_to_the_text(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    rows = [(k, t) for k, t in ROWS if t is None or len(t) < 6000]
    docs = documents(spark, rows)
    got = sampled_segmentations(docs, path, keys=["doc_id"], k=3)
    model = Sampler(path, 1.0).model
    expected = {k: model.decode(model.encode(t or "")) for k, t in rows}
    decoded = decode_ids(got, path).collect()
    assert {r.doc_id for r in decoded} == {k for k, _ in rows} and all(r.decoded == expected[r.doc_id] for r in decoded)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["rank"], tuple(r.ids))
    again = sampled_segmentations(docs.repartition(3), path, keys=["doc_id"], k=3).collect()
    assert sorted(map(key, got.collect())) == sorted(map(key, again))
    assert sampled_segmentations(documents(spark, []), path, keys=["doc_id"]).count() == 0


def test_decoding_by_arrays_equals_the_library(spark):
    """Of plain, byte, unknown and odd pieces, without the ids as Python lists; in the sampling task it is the same."""
    path = tokenizer_file("piece_bpe_32k.model")
    model = Sampler.load(path, 1.0).model
    rng = random.Random(1)
    space, size = model.piece_to_id(SPACE), model.get_piece_size()
    lists = [[], None, [0], [space] * 3, [space, 400, space], *([rng.randrange(size) for _ in range(rng.randint(1, 5))] for _ in range(500)), *([space, *rng.choices(range(size), k=2)] for _ in range(300))]
    lists += [[space, *model.encode(t)] for t in ("é日本 x", "\u0001\u0002 a", "plain words")] + [model.encode("🜚 and text")]
    decoder = Decoder(model)
    expected = [None if v is None else model.decode(v) for v in lists]
    assert decoder(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == expected
    assert decoder(pa.array(lists, pa.list_(pa.int32())).slice(3, 50)).to_pylist() == expected[3:53]
    docs = documents(spark, [(k, t) for k, t in ROWS if t is None or len(t) < 6000])
    got = sampled_segmentations(docs, path, keys=["doc_id"], decoded="text")
    assert got.columns == ["doc_id", "rank", "ids", "log_prob", "inclusion", "text"] and all(r.text == model.decode(r.ids) for r in got.collect())


def test_uniform_numbers_are_within_0_and_1():
    """Also of the extreme hashes: a draw's log has a log."""
    got = sampling._uniform(np.array([0, 1, (1 << 63) - 1, (1 << 64) - 1], np.uint64))
    assert (got > 0).all() and (got < 1).all() and -math.log(got[-1]) > math.exp(sampling._LEAST_DRAW)
    draws = Draws(3, "x")
    assert [draws.uniform(5, n) for n in range(9)] == sampling._uniform(draws.at(5, np.arange(9))).tolist()


def test_sampling_draws_few_numbers_for_each_word(monkeypatch):
    """Of the sets that leave a path, those whose mass is too small to be among the highest get no number, and states are hashed once a text."""
    sampler = Sampler.load(tokenizer_file("piece_bpe_32k.model"), 1.0)
    numbers, mixed = [0], sampling._mixed
    monkeypatch.setattr(sampling, "_mixed", lambda x: numbers.__setitem__(0, numbers[0] + np.size(x)) or mixed(x))
    text = " ".join("tionhe wasand theing 日本 lyer oning".split() * 500)
    sampler.sample_all([text], 3, [Draws(1, "x")])
    assert numbers[0] < 4 * 3 * len(sampler.words(text))


def test_all_sets_are_looked_at_where_the_first_could_lose(monkeypatch):
    """With a window of 1 the same sets come out as with one over the whole text."""
    sampler = Sampler.load(tokenizer_file("piece_bpe_32k.model"), 1.0)
    texts = ["the and " * 300, "tionhe wasand " * 40, "of", "", "日本 lyer oning" * 3]
    draws = [Draws(seed, "w") for seed in range(len(texts))]
    plain, out = sampling._highest, []
    for window in (1, 64, 1 << 20):
        monkeypatch.setattr(sampling, "_highest", lambda *a, w=window: plain(*a[:8], a[8] if len(a) > 8 else w))
        out.append([[(ids.tolist(), pytest.approx(lp), pytest.approx(i)) for ids, lp, i in got] for got in sampler.sample_all(texts, 5, draws)])
    assert out[0] == out[1] == out[2]


def test_shares_of_arcs_follow_from_the_pieces():
    """Also of words whose paths are too unlikely for plain numbers, and of characters without a piece."""
    for theta in (1.0, 8.0):
        sampler = Sampler(tokenizer_file("piece_bpe_32k.model"), theta)
        words = [SPACE + w for w in ("tionhe", "x" * 200, "日🙂🜚" * 40, "theé日x\0th" * 30, "a")]
        lattices = sampling.Lattices(words, sampler)
        for n, word in enumerate(words):
            score = [{j: sampler.theta * sampler.pieces[word[i:j]][1] for j in range(i + 1, len(word) + 1) if word[i:j] in sampler.pieces} for i in range(len(word))]
            for i, c in enumerate(word):
                score[i].setdefault(i + 1, sampler.theta * sampler.byte_score * len(c.encode()))
            z = [0.0] * (len(word) + 1)
            for i in range(len(word) - 1, -1, -1):
                top = max(s + z[j] for j, s in score[i].items())
                z[i] = top + math.log(sum(math.exp(s + z[j] - top) for j, s in score[i].items()))
            node = {0: int(lattices.start[n])}
            for i in range(len(word)):
                arcs = range(lattices.begin[node[i]], lattices.begin[node[i] + 1])
                ends = [i + 1 if t < 0 else i + len(sampler.model.id_to_piece(t)) for t in lattices.token[arcs].tolist()]
                assert sorted(ends) == sorted(score[i])
                assert lattices.log_share[arcs].tolist() == pytest.approx([score[i][j] + z[j] - z[i] for j in ends], abs=1e-9)
                node.update(zip(ends, lattices.dst[arcs].tolist(), strict=True))
