"""Quality network and toxicity lexicon."""

import random

import numpy as np
import pytest

from pitgauge.llm import quality_cnn, toxicity
from pitgauge.llm.labelled import labelled_sample, remainder


def text(rng, n=60, extra=()):
    words = ["".join(rng.choice(["on", "er", "th", "in", "le", "ka"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for e in extra:
        words.insert(rng.randrange(len(words)), e)
    return " ".join(words)


@pytest.fixture(scope="module")
def lexicon():
    rng = random.Random(1)
    clean = [text(rng, rng.randint(20, 200)) for _ in range(200)] + [text(rng, 50, ["zorgfish pond"]) for _ in range(20)]
    toxic = [text(rng, rng.randint(20, 200), rng.sample(["zorgon", "blatwit", "quimble"], 2)) for _ in range(80)]
    return toxicity.learn(clean + toxic, [0] * len(clean) + [1] * len(toxic))


def predicted(lexicon, t):
    return toxicity.probability(toxicity.measures(toxicity.fold(t), lexicon.automaton())[:2], lexicon.shape) >= 0.5


def test_lexicon_finds_disguised_terms(lexicon):
    rng = random.Random(2)
    for word in ("zorgon", "Z0RG0N", "zоrgоn", "z​orgon", "blatw1t", "blatwi7", "ｚｏｒｇｏｎ", "qu!mble", "zorgon,"):
        assert predicted(lexicon, text(rng, 30, [word])), word
    assert not predicted(lexicon, text(rng, 30)) and not predicted(lexicon, "")


def test_long_text_doesnt_hide_terms(lexicon):
    rng = random.Random(3)
    assert predicted(lexicon, text(rng, 2000, ["zorgon", "blatwit"] * 15))


def test_exceptions_take_back_terms():
    lexicon = toxicity.Lexicon({toxicity.fold("clow")[:-1]: 3.0}, [toxicity.fold("clown fish")], (-4.0, 1.0, 2.0))  # terms are folded as texts are
    a = lexicon.automaton()
    assert not toxicity.hits(toxicity.fold("a clown fish swims"), a)
    assert len(toxicity.hits(toxicity.fold("clown fish, clown"), a)) == 1


def test_overlapping_terms_count_once():
    a = toxicity.Lexicon({" abcd": 1.0, " abcd ": 2.0}).automaton()
    assert [w for _, _, w in toxicity.hits(" abcd abcde ", a)] == [2.0, 1.0]


def junk(rng, kind):
    words = text(rng, 80).split()
    if kind == "caps":
        return " ".join(w.upper() + "!!" for w in words)
    if kind == "signs":
        return " ".join(w + rng.choice(["$$$", "%%%", "###"]) for w in words)
    return " ".join(w for w in words[:8] for _ in range(20))


def test_network_learns_and_is_repeatable():
    rng = random.Random(4)
    make = lambda n: ([text(rng, rng.randint(40, 300)) for _ in range(n)] + [junk(rng, rng.choice(["caps", "signs", "same"])) for _ in range(n)], [1] * n + [0] * n)
    texts, labels = make(150)
    network = quality_cnn.learn(texts, labels)
    held, truth = make(100)
    p = quality_cnn.score(held, network)
    assert ((p >= 0.5) == np.array(truth)).mean() >= 0.95
    assert np.array_equal(quality_cnn.learn(texts[:40] + texts[-40:], labels[:40] + labels[-40:], epochs=1).weights["filter"],
                          quality_cnn.learn(texts[:40] + texts[-40:], labels[:40] + labels[-40:], epochs=1).weights["filter"])
    assert np.allclose(p, np.concatenate([quality_cnn.score([t], network) for t in held]), atol=1e-5)  # the batch doesn't matter
    hidden = text(rng, 3000) + " " + junk(rng, "caps") + " " + text(rng, 3000)
    assert quality_cnn.score([hidden], network)[0] < 0.5  # poor text deep inside a long one


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    network = quality_cnn.learn(["abc def " * 40, "ABC!! " * 60], [1, 0], epochs=1)
    w = {k: v.astype(np.float64) for k, v in network.weights.items()}
    flat, owner, a, b, fill, pooled, z, hidden, _ = quality_cnn.forward(["xyz abc " * 100], w)
    c = quality_cnn.poorest(owner, z, 1)[0]
    for name in ("out", "hidden"):
        at = tuple(rng.integers(0, s) for s in w[name].shape)
        up = {**w, name: w[name].copy()}
        up[name][at] += 1e-5
        slope = (quality_cnn.logits(pooled, fill, up)[0][c] - z[c]) / 1e-5
        exact = hidden[c][at[0]] if name == "out" else pooled[c][at[0]] * w["out"][at[1]] * (1 - hidden[c][at[1]] ** 2)
        assert abs(slope - exact) < 1e-4


def test_odd_rows_and_empty_tables(odd_docs, no_docs, lexicon):
    network = quality_cnn.learn(["abc def " * 40, "ABC!! " * 60], [1, 0], epochs=1)
    for score, model in ((toxicity.score_toxicity, lexicon), (quality_cnn.score_quality, network)):
        got = score(odd_docs, model)
        rows = got.select("doc_id", "text", "score", "predicted", "lang", "`a.b`").collect()
        assert len(rows) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1 and len({r["score"] for r in rows if not r["text"]}) == 1
        assert score(no_docs, model).count() == 0


def test_without_labels_scores_are_constant(spark, odd_docs):
    assert toxicity.learn(["a b"], [0]).always == 0.0 and quality_cnn.learn([], []).always == 0.5
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert labelled_sample(odd_docs, none, "toxic", remainder(5) != 0, 10, 1000) == ([], [])
    assert {r["score"] for r in toxicity.score_toxicity(odd_docs, toxicity.learn([], [])).collect()} == {0.5}


def test_sample_leaves_out_held_out_rows_and_nulls(spark):
    import zlib

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(100)] + [(None, "n"), (200, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] * 2 + [(None, 1), (200, 1), (5, None)], "doc_id long, toxic int")
    texts, ys = labelled_sample(docs, labels, "toxic", remainder(5) != 0, 1000, 1000)
    want = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    assert texts == [f"text {i}" for i in want] and ys == [i % 2 for i in want]
    assert len(labelled_sample(docs, labels, "toxic", remainder(5) != 0, 7, 1000)[0]) == 14


def plain_hits(folded, lexicon):
    """Terms of a folded text by search at every place, without those inside any exception phrase; of terms that overlap, the heaviest counts."""
    places = lambda t: [i for i in range(len(folded)) if folded.startswith(t, i)]
    covers = [(i, i + len(p)) for p in lexicon.exceptions for i in places(p)]
    found = sorted((i, -w, i + len(t), w) for t, w in lexicon.terms.items() for i in places(t))
    out = []
    for s, _, e, w in found:
        if any(a <= s + 1 and e - 1 <= b for a, b in covers):
            continue
        if out and s + 1 < out[-1][1]:
            if w > out[-1][2]:
                out[-1] = (s, e, w)
        else:
            out.append((s, e, w))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_matcher_equals_a_plain_search_with_all_exceptions(seed):
    rng = random.Random(seed)
    words = ["ab", "abc", "b", "ca", "bad", "good", "x"]
    phrase = lambda n: " " + " ".join(rng.choice(words) for _ in range(n)) + " "
    lexicon = toxicity.Lexicon({(" " + rng.choice(words) + rng.choice(["", " "])): rng.choice([0.5, 1.0, 2.0]) for _ in range(4)},
                               sorted({phrase(rng.randint(1, 7)) for _ in range(rng.randint(0, 25))} - set()))
    lexicon.exceptions = [p for p in lexicon.exceptions if p not in lexicon.terms]
    for _ in range(10):
        folded = toxicity.fold(" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))))
        assert toxicity.hits(folded, lexicon.automaton()) == plain_hits(folded, lexicon)


def test_more_phrases_than_eight_that_end_before_a_long_one():
    """A long phrase that begins first keeps nothing from being asked."""
    short = [f" s{i} t{i} " for i in range(12)]
    long = " a " + " ".join(s.strip() for s in short) + " q bad zz "
    lexicon = toxicity.Lexicon({" bad ": 2.0}, [long, " bad zz ", *short])
    text = "a " + " ".join(s.strip() for s in short) + " bad zz then bad luck"
    assert [s for s, *_ in toxicity.hits(toxicity.fold(text), lexicon.automaton())] == [toxicity.fold(text).rindex(" bad ")]


def test_conflicting_and_repeated_labels(spark):
    from pyspark.sql import functions as F

    from pitgauge.llm.labelled import labelled_sample

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(6)] + [(1, "s1"), (5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (4, None), (5, 0)], "doc_id long, toxic int")
    assert labelled_sample(docs, labels, "toxic", F.lit(True), 10, 100) == (["t0", "s1", "t3", "t5"], [1, 1, 0, 0])
