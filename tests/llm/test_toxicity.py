"""The kernel machine's parts, and the bound on labelled rows."""

from itertools import combinations

import numpy as np

from sparkwell.llm import toxicity


def explicit_kernel(a: str, b: str) -> float:
    def features(w: str) -> dict:
        out: dict = {}
        for c, x in zip(*toxicity.explicit(w)):
            out[int(c)] = out.get(int(c), 0.0) + float(x)
        return out

    fa, fb = features(a), features(b)
    return sum(x * fb.get(c, 0.0) for c, x in fa.items())


def test_kernel_matches_its_expansion():
    words = ["idiot", "iidiot", "idixot", "banana", "x", "é" * 40]
    table = toxicity.Landmarks(words).kernel(words)
    want = np.array([[explicit_kernel(a, b) for b in words] for a in words])
    assert np.allclose(table, want, atol=1e-5)
    assert table[0, 2] > 2 * table[0, 3]


def plain_kernel(a: str, b: str) -> float:
    """Gap-weighted subsequences of two short words, counted letter by letter."""

    def features(word: str) -> dict:
        w, out, norm = f"^{word}^", {}, 0.0
        for p in toxicity.ORDERS:
            for at in combinations(range(len(w)), p):
                gaps = at[-1] - at[0] - p + 1
                if gaps <= toxicity.MAX_GAP:
                    key = "".join(w[i] for i in at)
                    out[key] = out.get(key, 0.0) + toxicity.DECAY**gaps
                    norm += toxicity.DECAY ** (2 * gaps)
        return {k: v / norm**0.5 for k, v in out.items()}

    fa, fb = features(a), features(b)
    return sum(v * fb.get(k, 0.0) for k, v in fa.items())


def test_kernel_against_plain_python():
    words = ["idiot", "iidiot", "idixot", "banana", "xy", "thetable"]
    assert np.allclose(toxicity.Landmarks(words).kernel(words), [[plain_kernel(a, b) for b in words] for a in words], atol=1e-5)


TOXIC = [f"we went to the {p} today. you are an {w} and the {q} was fine.\nsee you then.".encode() for w in ("idiot", "moron", "worthless") for p in ("garden", "window", "table") for q in ("riot", "thesis", "weather")]
CLEAN = [f"we went to the {p} today. you are a {w} and the {q} was fine.\nsee you then.".encode() for w in ("modern friend", "worthy idea", "baron") for p in ("garden", "window", "table") for q in ("riot", "thesis", "weather")]


def test_sentences_tell_texts_apart():
    """Labels are of texts; the machine finds the sentence. Insults with letters put in or left out are near."""
    scorer = toxicity.Scorer(*toxicity.fit(TOXIC, CLEAN))
    assert min(scorer.texts(TOXIC)) > max(scorer.texts(CLEAN))
    bad = scorer.texts([b"the riot was fine. you are an idiiot.", b"you are an i.d.i.o.t today", b"you are an i d i o t today", b"you are an idixot and a moronn"])
    assert min(bad) > max(scorer.texts([b"the riot was fine.", b"a window and a garden", b""]))


def test_margin_is_the_kernel_expansion():
    """A text's margin against its sentences' words, one at a time, and sentences against plain Python."""
    sparse, bias = toxicity.fit(TOXIC, CLEAN)
    scorer = toxicity.Scorer(sparse, bias)
    table = {(p, int(c)): float(v) for p, (codes, values) in zip(toxicity.ORDERS, sparse) for c, v in zip(codes, values)}
    text = "You are an IDIOT. We went to the garden!\nm o r o n s? " + "long" * 20 + " 1d10t, idiot."
    sentences = [["you", "are", "an", "idiot"], ["we", "went", "to", "the", "garden"], ["morons"], ["long" * 20, "idiot", "idiot"]]

    def value(w: str) -> float:
        code, x = toxicity.explicit(w)
        return sum(float(v) * table.get((int(c) >> toxicity.SHIFT, int(c) & ((1 << toxicity.SHIFT) - 1)), 0.0) for c, v in zip(code, x))

    want = max(bias + sum(map(value, s)) / len(s) ** toxicity.POWER for s in sentences)
    assert abs(scorer.texts([text.encode()])[0] - want) < 1e-3
    assert scorer.texts([b"", b" \n\n 12 !!"]).tolist() == [-toxicity.LIMIT] * 2


def test_long_words_are_read_whole():
    a, b = "a" * 30 + "xyz", "a" * 30 + "uvw"
    assert set(toxicity.explicit(a)[0].tolist()) != set(toxicity.explicit(b)[0].tolist())


def test_obfuscated_words_are_read_whole():
    assert {"idiot", "moron"} <= set(toxicity.Sentences([b"an i.d.i.o.t and m o r o n here"], {}).words)
    assert toxicity.normal_word(b"1d10t!!") == "idiot" == toxicity.normal_word(b"IDIOT,") and toxicity.normal_word(b"12!") == ""


def test_labels_beyond_the_bound(spark):
    docs = spark.createDataFrame([(i, ("you idiot " if i % 2 else "a fine day ") + "word " * 5) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs, labels, max_labelled=100).collect()
    assert len(rows) == 400 and all(r["predicted"] == r["doc_id"] % 2 for r in rows)
