"""Language and toxicity against plain versions and on held-out rows."""

from __future__ import annotations

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkfold.llm import langid, toxicity
from sparkfold.llm import textvec as tv

from .test_kernels import distance


def plain_phrases(text: str, sample: bytes) -> int:
    data, n, i = text.encode(), 0, 0
    while i < len(data):
        k = 1
        while i + k <= len(data) and data[i : i + k] in sample:
            k += 1
        i, n = i + max(k - 1, 1), n + 1
    return n


@pytest.mark.parametrize("block", [3, 7, 512])
def test_phrases_are_those_of_whole_texts(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    r = random.Random(block)
    word = lambda letters: "".join(r.choices(letters, k=r.randint(1, 6)))
    samples = langid.Samples((("aa", "".join(word("abcd") + " " for _ in range(200))), ("zh", "".join(word("日本語的是不了人我在有他") + " " for _ in range(100)))))
    parser = langid.Parser(samples)
    texts = ["", "12 !?", "a", *(" ".join(word(r.choice(["abcd", "日本語的是", "xyzé"])) for _ in range(r.randint(1, 60))) for _ in range(40))]
    cost, letters = parser.costs(tv.strings(pa.array(texts)))
    for i, t in enumerate(texts):
        own = "".join(c if c.isalpha() else " " for c in t).split()
        assert letters[i] == sum(map(len, own))
        joined = " ".join(own) + " " if own and not t[-1].isalpha() else " ".join(own)
        for k, (_, sample) in enumerate(samples.texts):
            want = plain_phrases(joined, sample.encode()) * math.log2(len(sample.encode())) / max(len(joined.encode()), 1)
            assert abs(cost[i, k] - want) < 1e-9, (i, k)


def test_scripts_are_told_apart(spark):
    r = random.Random(9)
    scripts = {"zh": "日本語的是不了人我在有他這中大來上國", "ja": "のにはをたがでてとしれさあいうえおかき", "ru": "абвгдежзийклмнопрст", "bg": "ъщюяхцчшуфтсрпонмлк", "ar": "ابتثجحخدذرزسشصضطظع"}
    words = {k: ["".join(r.choices(v, k=r.randint(2, 5))) for _ in range(40)] for k, v in scripts.items()}
    rows = [(k, " ".join(r.choices(words[lang], k=r.randint(4, 30))), lang) for k in range(300) for lang in [list(words)[k % 5]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x["lang_pred"] for x in langid.identify(df, langid.learn(df, F.col("doc_id") % 3 != 1)).collect()}
    assert sum(got[k] == lang for k, _, lang in rows if k % 3 == 1) >= 98


def test_windows_of_long_documents_are_spread(spark):
    text = " ".join(f"{w}" * 40 for w in ("aaa", "bbb", "ccc", "ddd", "eee") for _ in range(400))
    df = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    sample = langid.learn(df, F.lit(True)).texts[0][1]
    assert all(c in sample for c in "abcde") and len(sample) < len(text)


def test_words_meet_the_closest_term_of_several_automata(monkeypatch):
    monkeypatch.setattr(toxicity, "TERMS_TOGETHER", 3)
    r = random.Random(3)
    terms = tuple((t, False) for t in sorted({"".join(r.choices("abcdé日", k=r.randint(3, 11))) for _ in range(20)}))
    scorer = toxicity.Scorer(terms)
    words = [t for t, _ in terms]
    for t, _ in terms:
        for _ in range(6):
            at = r.randrange(len(t))
            words.append(r.choice([t[:at] + t[at + 1 :], t[:at] + "x" + t[at:], t[:at] + "c" + t[at + 1 :], t[:at] + "xy" + t[at + 1 :]]))
    for w, got in zip(words, scorer.outcomes(words).tolist(), strict=True):
        near = [(d, k) for k, (t, _) in enumerate(terms) if (d := distance(t, w)) <= toxicity.edits(t)]
        assert got == (4 * min(near)[1] + min(near)[0] if near else -1)


def test_a_lexicon_of_many_letters_and_terms():
    terms = tuple((chr(0x4E00 + 3 * k) + chr(0x4E01 + 3 * k) + chr(0x4E02 + 3 * k), False) for k in range(150))
    scorer = toxicity.Scorer(terms)
    assert scorer.outcomes([t for t, _ in terms]).tolist() == [4 * k for k in range(150)] and scorer.outcomes(["abc"]).tolist() == [-1]


def test_every_term_that_isnt_chance_is_learned():
    r = random.Random(4)
    clean = [f"w{k}" for k in range(300)]
    bad = [f"b{k:03d}" + "".join(r.choices("aeioukst", k=5)) for k in range(140)] + ["x" * 40 + "end"]
    docs = [(" ".join(r.choices(clean, k=40) + (r.sample(bad, 14) if k % 2 else [])), k % 2) for k in range(1200)]
    terms = {t for t, _ in toxicity.lexicon(docs)}
    held = [(t, y) for t, y in docs if any(b in t for b in bad)]
    assert all(any(b.startswith(t) for t in terms) for b in bad) and len(held) == 600
    assert not any(c.startswith(t) for t in terms for c in clean)
    junk = [(t + " " + "z" * 20_000 + str(k), y) for k, (t, y) in enumerate(docs[:50])]
    assert isinstance(toxicity.lexicon(junk), tuple)
