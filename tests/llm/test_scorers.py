"""The queries of the two classifiers against scorers that work word by word and gram by gram with the fitted weights."""

import math

import numpy as np
import pytest

from segmentflow.llm import langid, toxicity
from segmentflow.llm.queries import QUERIES, fold_of
from segmentflow.session import table

MASK = (1 << 64) - 1


def slow_toxic_features(text):
    """Beginnings of 4 and 6 code points, whole words, and runs of 2 to 4 code points in words beyond ASCII; plain integers."""
    out, words, word = set(), [], []
    for c in text.lower() + " ":
        if ord(c) >= 128 or c.isalnum():
            word.append(ord(c))
        elif word:
            words.append(word)
            word = []
    for w in words:
        for cut in (4, 6):  # shorter words stand for their own beginnings
            h = 0
            for c in w[:cut]:
                h = (((h ^ c) * 16777619) + 0x9E3779B9) & 0xFFFFFFFF
            out.add((((h ^ ((cut - 1) * 0x85EBCA6B & 0xFFFFFFFF)) * 2654435761) & 0xFFFFFFFF) >> 12)
        whole, power = 0, 1
        for c in w:
            power = power * 0x9E3779B97F4A7C15 & MASK
            whole = (whole + (c + 1) * power) & MASK
        hashes = [whole]
        if any(c >= 128 for c in w):
            for n in (2, 3, 4):
                for i in range(len(w) - n + 1):
                    g = 0
                    for c in w[i : i + n]:
                        g = (g * 0x100000001B3 + c) & MASK
                    hashes.append(((g ^ n) * 0xC2B2AE3D27D4EB4F) & MASK)
        out.update((h * 0xD6E8FEB86659FD93 & MASK) >> 44 for h in hashes)
    return out


def test_toxicity_query_equals_a_slow_scorer(spark):
    folder = "/root/testdata/sf0.01"
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"), fold_of("doc_id", 5) != 0)
    weight = dict(zip(model.slots.tolist(), model.weights.tolist()))
    got = {r.doc_id: r.score for r in QUERIES["op9_toxicity"](spark, folder).select("doc_id", "score").collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows) and len(weight) > 5
    for r in rows:
        z = model.bias + sum(weight[f] for f in slow_toxic_features(r.text or "") if f in weight)
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-50, min(50, z)))), abs=1e-9), r.doc_id


def slow_grams(text):
    """Counts of bigrams and trigrams of folded bytes, one by one."""
    data = [32 if b < 128 and not chr(b).isalpha() else b for b in f" {text.lower()} ".encode("utf-8", "replace")]
    counts = {}
    for i in range(len(data) - 2):
        two = (data[i] * 257 + data[i + 1]) & 0xFFFFFFFF
        three = (two * 263 + data[i + 2] + (1 << 25)) & 0xFFFFFFFF
        for g in (two, three):
            slot = (g * 2654435761 & 0xFFFFFFFF) >> 20
            counts[slot] = counts.get(slot, 0) + 1
    length = math.sqrt(sum(counts.values()))
    return {k: math.sqrt(n) / length for k, n in counts.items()}


def test_language_query_equals_a_slow_scorer(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold_of("doc_id", 3) != 1)
    got = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op10_langid"](spark, sf_dir).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        text = r.text or ""
        if not any(map(str.isalpha, text)):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        grams = slow_grams(text)
        margin = lambda w: sum(float(w[k]) * v for k, v in grams.items()) + float(w[-1])
        chance = [1.0]
        if len(model.families) > 1:
            margins = [4 * margin(w) for w in model.family_weights]
            chance = [math.exp(m - max(margins)) for m in margins]
            chance = [c / sum(chance) for c in chance]
        family = int(np.argmax(chance))
        support = {i: [] for i in model.members[family]}
        for (i, j), w in zip(model.pairs, model.pair_weights):
            if i in support:
                win = 1 / (1 + math.exp(-4 * margin(w)))
                support[i].append(win)
                support[j].append(1 - win)
        means = {i: np.mean(s) if s else 1.0 for i, s in support.items()}
        best = max(means, key=lambda i: (means[i], -i))
        assert got[r.doc_id][1] == pytest.approx(chance[family] * means[best], abs=1e-3)
        clear = lambda values: len(values) < 2 or sorted(values)[-1] - sorted(values)[-2] > 1e-3
        if clear(chance) and clear(list(means.values())):  # else single precision may decide
            assert got[r.doc_id][0] == model.langs[best]
