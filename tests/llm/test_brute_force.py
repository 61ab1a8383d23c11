"""Predictions and fingerprints against plain loops; the recall of sketches on planted pairs; prefix doubling at several lengths."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from pathlens.llm import fingerprint, language, minhash, suffix, words  # noqa: E402

MASK = (1 << 64) - 1
ODD = [None, "", " \n", "12 !?", "é", "Straße Ǆ İ", "a", "ab", "a-b  c", "x" * 700, "words of some text and 漢字 more"]


def chances(model, text):
    """Each label's probability: the mean weight of all n-grams that hold a letter, found one by one."""
    letters = [0] * len(text)
    for i, char in enumerate(text):
        if char.isalpha():
            letters[i] = ord(char.lower()) if len(char.lower()) == 1 else ord(char)
    logits, n = np.zeros(len(model.labels)), 0
    for order in language.ORDERS:
        for at in range(len(text) - order + 1):
            gram = letters[at : at + order]
            if any(gram):
                name = 0
                for point in gram:
                    name = (name * 0x100000001B3 + point + 1) & MASK
                mixed = (name ^ order) * 0x9E3779B97F4A7C15 & MASK
                logits += model.weights[((mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9 & MASK) >> 64 - language.BITS]
                n += 1
    if not n:
        return None
    e = np.exp((logits / n + model.bias) / model.temperature)
    return e / e.sum()


def test_predictions_equal_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.fitted(table, F.col("doc_id") % 3 != 1)
    odd = spark.createDataFrame([(-1 - i, text, None) for i, text in enumerate(ODD)], table.schema)
    rows = language.identified(table.union(odd), model).collect()
    assert len(rows) == table.count() + len(ODD)
    for row in rows:
        expected = chances(model, row.text or "")
        if expected is None:
            assert (row.lang_pred, row.score) == ("und", 0.0)
        else:
            assert row.score == pytest.approx(expected.max(), abs=1e-5)
            assert expected[model.labels.index(row.lang_pred)] == pytest.approx(expected.max(), abs=1e-5)


def sampled(sampler, text):
    """A signature, term by term and sample by sample."""
    terms = Counter(re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower()))
    out = []
    for salt in sampler.salts:
        best = None
        for term, weight in terms.items():
            name = words.Words(pa.array([term.decode()])).names[0]
            draw = int(words.mix(np.array([name ^ salt]))[0])
            r, beta, ln_c = sampler.r[draw & 0xFFFF], sampler.beta[draw >> 16 & 0xFFFF], sampler.ln_c[draw >> 32 & 0xFFFF]
            step = np.floor(np.log(np.float32(weight)) / r + beta)
            value = (ln_c - r * (step - beta + np.float32(1)), draw >> 48 ^ int(step) * 40503 & 0xFFFF)
            best = value if best is None else min(best, value)
        out.append(0 if best is None else best[1])
    return np.array(out)


def test_likenesses_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "Cd", "é", "fgh", "i", "jk", "lm"]) for _ in range(rng.randint(1, 25))) for _ in range(9)]
    texts = [t or "" for t in ODD] + texts + texts[:2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sampler = fingerprint.WeightedSampler()
    got = {r.doc_id: r for r in fingerprint.edit_report(docs).collect()}
    assert len(got) == len(texts)
    signature = [sampled(sampler, t) for t in texts]
    for i, text in enumerate(texts):
        after, third = (i - 1) % len(texts), len(text) // 3
        edited = text[: len(text) - third] + texts[after][:third]
        other, row = sampled(sampler, edited), got[i]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == "".join(f"{x:04x}" for x in signature[i])
        assert row.edited_fingerprint == "".join(f"{x:04x}" for x in other)
        assert row.near_edited == np.mean(signature[i] == other) and row.near_next == np.mean(signature[i] == signature[after])


def test_planted_pairs_are_found(spark):
    """4000 pairs just above the threshold, where sketches miss most, and as many just below it."""
    rng = random.Random(11)
    word = lambda: f"{rng.getrandbits(44):x}"
    rows, linked = [], {}
    for pair in range(8000):
        text = [word() for _ in range(rng.randint(30, 250))]
        n = len(text) - 4
        if pair % 2:  # the end lacks: the rest has just 75 % of the shingles, or just less
            kept = -(-3 * n // 4) - (pair % 4 == 3)
            near, similar = text[: kept + 4], 4 * kept >= 3 * n
        else:  # so many single words differ as the threshold allows, or one more
            changes = n // 35 + (pair % 4 == 2)
            near = [word() if i % 5 == 4 and i < 5 * changes else w for i, w in enumerate(text)]
            both = n - 5 * changes
            similar = 100 * both >= 75 * (n + 5 * changes)
        rows += [(2 * pair, " ".join(text)), (2 * pair + 1, " ".join(near))]
        linked[2 * pair + 1] = similar
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id % 2 = 1").collect()
    found = {r.doc_id: not r.kept for r in got}
    assert 3500 < sum(linked.values()) < 4500
    assert found == linked


@pytest.mark.parametrize("threshold", [64, 32, 21])
def test_doubling_at_other_lengths(spark, threshold):
    rng = random.Random(threshold)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 300))) for _ in range(12)]
    texts += [texts[0][5:90], texts[1] + texts[2], "é" * 80, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    seen, expected = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = set()
        for at in range(len(data) - threshold + 1):
            part = data[at : at + threshold]
            gone |= set(range(at, at + threshold)) if part in seen else set()
            seen.add(part)
        expected.append((len(data), hashlib.sha256(bytes(c for i, c in enumerate(data) if i not in gone)).hexdigest()))
    got = suffix.repeat_report(docs, threshold=threshold, every=True).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.kept_sha256) for r in got] == expected
