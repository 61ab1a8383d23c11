"""The training-data operators against brute force on small fixtures with nulls, ties, repeats and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("public_tokenizers")

from pathlens.llm import byte_bpe, covertree, fingerprint, language, lattice, licenses, minhash, mixing, queries, shared, stream_files, suffix, tokens, words  # noqa: E402

BLANK = rb"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, component string, value string"


def make_texts():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 60))) for _ in range(12)]
    near = texts[0].split()
    near[5] = "changed"
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    texts += [" ".join(near), texts[1], texts[1], texts[2] + "\n" + passage, passage + " " + texts[3], texts[0].upper()]
    return [*texts, None, "", "  \t", "one", "a b c", "x" * 3000, "ab" * 700, "ÄÖ  　 x  y", passage, passage]


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "a"][i % 4], 0, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(BLANK, (text or "").encode().lower())


def test_words_and_pieces():
    rng = random.Random(1)
    for _ in range(60):
        rows = ["".join(rng.choice("ab  \n") for _ in range(rng.randint(0, 30))) for _ in range(6)]
        column = pa.array([*rows, None])
        found = words.Words(column)
        assert [[found.word(i) for i in range(a, b)] for a, b in zip(found.offsets[:-1], found.offsets[1:], strict=True)] == [words_of(t) for t in [*rows, None]]
        step = rng.randint(1, 9)
        data, offsets = words.buffers(column)
        cuts = list(words.pieces(data, offsets, words.BLANK_WORDS, step))
        assert [a for a, _ in cuts] == [0, *(b for _, b in cuts[:-1])][: len(cuts)]
        for _, b in cuts[:-1]:
            assert b in offsets or not words.BLANK_WORDS[data[b]]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 112)] + [(5, 5), (None, 3)]
    rng.shuffle(edges)
    group = {}

    def root(x):
        group.setdefault(x, x)
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            group[max(x, y)] = min(x, y)
    got = shared.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.id for r in got}) and {r.id: r.component for r in got} == {x: root(x) for x in group}


def test_minhash_equals_brute_force(docs, texts, nothing):
    sets = []
    for text in texts:
        w = words_of(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(len(sets)):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert [got[i].component_id for i in range(len(texts))] == label
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert minhash.near_duplicates(nothing).count() == 0


def test_prefix_join_finds_the_same_links(docs, texts, monkeypatch):
    plain = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    monkeypatch.setattr(minhash, "SHORT", 1)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == plain


def test_suffix_equals_brute_force(docs, texts, nothing):
    seen, expected = set(), {}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if (window := data[p : p + 100]) in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen.add(window)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        expected[i] = (len(data), sum(gone), sum(1 for j in range(len(data)) if gone[j] and (j == 0 or not gone[j - 1])), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeat_report(docs).collect()}
    assert got == expected
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeat_report(docs, every=True).collect()} == expected
    assert suffix.repeat_report(nothing).count() == 0
    left = {r.doc_id: r for r in suffix.remove_repeats(docs, length_column="n_chars").collect()}
    assert left[0].text == texts[0] and len(texts) - 1 not in left and left[18].text is None


def test_repeated_and_null_ids_do_not_crash(spark):
    rows = [(1, "a b c d e f g", "en", "s"), (1, "a b c d e f g", "en", "s"), (1, "quite another text than that", None, None), (None, "a b c d e f g", "fr", "s"), (None, None, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert minhash.near_duplicates(df).count() == 5
    assert suffix.repeat_report(df).count() == 5
    assert mixing.mix(df).count() == 5
    assert fingerprint.edit_report(df).count() == 5
    assert sum(f["documents"] for f in stream_files.write_tokens(df, tokenizers.path("word_bpe_49k.json"), f"{shared.checkpoint_dir(spark)}/repeated")) == 5
    assert lattice.lattice_scores(df, tokenizers.path("piece_bpe_32k.model"), F.col("doc_id").isNotNull()).count() == 5
    assert byte_bpe.round_trip(df, tokenizers.path("byte_bpe_50k.json")).count() == 5


def test_suffix_tells_apart_rows_that_share_an_id(spark):
    rng = random.Random(3)
    passage, other = ("".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(2))
    low = lambda text: zlib.crc32(text.encode()) & ((1 << 22) - 1)
    by_sum = {low(text): text for text in (f"{passage} {rng.random()}" for _ in range(8000))}
    clean = next(text for text in (f"{other} {rng.random()}" for _ in range(8000)) if low(text) in by_sum)
    copied, alone = by_sum[low(clean)], "".join(rng.choice("stuvwxyz ") for _ in range(200))
    rows = [(1, passage), (2, copied), (2, clean), (2, clean), (None, alone), (None, alone)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix.repeat_report(df).collect())
    assert got == Counter([(1, 150, 0), (2, len(copied), 150), (2, len(clean), 0), (2, len(clean), len(clean)), (None, 200, 0), (None, 200, 200)])
    left = Counter((r.doc_id, r.text) for r in suffix.remove_repeats(df).collect())
    assert left == Counter([(1, passage), (2, copied[150:]), (2, clean), (None, alone)])


def test_token_files(docs, texts, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in stream_files.token_report(docs, tokenizers.path("word_bpe_49k.json"), length=16).collect()}
    start, expected = 0, {}
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        expected[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == expected
    assert stream_files.token_report(nothing, tokenizers.path("word_bpe_49k.json")).count() == 0


def test_sequences_are_read_without_a_copy(spark, docs):
    files = stream_files.write_tokens(docs, tokenizers.path("word_bpe_49k.json"), f"{shared.checkpoint_dir(spark)}/sequences", length=8)
    with stream_files.SequenceReader(files[0]["file"]) as reader:
        everything = np.concatenate(list(reader.ids()))
        ids, mask = reader.sequence(1)
        assert ids.tolist() == everything[8:16].tolist() and mask.true_count == 8 and not ids.flags.owndata


def test_byte_bpe_round_trip(docs, texts):
    import base64

    import tiktoken

    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    reference = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs, path).collect()}
    for i, text in enumerate(texts):
        ids = reference.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = byte_bpe.decoded(byte_bpe.encoded(docs, path, offsets=True), path).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(texts)}
    assert all(len(r.ids) == len(r.offsets) and sorted(r.offsets) == r.offsets for r in back)


def test_units_encode_like_whole_texts():
    rng = random.Random(5)
    alphabet = ["a", "B", "é", "  ", " ", "\n", " ", "　", "'s", "1", "23", "!", "word", "\t", "日", "😀", "́", "İ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|end", "oftext|>", "\r", "\x85", "="]
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for name, leading in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True), ("byte_bpe_50k.tiktoken", True)):
        path = tokenizers.path(name)
        ids, offsets = tokens.UnitEncoder(path, leading).encode(pa.array(rows))
        whole = tokens.load(path, leading).encode_batch(rows, add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [e.ids for e in whole]


def test_what_a_worker_remembers_is_bounded_by_bytes():
    rng = random.Random(9)
    blank = chr(0xA0)
    rows = [blank + " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(1800)) for _ in range(60)]
    own = tokens.UnitEncoder(tokenizers.path("byte_bpe_50k.tiktoken"), True)
    ids, offsets = own.encode(pa.array(rows))
    assert len(offsets) == 61 and own.size == sum(tokens.ENTRY + len(k) + len(v) for k, v in own.known.items()) < 100_000
    own.encode(pa.array([row.replace(blank, "") for row in rows]))
    assert 0 < own.size == sum(tokens.ENTRY + len(k) + len(v) for k, v in own.known.items()) <= tokens.REMEMBERED


def brute_force_pieces(counts):
    """Log probabilities of pieces and of the end from the training words as the library segments them, one added to each count."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    seen = Counter()
    for word, n in counts.items():
        if word is not None:
            for i in processor.encode(word.decode("utf-8", "replace")):
                seen[i] += n
    usable = [i for i in range(len(processor)) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i))]
    total = sum(seen[i] + 1 for i in usable) + counts[None] + 1
    return {processor.id_to_piece(i): np.log((seen[i] + 1) / total) for i in usable}, np.log((counts[None] + 1) / total)


def brute_force_lattice(word, scores):
    """The sum over all segmentations, from the end backwards; characters without a piece go by their bytes."""
    text = lattice.MARK + word
    ways = [0.0] * len(text) + [1.0]
    for i in reversed(range(len(text))):
        if text[i] not in scores:
            ways[i] += np.exp(sum(scores[f"<0x{b:02X}>"] for b in text[i].encode())) * ways[i + 1]
        for j in range(i + 1, min(len(text), i + 32) + 1):
            if text[i:j] in scores:
                ways[i] += np.exp(scores[text[i:j]]) * ways[j]
    return np.log(ways[0]) if ways[0] > 1e-300 else lattice.Lattice({p: s for p, s in scores.items() if not p.startswith("<0x")}, [scores[f"<0x{b:02X}>"] for b in range(256)]).log_probability(word)


def test_lattice_sums_over_all_segmentations(docs, texts):
    tiny = lattice.Lattice({"▁": -1.0, "a": -2.0, "b": -3.0, "▁a": -1.5, "ab": -2.5, "▁ab": -4.0}, [-9.0] * 256)
    expected = np.logaddexp.reduce([-1 - 2 - 3, -1.5 - 3, -1 - 2.5, -4.0])
    assert tiny.log_probability("ab") == pytest.approx(expected)
    assert tiny.log_probability("é") == pytest.approx(-1 - 18)
    train = F.col("doc_id") % 3 != 0
    counts = Counter()
    for i, text in enumerate(texts):
        if i % 3:
            counts.update([*words_of(text), None])
    total = sum(counts.values())
    scores, end_score = brute_force_pieces(counts)
    lattice_word = lambda w: brute_force_lattice(w.decode("utf-8", "replace"), scores) / np.log(10)
    end_score /= np.log(10)
    for row in lattice.lattice_scores(docs, tokenizers.path("piece_bpe_32k.model"), train).collect():
        own = [*words_of(texts[row.doc_id]), None]
        assert (row.n_tokens, row.n_known, row.train_tokens, row.held_out) == (len(own), sum(counts[w] > 0 for w in own), total, row.doc_id % 3 == 0)
        assert row.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in own))
        assert row.score == pytest.approx(sum(lattice_word(w) for w in own[:-1]) + end_score, rel=1e-9)


def test_sampling_estimates_generalised_jaccard(docs, texts, nothing):
    sampler = fingerprint.WeightedSampler(512)
    a, b = Counter({"x": 3, "y": 1, "z": 2}), Counter({"x": 1, "y": 4, "w": 2})
    both = sampler.signatures(pa.array([" ".join(c.elements()) for c in (a, b)]))
    assert (both[0] == both[1]).mean() == pytest.approx(sum((a & b).values()) / sum((a | b).values()), abs=0.07)
    rows = sorted(((i, t or "") for i, t in enumerate(texts)), reverse=True)
    got = {r.doc_id: r for r in fingerprint.edit_report(docs).collect()}
    for at, (i, text) in enumerate(rows):
        third = len(text) // 3
        edited = text[: len(text) - third] + rows[(at + 1) % len(rows)][1][:third]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
    assert got[13].fingerprint == got[14].fingerprint == got[1].fingerprint
    assert fingerprint.edit_report(nothing).count() == 0


def test_licenses(docs, texts, spark, nothing):
    rows = [(0, "x Licensed under the Apache\nLicense, Version 2.0."), (1, "under the MIT license. Under the mit-license!"), (2, "CC-BY-NC"), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "licensed work of the public"), (5, None)]
    got = {r.doc_id: r for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[0].base_labels, got[0].first_word, got[0].n_base) == ("apache-2", 4, 1)
    assert (got[1].labels, got[1].n_base, got[1].first_word, got[1].last_word) == ("mit", 2, 0, 4)
    assert got[2].base_labels == "cc-by-nc" and got[3].base_labels == "" and got[3].labels == "gpl-3" and got[3].score == 1.0
    assert (got[4].labels, got[4].score) == ("", 0.0) and (got[5].n_words, got[5].first_word) == (0, None)
    assert licenses.license_report(nothing).count() == 0


def test_suffix_automaton_gives_matching_statistics():
    rng = random.Random(2)
    templates = [[rng.randint(0, 3) for _ in range(12)] for _ in range(3)]
    automaton = licenses.SuffixAutomaton(templates)
    text = [rng.randint(-1, 3) for _ in range(60)]
    inside = lambda run: any(run == t[i : i + len(run)] for t in templates for i in range(len(t)))
    for end, length, state in automaton.runs(text):
        run = text[end - length + 1 : end + 1]
        assert inside(run) and (end + 1 == len(text) or not inside([*run, text[end + 1]]))
        places = {(n, i + length - 1) for n, t in enumerate(templates) for i in range(len(t) - length + 1) if t[i : i + length] == run}
        assert {(n, p) for n, ps in automaton.ends[state].items() for p in ps} == places


def test_mixing(docs, texts, nothing):
    got = mixing.mix(docs, ["doc_id", "source"], seed=3).collect()
    again = mixing.mix(docs.repartition(2), ["doc_id", "source"], seed=3).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    size = Counter()
    for r in got:
        assert r["size"] == len(words_of(texts[r.doc_id])) and r.taken <= 2 * r["size"]
        size[r.source] += r["size"]
    target = {r.source: r.target for r in got}
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    left, capped = {"a": 5.0, "b": 2.0, None: 1.0}, {}
    while True:
        rest = 1.5 * sum(size.values()) - sum(capped.values())
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            capped[s] = 2.0 * size[s]
            del left[s]
    assert target == pytest.approx(share | capped)
    for s, t in target.items():
        own = [r["size"] for r in got if r.source == s]
        whole = int(t // size[s]) * size[s]
        sums = {whole}
        for n in own:
            sums |= {x + n for x in sums}
        assert sum(r.taken for r in got if r.source == s) == max(x for x in sums if x <= t)
    assert mixing.mix(nothing).count() == 0


def test_knapsack_is_optimal():
    rng = random.Random(4)
    for _ in range(50):
        sizes = rng.sample(range(1, 30), 4)
        counts = [rng.randint(0, 4) for _ in sizes]
        budget = rng.randint(0, 80)
        sums = {0}
        for s, c in zip(sizes, counts, strict=True):
            sums = {x + s * k for x in sums for k in range(c + 1)}
        taken = mixing.knapsack(sizes, counts, budget)
        assert all(taken.get(s, 0) <= c for s, c in zip(sizes, counts, strict=True))
        assert sum(s * k for s, k in taken.items()) == max(x for x in sums if x <= budget)


def test_language(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    model = language.fitted(docs, fold != 1)
    rows = language.identified(docs, model).filter(fold == 1).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    odd = language.identified(spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the of and in")], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in odd] == ["und", "und", "und", "en"]
    assert {r.lang_pred for r in language.identified(docs, language.fitted(nothing, F.lit(True))).collect()} == {"und"}


@pytest.mark.parametrize(("node", "fan", "depth"), [(16, 256, 12), (4, 3, 12), (4, 3, 1)])
def test_cover_tree_equals_brute_force(spark, monkeypatch, node, fan, depth):
    for name, value in (("NODE", node), ("FAN", fan), ("DEPTH", depth), ("GROUP", 32)):
        monkeypatch.setattr(covertree, name, value)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 6))
    points = np.concatenate([centres[rng.integers(0, 12, 150)] + rng.normal(scale=0.08, size=(150, 6)), rng.normal(size=(30, 6))]).astype(np.float32)
    points[7] = points[9] = points[8]
    rows = [(i, p.tolist(), i % 2, "x") for i, p in enumerate(points)]
    rows += [(500, None, 1, "x"), (501, [0.0] * 6, 1, "x"), (502, [float("nan")] * 6, 1, "x"), (503, points[0].tolist(), None, "x"), (504, [1.0, None], 1, "x"), (505, [], 0, "x"), (506, [1.0, 2.0], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key string")
    unit = points.astype(np.float64) / np.linalg.norm(points.astype(np.float64), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (np.arange(180)[:, None] % 2 == np.arange(180) % 2)
    np.fill_diagonal(near, False)
    label = np.arange(180)
    while True:
        new = np.minimum(label, np.where(near, label[None], 999).min(1))
        if (new == label).all():
            break
        label = new
    got = {r.vec_id: r for r in covertree.similar_vectors(df).collect()}
    assert [got[i].n_links for i in range(180)] == near.sum(1).tolist()
    assert [got[i].component_id for i in range(180)] == label.tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(500, 507))
    assert covertree.similar_vectors(df.limit(0)).count() == 0


def test_near_copies_alone_go_where_ids_are_repeated_or_null(spark):
    import corpus_pipeline

    rng = random.Random(5)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(30)) for _ in range(5))
    rows = [(1, a), (2, a), (7, b), (7, c), (7, b), (7, None), (None, d), (None, d), (None, e), (9, e)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert kept.columns == ["doc_id", "text"]
    assert Counter(tuple(r) for r in kept.collect()) == Counter([(1, a), (7, b), (7, c), (7, None), (None, d), (9, e)])


def test_pipeline_drops_texts_that_the_classifier_cannot_tell(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, "これは日本語の文章です", None), (-2, "Αυτό είναι ένα κείμενο στα ελληνικά που κανείς δεν έμαθε", None), (-3, "the of and in", None), (-4, "12 !?", None)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.union(odd), "").select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()} | {-3}
    one = spark.createDataFrame([(i, "the of and in", "en") for i in range(8)], docs.schema)
    assert corpus_pipeline.language(spark, one, "").count() == 8


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "/root/testdata/sf0.001")
        assert kept.columns == columns, name
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert 0 < kept.count()
    out = corpus_pipeline.STAGES[-1][1](spark, kept, "/root/testdata/sf0.001")
    assert out.count() == kept.count()
    digests = {hashlib.sha256(r.text.encode()).hexdigest() for r in kept.select("text").collect()}
    assert {r.decoded_sha256 for r in out.collect()} == digests


def thue_morse():
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_regular_strings_have_names_of_their_own(spark):
    one, other = thue_morse()
    rows = [(1, one), (2, other), (3, other + one), (4, one + other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(set(words.Words(pa.array([t for _, t in rows])).names.tolist())) == 4
    data = np.frombuffer((one * 40 + other * 40).encode(), np.uint8)
    starts = np.arange(0, len(data) - 300, 7)
    for length in (1, 7, 8, 9, 100, 255, 256, 300):
        strings = [data[i : i + length].tobytes() for i in starts]
        assert len(set(words.span_names(data, starts, starts + length).tolist())) == len(set(strings))
    assert {r.component_id for r in minhash.near_duplicates(df).collect()} == {1, 2, 3, 4}
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    assert {(r.doc_id, r.decoded_sha256) for r in byte_bpe.round_trip(df, path).collect()} == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
    own = tokens.load(tokenizers.path("word_bpe_49k.json"), False)
    expected = {i: zlib.crc32(np.array([*own.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in rows}
    assert {r.doc_id: r.ids_crc32 for r in stream_files.token_report(df, tokenizers.path("word_bpe_49k.json")).collect()} == expected
    assert len({r.fingerprint for r in fingerprint.fingerprints(df).collect()}) == 4
    assert {r.n_known for r in lattice.lattice_scores(df, tokenizers.path("piece_bpe_32k.model"), F.col("doc_id") == 1).collect() if r.doc_id > 1} == {1}


def test_license_chains_are_no_longer_than_their_template(spark):
    template = next(text for label, text in licenses.TEMPLATES if label == "gpl")
    half = template.split()
    far = " ".join(half[: len(half) // 2]) + " word" * 20_000 + " " + " ".join(half[len(half) // 2 :])
    twice = f"x {template} y z {template}"
    rows = [(1, far), (2, twice), (3, template.upper()), (4, "cc by nc cc by nc"), (5, "cc by\n-nc"), (6, "cc by xx nc")]
    got = {r.doc_id: r for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].labels, got[1].score, got[1].spans) == ("", 0.0, [])
    n = len(licenses.tokens(template))
    assert sorted((s.first, s.last) for s in got[2].spans if s.label == "gpl") == [(1, n), (n + 3, 2 * n + 2)]
    assert got[3].score == 1.0 and (got[4].n_base, got[4].first_word, got[4].last_word) == (2, 0, 3)
    assert (got[5].n_base, got[6].n_base) == (1, 0)


def chains_one_by_one(scanner, found, size):
    """The best chain, then the best of the runs that it leaves, each looked for from the start."""
    out = []
    while True:
        best, top = [], (0, 0, 0)
        for i, (word, place, length) in enumerate(found):
            cover, first = length, word
            for j in range(i - 1, -1, -1):
                w, p, n = found[j]
                if word - w > licenses.STRETCH * size:
                    break
                if w + n <= word and p + n <= place and word + length - best[j][1] <= licenses.STRETCH * size and best[j][0] + length > cover:
                    cover, first = best[j][0] + length, best[j][1]
            best.append((cover, first))
            top = max(top, (cover, -first, word + length - 1))
        if top[0] < licenses.LEAST_COVER * size:
            return out
        out.append((top[0], -top[1], top[2]))
        found = [x for x in found if x[0] > top[2] or x[0] + x[2] <= -top[1]]


def test_chains_equal_those_found_one_by_one():
    rng = random.Random(4)
    for _ in range(400):
        size = rng.randint(3, 20)
        found = sorted({(rng.randint(0, 150), rng.randint(0, size - 1), rng.randint(1, size)) for _ in range(rng.randint(0, 60))})
        assert list(licenses.chains(found, size)) == chains_one_by_one(None, found, size)


def test_many_copies_of_a_notice_take_linear_time():
    import time

    label, text = min(licenses.TEMPLATES, key=lambda t: len(t[1]))
    scanner = licenses.LicenseScanner()
    words_ = words.Words(pa.array([(text + " other words ") * 20_000]), licenses.ALNUM_WORDS)
    began = time.time()
    spoken, covered = scanner.scan(scanner.numbers(words_).tolist(), list(range(len(words_.names))))
    assert sum(scanner.labels[t] == label for t, *_ in covered) == 20_000 and time.time() - began < 20


def test_phrases_equal_brute_force(spark):
    rng = random.Random(8)
    pool = " ".join([*licenses.PHRASES, "x", "the license of version"]).split()
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 120)))) for i in range(300)]
    for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        own = rows[r.doc_id][1].split()
        found = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split())
        assert r.n_base == len(found) and r.first_word == (found[0][0] if found else None) and r.last_word == (found[-1][0] if found else None)
        assert r.base_labels == ",".join(sorted({label for _, label in found})) and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_budgets_are_fitted_alike_at_every_size():
    rng = np.random.default_rng(3)
    sizes = np.unique([1, *rng.integers(1, 900, 200)])
    counts = rng.integers(1, 400, len(sizes))
    total = int((sizes * counts).sum())
    for budget in (0, 1, 5000, 8191, 8192, 8193, 9000, 50_000, total // 2, total - 1, total, total + 5):
        take = mixing.fit(sizes, counts, float(budget))
        assert (take >= 0).all() and (take <= counts).all() and int((take * sizes).sum()) == min(budget, total)
    share = mixing.fit(sizes, counts, total / 2) / counts
    assert abs(float((share * counts).sum() / counts.sum()) - 0.5) < 0.05


def test_columns_whose_names_clash_stay(spark, docs, texts):
    import corpus_pipeline

    extra = ["score", "Lang_Pred", "lang_score", "size", "source_size", "target", "taken", "copies", "row", "did", "spans", "own", "empty", "slot", "id", "component_id", "kept", "place", "draw", "bucket"]
    wide = docs.drop("size", "component", "value").select("*", *(F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in extra))
    assert mixing.mix(wide, wide.columns).columns[-5:] == list(mixing.MEASURES)
    kept = wide
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = shared.keep(stage(spark, kept, ""))
        assert kept.columns == wide.columns, name
        assert all(r[c] == f"{c}-{r.doc_id}" for r in kept.collect() for c in extra), name


def test_pipeline_of_nothing(spark, nothing):
    import corpus_pipeline

    kept = nothing
    for _, stage in corpus_pipeline.STAGES:
        kept = shared.keep(stage(spark, kept, ""))
        assert kept.count() == 0


def test_texts_larger_than_a_step(spark):
    rng = random.Random(9)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(60_000))
    assert len(long) > words.STEP
    rows = [(1, long), (2, long[5000:5150]), (3, long[-150:] + long[1000:1100]), (4, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in suffix.repeat_report(df).collect()} == {1: 0, 2: 150, 3: 250, 4: 0}
    assert {r.doc_id: r.decoded_sha256 for r in byte_bpe.round_trip(df, tokenizers.path("byte_bpe_50k.tiktoken")).collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows}
    assert {r.doc_id: r.n_shingles for r in minhash.near_duplicates(df).collect()}[1] == len({tuple(w) for w in zip(*(long.split()[i:] for i in range(5)))})
    assert all(r.n_chars == len(dict(rows)[r.doc_id]) for r in fingerprint.edit_report(df).collect())


@pytest.mark.parametrize("name", ["op3_minhash_near_dedup", "op9_suffix_dedup"])
def test_sql_gives_the_same_rows(spark, docs, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    ours = queries.QUERIES[name](spark, str(tmp_path))
    theirs = con.sql(f"select {', '.join(ours.columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, ours.collect())) == sorted(theirs)
