"""Spelling variants, language identification and token alignment against brute force."""

import bisect
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.llm import alignment, language_id, queries, segmentation, spelling
from panelloom.llm.vocabularies import byte_level_tokenizer, path_of, pieces_model

FOLDER = "/root/testdata/sf0.001"
SYLLABLES = "ba ko mi tu re sol dan vi ße ñá çe ÿö".split()


def word(draw):
    return "".join(draw.choice(SYLLABLES) for _ in range(draw.randrange(3, 6)))


def edited(word, draw):
    at, letter = draw.randrange(len(word)), draw.choice("abkoé×")
    return draw.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]])


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, one_in=None):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n}


def variant_rows(frame):
    return [tuple(r) for r in frame.select("word", "n", "n_near", "form", "form_n", "root").collect()]


@pytest.mark.parametrize("one_in", [None, 3])
def test_variants_as_brute_force(documents, one_in):
    draw, words = random.Random(4), []
    for _ in range(60):
        base = word(draw)
        words += [base] * draw.choice([5, 30, 200])
        for _ in range(4):
            words += [edited(base, draw)] * draw.choice([4, 5, 6])
    words += ["aaaaaa"] * 5 + ["aaaaaaa"] * 25 + ["aaaaaaaa"] * 125 + ["ab" * 40] * 5 + ["ab" * 40 + "a"] * 26
    words += ["tiedone"] * 5 + ["tiedona"] * 25 + ["tiedonb"] * 25
    draw.shuffle(words)
    rows = [(i % 7, " ".join(words[at : at + 50]).upper() if i % 3 else "-".join(words[at : at + 50]))
            for i, at in enumerate(range(0, len(words), 50))]
    rows += [(None, None), (1, ""), (None, f"{words[0]} 12 {'x' * 5000}"), rows[0], rows[0]]
    docs = documents(*rows).withColumn("word", F.lit("w")).withColumn("n", F.lit(1)).withColumn("key", F.lit(2))
    counted = spelling.store(spelling.word_counts(docs, one_in=one_in), "words")
    got = variant_rows(spelling.group_variants(counted))
    want = brute_variants(rows, one_in)
    assert len(got) == len(want) and set(got) == want
    assert one_in or any(r[3] != r[5] for r in got if r[3])
    assert spelling.group_variants(spelling.store(counted.limit(0), "none")).count() == 0


@pytest.mark.parametrize("symbols", [2, 5])
def test_neighbourhoods_are_full(symbols):
    for length in range(1, 6):
        words = list(itertools.product(range(1, symbols + 1), repeat=length))[:200]
        rows, keys = spelling.neighbours(np.array(words, dtype=np.uint64), symbols)
        for i, w in enumerate(words):
            near = {w}
            for at in range(length + 1):
                near |= {w[:at] + (s,) + w[at:] for s in range(1, symbols + 1)}
                near |= {w[:at] + (s,) + w[at + 1 :] for s in range(1, symbols + 1)} if at < length else set()
                near |= {w[:at] + w[at + 1 :]} if at < length else set()
            own = keys[rows == i].tolist()
            want = {int(spelling.keys_of(np.array([x], dtype=np.uint64).reshape(1, -1))[0]) for x in near}
            assert len(own) == len(set(own)) and set(own) == want


def brute_total(text, probability, trie):
    """Sum over all segmentations, by recursion."""
    index = {p: i for i, p in enumerate(trie.pieces)}

    def total(rest):
        if not rest:
            return 1.0
        found = [(index[rest[:k]], k) for k in range(1, len(rest) + 1) if rest[:k] in index]
        if not any(k == 1 for _, k in found):
            found.append((len(trie.pieces), 1))
        return sum(probability[i] * total(rest[k:]) for i, k in found)

    return total(text)


def test_all_segmentations_are_summed():
    trie = segmentation.trie_of(language_id.VOCABULARY)
    draw = np.random.default_rng(1)
    models = draw.dirichlet(np.ones(len(trie.pieces) + 1), size=3)
    words = ["the", "a", "straße", "漢字", "intention", "zq́x", "ÿ"]
    got = segmentation.log_probabilities(words, models, trie)
    for w, scores in zip(words, got):
        for m, score in zip(models, scores):
            assert math.isclose(score, math.log(brute_total("▁" + w, m, trie)), rel_tol=1e-9)
    long = "ab" * 500
    assert np.isfinite(segmentation.log_probabilities([long], models, trie)).all()
    used = segmentation.expected_counts(["the"], np.array([5]), np.array([1]), models, trie)
    spelled = sum(len(p) * n for p, n in zip([*trie.pieces, "?"], used[1]))
    assert math.isclose(spelled, 5 * len("▁the"), rel_tol=1e-9) and used[0].sum() == used[2].sum() == 0


def test_languages_are_told_apart(documents):
    tongues = {"xa": "lopa mirte sanco velu", "xb": "krigt schowl hefn mbragt", "xc": "ñió quéz áluz íñor"}
    draw = random.Random(2)

    def text(lang, n):
        return " ".join(draw.choice(tongues[lang].split()) + draw.choice(["", "s", ", 7"]) for _ in range(n))

    rows = [(i, text(lang := "xa xb xc".split()[i % 3], 1 + i % 30), lang) for i in range(300)]
    odd = [(1000, None, None), (1001, "", "xa"), (1002, "12 -- 7", "xb"), (None, "LOPA", None), (5, "schowl", None)]
    docs = documents(*rows, *odd, schema="doc_id long, text string, lang string").withColumn("__text", F.lit(1))
    model = language_id.train(docs.where(~language_id.held_out()))
    assert model.languages == ["xa", "xb", "xc"] and np.allclose(model.probability.sum(axis=1), 1)
    got = [(r["doc_id"], r["lang"], r["lang_pred"], r["score"]) for r in language_id.predict(docs, model, cached=5).collect()]
    assert len(got) == 305 and all(0 <= s <= 1 for *_, s in got)
    by_id = {(i, lang): (p, s) for i, lang, p, s in got}
    assert all(by_id[i, lang][0] == lang for i, _, lang in rows)
    assert all(by_id[i, lang] == ("und", 0.0) for i, lang in ((1000, None), (1001, "xa"), (1002, "xb")))
    assert by_id[None, None][0] == "xa" and by_id[5, None][0] == "xb"
    none = language_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0
    clashing = docs.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(7)).withColumn("a.b", F.lit(1))
    again = language_id.predict(clashing, model)
    assert again.columns == ["doc_id", "lang", "__text", "a.b", "lang_pred", "score"]
    assert sorted((r["doc_id"] or -1, r["score"]) for r in again.collect()) == sorted((i or -1, s) for i, _, _, s in got)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", F.col("lang").alias("own"))
    got = queries.op12_language_id(spark, FOLDER)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    rows = got.where("held_out").join(docs, "doc_id").collect()
    for r in got.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert len(rows) > 30 and sum(r["lang_pred"] == r["own"] for r in rows) >= 0.9 * len(rows)


def brute_alignment(rows):
    a_model, b_model = byte_level_tokenizer(alignment.BYTE_LEVEL), pieces_model(alignment.PIECES)
    shown, held, made = alignment.visible_bytes(), Counter(), []
    for doc, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(shown[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := b_model.id_to_piece(i)) and b_model.is_byte(i)
                   else p.replace("▁", " ").encode() for i in b]
        if not text or {b"".join(a_bytes), b"".join(b_bytes)} != {f" {text}".encode()}:
            a, b, a_bytes, b_bytes = [], [], [], []
        spans = [list(zip([0, *ends[:-1]], ends)) for ends in (np.cumsum([len(x) for x in s]).tolist() for s in (a_bytes, b_bytes))]
        owners = [[i for i, x in enumerate(s) for _ in x] for s in (a_bytes, b_bytes)]
        links = [(a[i], b[j]) for i, j in sorted(set(zip(*owners)))]
        ends = [[e for _, e in span] for span in spans]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, start = [], 0
        for end in common:
            own = []
            for ids, stops in zip((a, b), ends):
                from_, to = (bisect.bisect_right(stops, x) for x in (start, end))
                own.append(",".join(map(str, ids[from_:to])))
            groups.append("|".join(own))
            start = end
        held.update(set(links))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        made.append((doc, len(a), len(b), len(groups), links, digest))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(n, best.get(x, 0))
    return sorted(
        (-1 if doc is None else doc, n_a, n_b, n, len(links), digest, sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links))
        for doc, n_a, n_b, n, links, digest in made
    )


def odd_text(draw):
    pieces = ["the", "don't", "naïve", "漢字", "😀", "<s>", "<|endoftext|>", "12345", "á", " ", "x" * 70, "http://a.b/c", "É", "'s", "　"]
    spaces = [" "] * 6 + ["  ", "\n", "\t", " \n ", " ", "\r\n", "   "]
    return "".join(draw.choice(pieces) + draw.choice([*spaces, ""]) for _ in range(draw.randrange(1, 30)))


def test_alignment_as_brute_force(documents):
    draw = random.Random(8)
    rows = [(i, odd_text(draw)) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " "), (203, "mark ▁ inside"), (204, "a\x00b"), (None, "the same"), (None, "the same"), (3, "the same"), (205, "word " * 3000)]
    docs = documents(*rows).withColumn("block", F.lit("b")).withColumn("place", F.lit(0)).withColumn("n_a", F.lit(0))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    want = brute_alignment(rows)
    assert sum(r[1] > 0 for r in want) > 110 and [r[1:5] for r in want if r[0] == 203] == [(0, 0, 0, 0)]
    for block, cached in ((alignment.BLOCK, 100_000), (40, 20)):
        made = alignment.align_tokens(docs.repartition(3), block=block, cached=cached).select(columns)
        assert sorted(tuple(-1 if c is None else c for c in r) for r in made.collect()) == want
    assert alignment.align_tokens(docs.limit(0)).count() == 0


def test_alignment_of_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_token_alignment(spark, FOLDER)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted(tuple(r) for r in got.select(columns).collect()) == brute_alignment(rows)


def test_groups_slice_both_lists():
    def aligned(a, b, ends_a, ends_b):
        found = alignment.align(ends_a, ends_b)
        links = [(a[i], b[j]) for i, j in zip(found.link_a, found.link_b)]
        return alignment.written(a, b, found, np.arange(len(found.ends)) == len(found.ends) - 1), links

    assert aligned([1, 2, 3], [4, 5, 6, 7], [2, 3, 7], [1, 4, 6, 7]) == (
        ["1,2,3|4,5,6,7"], [(1, 4), (1, 5), (2, 5), (3, 5), (3, 6), (3, 7)],
    )
    assert aligned([1, 2, 3], [8, 3], [2, 3, 7], [3, 7]) == (["1,2|8;3|3"], [(1, 8), (2, 8), (3, 3)])
    assert aligned([], [], [], []) == ([], [])


def test_vocabulary_paths():
    assert path_of("/x/y.json") == "/x/y.json" and path_of("byte_bpe_50k.json").endswith("/byte_bpe_50k.json")


def test_alignments_are_kept_for_later_tasks():
    files = alignment.BYTE_LEVEL, alignment.PIECES
    first = alignment.chunks_of(*files, 100)
    [chunk] = first.of(["Wörter"])
    assert alignment.chunks_of(*files, 100) is first and first.of(["Wörter"])[0] is chunk
