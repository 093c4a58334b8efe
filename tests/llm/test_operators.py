"""Operators against brute force on small tables: nulls, ties, repeats, long and empty texts."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from panelloom.llm import (
    chat_format,
    decontaminate,
    jaccard_join,
    license_scan,
    line_dedup,
    mixing,
    queries,
    sharding,
    token_counts,
    topk_search,
    toxicity,
)

WORDS = [a + b for a in "ba ko mi tu re sol dan vi".split() for b in "lo na per gi sta hum".split()]


def prose(n, seed):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(n))


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]


def test_lines_on_many_sites_go(documents):
    shared = "Subscribe to our letter"
    docs = documents(
        *[(i, f"{prose(5, i)}\n  {shared.upper() if i % 2 else shared}", f"s{i}") for i in range(6)],
        (10, shared, None), (11, None, "s1"), (12, "", "s1"), (13, "only here\n\nonly here", "s1"),
        *[(20 + i, "same site\nother", "s9") for i in range(7)], (11, None, "s1"),
    )
    got = {r["doc_id"]: r for r in line_dedup.remove_boilerplate(docs, min_sites=5).collect()}
    assert got[0]["text"] == prose(5, 0) and got[0]["n_removed"] == 1
    assert got[10]["text"] == "" and got[11]["text"] is None and got[11]["n_lines"] == 0
    assert got[13]["n_removed"] == 0 and got[20]["text"] == "same site\nother"
    assert line_dedup.remove_boilerplate(docs.limit(0)).count() == 0


ODD_NAMES = ["n_lines", "n_removed", "a", "b", "__id", "__text", "__gone", "__of", "__kept", "__key", "__source", "__size",
             "last", "rest", "start", "range", "upto", "__nth", "__times", "__target", "col0", "n"]


def with_odd_columns(docs):
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in ODD_NAMES])


def test_columns_of_any_name_stay(documents):
    docs = documents(*[(i, f"{prose(9, i)}\nshared line", f"s{i}") for i in range(8)], (None, None, None))
    plain = line_dedup.remove_boilerplate(docs)
    odd = line_dedup.remove_boilerplate(with_odd_columns(docs))
    kept = [c for c in ODD_NAMES if c not in ("n_lines", "n_removed")]
    assert odd.columns == [*docs.columns, *kept, "n_lines", "n_removed"]
    assert {tuple(r[c] for c in kept) for r in odd.collect()} == {tuple(f"own {c}" for c in kept)}
    assert sorted(map(str, rows_of(odd.select(plain.columns)))) == sorted(map(str, rows_of(plain)))
    plain, odd = mixing.mix(docs), mixing.mix(with_odd_columns(docs))
    assert odd.columns == [*docs.columns, *ODD_NAMES]
    assert {tuple(r[c] for c in ODD_NAMES) for r in odd.collect()} == {tuple(f"own {c}" for c in ODD_NAMES)}
    assert sorted(map(str, rows_of(odd.select(docs.columns)))) == sorted(map(str, rows_of(plain)))


def test_spread_bound_is_exact(documents):
    docs = documents(*[(k * 100 + i, f"line {k}", f"s{i}") for k in range(3, 9) for i in range(k)])
    found = line_dedup.boilerplate(docs, min_sites=5)
    assert found.count() == sum(k >= 5 for k in range(3, 9))


def test_chats_read_back(spark):
    said = [
        (1, 0, "system", "be \\ brief"), (1, 1, "user", "#### </turn>\n### User: hi"), (1, 2, "assistant", None),
        (2, 0, "assistant", "too early"), (2, 0, "assistant", "too early"), (3, None, None, "x"),
        (3, 1, "a:b\\@</turn>", "y </turn>"), (None, 1, "user", ""),
    ]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("z"))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(turns)).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(
            [(-1 if t is None else t, r or "", x or "") for c, t, r, x in said if c == conv]
        )
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        learned = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["turns_sha256"] == digest and got[conv]["n_turns"] == len(own)
        assert got[conv]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert got[1]["valid"] and got[1]["complete"] and not got[2]["valid"] and not got[3]["valid"]
    assert chat_format.read_back(chat_format.format_chats(turns.limit(0))).count() == 0


def test_licenses_and_suppression(documents):
    docs = documents(
        (1, "Under the MIT-License! and cc by nc sa 4.0; CC BY NC"), (2, None), (3, "Apache License, Version 2.0"),
        (4, "x " * 60_000 + "under the mit license"), (4, "nothing"), (5, "GNU General Public License v3"),
    )
    found = license_scan.scan_licenses(docs).select(
        "doc_id", "n_words", license_scan.labels_of("found", True), license_scan.labels_of("found"),
        license_scan.score_of("found"), F.transform("found", lambda d: d.first),
    )
    got = {(r[0], r[1]): r for r in rows_of(found)}
    one = got[(1, 14)]
    assert one[2] == "cc-by-nc,mit" and "cc-by-nc-sa" in one[3] and 0 < one[4] <= 1 and 0 in one[5]
    assert got[(2, 0)][3] == "" and got[(2, 0)][4] == 0.0
    assert got[(3, 5)][2] == "apache-2" and got[(4, 60_004)][2] == "mit"
    assert [r[3] for k, r in got.items() if k[0] == 5] == ["gpl-3"]
    assert license_scan.kept_of([(0, 5, 2, 0), (1, 3, 3, 1), (1, 3, 1, 2), (0, 5, 2, 3), (2, 3, 0, 4)]) == [
        True, False, True, False, True,
    ]
    assert len(license_scan.standard_rules()) > 200


def test_license_keywords_gate_no_alternative_off(documents):
    words_of = lambda name: {w for w in __import__("re").split(r"[^a-z0-9]+", name) if w}
    for label, keyword, name in license_scan.NAMES:
        for way in name[3:-1].split("|") if name.startswith("(?:") and name.endswith(")") else [name]:
            assert keyword in words_of(way), (label, way)
    docs = documents((1, "the FreeBSD license"), (2, "licensed under Apache2"), (3, "the ApacheV2 licence"), (4, "Apache2 and FreeBSD"))
    found = license_scan.scan_licenses(docs).select("doc_id", license_scan.labels_of("found"))
    assert dict(rows_of(found)) == {1: "bsd-2-clause", 2: "apache-2", 3: "apache-2", 4: ""}


def test_toxicity_learns_stems(documents, spark):
    bad = ["vileword", "grubface", "rotmouth"]
    draw = random.Random(3)
    texts = [(i, prose(40, i) + (f" {draw.choice(bad)} {draw.choice(bad)}s" if i % 4 == 0 else "")) for i in range(400)]
    docs = documents(*texts, (900, None), (901, ""), (None, "vileword"), (0, texts[0][1]))
    labels = spark.createDataFrame(
        [(i, int(i % 4 == 0)) for i in range(400)] + [(1, None), (None, 1), (4, 0)], "doc_id long, toxic int"
    )
    model = toxicity.train(docs, labels)
    got = toxicity.score_toxicity(docs, model).select("doc_id", toxicity.held_out(), "score").collect()
    assert len(got) == 404 and {r[1] for r in got if r[0] is not None} == {True, False}
    for i, held, score in got:
        assert held == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
        toxic = i is None or (i < 900 and i % 4 == 0)
        assert (score >= 0.5) == toxic and 0 <= score <= 1
    empty = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score_toxicity(docs, empty).collect()} == {0.0}


def test_scoring_takes_texts_from_arrow(documents):
    model = toxicity.ToxicityModel({"=bad": 4.0}, -2.0, 0.1)
    scored = toxicity.score_toxicity(documents((1, "a bad one"), (2, None), (3, "fine")), model)
    assert {r["doc_id"]: r["score"] > 0.5 for r in scored.collect()} == {1: True, 2: False, 3: False}
    assert "ArrowEvalPython" in scored._jdf.queryExecution().executedPlan().toString()
    assert not hasattr(toxicity, "pd")


def test_shards_move_only_to_the_new_one(documents):
    docs = documents(*[(i, "t") for i in range(500)], *[(7, "t")] * 200, (None, None))
    placed = sharding.shard(sharding.shard(docs, [1.0] * 6), [1.0] * 7, name="grown").select("doc_id", "shard", "grown")
    got = rows_of(sharding.numbered(placed, "shard", "doc_id", rows_in_range=50))
    assert len(got) == 701 and all(s == g or g == 6 for _, s, g, _ in got)
    for shard in range(6):
        slots = sorted(x for _, s, _, x in got if s == shard)
        assert slots == list(range(len(slots)))
    sizes = docs.withColumn("w", sharding.rendezvous(F.col("doc_id"), [3.0, 1.0, 0.0])).groupBy("w").count().collect()
    assert {r["w"] for r in sizes} == {0, 1}
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), [0.0])


def test_search_is_exhaustive(spark):
    draw = random.Random(5)
    vectors = [(i, [draw.uniform(-1, 1) for _ in range(6)]) for i in range(120)]
    vectors += [(200 + i, [0.5] * 6) for i in range(40)] + [(300, None), (301, [1.0, None]), (302, [float("nan")])]
    table = spark.createDataFrame(vectors + [vectors[0]], "vec_id long, embedding array<float>")
    got = {}
    for q, rank, v, s in rows_of(topk_search.search(table, F.col("vec_id") % 50 == 0, candidates_in_block=30, queries_in_block=2)):
        got.setdefault(q, []).append((rank, v, s))
    as_float = {r[0]: [int(256 * x // 1) for x in r[1]] for r in table.where("vec_id < 300").collect()}
    listed = [*as_float.items(), (0, as_float[0])]
    for q in (0, 50, 100, 200):
        scored = sorted((-sum(a * b for a, b in zip(as_float[q], t)), v) for v, t in listed if v != q)
        assert sorted(got[q]) == [(i + 1, v, -s) for i, (s, v) in enumerate(scored[:5])]
    assert topk_search.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_leaks_with_other_slots(documents, spark):
    item = "A train leaves with 30 passengers and after 5 km picks up 12 more so how many ride to the coast"
    moved = item.replace("30", "41").replace("12", "8")
    clash = "Of 5 boats and 5 rafts and 5 sails on the lake which carry the most of the heavy stones"
    bench = spark.createDataFrame([(1, item), (2, clash), (3, None), (4, "five small words only"), (1, item)], "item_id long, text string")
    docs = documents(
        (1, f"{prose(50, 1)}. {item}. {prose(50, 2)}"), (2, f"{prose(30, 3)}. {moved}"), (3, prose(400, 4)), (4, None), (5, ""),
        (6, clash.replace("5 rafts", "6 rafts")), (7, "so five small words only here"), (8, "the train leaves with 30 others"), (1, "x"),
    )
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got.pop((1, 1)) in ("exact", "near")
    assert got == {(2, 1): "reparameterised", (7, 4): "exact"}
    left = decontaminate.remove_leaks(docs, bench).select("doc_id").collect()
    assert sorted(r[0] for r in left) == [3, 4, 5, 6, 8]
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_leaks_in_any_letter_case(documents, spark):
    item = "A train leaves with 30 passengers and after 5 km picks up 12 more so how many ride to the coast"
    title, short = "Seven Old Bridges Over The Northern River Valley", "Old Mill Road Bridge"
    rows = [(1, item), (2, title), (3, short), (4, "Alone"), (1, prose(20, 8)), (5, "7")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    docs = documents(
        (1, f"{prose(50, 1)}. {item.upper()}. {prose(50, 2)}"), (2, f"{prose(9, 3)}. {item.title()}"), (3, f"so {title.lower()}"),
        (4, f"{prose(9, 4)}, {short.upper()} 7 alone"), (5, f"{item.upper()[:60]} {prose(900, 5)} {item.upper()[40:]}"),
        (None, title.upper()), (7, f"{' '.join(item.upper().split()[:12])} {' '.join(prose(20, 8).split()[:8])}"),
    )
    got = {(r["doc_id"], r["item_id"]): (r["kind"], r["coverage"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {k: ("exact", 1.0) for k in ((1, 1), (2, 1), (3, 2), (4, 3), (None, 2))}


def test_leaks_behind_other_places(documents, spark):
    item = "We count 7 boats on the lake and then 7 carts by the road while 9 men carry stones up to the old mill"
    clash, moved = item.replace("7 carts", "6 carts"), item.replace("7", "4").replace("9", "5")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    loose = clash.replace("7 boats", "3 boats").replace("9 men", "2 men")
    docs = documents(
        (1, f"{prose(9, 1)} {clash}"), (2, f"{loose} {prose(200, 2)} {moved}"), (3, f"{loose} {moved}"), (4, f"{moved} {loose}"),
        (5, loose), (6, f"{loose} {prose(90, 3)} {item.upper()}"), (7, f"{loose} {loose} {moved.replace('old', 'new')}"),
        (8, " ".join([loose] * 20 + [moved] + [loose] * 20)),
    )
    got = {r["doc_id"]: (r["kind"], r["changed_slots"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    moved_slots = ("reparameterised", 3)
    assert got == {1: ("near", 0), 2: moved_slots, 3: moved_slots, 4: moved_slots, 6: ("exact", 0), 7: moved_slots, 8: moved_slots}


def test_leaks_go_by_row(documents, spark):
    item = prose(12, 77)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = documents((None, f"so {item}"), (None, "clean"), (None, None), (1, item), (1, "clean too"), (2, "clean"))
    by_row = decontaminate.remove_leaks(docs, bench, by_row=True).select("doc_id", "text").collect()
    assert {tuple(r) for r in by_row} == {(None, "clean"), (None, None), (1, "clean too"), (2, "clean")}
    by_id = decontaminate.remove_leaks(docs, bench).select("doc_id", "text").collect()
    assert {tuple(r) for r in by_id} == {(None, "clean"), (None, None), (2, "clean")}


def test_mix_meets_targets(documents):
    docs = documents(
        *[(i, prose(5 + i % 9, i), "abc"[i % 3] if i % 7 else None) for i in range(400)],
        *[(1000, prose(8, 1), "a")] * 60, (5000, None, "empty"), (5001, "", "a"),
    )
    taken = mixing.mix(docs).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("words"))
    words = {r["source"]: r["words"] for r in taken.collect()}
    sizes = docs.groupBy(F.col("source")).agg(F.sum(mixing.word_count(F.col("text"))).alias("total"))
    aims = {r["source"]: r["target"] for r in mixing.targets(sizes, (5, 2, 1), 1.5, 2.0).collect()}
    total = sum(r["total"] for r in sizes.collect())
    assert abs(sum(aims.values()) - 1.5 * total) < 1e-6
    assert all(abs(words.get(s, 0) - aim) <= (250 if s == "a" else 20) for s, aim in aims.items())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_tokens_as_the_library(documents):
    texts = [None, "", "It's 'S  two\n\n spaces \t <|endoftext|> x<|endoftext|>", "naïve façade №5    漢字 😀", prose(3000, 1), "a" * 5000]
    docs = documents(*enumerate(texts), (1, "again"))
    counted = token_counts.count_tokens(docs, queries.TOKENIZER, cached=50)
    own = token_counts.tokenizer(queries.TOKENIZER)
    for i, text, _, n_bytes, n_tokens, over in rows_of(counted):
        n = len(own.encode(text or "", add_special_tokens=False).ids)
        assert (n_bytes, n_tokens, over) == (len((text or "").encode()), n, n > 512), (i, text)


def brute_components(rows, n, percent):
    sets = []
    for _, text in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        words = [w for w in __import__("re").split("[\\x20\\x09-\\x0D]+", low) if w]
        sets.append({tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, min(len(words), 1)))})
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        smallest[root(i)] = min(doc, smallest.get(root(i), doc))
    return sorted((doc, len(s), smallest[root(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_components_as_brute_force(documents, n, percent):
    draw, rows = random.Random(9), []
    for group in range(12):
        base = prose(90, group).split()
        for _ in range(12):
            copy = list(base)
            for _ in range(draw.randrange(5)):
                copy[draw.randrange(len(copy))] = draw.choice(WORDS)
            rows.append(" ".join(copy) + (" " + prose(draw.randrange(6), len(rows)) if draw.random() < 0.3 else ""))
    rows += ["", None, "one", "ONE", "one two", "Two one", prose(9000, 1), prose(9000, 1) + " tail", "  \t "]
    draw.shuffle(rows)
    rows = [(i + 1, t) for i, t in enumerate(rows)]
    docs = documents(*rows).withColumn("cls", F.lit(1)).withColumn("size", F.lit("x"))
    assert sorted(rows_of(jaccard_join.near_duplicates(docs, n, percent))) == brute_components(rows, n, percent)


def test_shared_grams_travel_for_possible_links_only(documents, monkeypatch):
    stored, store = {}, jaccard_join.store
    monkeypatch.setattr(jaccard_join, "store", lambda frame, name: stored.setdefault(name, []).append(store(frame, name)) or stored[name][-1])
    words = [f"w{i}" for i in range(47)]
    rows = [(i, " ".join(words[a:b])) for i, (a, b) in enumerate([(0, 2), (2, 7), (7, 18), (18, 41), (0, 47)], 1)]
    assert sorted(rows_of(jaccard_join.near_duplicates(documents(*rows), 1, 50))) == brute_components(rows, 1, 50)
    assert stored["shared_grams"][0].count() > 0 and stored["grams"][0].count() == 0


@pytest.mark.parametrize(("n", "percent"), [(2, 60)])
def test_chance_sharing_as_brute_force(documents, n, percent):
    draw = random.Random(n)
    rows = [(i + 1, " ".join(draw.choices("abcdefg"[: 9 - 2 * n], k=draw.randrange(1, 40)))) for i in range(90)]
    rows += [(200 + i, text) for i, (_, text) in enumerate(rows[:9])]
    assert sorted(rows_of(jaccard_join.near_duplicates(documents(*rows), n, percent))) == brute_components(rows, n, percent)


def test_one_of_each_stays(documents):
    text = prose(60, 1)
    docs = documents((3, text), (2, text + " end"), (2, text + " end"), (5, prose(60, 2)), (6, None), (7, ""), (None, prose(50, 3)))
    assert sorted((r["doc_id"] or 0) for r in jaccard_join.keep_one_of_each(docs).collect()) == [0, 2, 5, 6, 7]
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0


def test_copies_go_by_row(documents):
    a, b, c, d = (prose(60, i) for i in (1, 2, 3, 4))
    docs = documents(
        (1, a), (2, a + " end"), (2, b), (None, b + " end"), (None, c), (None, c), (None, c + " end"), (5, d), (5, d + " end"),
        (5, d + " end"), (None, None), (None, None), (5, ""), (None, prose(60, 5)),
    )
    got = [tuple(r) for r in jaccard_join.keep_one_of_each(docs).select("doc_id", "text").collect()]
    own = lambda text: [(i, t) for i, t in got if (t or "").startswith(text)]
    assert own(a) == [(1, a)] and own(b) == [(2, b)] and len(own(c)) == 1 and len(own(d)) == 1
    assert len(got) == 8 and got.count((None, None)) == 2 and (5, "") in got and (None, prose(60, 5)) in got
