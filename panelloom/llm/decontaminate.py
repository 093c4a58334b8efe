"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Text becomes a template: words in lower case, while numbers, names and the units after
numbers turn into typed placeholders. Windows of `window` template tokens of the benchmark
are hash-joined with windows of the documents. For each (document, item) found, every alignment
that has enough windows itself, and the best ones of each stretch of twice the item's
length, are looked at again in the whole neighbourhood: `coverage` is the share of the
item's tokens inside common windows, and slots must be consistent, that is, one value of
the item always stands for one value of the document. A match whose slots differ is a
re-parameterised question, one whose slots agree an exact or near copy. Of several places
the one with the fewest changed slots is reported.

Windows are taken at every token on both sides, so that no common window is missed. A
benchmark window needs at least two distinct plain words, as placeholders alone match any
table of numbers.

Names are told by capitals, so a passage in capitals or title case has another template. A
second stream of windows therefore holds the words as they are, in lower case: a place with
at least `min_coverage` of the item's tokens in such windows is a leak whatever its slots. Its coverage comes from the joined windows alone, over all alignments that lie
within the item's length of each other. All these windows count; only an item shorter than
`window` needs two distinct words, as it would else be found wherever its one word stands.

Windows of documents are never shuffled while the benchmark's windows are few (their
stored rows are counted); beyond that both sides are shuffled by hash. Texts are read
again only for documents with a match.

Defined cases: null or empty texts and items match nothing; items shorter than `window`
tokens are compared as one window of their own length; repeated rows and ids: a pair
(doc_id, item_id) is reported once if any of its rows matches, each text of an item being
compared by itself; slots are 0 where only the words as they are match; empty tables: empty result;
other columns are ignored; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.frames import side_of_join
from panelloom.sources.storage import store

#: Placeholders: single characters that no text can hold as a word.
NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
#: Units that may follow a number.
UNITS = (
    "km m cm mm kg g mg lb lbs oz l ml mi ft in yd s sec seconds min minutes h hr hours days weeks "
    "months years meters metres kilometers kilometres miles feet inches grams kilograms pounds liters "
    "litres dollars euros cents percent degrees mph kmh"
).split()
TOKEN = r"[\p{L}\p{M}]+|\p{N}+(?:[.,]\p{N}+)*"


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def template_tokens(text: Column) -> Column:
    """As many tokens as `raw_tokens`, with placeholders for names, numbers and units.

    A name is a capitalised word inside a sentence: after a letter, comma, colon or
    semicolon and a space.
    """
    plain = F.translate(text, NAME + NUMBER + UNIT, "   ")
    named = F.regexp_replace(plain, r"(?<=[\p{L}\p{M},;:] )\p{Lu}[\p{L}\p{M}]*", NAME)
    numbered = F.regexp_replace(named, r"\p{N}+(?:[.,]\p{N}+)*", NUMBER)
    units = "|".join(UNITS)
    typed = F.regexp_replace(F.lower(numbered), f"(?<={NUMBER}) ?(?:{units})(?![\\p{{L}}\\p{{M}}])", f" {UNIT}")
    return F.regexp_extract_all(typed, F.lit(f"[\\p{{L}}\\p{{M}}]+|[{NAME}{NUMBER}{UNIT}]"), F.lit(0))


def literal_tokens(text: Column) -> Column:
    """The words and numbers themselves, in lower case."""
    return raw_tokens(F.lower(text))


def windows(tokens: Column, window: int) -> Column:
    """Array of hashes of the windows that start at every token."""
    starts = F.sequence(F.lit(0), F.size(tokens) - window)
    return F.when(
        F.size(tokens) >= window, F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i + 1, window)))
    ).otherwise(F.array().cast("array<bigint>"))


def exploded_windows(rows: DataFrame, window: int) -> DataFrame:
    """rows: id columns and tokens. One row per window: id columns, position, h."""
    ids = [c for c in rows.columns if c != "tokens"]
    return rows.select(*ids, F.posexplode(windows(F.col("tokens"), window)).alias("position", "h"))


def plain_words(tokens: Column) -> Column:
    """Number of distinct words, without numbers and placeholders."""
    return F.size(F.array_distinct(F.filter(tokens, lambda t: t.rlike(r"^[\p{L}\p{M}]"))))


def benchmark_windows(items: DataFrame, window: int, least_words: int) -> DataFrame:
    """items: entry, tokens. One row per window with `least_words` distinct words; two in items without a whole window."""
    starts = F.sequence(F.lit(0), F.size("tokens") - window)
    placed = items.where(F.size("tokens") >= window).select("entry", "tokens", F.explode(starts).alias("start"))
    words = F.slice("tokens", F.col("start") + 1, window)
    placed = placed.where(plain_words(words) >= least_words) if least_words else placed
    long = placed.select(
        F.xxhash64(words).alias("h"), "entry", "start", F.size("tokens").alias("length"), F.lit(window).alias("width")
    )
    short = items.where(F.size("tokens").between(1, window - 1) & (plain_words(F.col("tokens")) >= 2)).select(
        F.xxhash64("tokens").alias("h"), "entry", F.lit(0).alias("start"), F.size("tokens").alias("length"),
        F.size("tokens").alias("width"),
    )
    return long.unionByName(short)


def common_windows(tokens: DataFrame, known: DataFrame) -> DataFrame | None:
    """doc_id, of, position, entry, start, length, width of every window of tokens that is known."""
    widths = sorted(r["width"] for r in known.select("width").distinct().collect())
    hits = None
    for width in widths:
        of_width = side_of_join(known.where(F.col("width") == width))
        found = exploded_windows(tokens, width).join(of_width, "h")
        hits = found if hits is None else hits.unionByName(found)
    return hits


def literal_places(hits: DataFrame, min_coverage: float) -> DataFrame:
    """doc_id, of, entry, coverage of the places with enough of an item's words as they are.

    A place holds alignments over twice the item's length and overlaps the next by half, so
    that any two alignments within the item's length of each other meet in one.
    """
    block = F.floor((F.col("position") - F.col("start")) / F.col("length"))
    starts = F.array_sort("starts")
    gaps = F.zip_with(
        F.slice(starts, 2, F.size("starts")), F.slice(starts, 1, F.size("starts") - 1),
        lambda b, a: F.least(b - a, F.col("width")),
    )
    return (
        hits.select("doc_id", "of", "entry", "length", "width", "start", F.explode(F.array(block, block + 1)).alias("place"))
        .groupBy("doc_id", "of", "entry", "length", "width", "place")
        .agg(F.collect_set("start").alias("starts"))
        .select("doc_id", "of", "entry", (F.aggregate(gaps, F.col("width"), lambda total, d: total + d) / F.col("length")).alias("coverage"))
        .where(F.col("coverage") >= min_coverage)
    )


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 5,
    min_coverage: float = 0.8,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per leaked pair: doc_id, item_id, coverage, slots, changed_slots, kind."""
    places = leak_places(docs, benchmark, window, min_coverage, doc_id, text, item_id, item_text)
    if places is None:
        return empty_result(docs, benchmark, doc_id, item_id)
    best = F.max(F.when(~F.col("literal"), F.struct((-F.col("changed_slots")).alias("unchanged"), "coverage", "slots")))
    changed = F.when(F.col("as_it_is") == 1, 0).otherwise(F.coalesce(-F.col("best")["unchanged"], F.lit(0)))
    return (
        places.groupBy("doc_id", "item_id")
        .agg(F.max(F.when(F.col("literal"), F.col("coverage"))).alias("as_it_is"), best.alias("best"))
        .select(
            "doc_id", "item_id", F.greatest("as_it_is", F.col("best")["coverage"]).alias("coverage"),
            F.coalesce(F.col("best")["slots"], F.lit(0)).alias("slots"), changed.alias("changed_slots"),
        )
        .withColumn("kind", F.when(F.col("changed_slots") > 0, "reparameterised").when(F.col("coverage") < 1, "near").otherwise("exact"))
    )


def leak_places(
    docs: DataFrame, benchmark: DataFrame, window: int, min_coverage: float, doc_id: str, text: str, item_id: str, item_text: str
) -> DataFrame | None:
    """doc_id, hash `of` of the text, item_id, literal, coverage, slots, changed_slots of every place that leaks."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct()
    items = store(
        items.select(
            "item_id", F.xxhash64("item_id", "text").alias("entry"), template_tokens(F.col("text")).alias("tokens"),
            raw_tokens(F.col("text")).alias("words"), literal_tokens(F.col("text")).alias("literal"),
        ),
        "benchmark_templates",
    )
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")

    def joined(made, column: str, least_words: int) -> DataFrame | None:
        own = items.select("entry", F.col(column).alias("tokens"))
        known = store(benchmark_windows(own, window, least_words), f"benchmark_windows_{column}")
        return common_windows(texts.select("doc_id", F.xxhash64("text").alias("of"), made(F.col("text")).alias("tokens")), known)

    found = []
    if (hits := joined(literal_tokens, "literal", 0)) is not None:
        found.append(
            literal_places(hits, min_coverage)
            .join(side_of_join(items.select("entry", "item_id")), "entry")
            .select("doc_id", "of", "item_id", F.lit(True).alias("literal"), "coverage", F.lit(0).alias("slots"), F.lit(0).alias("changed_slots"))
        )
    if (hits := joined(template_tokens, "tokens", 2)) is not None:
        found.append(template_places(texts, hits, items, window, min_coverage))
    return found[0].unionByName(found[-1]) if len(found) > 1 else next(iter(found), None)


def alignments(hits: DataFrame, items: DataFrame, window: int, min_coverage: float) -> DataFrame:
    """doc_id, of and the alignments (entry, length, shift) of each text that are worth a look.

    `need` is the least number of known windows of an item covered by min_coverage. Stretches
    whose neighbourhood has fewer cannot reach it; they alone are left out. Of the others every
    alignment with `need` windows of its own stays, and all that have most in their stretch.
    """
    width = F.least(F.lit(window), F.size("tokens"))
    known = benchmark_windows(items.select("entry", "tokens"), window, 2).groupBy("entry").agg(F.count("*").alias("known"))
    unknown = F.size("tokens") - width + 1 - F.col("known")
    need = F.greatest(F.ceil(min_coverage * F.size("tokens") / width - 1e-9) - unknown, F.lit(1))
    needs = store(items.join(known, "entry").select("entry", need.alias("need")), "benchmark_needs")
    shifts = (
        hits.groupBy("doc_id", "of", "entry", "length", (F.col("position") - F.col("start")).alias("shift"))
        .agg(F.count("*").alias("n"))
        .withColumn("block", F.floor(F.col("shift") / (2 * F.col("length"))))
        .withColumn("stretch", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
    )
    own = F.when(F.col("block") == F.col("stretch"), F.struct("n", "shift"))
    chosen = F.filter("own", lambda a: (a["n"] >= F.col("need")) | (a["n"] == F.array_max(F.transform("own", lambda b: b["n"]))))
    return (
        shifts.groupBy("doc_id", "of", "entry", "length", "stretch")
        .agg(F.sum("n").alias("n"), F.collect_list(own).alias("own"))
        .join(side_of_join(needs), "entry")
        .where((F.col("n") >= F.col("need")) & (F.size("own") > 0))
        .select("doc_id", "of", "entry", "length", F.explode(chosen).alias("at"))
        .groupBy("doc_id", "of")
        .agg(F.collect_list(F.struct("entry", "length", F.col("at")["shift"].alias("shift"))).alias("alignments"))
    )


def template_places(texts: DataFrame, hits: DataFrame, items: DataFrame, window: int, min_coverage: float) -> DataFrame:
    """The places where an item's template stands with consistent slots."""
    candidates = side_of_join(store(alignments(hits, items, window, min_coverage), "leak_candidates"), 20_000)
    near = texts.withColumn("of", F.xxhash64("text")).join(
        candidates.select(F.col("doc_id").alias("id"), F.col("of").alias("text_of"), "alignments"),
        F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("of") == F.col("text_of")),
    )
    # a text is taken apart once, however many alignments it has
    near = near.select(
        "doc_id", "of", template_tokens(F.col("text")).alias("all_tokens"), raw_tokens(F.col("text")).alias("all_words"),
        "alignments",
    ).select("doc_id", "of", "all_tokens", "all_words", F.explode("alignments").alias("at"))
    length, shift = F.col("at")["length"], F.col("at")["shift"]
    first = F.greatest(shift - length, F.lit(0))
    around = near.select(
        "doc_id", "of", F.col("at")["entry"].alias("entry"), (shift - first).alias("shift"),
        *[F.slice(f"all_{name}", first + 1, 3 * length).alias(f"near_{name}") for name in ("tokens", "words")],
    )
    return (
        verified(around.join(side_of_join(items.drop("literal")), "entry"), window)
        .where((F.col("coverage") >= min_coverage) & F.col("consistent"))
        .select("doc_id", "of", "item_id", F.lit(False).alias("literal"), "coverage", "slots", "changed_slots")
    )


def verified(pairs: DataFrame, window: int) -> DataFrame:
    """Coverage over the neighbourhood and slot consistency along the alignment."""
    width = F.least(F.lit(window), F.size("tokens"))
    spans = lambda t: F.when(
        F.size(t) >= width,
        F.transform(F.sequence(F.lit(0), F.size(t) - width), lambda i: F.xxhash64(F.slice(t, i + 1, width))),
    ).otherwise(F.array().cast("array<bigint>"))
    with_spans = pairs.withColumn("item_spans", spans(F.col("tokens"))).withColumn("near_spans", spans(F.col("near_tokens")))
    covered = F.array_distinct(
        F.flatten(
            F.transform(
                F.filter(
                    F.sequence(F.lit(0), F.size("item_spans") - 1),
                    lambda i: F.array_contains("near_spans", F.get("item_spans", i)),
                ),
                lambda i: F.sequence(i, i + width - 1),
            )
        )
    )
    place = F.sequence(F.lit(0), F.size("tokens") - 1)
    there = lambda i: i + F.col("shift")
    slot_places = F.filter(
        place,
        lambda i: F.get("tokens", i).isin(NAME, NUMBER, UNIT)
        & (there(i) >= 0)
        & (F.get("near_tokens", there(i)) == F.get("tokens", i)),
    )
    bound = F.transform(
        slot_places,
        lambda i: F.struct(
            F.get("tokens", i).alias("type"), F.get("words", i).alias("item"), F.get("near_words", there(i)).alias("doc")
        ),
    )
    pairs_of = F.array_distinct(F.col("bound"))
    values_of = F.array_distinct(F.transform("bound", lambda b: F.struct(b["type"], b["item"])))
    return (
        with_spans.where(F.size("item_spans") > 0)
        .withColumn("bound", bound)
        .select(
            "doc_id",
            "of",
            "item_id",
            (F.size(covered) / F.size("tokens")).alias("coverage"),
            F.size("bound").alias("slots"),
            F.size(F.filter("bound", lambda b: b["item"] != b["doc"])).alias("changed_slots"),
            (F.size(pairs_of) == F.size(values_of)).alias("consistent"),
        )
    )


def empty_result(docs: DataFrame, benchmark: DataFrame, doc_id: str, item_id: str) -> DataFrame:
    ids = docs.select(F.col(doc_id).alias("doc_id")).limit(0)
    return ids.select(
        "doc_id",
        F.lit(None).cast(benchmark.schema[item_id].dataType).alias("item_id"),
        F.lit(0.0).alias("coverage"), F.lit(0).alias("slots"), F.lit(0).alias("changed_slots"), F.lit("").alias("kind"),
    )


def remove_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = 5, min_coverage: float = 0.8, doc_id: str = "doc_id",
    text: str = "text", item_id: str = "item_id", item_text: str = "text", by_row: bool = False,
) -> DataFrame:
    """docs without the documents that hold a leaked item.

    A document is all rows of one id, or with `by_row` each text of an id by itself. Rows
    without an id are documents of their own either way.
    """
    places = leak_places(docs, benchmark, window, min_coverage, doc_id, text, item_id, item_text)
    if places is None:
        return docs

    def part(of: Column, of_id: Column) -> Column:
        return of if by_row else F.when(of_id.isNull(), of).otherwise(F.lit(0).cast("long"))

    leaks = places.select(F.col("doc_id").alias("__leak"), part(F.col("of"), F.col("doc_id")).alias("__of")).distinct()
    gone = side_of_join(store(leaks, "leaked_documents"))
    same = F.col(doc_id).eqNullSafe(F.col("__leak")) & (part(F.xxhash64(F.col(text)), F.col(doc_id)) == F.col("__of"))
    return docs.join(gone, same, "left_anti")
