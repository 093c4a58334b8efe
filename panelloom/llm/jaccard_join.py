"""Near-duplicate documents by a Jaccard join on word n-grams with prefix filtering.

Equal n-gram sets are one class (by a 64-bit hash of the set). A set's n-grams are ordered
rarest first, by a count sketch over all documents; two sets with the required similarity
share an n-gram among the first n - ceil(t * n) + 1 of each, so only these prefixes are
joined. The sketch has a fixed width and decides the order only: any order gives the same
links.

1. One pass over the texts counts n-grams in the sketch, summed as streams of chunks.
2. A second pass writes each document's set size, class, histogram and prefix.
3. A prefix n-gram is kept for the classes that have a neighbour by size within the length and
   positional filters. For each, all of them are paired with one class
   that has it earliest: a star instead of all pairs of a group. Edited copies have rare
   n-grams of their own in front, their original has none, so originals become centers.
   Which of equals is taken does not change the result. Pairs that pass the length and
   suffix filters are verified once.
4. Components of these links are contracted. Where a prefix n-gram still meets several
   components, members outside its largest one are paired with that one's earliest member.
5. Where an n-gram still meets several components, members outside its largest one are
   joined with everything of another component through the length, positional and suffix
   filters (256 parities here), and verified once. Pairs inside a component cannot change it, so groups of
   copies stay linear and no link between components is missed.

The suffix filter compares two summaries of the sets, both lower bounds of the symmetric
difference: a histogram over fixed ranges of the hash (sum of differences) and the parities
of 256 cells of the hash (cells that differ); distinct pairs of the last join are compared by
1,024 cells too. Pairs that pass are filtered again by
histograms whose number of ranges follows the set's size, which tells long texts apart
too, so that whole sets travel for hardly more pairs than are links. Sets for verification are made again from the texts of the classes
concerned only.

Defined cases: null or empty texts have size 0 and link with nothing; fewer words than an
n-gram: the whole sequence is the only one; rows with a null doc_id take part, but never
name a component with others; repeated ids and rows are allowed; an empty table gives an
empty result; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelloom.llm.components import components
from panelloom.llm.frames import side_of_join
from panelloom.llm.shingles import mixed, shingle_sets
from panelloom.sources.storage import store

SKETCH_BITS = 23
CHUNK_BITS = 16
MOST_IN_TASK = 255
BINS = 16
CELLS = 256
#: The histogram's columns, four counts of 16 bits (at most 65,535 each) in each, and the parities'.
HISTOGRAM = ("bins0", "bins1", "bins2", "bins3")
PARITIES = ("bits0", "bits1", "bits2", "bits3")
PACKED = (*HISTOGRAM, *PARITIES)
#: Parities of more cells, for pairs of the last join: they tell sets of a thousand n-grams apart.
WIDE_CELLS = 1024
WIDE = tuple(f"wide{i}" for i in range(WIDE_CELLS // 64))


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Smaller batches of about `size` bytes of text or one row, so that a worker holds few sets at a time."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            full = int(np.searchsorted(ends, size + (ends[at - 1] if at else 0), "right"))
            to = min(max(full, at + 1), at + rows)
            yield batch.slice(at, to - at)
            at = to


def texts_of(docs: DataFrame, doc_id: str, text: str, hashed: bool = False) -> DataFrame:
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.withColumn("text_hash", F.xxhash64("text")) if hashed else texts


def counters_of(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def gram_counts(texts: DataFrame, n: int) -> np.ndarray:
    """For each of the 2^SKETCH_BITS counters, how common its n-grams are: one byte on a logarithmic scale.

    A task counts documents up to MOST_IN_TASK for each counter; parts of the counters travel
    compressed and are summed. An eighth of an octave is one step of the scale.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
        for batch in in_slices(batches):
            sets = list(shingle_sets(batch.column("text"), n))
            if sets:
                places, more = np.unique(counters_of(np.concatenate(sets)), return_counts=True)
                counts[places] = np.minimum(counts[places] + more, MOST_IN_TASK)
        parts = enumerate(counts.reshape(-1, 1 << CHUNK_BITS))
        filled = {chunk: zlib.compress(part.tobytes(), 1) for chunk, part in parts if part.any()}
        if filled:
            yield chunks(filled)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(zlib.decompress(data), dtype=np.uint8).astype(np.int64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        if sums:
            steps = {chunk: np.minimum(np.rint(8 * np.log2(1 + part)), 255) for chunk, part in sums.items()}
            yield chunks({chunk: zlib.compress(part.astype(np.uint8).tobytes(), 1) for chunk, part in steps.items()})

    layout = "chunk int, counts binary"
    rows = texts.select("text").mapInArrow(counted, layout).repartition("chunk").mapInArrow(summed, layout).collect()
    counts = np.zeros((1 << (SKETCH_BITS - CHUNK_BITS), 1 << CHUNK_BITS), dtype=np.uint8)
    for row in rows:
        counts[row["chunk"]] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.uint8)
    return counts.reshape(-1)


def chunks(of: dict[int, bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(of), pa.int32()), pa.array(list(of.values()), pa.binary())], names=["chunk", "counts"]
    )


def class_of(grams: np.ndarray) -> int:
    """A 64-bit hash of the set."""
    whole = mixed(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True, dtype=np.uint64)
    return int(mixed(whole + np.uint64(len(grams))).view(np.int64)[0])


def summary_of(grams: np.ndarray) -> np.ndarray:
    """The values of PACKED and WIDE."""
    counts = np.bincount((grams >> np.uint64(60)).astype(np.int64), minlength=BINS)
    bits = parities(grams, CELLS), parities(grams >> np.uint64(20), WIDE_CELLS)
    return np.concatenate([np.minimum(counts, 0xFFFF).astype("<u2").view("<i8"), *bits])


def parities(grams: np.ndarray, cells: int) -> np.ndarray:
    """Whether each cell holds an odd number of n-grams, 64 cells in a number."""
    parity = np.bincount((grams & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view("<i8")


def fine_histogram(grams: np.ndarray) -> np.ndarray:
    """Counts over 2^k ranges of the hash, eight to sixteen n-grams a range on average."""
    k = max(len(grams) // 8, 1).bit_length() - 1
    cells = (grams >> np.uint64(64 - k)).astype(np.int64) if k else np.zeros(len(grams), dtype=np.int64)
    return np.bincount(cells, minlength=1 << k)


def finely_similar(a: str, b: str, a_size: str, b_size: str, percent: int) -> Column:
    """The suffix filter on fine histograms; the longer one is halved to the shorter's ranges.

    Sizes within the length filter differ by less than 2, so by one halving at most.
    """

    def halved(x: str) -> Column:
        places = F.sequence(F.lit(0), F.size(x) - 1, F.lit(2))
        return F.transform(places, lambda i: F.get(x, i) + F.get(x, i + 1))

    def fitted(x: str, other: str) -> Column:
        return F.when(F.size(x) > F.size(other), halved(x)).otherwise(F.col(x))

    apart = F.aggregate(
        F.zip_with(fitted(a, b), fitted(b, a), lambda p, q: F.abs(p - q)), F.lit(0), lambda total, d: total + d
    )
    return apart * (100 + percent) <= (100 - percent) * (F.col(a_size) + F.col(b_size))


def in_reach(size: str, left: str, other: str, percent: int) -> Column:
    """The positional filter: whether `left` n-grams of the set of `size`, from the first common one on, suffice."""
    return F.col(left) * (100 + percent) >= percent * (F.col(size) + F.col(other))


def maybe_similar(
    a: str, b: str, percent: int, cells: tuple[str, ...] = PARITIES, bins: tuple[str, ...] = HISTOGRAM
) -> Column:
    """The length and suffix filters for sides whose columns are prefixed a_ and b_.

    cells, bins: the columns of parities and of the histogram that are compared.
    """

    def bin_of(column: str, i: int) -> Column:
        return F.shiftrightunsigned(column, 16 * i).bitwiseAND(F.lit(0xFFFF))

    sizes = F.col(f"{a}_size"), F.col(f"{b}_size")
    in_bins = sum(
        (F.abs(bin_of(f"{a}_{c}", i) - bin_of(f"{b}_{c}", i)) for c in bins for i in range(BINS // len(HISTOGRAM))),
        F.lit(0),
    )
    in_cells = sum(F.bit_count(F.col(f"{a}_{c}").bitwiseXOR(F.col(f"{b}_{c}"))) for c in cells)
    # |x - y| + |y - x| <= (1 - t) / (1 + t) * (|x| + |y|), in whole numbers
    most = (100 - percent) * (sizes[0] + sizes[1])
    return (
        (F.least(*sizes) * 100 >= F.greatest(*sizes) * percent)
        & (in_cells * (100 + percent) <= most)
        & (in_bins * (100 + percent) <= most)
    )


def prefixes(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id (and text_hash), size, cls, histogram and prefix (rarest first) of every document."""
    names = [c for c in texts.columns if c != "text"]
    rarity = texts.sparkSession.sparkContext.broadcast(gram_counts(texts, n))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = rarity.value
        for batch in in_slices(batches):
            sizes, classes, bins, fine, kept = [], [], [], [], []
            for grams in shingle_sets(batch.column("text"), n):
                sizes.append(len(grams))
                classes.append(class_of(grams))
                bins.append(summary_of(grams))
                fine.append(fine_histogram(grams))
                length = len(grams) - -(-percent * len(grams) // 100) + 1 if len(grams) else 0
                order = np.lexsort((grams, counts[counters_of(grams)]))[:length]
                kept.append(grams[order].view(np.int64))
            packed = np.array(bins, dtype=np.int64).reshape(-1, len(PACKED) + len(WIDE)).T
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()),
                 *[pa.array(b, pa.int64()) for b in packed], pa.array(fine, pa.list_(pa.int32())),
                 pa.array(kept, pa.list_(pa.int64()))],
                names=[*names, "size", "cls", *PACKED, *WIDE, "fine", "prefix"],
            )

    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in names)
    layout = f"{kinds}, size long, cls long, {', '.join(f'{b} long' for b in PACKED + WIDE)}, fine array<int>, prefix array<long>"
    return store(texts.mapInArrow(made, layout), "prefixes")


def sets_of(texts: DataFrame, wanted: DataFrame, n: int, repeated: bool) -> DataFrame:
    """cls, grams of the wanted classes (columns cls, doc_id), from the texts again."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            grams = list(shingle_sets(batch.column("text"), n))
            own = [class_of(g) for g in grams]
            keep = [i for i, (a, b) in enumerate(zip(own, batch.column("cls").to_pylist())) if a == b]
            yield pa.RecordBatch.from_arrays(
                [pa.array([own[i] for i in keep], pa.int64()),
                 pa.array([grams[i].view(np.int64) for i in keep], pa.list_(pa.int64()))],
                names=["cls", "grams"],
            )

    wanted = side_of_join(wanted.select(F.col("doc_id").alias("of"), "cls"))
    chosen = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("of"))).select("text", "cls")
    if repeated:  # rows that share id and text: texts are short of their sets, so drop those
        chosen = chosen.dropDuplicates(["cls", "text"])
    return chosen.mapInArrow(made, "cls long, grams array<long>")


def sided(frame: DataFrame, side: str, *columns: str) -> DataFrame:
    return frame.select(*[F.col(c).alias(f"{side}_{c}") for c in columns])


def members_of(pairs: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    members = pairs.select(F.col("x").alias("cls")).union(pairs.select("y")).distinct()
    return store(members.join(classes.select("cls", "doc_id"), "cls"), name)


def with_sides(pairs: DataFrame, of_class: DataFrame, column: str) -> DataFrame:
    for side in "xy":
        pairs = pairs.join(of_class.select(F.col("cls").alias(side), F.col(column).alias(f"{side}_{column}")), side)
    return pairs


@dataclass(frozen=True)
class Corpus:
    """What verification reads: texts, stored rows of `prefixes`, their classes."""

    texts: DataFrame
    rows: DataFrame
    classes: DataFrame
    repeated: bool
    n: int
    percent: int

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (x, y) of classes those with the required similarity, each verified once."""
        sides = [sided(self.classes, s, "cls", "size", *PACKED).withColumnRenamed(f"{s}_cls", s) for s in "xy"]
        maybe = store(
            pairs.join(sides[0], "x")
            .join(sides[1], "y")
            .where(maybe_similar("x", "y", self.percent))
            .select("x", "y", "x_size", "y_size"),
            "maybe_pairs",
        )
        wanted = side_of_join(members_of(maybe, self.classes, "maybe_classes").select("cls", F.col("doc_id").alias("of")))
        fine = self.rows.select("doc_id", "cls", "fine").join(wanted, "cls").where(F.col("doc_id").eqNullSafe(F.col("of")))
        fine = fine.dropDuplicates(["cls"]) if self.repeated else fine
        open_pairs = store(
            with_sides(maybe, store(fine.select("cls", "fine"), "fine_histograms"), "fine")
            .where(finely_similar("x_fine", "y_fine", "x_size", "y_size", self.percent))
            .select("x", "y", "x_size", "y_size"),
            "open_pairs",
        )
        wanted = members_of(open_pairs, self.classes, "wanted_classes")
        sets = store(sets_of(self.texts, wanted, self.n, self.repeated), "wanted_sets")
        common = F.size(F.array_intersect("x_grams", "y_grams"))
        links = with_sides(open_pairs, sets, "grams").select("x", "y", "x_size", "y_size", common.alias("common"))
        most = F.col("x_size") + F.col("y_size") - F.col("common")
        return store(links.where(F.col("common") * 100 >= self.percent * most).select("x", "y"), "class_links")


def ordered_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where("x <> y").distinct()


def with_partners(grams: DataFrame, percent: int) -> DataFrame:
    """One row for each n-gram and class (cls, size, place), of those that may be linked over that n-gram.

    A link's first common n-gram has no other common one before it on either side, so what is
    `left` of both sets from there holds all of them. The next class by size stands for all
    larger ones, the one before for all smaller ones.
    """
    once = grams.groupBy("gram", "cls", "size", "place", "center").agg(F.count("*").alias("n")).drop("n")
    by_size = W.partitionBy("gram").orderBy("size", "cls")
    beside = once.withColumn("left", F.col("size") - F.col("place")).select(
        "*", F.lag("size").over(by_size).alias("before"), F.lead("size").over(by_size).alias("after")
    )
    is_near = (F.col("before") * 100 >= F.col("size") * percent) | in_reach("size", "left", "after", percent)
    return beside.where(is_near).drop("before", "after")


def in_mixed_grams(grams: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of n-grams that meet several components: with their component and the gram's largest."""
    rows = store(
        grams.drop("center").join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
            "component", F.coalesce("component", "cls")
        ),
        "grams_of_components",
    )
    sizes = rows.groupBy("gram", "component").agg(F.count("*").alias("n"), F.min_by("cls", "place").alias("center"))
    mains = (
        sizes.groupBy("gram")
        .agg(F.max_by("component", "n").alias("main"), F.max_by("center", "n").alias("center"), F.count("*").alias("components"))
        .where("components > 1")
        .drop("components")
    )
    return store(rows.join(store(mains, "mixed_grams"), "gram"), "mixed_rows")


def remaining_pairs(mixed_rows: DataFrame, classes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes in different components that share a prefix n-gram and pass all filters.

    An n-gram's rows carry the narrow parities only. The wide ones come from `rows`, once for
    each class of a pair that is left.
    """
    full = mixed_rows.join(classes.select("cls", *PARITIES), "cls")
    columns = ("gram", "cls", "size", "left", "component", *PARITIES)
    left = sided(full.where("component <> main"), "a", *columns, "main")
    right = sided(full, "b", *columns)
    condition = (
        (F.col("a_gram") == F.col("b_gram"))
        & (F.col("a_component") != F.col("b_component"))
        & ((F.col("b_component") == F.col("a_main")) | (F.col("a_cls") < F.col("b_cls")))
        & in_reach("a_size", "a_left", "b_size", percent)
        & in_reach("b_size", "b_left", "a_size", percent)
        & maybe_similar("a", "b", percent, bins=())
    )
    pairs = store(ordered_pairs(left.join(right, condition), "a_cls", "b_cls"), "near_pairs")
    members = store(pairs.select(F.col("x").alias("cls")).union(pairs.select("y")).distinct(), "near_classes")
    concerned = rows.select("cls", "size", *WIDE).join(side_of_join(members), "cls", "left_semi")
    wide = store(concerned.groupBy("cls").agg(*[F.max(c).alias(c) for c in ("size", *WIDE)]), "wide_parities")
    for side in "xy":
        pairs = pairs.join(sided(wide, side, "cls", "size", *WIDE).withColumnRenamed(f"{side}_cls", side), side)
    return pairs.where(maybe_similar("x", "y", percent, WIDE, bins=())).select("x", "y")


def linked_rows(texts: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of `prefixes`, and cls, doc_id (the smallest), component of the classes that have words."""
    rows = prefixes(texts, n, percent)
    filled = rows.where("size > 0")
    repeated = not filled.groupBy("doc_id", "cls").count().where("count > 1").isEmpty()
    of_class = filled.groupBy("cls", "size").agg(F.min("doc_id").alias("doc_id"), *[F.max(b).alias(b) for b in PACKED])
    classes = store(of_class, "classes")

    grams = filled.select("cls", "size", F.posexplode("prefix").alias("place", "gram"))
    shared = (
        grams.groupBy("gram")
        .agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.min_by("cls", "place").alias("center"))
        .where("low <> high")
        .drop("low", "high")
    )
    grams = store(with_partners(grams.join(store(shared, "shared_grams"), "gram"), percent), "grams")

    corpus = Corpus(texts, rows, classes, repeated, n, percent)
    links = corpus.linked(ordered_pairs(grams, "cls", "center"))
    comps = components(links)
    for star in (True, False):
        rows_left = in_mixed_grams(grams, comps)
        if star:
            pairs = ordered_pairs(rows_left.where("component <> main"), "cls", "center")
        else:
            pairs = remaining_pairs(rows_left, classes, filled, percent)
        more = corpus.linked(pairs)
        if not more.isEmpty():
            links = links.union(more)
            comps = components(links)

    named = classes.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls")
    )
    return rows, named.select("cls", "doc_id", "component")


def near_duplicates(
    docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row."""
    rows, named = linked_rows(texts_of(docs, doc_id, text), n, percent)
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = store(named.join(smallest, "component").select("cls", "component_id"), "named_classes")
    out = rows.select("doc_id", "size", F.when(F.col("size") > 0, F.col("cls")).alias("cls"))
    return out.join(named, "cls", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one_of_each(
    docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """docs without near copies: one row of each component stays, by doc_id (nulls last) and the text's hash.

    Rows are told apart by doc_id and text, so ids may be null or repeated. Rows without any
    word all stay. Of rows that share doc_id and text one stays.
    """
    rows, named = linked_rows(texts_of(docs, doc_id, text, hashed=True), n, percent)
    worded = rows.where("size > 0").select("doc_id", "text_hash", "cls")
    named = store(named.select("cls", "component"), "components_of_classes")
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")
    firsts = store(worded.groupBy("cls").agg(F.min(order).alias("first")).join(named, "cls"), "firsts_of_classes")
    stays = store(firsts.groupBy("component").agg(F.min("first").alias("first")), "firsts")
    stays = store(firsts.select("cls", "component").join(stays, "component").select("cls", "first"), "firsts_by_class")
    is_first = F.col("doc_id").eqNullSafe(F.col("first")["doc_id"]) & (F.col("text_hash") == F.col("first")["text_hash"])
    ids = F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")
    placed = worded.join(stays, "cls").groupBy(*ids, is_first.alias("first")).agg(F.count("*").alias("n"))
    placed = store(placed, "near_copies")
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__hash"))
    lost = side_of_join(store(placed.where(~F.col("first")).select("__id", "__hash"), "lost_rows"))
    kept = docs.join(lost, same, "left_anti")
    again = store(placed.where(F.col("first") & (F.col("n") > 1)).select("__id", "__hash"), "repeated_rows")
    if again.isEmpty():
        return kept
    again = side_of_join(again)
    repeated = kept.join(again, same, "left_semi").dropDuplicates([doc_id, text])
    return kept.join(again, same, "left_anti").unionByName(repeated)
