"""Language of texts from unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces (a forward pass);
that of a text is the product over its words, as pieces never cross a word's start. The
language is the most probable one, the score its share of the whole.

Training reads all labelled rows: words are counted by language (in batches on the map side,
then by a hash aggregate), and expectation maximisation runs over this table, one job a
round, in which forward and backward passes give the expected use of each piece. What comes
to the driver is one number for each language and used piece: the vocabulary is fixed, and
more than MOST_LANGUAGES languages are refused. Rare pieces lean on all languages together.

Scoring keeps distinct words with their scores in each worker, at most `cached` of them, and
takes a batch's words once.

Defined cases: texts are lower-cased and cut at everything but letters and their marks; a
text that is null or has no letter, and any text if nothing was learned, is `und` with score
0; rows with a null lang are not learned from; a null id is hashed as an empty string; ties
go to the smallest language; repeated rows count again; empty tables give empty results;
other columns are kept, but for the text and ones named as a result, which it replaces;
texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.frames import renamed, text_slices
from panelloom.llm.segmentation import expected_counts, log_probabilities, trie_of
from panelloom.sources.storage import store

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN = "und"
MOST_LANGUAGES = 1_000
SCORED = ("lang_pred", "score")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The row of each word, and the words."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+", " ")
    parts = pc.split_pattern(spaced, " ")
    rows, flat = pc.list_parent_indices(parts), pc.list_flatten(parts)
    full = pc.greater(pc.binary_length(flat), 0)
    return rows.filter(full).to_numpy(zero_copy_only=False), flat.filter(full).dictionary_encode()


@dataclass(frozen=True)
class LanguageModel:
    """probability: languages x (pieces + one for other characters); log_prior: of each language."""

    languages: list[str]
    log_prior: np.ndarray
    probability: np.ndarray
    file: str


def word_counts(labelled: DataFrame, languages: list[str]) -> DataFrame:
    """model (place in languages), word, n."""
    place = {language: i for i, language in enumerate(languages)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            models = np.array([place[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            rows, words = words_of(batch.column(-1))
            if len(rows):
                keys = models[rows] * len(words.dictionary) + words.indices.to_numpy(zero_copy_only=False)
                keys, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((keys // len(words.dictionary)).astype(np.int32)),
                     words.dictionary.take(pa.array(keys % len(words.dictionary))), pa.array(n.astype(np.int64))],
                    names=["model", "word", "n"],
                )

    rows = labelled.select("lang", "text").mapInArrow(counted, "model int, word string, n long")
    return rows.groupBy("model", "word").agg(F.sum("n").alias("n"))


def improved(counts: DataFrame, model: LanguageModel, lean: float) -> LanguageModel:
    """One round of expectation maximisation."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = shared.value, 0
        trie = trie_of(now.file)
        for batch in batches:
            models, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("model", "n"))
            used = used + expected_counts(batch.column("word").to_pylist(), n, models, now.probability, trie)
        if not np.isscalar(used):
            own, piece = np.nonzero(used)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(used[own, piece])],
                names=["model", "piece", "used"],
            )

    parts = counts.mapInArrow(expected, "model int, piece int, used double")
    used = np.zeros(model.probability.shape)
    for row in parts.groupBy("model", "piece").agg(F.sum("used").alias("used")).collect():
        used[row["model"], row["piece"]] = row["used"]
    shared.unpersist()
    return LanguageModel(model.languages, model.log_prior, leaning(used, lean), model.file)


def leaning(used: np.ndarray, lean: float) -> np.ndarray:
    """Probabilities, each language's counts with `lean` more that are spread as those of all."""
    together = used.sum(axis=0) + 0.1
    probability = used + lean * together / together.sum()
    return probability / probability.sum(axis=1, keepdims=True)


def train(
    labelled: DataFrame, file: str = VOCABULARY, text: str = "text", lang: str = "lang", rounds: int = 4,
    lean: float = 200.0,
) -> LanguageModel:
    """labelled: the rows to learn from."""
    known = labelled.where(F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    sizes = known.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in {lang}")
    languages = [row["lang"] for row in sizes]
    prior = np.array([row["count"] for row in sizes], dtype=float) + 1
    width = len(trie_of(file).pieces) + 1
    flat = np.full((len(languages), width), 1 / width)
    model = LanguageModel(languages, np.log(prior / prior.sum()), flat, file)
    if languages:
        counts = store(word_counts(known, languages), "words_by_language")
        for _ in range(rounds):
            model = improved(counts, model, lean)
    return model


class WordScores:
    """Log probabilities of words in every language; keeps at most `most` words."""

    def __init__(self, model: LanguageModel, most: int):
        self.model, self.most, self.trie = model, most, trie_of(model.file)
        self.forget()

    def forget(self) -> None:
        self.row_of: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))

    def of(self, words: list[str]) -> np.ndarray:
        rows = np.array([self.row_of.get(w, -1) for w in words], dtype=np.int64)
        new = [words[i] for i in np.flatnonzero(rows < 0)]
        if new and len(self.row_of) + len(new) > self.most:
            self.forget()
            rows[:], new = -1, words
        if new:
            at = len(self.scores)
            scores = log_probabilities(new, self.model.probability, self.trie)
            self.scores = np.concatenate([self.scores, scores])
            self.row_of.update(zip(new, range(at, at + len(new))))
            rows[rows < 0] = np.arange(at, at + len(new))
        return self.scores[rows]


def predict(
    docs: DataFrame, model: LanguageModel, text: str = "text", cached: int = 200_000
) -> DataFrame:
    """docs without the text, with lang_pred and score."""
    names = [c for c in docs.columns if c not in (text, *SCORED)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, prior = np.array([*shared.value.languages, UNKNOWN], dtype=object), shared.value.log_prior
        known = WordScores(shared.value, cached)
        for batch in text_slices(batches):
            best, score = np.full(batch.num_rows, len(prior)), np.zeros(batch.num_rows)
            rows, words = words_of(batch.column(-1))
            if len(prior) and len(rows):
                each = known.of(words.dictionary.to_pylist())[words.indices.to_numpy(zero_copy_only=False)]
                begins = np.flatnonzero(np.diff(rows, prepend=-1))
                sums = np.add.reduceat(each, begins) + prior
                share = np.exp(sums - sums.max(axis=1, keepdims=True))
                at = rows[begins]
                best[at], score[at] = sums.argmax(axis=1), 1 / share.sum(axis=1)
                bare = ~pc.match_substring_regex(batch.column(-1), r"\p{L}").to_numpy(zero_copy_only=False)
                best[bare], score[bare] = len(prior), 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(languages[best], pa.string()), pa.array(score)], names=[*names, *SCORED]
            )

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    own, inner = renamed(docs)
    whole = own.select(*[inner[c] for c in names], F.coalesce(F.col(inner[text]), F.lit("")).alias("text"))
    return whole.mapInArrow(scored, f"{kinds}lang_pred string, score double")
