"""Conversations and the models that compare their turns, as lazily built plans."""

from __future__ import annotations

from collections.abc import Sequence
from copy import copy
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions.text import TextFunction, default_stopwords, sentences, tokens
from turnwise.operators import concepts, conversation, near, pairs, products, recurrence, similar, terms, vectors
from turnwise.operators.ordering import all_brief
from turnwise.operators.prepare import prepare_turns
from turnwise.operators.recurrence import check_choice
from turnwise.session import cut_lineage, lay_out


class Conversations:
    """A table of conversations: one row per turn, any number of conversations.

    Args:
        data: table with a conversation id, an integral turn column, a speaker and a text.
        dense: the turn column already counts from 0 without gaps.
        conversation_column: ``None`` makes the whole table one conversation.
        stopwords: words to ignore; by default Spark's lists for English, French, German and Spanish.
        tokenizer, splitter: ``Column -> Column`` functions for words and sentences.
    """

    def __init__(
        self,
        data: DataFrame,
        text_column: str = "text",
        speaker_column: str = "speaker",
        id_column: str | None = None,
        *,
        conversation_column: str | None = "conv_id",
        turn_column: str = "turn",
        dense: bool = False,
        stopwords: Sequence[str] | None = None,
        tokenizer: TextFunction = tokens,
        splitter: TextFunction = sentences,
    ) -> None:
        if conversation_column is None:
            conversation_column = "conv_id"
            data = data.withColumn(conversation_column, F.lit(0).cast("bigint"))
        self.turn_source = None if dense else f"{turn_column}_original"
        self.turns = prepare_turns(
            data,
            text_column,
            speaker_column,
            id_column,
            conversation_column=conversation_column,
            turn_column=turn_column,
            dense=dense,
        )
        self.stopwords = stopwords
        self.tokenizer = tokenizer
        self.splitter = splitter

    def add_stopword(self, *words: str) -> None:
        """Ignore more words from now on, also in the models made from this object before."""
        known = default_stopwords() if self.stopwords is None else self.stopwords
        self.stopwords = [*known, *words]
        self.__dict__.pop("sentence_terms", None)

    def with_stopwords(self, *words: str) -> Conversations:
        """The same conversations with more words ignored; this object stays as it is."""
        other = copy(self)
        other.add_stopword(*words)
        return other

    def renumbered(self, table: DataFrame, *columns: str, by: str = "turn") -> DataFrame:
        """A table from outside with its turns numbered as here.

        ``columns`` hold turns as they were in the data (``by="turn"``) or ids of texts (``by="text_id"``). A turn that the
        conversations do not have is an error, raised when the rows are read.
        """
        check_choice("by", by, ("turn", "text_id"))
        source = self.turn_source if by == "turn" else "text_id"
        if source is None:
            return table
        for column in columns:
            known = self.turns.select(
                "conv_id", F.col(source).alias(column), F.col("turn").cast("bigint").alias("__turn")
            )
            if column not in table.columns:
                raise ValueError(f"no column {column!r}")
            missing = F.raise_error(F.concat(F.lit(f"no turn for {column} "), F.col(column).cast("string")))
            place = F.coalesce("__turn", missing.cast("bigint"))
            table = table.join(known, ["conv_id", column], "left").withColumn(column, place).drop("__turn")
        return table

    @cached_property
    def brief(self) -> bool:
        """Does every conversation fit one block? Decides how the later plans are laid out."""
        return all_brief(self.turns)

    @cached_property
    def sentence_terms(self) -> DataFrame:
        """The texts as terms, written to the shared folder: the texts are read once."""
        rows = concepts.sentence_terms(
            self.turns,
            stopwords=self.stopwords,
            tokenizer=self.tokenizer,
            splitter=self.splitter,
            brief=self.brief,
        )
        return lay_out(rows, concepts.place(rows))

    @property
    def _text_options(self) -> dict:
        return {"stopwords": self.stopwords, "tokenizer": self.tokenizer}

    def n_utterances(self) -> DataFrame:
        return conversation.n_utterances(self.turns)

    def n_speakers(self) -> DataFrame:
        return conversation.n_speakers(self.turns)

    def speaker_names(self) -> DataFrame:
        return conversation.speaker_names(self.turns)

    def term_frequencies(self, method: str = "overall") -> DataFrame:
        return terms.term_frequencies(self.turns, method, **self._text_options)

    def all_terms(self) -> DataFrame:
        return terms.all_terms(self.turns, **self._text_options)

    def most_common_terms(self, n: int = 10, method: str = "overall") -> DataFrame:
        return terms.top_terms(self.turns, n, method, **self._text_options)

    def mean_vector_similarity(self, word_vectors: DataFrame) -> DataFrame:
        """Similarity of the turns' mean word vectors."""
        means = vectors.mean_vectors(self.turns, word_vectors, tokenizer=self.tokenizer)
        units = cut_lineage(pairs.unit_vectors(means))
        return pairs.pairwise_similarity(units, diagonal=True, brief=self.brief)

    def topic_recurrence(
        self,
        similarity: DataFrame,
        time_scale: str,
        direction: str,
        speaker: str,
        normalize: bool = False,
        t_short: int | str = "n_speakers",
        t_medium: int = recurrence.T_MEDIUM,
        by: str | None = None,
    ) -> DataFrame:
        """One kind of recurrence from a similarity table.

        ``similarity`` is a table of this package, or, with ``by``, one from outside (see :func:`renumbered`).
        """
        recurrence.check_choice("time_scale", time_scale, recurrence.TIME_SCALES)
        recurrence.check_choice("direction", direction, recurrence.DIRECTIONS)
        recurrence.check_choice("speaker", speaker, recurrence.SPEAKERS)
        wide = self._recurrences(self._own(similarity, by), normalize, t_short, t_medium)
        return recurrence.topic_recurrence(wide, time_scale, direction, speaker)

    def all_topic_recurrences(
        self,
        similarity: DataFrame,
        normalize: bool = False,
        t_short: int | str = "n_speakers",
        t_medium: int = recurrence.T_MEDIUM,
        by: str | None = None,
    ) -> DataFrame:
        wide = self._recurrences(self._own(similarity, by), normalize, t_short, t_medium)
        return recurrence.long_recurrences(wide)

    def _own(self, similarity: DataFrame, by: str | None) -> DataFrame:
        """A similarity table in the numbers of this package, earlier turn first."""
        if by is None:
            return similarity
        named = self.renumbered(similarity, "row_turn", "col_turn", by=by)
        return named.withColumns(
            {"row_turn": F.least("row_turn", "col_turn"), "col_turn": F.greatest("row_turn", "col_turn")}
        )

    def _recurrences(self, similarity, normalize, t_short, t_medium) -> DataFrame:
        return recurrence.topic_recurrences_of_similarity(
            self.turns,
            similarity,
            normalize=normalize,
            t_short=None if t_short == "n_speakers" else t_short,
            t_medium=t_medium,
            brief=self.brief,
        )

    def conceptual_recurrence_rate(self, similarity: DataFrame, by: str | None = None) -> DataFrame:
        return recurrence.recurrence_rate_of_similarity(self.turns, self._own(similarity, by))

    def grouped_recurrence(
        self,
        similarity: DataFrame,
        grouping_column: str = "speaker",
        normalize: bool = True,
        by: str | None = None,
    ) -> DataFrame:
        return recurrence.grouped_recurrence_of_similarity(
            self.turns,
            self._own(similarity, by),
            column=grouping_column,
            normalize=normalize,
            brief=self.brief,
        )


def _per_stopwords(make):
    """A property kept until the stop words of the conversations change."""

    def get(self):
        words = self.conversations.stopwords
        key = None if words is None else tuple(words)
        kept = self.__dict__.setdefault("_kept", {})
        if kept.get(make.__name__, (None, None, False))[2] and kept[make.__name__][0] == key:
            return kept[make.__name__][1]
        value = make(self)
        kept[make.__name__] = (key, value, True)
        return value

    return property(get, doc=make.__doc__)


class _VectorBacked:
    """What all models with one vector per turn offer.

    Subclasses give ``units`` (``conv_id, turn, unit``) and ``dims``.
    """

    conversations: Conversations
    dims: int

    @property
    def units(self) -> DataFrame:
        raise NotImplementedError

    @property
    def brief(self) -> bool:
        """Do the turns, and the vectors that are paired, fit one block?"""
        return self.conversations.brief

    def _keep(self, rows: DataFrame) -> DataFrame:
        """Write the vectors down: small next to the texts, and read several times."""
        return lay_out(rows, ["conv_id"]) if self.brief else cut_lineage(rows)

    def conversation_similarity(self, diagonal: bool = False, threshold: float | None = None) -> DataFrame:
        """``conv_id, row_turn, col_turn, similarity``; zero cells are absent.

        With a ``threshold`` above 0 the pairs below it are absent, too, and mostly not formed.
        """
        if threshold is None or threshold <= 0:
            cells = pairs.pairwise_similarity(self.units, dims=self.dims, diagonal=diagonal, brief=self.brief)
            return cells if threshold is None else cells.filter(F.col("similarity") >= threshold)
        cells = similar.similar_pairs(self.units, self.dims, threshold, brief=self.brief)
        return cells.unionByName(pairs.own_cells(self.units)) if diagonal else cells

    def pairs_formed(self, threshold: float) -> DataFrame:
        """How many pairs :meth:`conversation_similarity` takes up: ``conv_id, pairs, formed, similar``."""
        return similar.pairs_formed(self.units, self.dims, threshold, brief=self.brief)

    def topic_recurrences(
        self,
        normalize: bool = False,
        t_short: int | None = None,
        t_medium: int = recurrence.T_MEDIUM,
    ) -> DataFrame:
        """All twelve kinds per turn in one pass, without the table of pairs."""
        return recurrence.topic_recurrences_of_vectors(
            self.conversations.turns,
            self.units,
            self.dims,
            normalize=normalize,
            t_short=t_short,
            t_medium=t_medium,
            brief=self.brief,
        )

    def all_topic_recurrences(self, **options) -> DataFrame:
        return recurrence.long_recurrences(self.topic_recurrences(**options))

    def recurrence_rate(self) -> DataFrame:
        return recurrence.recurrence_rate_of_vectors(
            self.conversations.turns, self.units, self.dims
        )

    def grouped_recurrence(self, column: str = "speaker", normalize: bool = True) -> DataFrame:
        return recurrence.grouped_recurrence_of_vectors(
            self.conversations.turns,
            self.units,
            self.dims,
            column=column,
            normalize=normalize,
            brief=self.brief,
        )


class ConceptModel(_VectorBacked):
    """Similarity of turns from local co-occurrence of terms.

    Args:
        key_terms: number of top terms (by turns), an explicit sequence, or ``"all"``.
        sentence_window_size: sentences in which terms count as occurring together.
    """

    def __init__(
        self,
        conversations: Conversations,
        key_terms: str | int | Sequence[str] = 20,
        sentence_window_size: int = 3,
    ) -> None:
        terms.check_key_terms(key_terms)
        self.conversations = conversations
        self.key_terms = key_terms
        self.sentence_window_size = sentence_window_size
        self.dims = 0 if key_terms == "all" else concepts.key_term_count(key_terms)

    @property
    def base(self) -> DataFrame:
        return concepts.window_terms(self.conversations.sentence_terms, self.sentence_window_size)

    def total_windows(self) -> DataFrame:
        return concepts.total_windows(self.base)

    def occurrence(self) -> DataFrame:
        return concepts.term_occurrence(self.base)

    def cooccurrence(self) -> DataFrame:
        return concepts.term_cooccurrence(self.base)

    def contingency(self) -> DataFrame:
        return concepts.term_contingency(self.base)

    def term_similarity(self, cooccurrence: DataFrame | None = None) -> DataFrame:
        """Similarity of the terms; from known counts (:func:`cooccurrence`) if they are given."""
        if cooccurrence is None:
            return concepts.window_term_similarity(self.base)
        counted = self.occurrence().join(self.total_windows(), "conv_id")
        return concepts.term_similarity(concepts.contingency_cells(cooccurrence, counted))

    @_per_stopwords
    def _key_concepts(self) -> tuple[DataFrame, DataFrame]:
        """Key terms and vectors; conversations that a task may hold are worked on in one place, the others by stretches."""
        at_once, others = near.split(self.base, near.PAIR_WORDS)
        found = near.key_concepts(at_once, self.key_terms, self.dims)
        found = cut_lineage(found) if others is not None else self._keep(found)
        lists = found.where("key_terms IS NOT NULL").select("conv_id", "key_terms", "n_windows")
        arrays = found.where("turn IS NOT NULL").select("conv_id", "turn", "vector")
        if others is not None:
            lists = cut_lineage(lists.unionByName(concepts.key_term_lists(others, self.key_terms)))
            weights = concepts.key_similarity(others, lists, self.dims)
            arrays = self._keep(arrays.unionByName(concepts.concept_arrays(others, weights, self.dims)))
        return lists, arrays

    @_per_stopwords
    def lists(self) -> DataFrame:
        """Key terms of each conversation, one short array each."""
        return self._key_concepts[0]

    @_per_stopwords
    def arrays(self) -> DataFrame:
        return self._key_concepts[1]

    @_per_stopwords
    def units(self) -> DataFrame:
        if self.key_terms == "all":
            raise ValueError(
                "with all terms as key terms the vectors have no fixed length: "
                "use conversation_similarity() and the methods of Conversations"
            )
        return pairs.unit_vectors(self.arrays)

    def concept_vectors(self, term_similarity: DataFrame | None = None) -> DataFrame:
        """``conv_id, turn, term, value``; from a known :func:`term_similarity` if it is given."""
        if self.key_terms == "all" or term_similarity is not None:
            known = self.term_similarity() if term_similarity is None else term_similarity
            if self.key_terms != "all":
                wanted = self.lists.select("conv_id", F.explode("key_terms.term").alias("term_i"))
                known = known.join(wanted, ["conv_id", "term_i"], "left_semi")
            return concepts.concept_vectors_all(self.base, known)
        return concepts.concept_vectors(self.arrays, self.lists, brief=self.brief)

    @_per_stopwords
    def vectors_all(self) -> DataFrame:
        """The concept vectors with every term as a key term, written down."""
        return cut_lineage(self.concept_vectors())

    def _products_all(self, n_concepts: int = 0) -> DataFrame:
        """Products of the turns' vectors of all terms; conversations that a task may hold are worked on in one place."""
        at_once, others = near.split(self.base, near.SQUARE_WORDS)
        found = near.turn_pairs(at_once, n_concepts)
        found = found if n_concepts else found.drop("top")
        if others is None:
            return found
        long = cut_lineage(concepts.concept_vectors_all(others, concepts.window_term_similarity(others)))
        return found.unionByName(products.sparse_products(products.unit_entries(long), n_concepts))

    def conversation_similarity(self, diagonal: bool = False, threshold: float | None = None) -> DataFrame:
        if self.key_terms != "all":
            return super().conversation_similarity(diagonal, threshold)
        cells = self._products_all().withColumnRenamed("value", "similarity").filter("similarity != 0")
        if diagonal:
            cells = cells.unionByName(pairs.own_cells(self.vectors_all.select("conv_id", "turn").distinct()))
        return cells if threshold is None else cells.filter(F.col("similarity") >= threshold)

    def term_overlap(self) -> DataFrame:
        if self.key_terms != "all":
            return concepts.term_overlap(self.base, self.lists)
        shared = products.sparse_products(products.turn_terms(self.base))
        return shared.select("conv_id", "row_turn", "col_turn", F.col("value").cast("bigint").alias("n_terms"))

    def common_concepts(self, n_concepts: int = 5) -> DataFrame:
        if self.key_terms != "all":
            return concepts.common_concepts(self.units, self.lists, n_concepts, brief=self.brief)
        found = self._products_all(n_concepts)
        return found.select("conv_id", "row_turn", "col_turn", F.col("top").alias("concepts")).filter(F.size("concepts") > 0)


class VectorModel(_VectorBacked):
    """The concept model with word vectors instead of co-occurrence.

    Args:
        word_vectors: ``term, vector``.
        key_terms: number of top terms (by turns), an explicit sequence, or ``"all"``; with all terms the vectors the model
            compares are as long as a word vector (``vectors.arrays_all``), not as the vocabulary.
    """

    def __init__(
        self,
        conversations: Conversations,
        word_vectors: DataFrame,
        key_terms: str | int | Sequence[str] = 20,
    ) -> None:
        terms.check_key_terms(key_terms)
        self.conversations = conversations
        self.word_vectors = word_vectors
        self.key_terms = key_terms

    @cached_property
    def shape(self) -> tuple[int, int]:
        """Number of word vectors and numbers per vector."""
        return vectors.vector_shape(self.word_vectors)

    @property
    def dims(self) -> int:
        return self.shape[1] if self.key_terms == "all" else concepts.key_term_count(self.key_terms)

    @property
    def words(self) -> DataFrame:
        return vectors.known_words(self.base, self.word_vectors, self.shape)

    @property
    def base(self) -> DataFrame:
        return concepts.window_terms(self.conversations.sentence_terms)

    @_per_stopwords
    def lists(self) -> DataFrame:
        return cut_lineage(concepts.key_term_lists(self.base, self.key_terms))

    def term_similarity(self) -> DataFrame:
        if self.key_terms == "all":
            return vectors.term_similarity_all(self.words, self.dims)
        return vectors.term_similarity(self.base, self.lists, self.word_vectors)

    @_per_stopwords
    def arrays(self) -> DataFrame:
        if self.key_terms == "all":
            return self._keep(vectors.arrays_all(self.base, self.word_vectors, self.shape))
        return self._keep(vectors.feature_arrays(self.base, self.lists, self.word_vectors, self.dims))

    @_per_stopwords
    def units(self) -> DataFrame:
        return pairs.unit_vectors(self.arrays)

    def feature_vectors(self) -> DataFrame:
        if self.key_terms == "all":
            return vectors.features_all(self.base, self.word_vectors, self.shape)
        return concepts.concept_vectors(self.arrays, self.lists, brief=self.brief)


class EmbeddingModel(_VectorBacked):
    """Similarity from sentence embeddings that come with the data.

    Args:
        embeddings: ``conv_id``, ``turn`` (as it was in the data) and ``embedding`` with ``dims`` numbers each; with
            ``by="text_id"`` the column ``text_id`` names the turn. A vector without a turn is an error.
    """

    def __init__(
        self, conversations: Conversations, embeddings: DataFrame, dims: int, *, by: str = "turn"
    ) -> None:
        self.conversations = conversations
        self.dims = dims
        self.embeddings = conversations.renumbered(embeddings, by, by=by)
        if by != "turn":
            self.embeddings = self.embeddings.drop("turn").withColumnRenamed(by, "turn")

    @cached_property
    def brief(self) -> bool:
        return self.conversations.brief and all_brief(self.embeddings)

    @cached_property
    def units(self) -> DataFrame:
        rows = self.embeddings.select("conv_id", "turn", F.col("embedding").alias("vector"))
        return self._keep(pairs.unit_vectors(rows))
