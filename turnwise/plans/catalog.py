"""One query per operator over the given tables; ``oracle.py`` states the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions.text import drop_stopwords, sentences, token_count, tokens
from turnwise.operators import concepts, conversation, layout, prepare, recurrence, terms
from turnwise.operators import concordance as kwic
from turnwise.operators.ordering import number_rows, top_rows
from turnwise.plans.conversation import ConceptModel, Conversations, EmbeddingModel, VectorModel
from turnwise.plans.plot import ModelPlot
from turnwise.session import configure, cut_lineage, scratch_path
from turnwise.sources import files, results, tables

Query = Callable[[SparkSession, str], DataFrame]

# The stop words of the registered queries, and the words they search for.
STOP_WORDS = (
    "the of and to in a is that it for was on as with by be from this are an at or he his not "
    "de la en que les le des un une et est du pour dans qui par sur plus ne se il elle au ce "
    "der die und von das den zu ein eine ist mit sich nicht auch es auf dem "
    "el los las del y una por con para su como al lo"
).split()
KEYWORDS = ["the", "der", "que"]
SENTENCE_WINDOW = 3
KEY_TERMS = 20
DIGITS = 6

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return tables.deal_out(docs).withColumnRenamed("doc_id", "text_id")


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.deal_out(table(spark, sf_dir, "documents"))
    return number_rows(docs, "doc_id", name="row")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.split_lines(documents(spark, sf_dir), ["text_id"])


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = tables.deal_out(table(spark, sf_dir, "conversations"))
    return data.withColumnRenamed("role", "speaker")


def conversations(spark: SparkSession, sf_dir: str) -> Conversations:
    return Conversations(turns(spark, sf_dir), dense=True, stopwords=STOP_WORDS)


def concept_model(spark: SparkSession, sf_dir: str) -> ConceptModel:
    return ConceptModel(conversations(spark, sf_dir), KEY_TERMS, SENTENCE_WINDOW)


def window_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_lineage(concepts.sentence_terms(turns(spark, sf_dir), stopwords=STOP_WORDS))
    return concepts.window_terms(rows, SENTENCE_WINDOW)


def embedding_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as conversations of ten turns."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 10").alias("conv_id"),
        F.expr("vec_id % 10").alias("turn"),
        "embedding",
        F.col("label").cast("string").alias("speaker"),
    )


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for every word of the conversations, drawn from the embeddings by a hash."""
    words = turns(spark, sf_dir).select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    given = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    size = given.agg(F.max("vec_id") + 1).first()[0]
    hashed = words.withColumn(
        "vec_id", F.expr(f"cast(conv(substring(md5(term), 1, 6), 16, 10) AS bigint) % {size}")
    )
    return cut_lineage(hashed.join(given, "vec_id").select("term", "vector"))


def vector_model(spark: SparkSession, sf_dir: str) -> VectorModel:
    return VectorModel(conversations(spark, sf_dir), word_vectors(spark, sf_dir), KEY_TERMS)


def plot(spark: SparkSession, sf_dir: str, *, labelled: bool = False, threshold=None) -> ModelPlot:
    model = concept_model(spark, sf_dir)
    return ModelPlot(model.conversations, model, labelled=labelled, threshold=threshold)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Round doubles, as sums come in any order."""
    for column in columns:
        df = df.withColumn(column, F.round(F.col(column), DIGITS) + F.lit(0.0))
    return df


def text_of(items: str | Column, separator: str = " ") -> Column:
    return F.array_join(items, separator)


def numbers_of(items: str) -> Column:
    """A list of numbers as text with a fixed number of digits."""
    return text_of(F.transform(items, lambda x: F.format_string("%.4f", F.round(x, 4) + F.lit(0.0))))


# ---------------------------------------------------------------- sources and sinks


@query
def load_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    columns = ["doc_id", "text", "lang", "source"]
    results.write_results(table(spark, sf_dir, "documents").select(*columns), path)
    schema = "doc_id bigint, text string, lang string, source string"
    return files.read_csv(spark, path, schema=schema).select(*columns)


@query
def load_dataframe(spark, sf_dir):
    return tables.from_dataframe(documents(spark, sf_dir)).select("text_id", "text", "lang")


@query
def load_plain_lines(spark, sf_dir):
    return tables.plain_lines(document_lines(spark, sf_dir))


@query
def load_text_files(spark, sf_dir):
    path = scratch_path(spark, "text")
    documents(spark, sf_dir).select("text").write.text(path)
    lines = files.read_lines(spark, path)
    return lines.groupBy("text").agg(F.count("*").alias("n"))


@query
def load_text_files_numbering(spark, sf_dir):
    path = scratch_path(spark, "text")
    documents(spark, sf_dir).select("text").write.text(path)
    per_file = files.read_lines(spark, path).groupBy("source_file")
    counted = per_file.agg(
        F.count("*").alias("n"), F.countDistinct("row").alias("d"), F.max("row").alias("last")
    )
    return counted.agg(
        F.sum("n").alias("n_lines"),
        F.sum("d").alias("n_row_numbers"),
        (F.sum("last") + F.count("*")).alias("n_expected"),
    )


@query
def load_text_files_order(spark, sf_dir):
    """The row number of every line of one text, in which the documents stand in order: a folder of sorted parts."""
    path = scratch_path(spark, "ordered")
    documents(spark, sf_dir).select("text_id", "text").orderBy("text_id").select("text").write.text(path)
    return files.read_lines(spark, path, as_one=True).select("row", "text")


@query
def load_keyed_lines(spark, sf_dir):
    return tables.keyed_lines(document_lines(spark, sf_dir), ",")


@query
def load_keyed_files(spark, sf_dir):
    path = scratch_path(spark, "keyed")
    documents(spark, sf_dir).select("text").write.text(path)
    lines = files.read_keyed_lines(spark, path, ",")
    return lines.groupBy("key").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars")
    )


@query
def load_encoding_fallback(spark, sf_dir):
    """Lines of files of which some are UTF-8 and some Latin-1."""
    path = scratch_path(spark, "encodings")
    docs = documents(spark, sf_dir)
    is_latin = F.rlike("text", F.lit("^[\\x00-\\xFF]*$"))
    # The bytes of a string are written as they are, so a file may hold Latin-1.
    docs.filter(is_latin).select(F.encode("text", "ISO-8859-1").cast("string")).write.text(path)
    docs.filter(~is_latin).select("text").write.mode("append").text(path)
    return files.read_lines(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query
def export_results(spark, sf_dir):
    path = scratch_path(spark, "export")
    found = kwic.search(documents(spark, sf_dir), "tion", window_width=20)
    results.write_results(found, path, "csv")
    schema = "text_id bigint, match_no bigint, left_context string, match string, right_context string"
    again = files.read_csv(spark, path, schema=schema)
    return again.select(
        "text_id",
        "match_no",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("left_context", "match", "right_context")],
    )


@query
def column_display_width(spark, sf_dir):
    return results.column_widths(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- preparation and chunks


@query
def prepare_texts(spark, sf_dir):
    prepared = prepare.prepare_texts(table(spark, sf_dir, "documents"), "text", "doc_id")
    return prepared.select("text_id", "lang", "text", text_of("tokens").alias("tokens"))


@query
def assign_text_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return number_rows(docs, "doc_id", keys=["source"]).select("source", "doc_id", "text_id")


@query
def assign_text_id_sparse(spark, sf_dir):
    """The same by order values far apart, over the whole table."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("doc_id") * F.lit(1 << 33)).alias("stamp")
    )
    return number_rows(docs, "stamp").select("doc_id", "text_id")


@query
def prepare_turns(spark, sf_dir):
    data = table(spark, sf_dir, "conversations")
    prepared = prepare.prepare_turns(data, speaker_column="role")
    return prepared.select("conv_id", "turn", "text_id", "speaker", "text")


@query
def chunk_rows(spark, sf_dir):
    return prepare.chunk_rows(document_rows(spark, sf_dir), 7).select("doc_id", "row", "chunk")


@query
def tag_rows(spark, sf_dir):
    return prepare.tag_rows(document_rows(spark, sf_dir)).select("row", "text")


def _chunks(spark, sf_dir):
    chunked = prepare.chunk_rows(document_rows(spark, sf_dir), 5)
    return prepare.concat_chunks(prepare.tag_rows(chunked))


@query
def chunk_concat(spark, sf_dir):
    return _chunks(spark, sf_dir)


@query
def largest_text_length(spark, sf_dir):
    return prepare.largest_text_length(_chunks(spark, sf_dir))


@query
def metadata_columns(spark, sf_dir):
    rows = prepare.chunk_rows(document_rows(spark, sf_dir), 5)
    return prepare.metadata(rows.withColumn("tokens", tokens(F.col("text"))))


@query
def stacked_chunks(spark, sf_dir):
    docs = documents(spark, sf_dir).select("text_id", "text", "lang")
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "text_id")
    return prepare.stack_tables([docs, items])


# ---------------------------------------------------------------- concordance


@query
def kwic_literal(spark, sf_dir):
    return kwic.search(documents(spark, sf_dir), "tion")


@query
def kwic_regex(spark, sf_dir):
    return kwic.search(documents(spark, sf_dir), "[aeiou]{2}n", regex=True)


@query
def kwic_regex_empty_match(spark, sf_dir):
    found = kwic.search(documents(spark, sf_dir), "x*", regex=True, window_width=5)
    return found.groupBy("text_id").agg(
        F.count("*").alias("n"), F.sum(F.length("match")).alias("n_chars")
    )


@query
def kwic_regex_words(spark, sf_dir):
    return kwic.search(documents(spark, sf_dir), r"\w+ing", regex=True, window_width=20)


@query
def kwic_case_sensitive(spark, sf_dir):
    return kwic.search(documents(spark, sf_dir), "The", ignore_case=False)


@query
def kwic_whole_word(spark, sf_dir):
    return kwic.search(documents(spark, sf_dir), "the", whole_word=True)


@query
def context_window(spark, sf_dir):
    return kwic.search(documents(spark, sf_dir), "tion", window_width=500)


def _chunk_rows(spark, sf_dir):
    return prepare.chunk_rows(document_rows(spark, sf_dir), 5)


@query
def kwic_chunked(spark, sf_dir):
    return kwic.search_chunks(_chunk_rows(spark, sf_dir), "the", whole_word=True).select(
        "chunk", "match_no", "left_context", "match", "right_context", "text_id"
    )


@query
def match_source_row(spark, sf_dir):
    found = kwic.search_chunks(_chunk_rows(spark, sf_dir), "tion", window_width=0, clean=True)
    return found.select("chunk", "match_no", "start", "row")


@query
def kwic_with_metadata(spark, sf_dir):
    rows = _chunk_rows(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    labelled = rows.join(labels, "doc_id", "left")
    found = kwic.search_chunks(
        labelled, "the", whole_word=True, window_width=10, metadata=["lang", "quality"]
    )
    return found.select("chunk", "match_no", "row", "text_id", "match", "lang", "quality")


@query
def dedup_metadata(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").dropDuplicates()


@query
def kwic_sort_text_id(spark, sf_dir):
    found = kwic.search(documents(spark, sf_dir), "the", whole_word=True, window_width=20)
    return kwic.numbered_results(found, "text_id")


def _with_sort_key(spark, sf_dir, by):
    found = kwic.search(documents(spark, sf_dir), "the", whole_word=True, window_width=20)
    key = kwic.sort_keys(by)[0]
    keyed = kwic.numbered_results(found, by).withColumn("sort_key", key)
    return keyed.select("position", "text_id", "match_no", by, "sort_key")


@query
def kwic_sort_left(spark, sf_dir):
    return _with_sort_key(spark, sf_dir, "left_context").withColumn("sort_key", text_of("sort_key", "|"))


@query
def kwic_sort_right(spark, sf_dir):
    return _with_sort_key(spark, sf_dir, "right_context")


@query
def strip_row_tags(spark, sf_dir):
    tagged = prepare.tag_rows(document_rows(spark, sf_dir))
    return kwic.remove_tags(tagged).select("row", "text")


@query
def kwic_count(spark, sf_dir):
    return kwic.count_matches(documents(spark, sf_dir), "the", whole_word=True)


@query
def kwic_total_pages(spark, sf_dir):
    return kwic.total_matches(kwic.count_matches(documents(spark, sf_dir), "the", whole_word=True))


@query
def kwic_page(spark, sf_dir):
    found = kwic.search(documents(spark, sf_dir), "the", whole_word=True)
    return kwic.result_page(found, 3, by="right_context")


@query
def kwic_page_left(spark, sf_dir):
    found = kwic.search(documents(spark, sf_dir), "the", whole_word=True)
    return kwic.result_page(found, 2, 50, by="left_context")


@query
def kwic_page_far(spark, sf_dir):
    found = kwic.search(documents(spark, sf_dir), "e", window_width=20)
    return kwic.numbered_results(kwic.result_page(found, 2000, by="right_context"), "right_context")


@query
def line_context_rare(spark, sf_dir):
    """A word that few lines hold: only the lines around them are put together."""
    found = kwic.line_context(document_lines(spark, sf_dir), "license", 3, keys=["text_id"])
    return found.select(
        "text_id", "line_no", text_of("before", "\n").alias("before"), "line", text_of("after", "\n").alias("after")
    )


@query
def line_context(spark, sf_dir):
    found = kwic.line_context(document_lines(spark, sf_dir), "the", 2, keys=["text_id"])
    return found.select(
        "text_id", "line_no", text_of("before", "\n").alias("before"), "line", text_of("after", "\n").alias("after")
    )


@query
def kwic_many(spark, sf_dir):
    return kwic.search_many(documents(spark, sf_dir), KEYWORDS, whole_word=True, window_width=20)


def thousands_of_words() -> list[str]:
    """Invented keywords of two to four letters."""
    letters = "etaoinsrhl"
    return [a + b + c + d for a in letters for b in letters for c in ("", *letters[:5]) for d in ("", *letters[:8])]


@query
def kwic_many_thousands(spark, sf_dir):
    found = kwic.search_many(documents(spark, sf_dir), thousands_of_words(), whole_word=True, window_width=5)
    return found.groupBy("keyword").agg(F.count("*").alias("n"), F.countDistinct("text_id").alias("n_texts"))


@query
def kwic_many_regex(spark, sf_dir):
    """Patterns that Spark reads like Python, and one that only Python reads."""
    found = kwic.search_many(
        documents(spark, sf_dir), ["[aeiou]{2}n", "x*"], regex=True, window_width=5
    )
    return found.groupBy("keyword", "text_id").agg(
        F.count("*").alias("n"), F.sum(F.length("match")).alias("n_chars")
    )


# ---------------------------------------------------------------- tokens and terms


@query
def tokenize(spark, sf_dir):
    words = documents(spark, sf_dir).select(F.explode(tokens(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n"))


@query
def token_counts(spark, sf_dir):
    return turns(spark, sf_dir).select(
        "conv_id", "turn", token_count(F.col("text")).alias("n_words")
    )


@query
def filter_tokens(spark, sf_dir):
    words = turns(spark, sf_dir).withColumn("words", tokens(F.col("text")))
    kept = drop_stopwords("words", STOP_WORDS)
    return words.select("conv_id", "turn", text_of(kept).alias("tokens"))


@query
def add_stopword(spark, sf_dir):
    data = conversations(spark, sf_dir)
    data.add_stopword("th", "tion")
    return data.term_frequencies()


@query
def split_sentences(spark, sf_dir):
    split = turns(spark, sf_dir).select(
        "conv_id", "turn", F.posexplode(sentences(F.col("text"))).alias("n", "sentence")
    )
    return split.withColumn("n", F.col("n").cast("bigint"))


@query
def sentence_windows(spark, sf_dir):
    windows = concepts.sentence_windows(turns(spark, sf_dir), SENTENCE_WINDOW)
    return windows.withColumn("sentences", text_of("sentences", "|"))


@query
def term_freq_overall(spark, sf_dir):
    return conversations(spark, sf_dir).term_frequencies("overall")


@query
def term_freq_turns(spark, sf_dir):
    return conversations(spark, sf_dir).term_frequencies("n_turns")


@query
def all_terms(spark, sf_dir):
    return conversations(spark, sf_dir).all_terms()


@query
def top_terms(spark, sf_dir):
    top = conversations(spark, sf_dir).most_common_terms(10)
    return top.withColumn("rank", F.col("rank").cast("bigint"))


@query
def top_terms_by_source(spark, sf_dir):
    frequencies = terms.term_frequencies(documents(spark, sf_dir), keys=["source"], stopwords=STOP_WORDS)
    top = top_rows(frequencies, ["source"], [F.desc("frequency"), F.asc("term")], 25)
    return top.withColumn("rank", F.col("rank").cast("bigint"))


@query
def key_terms(spark, sf_dir):
    return terms.key_terms(turns(spark, sf_dir), KEY_TERMS, stopwords=STOP_WORDS)


@query
def doc_term(spark, sf_dir):
    return terms.doc_term(turns(spark, sf_dir), stopwords=STOP_WORDS)


# ---------------------------------------------------------------- descriptors


@query
def n_utterances(spark, sf_dir):
    return conversation.n_utterances(turns(spark, sf_dir))


@query
def n_speakers(spark, sf_dir):
    return conversation.n_speakers(turns(spark, sf_dir))


@query
def speaker_names(spark, sf_dir):
    return conversation.speaker_names(turns(spark, sf_dir))


# ---------------------------------------------------------------- concept model


@query
def total_windows(spark, sf_dir):
    return concepts.total_windows(window_base(spark, sf_dir))


@query
def term_occurrence(spark, sf_dir):
    return concepts.term_occurrence(window_base(spark, sf_dir))


@query
def term_cooccurrence(spark, sf_dir):
    return concepts.term_cooccurrence(window_base(spark, sf_dir))


@query
def term_contingency(spark, sf_dir):
    return concept_model(spark, sf_dir).contingency().drop("n_windows")


@query
def term_similarity_concept(spark, sf_dir):
    return rounded(concept_model(spark, sf_dir).term_similarity(), "similarity")


@query
def concept_vectors(spark, sf_dir):
    return rounded(concept_model(spark, sf_dir).concept_vectors(), "value")


@query
def similarity_concept(spark, sf_dir):
    return rounded(concept_model(spark, sf_dir).conversation_similarity(), "similarity")


def _all_terms_model(spark, sf_dir):
    return ConceptModel(conversations(spark, sf_dir), "all", SENTENCE_WINDOW)


@query
def similarity_concept_all_terms(spark, sf_dir):
    return rounded(_all_terms_model(spark, sf_dir).conversation_similarity(), "similarity")


@query
def term_overlap_all_terms(spark, sf_dir):
    return _all_terms_model(spark, sf_dir).term_overlap()


@query
def common_concepts_all_terms(spark, sf_dir):
    found = _all_terms_model(spark, sf_dir).common_concepts()
    return found.withColumn("concepts", text_of("concepts", ", "))


@query
def term_overlap(spark, sf_dir):
    return concept_model(spark, sf_dir).term_overlap()


@query
def common_concepts(spark, sf_dir):
    found = concept_model(spark, sf_dir).common_concepts()
    return found.withColumn("concepts", text_of("concepts", ", "))


# ---------------------------------------------------------------- vector models


@query
def term_similarity_vector(spark, sf_dir):
    return rounded(vector_model(spark, sf_dir).term_similarity(), "similarity")


@query
def feature_vectors(spark, sf_dir):
    return rounded(vector_model(spark, sf_dir).feature_vectors(), "value")


@query
def similarity_vector(spark, sf_dir):
    return rounded(vector_model(spark, sf_dir).conversation_similarity(), "similarity")


def _all_terms_vector_model(spark, sf_dir):
    return VectorModel(conversations(spark, sf_dir), word_vectors(spark, sf_dir), "all")


@query
def feature_vectors_all_terms(spark, sf_dir):
    return rounded(_all_terms_vector_model(spark, sf_dir).feature_vectors(), "value")


@query
def similarity_vector_all_terms(spark, sf_dir):
    return rounded(_all_terms_vector_model(spark, sf_dir).conversation_similarity(), "similarity")


@query
def similarity_mean_vector(spark, sf_dir):
    data = conversations(spark, sf_dir)
    return rounded(data.mean_vector_similarity(word_vectors(spark, sf_dir)), "similarity")


def _embedding_model(spark, sf_dir):
    rows = embedding_turns(spark, sf_dir)
    data = Conversations(rows.withColumn("text", F.lit("")), dense=True)
    return EmbeddingModel(data, rows, 64)


@query
def similarity_embedding(spark, sf_dir):
    return rounded(_embedding_model(spark, sf_dir).conversation_similarity(), "similarity")


def _sparse_embedding_model(spark, sf_dir):
    """Turns 1, 4, 7, ...: numbered anew, as are the embeddings that come with them."""
    rows = embedding_turns(spark, sf_dir).withColumn("turn", F.col("turn") * 3 + 1)
    data = Conversations(rows.drop("embedding").withColumn("text", F.lit("")))
    return EmbeddingModel(data, rows.select("conv_id", "turn", "embedding"), 64)


@query
def similarity_embedding_renumbered(spark, sf_dir):
    return rounded(_sparse_embedding_model(spark, sf_dir).conversation_similarity(), "similarity")


@query
def recurrence_embedding(spark, sf_dir):
    return rounded(_embedding_model(spark, sf_dir).all_topic_recurrences(), "score")


@query
def similarity_embedding_above(spark, sf_dir):
    """Similar pairs of conversations of a thousand turns."""
    rows = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id div 1000 AS conv_id", "vec_id % 1000 AS turn", "embedding", "cast(label AS string) AS speaker", "'' AS text"
    )
    model = EmbeddingModel(Conversations(rows, dense=True), rows, 64)
    return rounded(model.conversation_similarity(threshold=0.3), "similarity")


@query
def similarity_concept_above(spark, sf_dir):
    return rounded(concept_model(spark, sf_dir).conversation_similarity(threshold=0.4567), "similarity")


# ---------------------------------------------------------------- recurrence


@query
def topic_recurrence(spark, sf_dir):
    model = concept_model(spark, sf_dir)
    wide = model.topic_recurrences(t_medium=4)
    return rounded(recurrence.topic_recurrence(wide, "medium", "backward", "other"), "score")


@query
def topic_recurrence_normalized(spark, sf_dir):
    model = concept_model(spark, sf_dir)
    wide = model.topic_recurrences(normalize=True)
    return rounded(recurrence.topic_recurrence(wide, "short", "forward", "self"), "score")


@query
def topic_recurrence_of_similarity(spark, sf_dir):
    model = concept_model(spark, sf_dir)
    cells = model.conversation_similarity()
    found = model.conversations.topic_recurrence(cells, "long", "forward", "other", normalize=True)
    return rounded(found, "score")


@query
def all_topic_recurrences(spark, sf_dir):
    return rounded(concept_model(spark, sf_dir).all_topic_recurrences(), "score")


@query
def all_topic_recurrences_long_path(spark, sf_dir):
    """The running totals that long conversations take, on all of them."""
    model = concept_model(spark, sf_dir)
    wide = recurrence.topic_recurrences_of_vectors(
        model.conversations.turns, model.units, model.dims, normalize=True, width=1
    )
    return rounded(recurrence.long_recurrences(wide), "score")


@query
def conceptual_recurrence_rate(spark, sf_dir):
    return rounded(concept_model(spark, sf_dir).recurrence_rate(), "recurrence_rate")


@query
def grouped_recurrence(spark, sf_dir):
    return rounded(concept_model(spark, sf_dir).grouped_recurrence(), "score")


@query
def grouped_recurrence_by_column(spark, sf_dir):
    """Groups of embeddings by label, each run of ten vectors a conversation."""
    return rounded(_embedding_model(spark, sf_dir).grouped_recurrence(), "score")


@query
def grouped_recurrence_sparse_turns(spark, sf_dir):
    return rounded(_sparse_embedding_model(spark, sf_dir).grouped_recurrence(), "score")


@query
def grouped_recurrence_raw(spark, sf_dir):
    return rounded(concept_model(spark, sf_dir).grouped_recurrence(normalize=False), "score")


# ---------------------------------------------------------------- plot tables


@query
def similarity_long(spark, sf_dir):
    return rounded(plot(spark, sf_dir).long, "similarity")


@query
def turns_in_similarity(spark, sf_dir):
    tables_ = plot(spark, sf_dir)
    return tables_.shown().select("conv_id", "turn", "speaker")


@query
def tile_layout(spark, sf_dir):
    return rounded(layout.tile_layout(turns(spark, sf_dir)), "size", "position")


@query
def tile_attributes(spark, sf_dir):
    return rounded(
        plot(spark, sf_dir).cells, "similarity", "width", "height", "x_position", "y_position"
    )


@query
def diagonal_tiles(spark, sf_dir):
    tiles = plot(spark, sf_dir).diagonal()
    return rounded(
        tiles.select("conv_id", "x_index", "x_group", "width", "x_position", "text"), "width", "x_position"
    )


@query
def similarity_triangles(spark, sf_dir):
    shown = plot(spark, sf_dir).triangles()
    corners = [c for c in shown.columns if c.endswith(("_x", "_y"))]
    for column in corners:
        shown = shown.withColumn(column, numbers_of(column))
    return rounded(shown, "similarity")


@query
def similarity_threshold(spark, sf_dir):
    cells = plot(spark, sf_dir).long
    return rounded(layout.similarity_threshold(cells, 0.4567), "similarity")


@query
def cells_with_concepts(spark, sf_dir):
    shown = plot(spark, sf_dir, labelled=True).triangles()
    return rounded(shown.select("conv_id", "x_index", "y_index", "similarity", "concepts"), "similarity")


@query
def texts_for_cells(spark, sf_dir):
    tables_ = plot(spark, sf_dir)
    selected = layout.similarity_threshold(tables_.long.filter("x_index < y_index"), 0.8765)
    return tables_.texts(selected).select("conv_id", "turn", "speaker", "text")


@query
def texts_above_threshold(spark, sf_dir):
    """The turns that are similar to another one, found without the table of all pairs."""
    tables_ = plot(spark, sf_dir, threshold=0.8765)
    return tables_.texts(tables_.long.filter("x_index < y_index")).select("conv_id", "turn", "speaker", "text")


@query
def plot_groups(spark, sf_dir):
    return plot(spark, sf_dir).groups()
