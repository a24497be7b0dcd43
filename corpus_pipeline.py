"""The corpus pipeline: documents in, encoded documents out.

1. Quality: documents that the factorisation machine scores below 0.3 go.
2. Near duplicates: of each component of the n-gram Jaccard join (five words, similarity 0.75) the
   document with the smallest doc_id stays.
3. Repeated passages: words covered by a 13-word window that also starts in a document with a
   smaller doc_id go; the text is what is left, joined by one space. The document stays.
4. Mixing: rates that bring the expected tokens of each domain to their target shares. Languages
   are only ever raised (the total is chosen so), toxic text goes to rate 0; a document is
   repeated as often as its rate says.
5. Encoding: every document's pieces under seeded merge dropout, decoded again as proof. Equal rows are
   numbered, so that copies made by stage 4 get segmentations of their own.

Every stage reads all that its predecessor kept. All but the last return doc_id,
text, lang, source, n_chars. Rows with a null doc_id pass stages 1, 3 and 4 and count as
one document each in stage 2. Rows that repeat a doc_id
are told apart by their sets of n-grams: stage 2 keeps one row of each set (the smallest text, then lang, source) unless the set
links with a smaller doc_id; those without words all stay. An empty table gives an empty result.

SQL can't express the classifier; the pipeline's stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.jaccard import jaccard_components, with_set_ids
from tessera.llm.mixing import copies, mixing_rates
from tessera.llm.piece_dropout import round_trip
from tessera.llm.quality import QualityClassifier, held_out
from tessera.llm.queries import MIX, PIECE_MODEL, TOKENIZER, mix_labels
from tessera.llm.shared import BROADCAST_KEYS, Scratch, plain, table
from tessera.llm.substring_dedup import dedup_substrings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEEP_FROM = 0.3
#: The wanted total is so much above the least one at which no wanted domain shrinks.
UPSAMPLE = 1.15
#: Pull of rates towards 1: with less, clean documents that the classifier gives a few percent of toxic would leave too.
RIDGE = 0.01


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = plain(docs, *COLUMNS)
    labels = plain(table(spark, sf_dir, "labels"), "doc_id", "quality")
    fitted = QualityClassifier(metadata=("n_chars",)).fit(docs, labels, "quality", ~held_out(F.col("doc_id")))
    return fitted.score(docs, COLUMNS[1:]).filter(F.col("score") >= KEEP_FROM).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = plain(docs, *COLUMNS)
    scratch = Scratch(spark, "near")
    found = scratch.save(jaccard_components(docs, with_sets=True), "found")
    repeated = scratch.save(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    many = repeated.count()
    if many:
        # rows of a repeated id are told apart by their sets: of each set one row stays, if nothing smaller links with the set
        of_set = found.join(_hinted(repeated, many), "doc_id", "left_semi").filter("set_id is not null").groupBy("doc_id", "set_id").agg(F.first("component_id").alias("component_id"))
        several = with_set_ids(docs.join(_hinted(repeated, many), "doc_id", "left_semi").select(*COLUMNS))
        first = several.filter("set_id is not null").groupBy("doc_id", "set_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r"))
        stay = first.join(of_set.filter("component_id = doc_id"), ["doc_id", "set_id"], "left_semi").select("doc_id", "r.*")
        gone = gone.unionByName(repeated).distinct()
        extra = stay.select(*COLUMNS).unionByName(several.filter("set_id is null").select(*COLUMNS))
    gone = scratch.save(gone, "gone")
    kept = docs.join(_hinted(gone, gone.count()), "doc_id", "left_anti").select(*COLUMNS)
    return kept.unionByName(extra) if many else kept


def _hinted(keys: DataFrame, count: int) -> DataFrame:
    return F.broadcast(keys) if count <= BROADCAST_KEYS else keys.hint("shuffle_hash")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = dedup_substrings(plain(docs, *COLUMNS), keep=("lang", "source"))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = plain(docs, *COLUMNS)
    labels = plain(table(spark, sf_dir, "labels"), "doc_id", "toxic")
    rated = mixing_rates(docs, mix_labels(docs, labels), MIX, UPSAMPLE, keep=COLUMNS[1:], ridge=RIDGE, tokenizer=public_tokenizers.path(TOKENIZER))
    times = rated.withColumn("times", copies(F.col("rate"), F.xxhash64("doc_id", "text"))).filter("times > 0")
    return times.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    copies_of = plain(docs, *COLUMNS).groupBy(*COLUMNS).agg(F.count("*").alias("n"))
    numbered = copies_of.select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return round_trip(numbered, public_tokenizers.path(PIECE_MODEL), with_ids=True, copy="copy")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", encoding),
]

#: The classifier and the mixing fit can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage-{i}")
    return docs
