"""One query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import chat, embeddings, langid, licences, mixing, neardup, packing, paragraphs, repair, search, sharding, toxicity, whitening
from folioscope.plans.business_docs import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_shards(spark, sf_dir):
    """All documents in 16 shards of equal row counts; the digest columns come from the sharded records."""
    sharded = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), 16)
    text = F.coalesce("text", F.lit(""))
    return sharded.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op7_chat(spark, sf_dir):
    """All conversations and one that holds the template's control strings, read back from the windows."""
    tricky = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_windows(turns)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query
def op2_pack(spark, sf_dir):
    """All documents in sequences of at most 4096 ids."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer)


@query
def op4_language(spark, sf_dir):
    """The language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query
def op5_neardup(spark, sf_dir):
    """Components of documents whose shingle sets are 85 % alike."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_embeddings(spark, sf_dir):
    """Components of embeddings at a cosine of 0.95 or more."""
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query
def op10_toxicity(spark, sf_dir):
    """The toxicity of every document, learned from the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = docs.filter(~langid.held_out()).join(labels, "doc_id").select(F.col("doc_id").alias("id"), "text", "toxic")
    found = toxicity.assess(docs.select("doc_id", "text"), toxicity.train(labelled))
    predicted = (F.col("toxicity") >= toxicity.PREDICT_AT).cast("int")
    return found.select("doc_id", langid.held_out().alias("held_out"), F.col("toxicity").alias("score"), predicted.alias("predicted"))


@query
def op9_paragraphs(spark, sf_dir):
    """The lines and passages of all documents that repeat an earlier one, and which."""
    return paragraphs.repeats(table(spark, sf_dir, "documents"))


@query
def op1_mix(spark, sf_dir):
    """Weight, probability and draw of every document for margins evened out by a power of one half."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "sampled")


@query
def op8_search(spark, sf_dir):
    """The ten best documents for each document whose id is divisible by 50, taken as a query."""
    docs = table(spark, sf_dir, "documents")
    return search.search(docs, docs.filter("doc_id % 50 = 0"))


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text``: rows dropped, emptied, cut, repeated or given to the user, by a checksum of conversation and turn."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    damage = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", named[2].alias("role"), named[3].alias("text"), damage.alias("damage")).filter("damage != 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(1), F.when(F.col("damage") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


@query
def op13_repair(spark, sf_dir):
    """All conversations, damaged and repaired: the faults, the cheapest edits and a digest of what they make."""
    turns = table(spark, sf_dir, "conversations")
    edited, totals = repair.repair(damaged(turns))
    parts = turns.select("conv_id").distinct().unionByName(totals, allowMissingColumns=True)
    parts = parts.unionByName(repair.digests(edited), allowMissingColumns=True)
    counts = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    audit = F.coalesce(F.max("audit"), F.lit("")).alias("audit")
    return parts.groupBy("conv_id").agg(*counts, audit, F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query
def op11_licences(spark, sf_dir):
    """Words, licence phrases and licence labels of every document."""
    found = licences.scan(table(spark, sf_dir, "documents"))

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    share = F.greatest(F.array_max("templates.share"), F.when(F.size("phrases") > 0, 1.0).otherwise(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.word").cast("long").alias("first_word"),
        F.array_max("phrases.word").cast("long").alias("last_word"),
        joined(F.col("phrases.label")).alias("base_labels"),
        joined(F.concat("phrases.label", "templates.label")).alias("labels"),
        F.round(share, 6).alias("score"),
    )


@query
def op12_whitening(spark, sf_dir):
    """All embeddings on their eight leading components, whitened."""
    rows, model = whitening.whiten(table(spark, sf_dir, "embeddings"))
    explained = F.array(*[F.lit(float(e)) for e in model.explained]) if model else F.array()
    error = F.lit(model.identity_error if model else None).cast("double")
    deviation = F.col("deviation").try_cast("long")  # a long holds it up to some million vectors
    rows = rows.select("vec_id", "n", deviation.alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.get(explained.cast("array<double>"), F.col("at")).alias("explained"), error.alias("identity_error"),
    )
