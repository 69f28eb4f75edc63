"""The domain's relations over the driver's tables, as DataFrames with fixed column lists, and the same as SQL for the oracle.

Each relation is a narrow projection of one table (review states also fold their history), so filters and column lists
reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: Headings that give the synthetic documents a structure.
HEADINGS = ("1.2 Introduction to", "Paging Algorithm for", "What is", "References", "Exercises on", "Example", "Definition of", "Routing Protocol", "Theorem", "Overview of", "Appendix", "3. Deadlock Recovery in")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunk_type(header: F.Column, body: F.Column):
    """Kind of a section by its heading, then by its beginning; the first rule that fits."""
    h, b = F.lower(header), F.lower(F.substring(body, 1, 800))
    return X.first_of(
        (F.contains(h, F.lit("references")), F.lit("references")),
        (F.contains(h, F.lit("bibliography")), F.lit("bibliography")),
        (F.contains(h, F.lit("citations")), F.lit("citations")),
        (F.contains(h, F.lit("appendix")), F.lit("appendix")),
        (X.contains_any(h, ("exercise", "problem")), F.lit("exercise")),
        (X.contains_any(h, ("algorithm", "procedure", "pseudo")), F.lit("algorithm")),
        (X.contains_any(h, ("example", "case study", "case-study")), F.lit("example")),
        (F.contains(h, F.lit("definition")) | h.rlike(r"\bwhat\s+is\b"), F.lit("definition")),
        (X.contains_any(h, ("theorem", "lemma", "proof")), F.lit("theorem")),
        (F.contains(h, F.lit("protocol")) | F.contains(b, F.lit("handshake")), F.lit("protocol")),
        otherwise=F.lit("section"),
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """(id, book_id, header_path, chunk_type, text, subject, pos)"""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    head = F.element_at(F.array(*map(F.lit, HEADINGS)), (F.col("doc_id") % len(HEADINGS) + 1).cast("int"))
    header = F.concat(F.lit("Part "), F.col("lang"), F.lit(" > "), head, F.lit(" "), F.trim(F.substring(F.split("text", "\n")[0], 1, 40)))
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("book_id"),
        header.alias("header_path"),
        chunk_type(X.last_header(header), F.col("text")).alias("chunk_type"),
        "text",
        F.col("lang").alias("subject"),
        F.col("doc_id").alias("pos"),
    )


CHUNKS_SQL = f"""chunks0 as (select doc_id id, source book_id, lang subject, coalesce(text, '') as text,
  'Part ' || lang || ' > ' || ({list(HEADINGS)!r})[doc_id % {len(HEADINGS)} + 1] || ' ' || trim(substr(split_part(coalesce(text, ''), chr(10), 1), 1, 40)) header_path from documents),
chunks1 as (select *, lower(trim(split_part(header_path, '>', -1))) h, lower(substr(text, 1, 800)) b from chunks0),
chunks as (select id, book_id, header_path, case when contains(h, 'references') then 'references' when contains(h, 'bibliography') then 'bibliography'
  when contains(h, 'citations') then 'citations' when contains(h, 'appendix') then 'appendix' when contains(h, 'exercise') or contains(h, 'problem') then 'exercise'
  when contains(h, 'algorithm') or contains(h, 'procedure') or contains(h, 'pseudo') then 'algorithm' when contains(h, 'example') or contains(h, 'case study') or contains(h, 'case-study') then 'example'
  when contains(h, 'definition') or regexp_matches(h, '\\bwhat\\s+is\\b') then 'definition' when contains(h, 'theorem') or contains(h, 'lemma') or contains(h, 'proof') then 'theorem'
  when contains(h, 'protocol') or contains(b, 'handshake') then 'protocol' else 'section' end chunk_type, text, subject, id pos from chunks1)"""

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9_]+'), lambda t: length(t) > 2 and not list_contains({STOP_SQL}, t))"


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, query): every benchmark text."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """(id, user_id, card_id, attempted_at, quality): every event is a review; the card is the number in its properties."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("card_id"),
        F.col("ts").alias("attempted_at"),
        F.pmod(F.floor("value"), F.lit(6)).cast("int").alias("quality"),
    )


ATTEMPTS_SQL = "attempts as (select event_id id, user_id, (props::json->>'k')::bigint card_id, ts attempted_at, (((floor(value)::bigint % 6) + 6) % 6)::int quality from events)"

#: Subjects and topics of the cards.
SUBJECTS = ("os", "cn", "dbms")


def topics(spark: SparkSession, sf: str) -> DataFrame:
    """(id, name): a topic for each region, with one whose name needs trimming and case folding."""
    return table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.concat(F.lit(" "), "r_name").alias("name"))


TOPICS_SQL = "topics as (select r_regionkey::bigint id, ' ' || r_name as name from region)"


def cards(spark: SparkSession, sf: str) -> DataFrame:
    """(id, topic_id, question, answer, difficulty, question_type, topic_key, variant_of_card_id): every part is a card.

    Some topic keys are null or blank, and every seventh card above 6 is a variant of the one six before it.
    """
    k = F.col("p_partkey").cast("long")
    return table(spark, sf, "part").select(
        k.alias("id"),
        F.pmod(k, F.lit(5)).alias("topic_id"),
        F.col("p_name").alias("question"),
        F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("answer"),
        F.element_at(F.array(*map(F.lit, ("easy", "medium", "hard"))), (F.col("p_size") % 3 + 1).cast("int")).alias("difficulty"),
        F.element_at(F.array(*map(F.lit, ("definition", "procedural", "comparative", "factual"))), (k % 4 + 1).cast("int")).alias("question_type"),
        F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" Key:T"), (k % 9).cast("string"))).alias("topic_key"),
        F.when((k % 7 == 0) & (k > 6), k - 6).alias("variant_of_card_id"),
    )


CARDS_SQL = """cards as (select p_partkey::bigint id, p_partkey::bigint % 5 topic_id, p_name question, p_brand || ' ' || p_type || ' ' || p_name answer,
  (['easy', 'medium', 'hard'])[p_size % 3 + 1] difficulty, (['definition', 'procedural', 'comparative', 'factual'])[p_partkey % 4 + 1] question_type,
  case when p_partkey % 11 = 0 then null when p_partkey % 13 = 0 then '  ' else ' Key:T' || (p_partkey % 9)::varchar end topic_key,
  case when p_partkey % 7 = 0 and p_partkey > 6 then p_partkey::bigint - 6 end variant_of_card_id from part)"""


def identities(cards: DataFrame, topics: DataFrame) -> DataFrame:
    """(card_id, subject, topic_key) of every card: trimmed and folded; a blank key is the subject's core topic."""
    subject = F.coalesce(F.nullif(F.trim(F.lower("name")), F.lit("")), F.lit("unknown"))
    key = F.coalesce(F.nullif(F.trim(F.lower("topic_key")), F.lit("")), F.concat("subject", F.lit(":core")))
    named = cards.select(F.col("id").alias("card_id"), "topic_id", "topic_key").join(topics.select(F.col("id").alias("topic_id"), "name"), "topic_id", "left")
    return named.withColumn("subject", subject).select("card_id", "subject", key.alias("topic_key"))


IDENTITIES_SQL = """identities as (select card_id, subject, coalesce(nullif(trim(lower(topic_key)), ''), subject || ':core') topic_key from
  (select c.id card_id, coalesce(nullif(trim(lower(t.name)), ''), 'unknown') subject, topic_key from cards c left join topics t on c.topic_id = t.id))"""

#: The clock of the queries: after every event.
NOW = "2024-02-01 12:00:00"
