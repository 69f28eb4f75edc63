"""Corpus preparation: cleaning lines and paragraphs, sections by headings, chunks with metadata.

Line work is array work inside a row; nothing is shuffled until a result needs it.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.relations import chunk_type

#: Kinds and headings that are left out of the corpus.
EXCLUDED_TYPES = ("exercise", "references", "bibliography", "citations", "appendix")
EXCLUDED_HEADERS = ("appendix", "exercises", "review questions", "selected bibliography", "references", "bibliography", "citations", "acknowledgment", "index")
#: Parts of book names and their subjects, in order.
BOOK_SUBJECTS = (
    ("computer networking", "cn"),
    ("computer networks", "cn"),
    ("database management", "dbms"),
    ("database system", "dbms"),
    ("fundamentals of database", "dbms"),
    ("modern operating", "os"),
    ("operating system concepts", "os"),
    ("operating systems three", "os"),
)
#: Terms of two subjects, in order; anything else is the third.
DBMS_TERMS = ("database", "sql", "transaction", "acid", "index", "b+ tree", "normalization", "dbms")
CN_TERMS = ("tcp", "udp", "network", "protocol", "routing", "handshake", "http", "computer network")


def words(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


def collapse_repeats(line: Column) -> Column:
    """Runs of one token are cut to two; white space is collapsed."""
    return X.let(words(line), lambda w: F.array_join(F.filter(w, lambda x, i: (i < 2) | (x != F.get(w, i - 1)) | (x != F.get(w, i - 2))), " "))


def dedup_sentences(line: Column) -> Column:
    """Immediately repeated sentences go. What follows the last terminator is lost if there is any sentence."""
    ended = F.regexp_extract(F.trim(line), r"(?s)^(.*[.!?])", 1)  # up to the last terminator, then cut behind each: linear in the line
    found = F.filter(F.transform(F.split(ended, r"(?<=[.!?])"), lambda s: F.trim(s)), lambda s: s != "")
    joined = X.let(found, lambda a: F.when(F.size(a) > 0, F.array_join(F.filter(a, lambda s, i: (i == 0) | (s != F.get(a, i - 1))), " ")))
    return F.coalesce(joined, line)


def noisy_line(line: Column) -> Column:
    s = F.trim(line)
    return (s != "") & ~s.rlike(r"^[#*+-]") & (F.length(s) < 8)


def caption_line(line: Column) -> Column:
    return F.trim(line).rlike(r"^(Figure|Table)\s+\d")


def dominant_ratio(line: Column) -> Column:
    """Share of the most frequent token; 0 without tokens."""
    return X.let(words(F.trim(line)), lambda w: F.when(F.size(w) == 0, F.lit(0.0)).otherwise(most_frequent(w) / F.size(w)))


def most_frequent(w: Column) -> Column:
    """Count of the most frequent element: the longest run of the sorted array."""
    s = F.array_sort(w)
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))
    step = lambda a, x: F.struct(x.alias("last"), F.when(a["last"] == x, a["run"] + 1).otherwise(F.lit(1)).alias("run"), F.greatest(a["best"], F.when(a["last"] == x, a["run"] + 1).otherwise(F.lit(1))).alias("best"))
    return F.aggregate(s, start, step, lambda a: a["best"])


def noisy_paragraph(lines: Column) -> Column:
    joined = F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), " ")

    def repeats(w: Column) -> Column:
        return X.let(most_frequent(w), lambda top: (top / F.greatest(F.size(w), F.lit(1)) >= 0.4) | ((top >= 20) & (F.size(w) > 40)))

    return X.let(joined, lambda j: (F.length(j) >= 80) & X.let(words(j), repeats))


def cleaned(books: DataFrame) -> DataFrame:
    """books(book_id, text) -> the same with cleaned text: noisy paragraphs and lines and captions go, repeats are collapsed, a blank line follows each paragraph."""
    paragraphs = F.filter(F.transform(F.split("text", r"\n[ \t\r]*(?:\n[ \t\r]*)+"), lambda p: F.filter(F.split(p, "\n"), lambda x: F.trim(x) != "")), lambda p: F.size(p) > 0)
    kept = F.transform(F.filter(paragraphs, lambda p: ~noisy_paragraph(p)), lambda p: F.transform(F.filter(p, lambda x: ~noisy_line(x) & ~caption_line(x)), lambda x: dedup_sentences(collapse_repeats(x))))
    return books.withColumn("text", F.array_join(F.transform(kept, lambda p: F.array_join(F.concat(p, F.array(F.lit(""))), "\n")), "\n"))


def sections(books: DataFrame) -> DataFrame:
    """books(book_id, text) -> (book_id, n, id, header_path, chunk_type, text): one row for each non-empty section under a heading of level 2 to 4.

    Lines get their section by a running count of headings in the book; each level's heading is carried forward and dropped when a shallower
    one appears. What stands before the first heading is skipped, and sections are numbered after empty ones are gone.
    """
    lines = books.select("book_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    order = Window.partitionBy("book_id").orderBy("pos")
    level = F.when(F.col("line").rlike(r"^#{2,4}\s+"), F.length(F.regexp_extract("line", r"^(#{2,4})\s", 1)))
    lines = lines.withColumn("level", level).withColumn("head", F.when(F.col("level").isNotNull(), F.trim(F.regexp_extract("line", r"^#{2,4}\s+(.*)", 1))))
    lines = lines.withColumn("section", F.count("level").over(order))
    heads = lines.filter("level is not null").select("book_id", "section", "level", "head")
    along = Window.partitionBy("book_id").orderBy("section")

    def at(k: int) -> Column:
        """The heading in force at level k, with its section."""
        return F.last(F.when(F.col("level") == k, F.struct("section", "head")), ignorenulls=True).over(along)

    heads = heads.withColumns({"h2": at(2), "h3": at(3), "h4": at(4)})
    # a deeper heading holds only if it is not older than the shallower ones
    last2, last3 = F.coalesce("h2.section", F.lit(0)), F.greatest(F.coalesce("h2.section", F.lit(0)), F.coalesce("h3.section", F.lit(0)))
    three = F.when(F.col("h3.section") >= last2, F.col("h3.head"))
    four = F.when(F.col("h4.section") >= last3, F.col("h4.head"))
    parts = F.array(F.coalesce("h2.head", F.lit("")), F.coalesce(three, F.lit("")), F.coalesce(four, F.lit("")))
    path = F.array_join(F.slice(parts, F.lit(1), F.col("level") - 1), " > ")
    heads = heads.select("book_id", "section", "head", path.alias("header_path"))
    bodies = lines.filter("section > 0 and level is null").groupBy("book_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    body = F.regexp_replace("body", r"^\s+|\s+$", "")
    found = heads.join(bodies, ["book_id", "section"]).withColumn("text", body).filter("text <> ''")
    found = found.withColumn("n", F.row_number().over(along) - 1)
    return found.select("book_id", "n", F.format_string("%s::chunk_%05d", "book_id", "n").alias("id"), "header_path", chunk_type(F.col("head"), F.col("text")).alias("chunk_type"), "text")


def excluded(kind: Column, header: Column) -> Column:
    return kind.isin(*EXCLUDED_TYPES) | X.contains_any(F.lower(header), EXCLUDED_HEADERS)


def book_subject(book: Column) -> Column:
    return X.first_of(*((F.contains(F.lower(book), F.lit(k)), F.lit(s)) for k, s in BOOK_SUBJECTS), otherwise=F.lit("os"))


def text_subject(tag: Column, header: Column, text: Column) -> Column:
    h, t = F.lower(header), F.lower(F.substring(text, 1, 500))
    return X.first_of((F.coalesce(tag, F.lit("")) != "", tag), (X.contains_any(h, DBMS_TERMS) | X.contains_any(t, DBMS_TERMS), F.lit("dbms")), (X.contains_any(h, CN_TERMS) | X.contains_any(t, CN_TERMS), F.lit("cn")), otherwise=F.lit("os"))


def potential_questions(header: Column, kind: Column, key_terms: Column) -> Column:
    """At most three question templates for a chunk's concept; without a concept, one about its two leading terms."""
    c = X.main_concept(header)
    said = lambda *forms: F.array(*(F.replace(F.lit(f), F.lit("{}"), c) for f in forms))
    by_kind = X.first_of(
        (kind == "definition", said("Why is {} important in real systems?", "What trade-offs are involved in {}?")),
        (kind == "algorithm", said("How does {} work?", "What are the key steps and edge cases in {}?")),
        (kind == "protocol", said("How does the {} protocol work end-to-end?", "What design trade-offs does the {} protocol make?")),
        otherwise=said("Explain how {} behaves in practice."),
    )
    terms = F.concat(F.lit("Explain "), F.array_join(F.slice(key_terms, 1, 2), " "), F.lit("."))
    none = F.array().cast("array<string>")
    return F.slice(F.array_distinct(X.first_of((c != "", by_kind), (F.coalesce(F.size(key_terms), F.lit(0)) > 0, F.array(terms)), otherwise=none)), 1, 3)


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns as one compact JSON object with sorted keys; nulls are kept apart from empty strings."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def remapped(keys: DataFrame, rules: list[tuple[str, tuple[str, ...]]], key: str = "topic_key", text: str | None = None) -> DataFrame:
    """Rules (to, patterns) in turn: a row whose current key is like one of a rule's patterns, and is not the rule's key, gets the rule's key. Later rules see what earlier ones wrote.

    A pattern is `head%word%`: the key begins with head (it may be empty) and holds the word behind it; other wildcards are refused. With text, a key or text
    that holds it in any case counts. The rules are one literal that an aggregate folds over, so the plan does not grow with them, and rows are not shuffled.
    """
    table = []
    for to, patterns in rules:
        found = []
        for p in patterns:
            head, _, word = p.partition("%")
            if not word.endswith("%") or "%" in word[:-1] or "_" in p:
                raise ValueError(f"not of the form head%word%: {p}")
            found.append(F.struct(F.lit(head).alias("head"), F.lit(word[:-1]).alias("word")))
        table.append(F.struct(F.lit(to).alias("to"), F.array(*found).alias("found")))
    if not table:
        return keys
    low = (lambda c: F.lower(F.coalesce(c, F.lit("")))) if text else (lambda c: F.coalesce(c, F.lit("")))

    def one(current: Column, rule: Column) -> Column:
        own = low(current)
        like = lambda v: lambda p: F.startswith(v, p["head"]) & F.contains(F.substr(v, F.length(p["head"]) + 1), p["word"])
        hit = F.exists(rule["found"], like(own))
        if text:
            hit = hit | F.exists(rule["found"], like(low(F.col(text))))
        return F.when(hit & ~current.eqNullSafe(rule["to"]), rule["to"]).otherwise(current)

    return keys.withColumn(key, F.aggregate(F.array(*table), F.col(key), one))
