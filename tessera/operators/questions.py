"""Question sets: structural quality, validation, scoring, review merge, greedy near-duplicate removal, batching, chunk choice."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, first_of, word_set
from ..sources.shared import written
from .graph import connected
from .order import numbered

TYPES = ("definition", "procedural", "comparative", "factual")
DIFFICULTIES = ("easy", "medium", "hard")
#: Words that speak for depth, headings that speak against it.
DEPTH_TERMS = ("trade-off", "throughput", "latency", "deadlock", "consistency", "isolation", "fault", "failure", "recovery", "congestion", "synchronization")
SHALLOW_HEADERS = ("introduction", "overview", "business applications", "history", "what is")


def chunk_potential(chunk_type: Column, header: Column, text: Column, n_terms: Column, n_questions: Column) -> Column:
    """How much a chunk promises as a source of questions; never negative."""
    low, n = F.lower(header), F.length(text)
    kind = first_of((chunk_type.isin("algorithm", "protocol"), F.lit(1.0)), (chunk_type == "section", F.lit(0.9)), (chunk_type == "definition", F.lit(0.65)), (chunk_type.isin("theorem", "example"), F.lit(0.6)), otherwise=F.lit(0.5))
    size = first_of((n < 150, F.lit(-0.3)), (n < 400, F.lit(-0.1)), (n <= 1800, F.lit(0.2)), (n > 2600, F.lit(-0.1)), otherwise=F.lit(0.0))
    add = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    deep = contains_any(low, DEPTH_TERMS) | contains_any(F.lower(F.substring(text, 1, 1200)), DEPTH_TERMS)
    total = kind + size + add(n_terms >= 4, 0.1) + add(n_terms >= 8, 0.05) + add(n_questions > 0, 0.3) + add(n_questions > 1, 0.05) + add(contains_any(low, SHALLOW_HEADERS), -0.2) + add(deep, 0.15)
    return F.greatest(F.lit(0.0), F.round(total, 6))


def diversity_key(book: Column, header: Column) -> Column:
    return F.concat(book, F.lit("::"), F.lower(F.trim(F.element_at(F.split(header, ">"), 1))))


def round_robin(scored: DataFrame, target: int) -> DataFrame:
    """scored(id, key, score): groups take turns, best group first, each giving its best remaining row, until `target` rows. Scores are computed once and written."""
    scored = written(scored.select("id", "key", "score"))
    best = scored.groupBy("key").agg(F.max("score").alias("best"))
    groups = best.withColumn("g", F.row_number().over(Window.orderBy(F.desc("best"), "key")))  # one row for each group
    turn = scored.withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))).filter(F.col("turn") <= target)
    rows = turn.join(groups.select("key", "g"), "key").orderBy("turn", "g").limit(target)
    return rows.withColumn("position", F.row_number().over(Window.orderBy("turn", "g"))).select("id", "key", "position")  # `target` rows


def structural_quality(q: DataFrame) -> DataFrame:
    """q with `structural` (0 to 100) and `reasons`: penalties on type, difficulty, lengths and facts."""
    query, answer = F.trim(F.coalesce("query", F.lit(""))), F.trim(F.coalesce("answer", F.lit("")))
    facts = F.filter(F.transform(F.coalesce("atomic_facts", F.array().cast("array<string>")), lambda f: F.trim(f)), lambda f: f != "")
    kind, level = F.lower(F.trim(F.coalesce("question_type", F.lit("")))), F.lower(F.trim(F.coalesce("difficulty", F.lit(""))))
    ql, al = F.length(query), F.length(answer)
    rules = [
        [(~kind.isin(*TYPES), 30, "invalid question_type")],
        [(~level.isin(*DIFFICULTIES), 20, "invalid difficulty")],
        [(ql < 12, 35, "query too short"), (ql < 20, 20, "query is terse"), (ql > 280, 10, "query too long")],
        [(al < 50, 35, "answer too short"), (al < 90, 15, "answer lacks detail"), (al > 1400, 15, "answer too long")],
        [(F.size(facts) < 2, 20, "needs at least 2 atomic_facts"), (F.size(facts) > 6, 6, "too many atomic_facts")],
        [(F.exists(facts, lambda f: F.length(f) < 5), 8, "atomic_facts too terse")],
        [(F.startswith(F.lower(query), F.lit("generate ")) | F.contains(F.lower(query), F.lit("return only json")), 30, "query appears to be an instruction, not a real question")],
    ]
    lost = sum(first_of(*((c, F.lit(n)) for c, n, _ in group), otherwise=F.lit(0)) for group in rules)
    why = F.filter(F.array(*(first_of(*((c, F.lit(r)) for c, _, r in group), otherwise=F.lit(None).cast("string")) for group in rules)), lambda r: r.isNotNull())
    gone = F.when(query == "", F.array(F.lit("missing query"))).when(answer == "", F.array(F.lit("missing answer")))
    return q.withColumn("structural", F.when(gone.isNotNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost)))).withColumn("reasons", F.coalesce(gone, why))


def validated(q: DataFrame, min_score: int = 70, require_llm: bool = True) -> DataFrame:
    """q with structural quality and `errors`; a question is valid if there are none. Scores are taken as columns."""
    q = structural_quality(q)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    effective = F.coalesce(F.col("quality_score").try_cast("int"), F.col("llm_interview_score").try_cast("int"))
    decision = F.lower(F.trim(text("llm_review_decision")))
    rules = [(text(c) == "", F.lit(f"Missing or empty '{c}'")) for c in ("query", "answer", "question_type", "difficulty")]
    rules += [
        (~text("question_type").isin(*TYPES), F.concat(F.lit("Invalid question_type: "), text("question_type"))),
        (~text("difficulty").isin(*DIFFICULTIES), F.concat(F.lit("Invalid difficulty: "), text("difficulty"))),
        (F.length(text("answer")) < 50, F.concat(F.lit("Answer too short ("), F.length(text("answer")).cast("string"), F.lit(" chars, min 50)"))),
        (F.length(text("answer")) > 1000, F.concat(F.lit("Answer too long ("), F.length(text("answer")).cast("string"), F.lit(" chars, max 1000)"))),
        (F.length(text("query")) < 10, F.concat(F.lit("Query too short ("), F.length(text("query")).cast("string"), F.lit(" chars)"))),
        (F.contains(F.lower(text("query")), F.lit("generate")), F.lit("Query appears to be a generation instruction, not a real question")),
        (F.coalesce(F.size("atomic_facts"), F.lit(0)) < 2, F.lit("Need at least 2 atomic_facts")),
        (F.col("structural") < 55, F.concat(F.lit("Structural quality too low ("), F.col("structural").cast("string"), F.lit(" < 55)"))),
        (F.lit(require_llm) & effective.isNull(), F.lit("Missing LLM score fields")),
        (F.lit(require_llm) & ~decision.isin("keep", "rewrite", "reject"), F.lit("Missing or invalid llm_review_decision")),
        (effective < min_score, F.concat(F.lit("Interview quality score too low ("), effective.cast("string"), F.lit(f" < {min_score})"))),
        (decision == "reject", F.lit("LLM reviewer decision is reject")),
    ]
    return q.withColumn("errors", F.filter(F.array(*(F.when(c, e) for c, e in rules)), lambda e: e.isNotNull()))


def similar_pairs(q: DataFrame, threshold: float = 0.8) -> DataFrame:
    """q(id, query) -> (a, b), a before b, whose word sets have a Jaccard likeness above threshold, or whose texts are equal.

    Exact: words are ordered by rarity, and two sets above the threshold share a word among their first n - ceil(threshold * n) + 1.
    Equal texts are folded into one before and linked to their first after, so a group of copies adds no pairs.
    """
    text = F.lower(F.trim("query"))
    rows = q.select("id", text.alias("t"))
    first = rows.groupBy("t").agg(F.min("id").alias("a"))
    sets = first.select("a", word_set(F.col("t")).alias("w")).filter("size(w) > 0")
    tokens = sets.select("a", F.explode("w").alias("tok"))
    rare = tokens.groupBy("tok").agg(F.count("*").alias("df"))
    ordered = tokens.join(rare, "tok").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("w"))
    n = F.size("w")
    heads = ordered.select("a", n.alias("n"), F.explode(F.slice(F.transform("w", lambda x: x["tok"]), F.lit(1), n - F.ceil(n * threshold).cast("int") + 1)).alias("tok"))
    left, right = heads.alias("l"), heads.alias("r")
    sized = (F.col("l.a") < F.col("r.a")) & (F.col("l.n") >= F.col("r.n") * threshold) & (F.col("r.n") >= F.col("l.n") * threshold)
    met = left.join(right, F.expr("l.tok = r.tok")).filter(sized).select(F.col("l.a").alias("a"), F.col("r.a").alias("b")).distinct()  # ids alone meet; the sets come afterwards
    both = met.join(sets, "a").join(sets.select(F.col("a").alias("b"), F.col("w").alias("v")), "b")
    common = F.size(F.array_intersect("w", "v"))
    near = both.filter(common / (F.size("w") + F.size("v") - common) > threshold).select("a", "b")
    copies = rows.join(first, "t").filter("id <> a").select("a", F.col("id").alias("b"))
    return near.unionByName(copies)


def greedy_dedup(q: DataFrame, threshold: float = 0.8, local: int = 1_000_000) -> DataFrame:
    """q(id, query) in order of id: a question goes if it is similar to one that is kept before it.

    All but the first of equal texts go: what keeps or removes the first removes them too. For the rest the pairs decide it: an id is kept if none of
    its earlier partners is, and goes if one of them is kept. Pairs are dealt by the connected component that they lie in, and a task settles its
    components one after another in order of id. A component of more than `local` pairs is settled by rounds of joins instead: each settles all ids whose
    earlier partners are settled, until none is open.
    """
    text = F.lower(F.trim("query"))
    rows = q.select("id", text.alias("t"))
    copies = rows.join(rows.groupBy("t").agg(F.min("id").alias("a")), "t").filter("id <> a").select("id")
    gone = written(copies)
    pairs = written(similar_pairs(q.join(gone, "id", "left_anti"), threshold))
    of = pairs.join(connected(pairs).select(F.col("node").alias("a"), "root"), "a")
    sizes = written(of.groupBy("root").agg(F.count("*").alias("n")))
    small = of.join(sizes.filter(F.col("n") <= local).select("root"), "root", "left_semi")

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, off = None, set()
        for frame in frames:
            out = []
            for root, a, b in zip(frame["root"], frame["a"], frame["b"], strict=True):
                if root != now:
                    now, off = root, set()
                if a not in off and b not in off:
                    off.add(b)
                    out.append(b)
            yield pd.DataFrame({"id": out}, dtype=frame["a"].dtype)

    parts = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    settled = small.select("root", "a", "b").repartition(parts, "root").sortWithinPartitions("root", "a", "b").mapInPandas(settle, gone.schema)
    gone = written(gone.unionByName(settled))
    pairs = written(of.join(sizes.filter(F.col("n") > local).select("root"), "root", "left_semi").select("a", "b"))
    while not pairs.isEmpty():
        kept = pairs.select("a").distinct().join(pairs.select(F.col("b").alias("a")), "a", "left_anti")
        new = written(pairs.join(kept, "a", "left_semi").select(F.col("b").alias("id")).distinct())
        gone = written(gone.unionByName(new))
        pairs = written(pairs.join(new.toDF("a"), "a", "left_anti").join(new.toDF("b"), "b", "left_anti").select("a", "b"))
    return q.join(gone, "id", "left_anti")


def batches(q: DataFrame, max_rows: int = 20, max_chars: int = 24000, group: str = "part", chunk: int = 512) -> DataFrame:
    """q(part, id, chars) -> (part, id, batch): rows in order of id fill batches up to a row count and a character count (96 more for each row).

    A part is cut into chunks of so many rows, which are packed for each place at which a batch may begin in them: one of the first max_rows.
    So a chunk is a function from where the first batch begins to where the first one of the next chunk does, and how many there were.
    Doubling puts these functions together, in as many rounds as the number of chunks has bits; then every chunk knows where to begin.
    """
    chunk, P = max(chunk, 2 * max_rows), [F.col(group).alias("_p")]
    rows = numbered(q.select(group, "id", "chars"), group, "id", "chars")
    packs = rows.groupBy(*P, F.floor(F.col("_n") / chunk).alias("c")).agg(F.array_sort(F.collect_list(F.struct("_n", "id", (F.col("chars") + 96).cast("long").alias("w")))).alias("r"))
    packs = written(packs.select("_p", "c", F.transform("r", lambda x: x["w"]).alias("w"), F.transform("r", lambda x: x["id"]).alias("ids")))
    start = "named_struct('k', 0L, 't', 0L, 'n', 0L)"
    full = f"s.k = 0 or s.k >= {max_rows} or s.t + x > {max_chars}"
    put = f"named_struct('k', if({full}, 1L, s.k + 1), 't', if({full}, x, s.t + x), 'n', if({full}, s.n + 1, s.n))"
    ends = packs.select("_p", "c", "w", F.explode(F.expr(f"sequence(0, least({max_rows}, size(w)) - 1)")).alias("e")).withColumn("s", F.expr(f"aggregate(slice(w, e + 1, size(w) - e), {start}, (s, x) -> {put})"))
    heads = packs.select(F.col("_p").alias("_p2"), (F.col("c") - 1).alias("c2"), F.slice("w", 1, max_rows).alias("h"))
    fits = f"s.open and s.k < {max_rows} and s.t + x <= {max_chars}"
    taken = F.expr(f"aggregate(h, named_struct('k', s.k, 't', s.t, 'a', 0, 'open', true), (s, x) -> named_struct('k', if({fits}, s.k + 1, s.k), 't', if({fits}, s.t + x, s.t), 'a', if({fits}, s.a + 1, s.a), 'open', {fits})).a")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    jump = written(ends.join(heads, same("_p", "_p2") & (F.col("c") == F.col("c2"))).select("_p", "c", "e", (F.col("c") + 1).alias("to_c"), taken.alias("to_e"), F.col("s.n").alias("n")))
    at = written(packs.filter("c = 0").select("_p", "c", F.lit(0).alias("e"), F.lit(0).cast("long").alias("base")))
    while True:
        step = jump.toDF(*(f"j_{c}" for c in jump.columns))
        new = written(at.join(step, same("_p", "j__p") & (F.col("c") == F.col("j_c")) & (F.col("e") == F.col("j_e"))).select("_p", F.col("j_to_c").alias("c"), F.col("j_to_e").alias("e"), (F.col("base") + F.col("j_n")).alias("base")))
        if new.isEmpty():
            break
        at = written(at.unionByName(new))
        far = jump.join(step, same("_p", "j__p") & (F.col("to_c") == F.col("j_c")) & (F.col("to_e") == F.col("j_e")))
        jump = written(far.select("_p", "c", "e", F.col("j_to_c").alias("to_c"), F.col("j_to_e").alias("to_e"), (F.col("n") + F.col("j_n")).alias("n")))
    begun = at.select(F.col("_p").alias("_p2"), F.col("c").alias("c2"), "e", "base")
    placed = packs.join(begun, same("_p", "_p2") & (F.col("c") == F.col("c2")))
    own = F.expr(f"aggregate(slice(w, e + 1, size(w) - e), named_struct('k', 0L, 't', 0L, 'n', 0L, 'out', cast(array() as array<bigint>)), (s, x) -> named_struct('k', if({full}, 1L, s.k + 1), 't', if({full}, x, s.t + x), 'n', if({full}, s.n + 1, s.n), 'out', array_append(s.out, if({full}, s.n, s.n - 1)))).out")
    found = F.concat(F.expr("array_repeat(base - 1, e)"), F.transform(own, lambda b: b + F.col("base")))
    return placed.select(F.col("_p").alias(group), F.explode(F.arrays_zip(F.col("ids").alias("id"), found.alias("batch"))).alias("x")).select(group, F.col("x.id").alias("id"), F.col("x.batch").cast("int").alias("batch"))


def auto_linked(q: DataFrame, hits: DataFrame, k: int = 3) -> DataFrame:
    """q(id, source_chunk_id), hits(id, rank, chunk_id) -> (id, linked): the k best chunks; the source goes first if it is not among them."""
    best = hits.filter(F.col("rank") <= k).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda h: h["chunk_id"]).alias("found"))
    rows = q.join(best, "id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    own = F.when(F.col("source_chunk_id").isNotNull() & ~F.array_contains("found", F.col("source_chunk_id")), F.array("source_chunk_id")).otherwise(F.array().cast("array<string>"))
    return rows.select("id", F.slice(F.concat(own, "found"), 1, k).alias("linked"))


def selected_chunks(chosen: DataFrame, hits: DataFrame) -> DataFrame:
    """chosen(id, selection), hits(id, rank, chunk_id) -> (id, linked): what a comma-separated selection names, in its order: numbers are ranks of the question's hits, other names are ids.

    Ranks that the question's hits do not have are left out; a question without any keeps an empty list."""
    named = chosen.select("id", F.posexplode(F.transform(F.split("selection", ","), lambda x: F.trim(x))).alias("pos", "name"))
    rank = F.when(F.col("name").rlike("^[0-9]+$"), F.col("name").try_cast("int"))
    number = F.col("name").rlike("^[0-9]+$")
    found = named.withColumn("rank", rank).join(hits.select("id", "rank", "chunk_id"), ["id", "rank"], "left").filter(~number | F.col("chunk_id").isNotNull())
    lists = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("chunk_id", "name").alias("c")))).alias("l"))
    return chosen.select("id").join(lists, "id", "left").select("id", F.coalesce(F.transform("l", lambda x: x["c"]), F.array().cast("array<string>")).alias("linked"))
