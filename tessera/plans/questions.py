"""Question-set queries: benchmark texts and parts as questions, labels as review decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import text as X
from ..operators import questions as O
from ..operators import retrieval as R
from ..sources import relations as S
from ..sources.shared import written
from .registry import query
from .retrieval import KEY_TERMS_SQL


def _any(col, words):
    return "(" + " or ".join(f"contains({col}, '{w}')" for w in words) + ")"


POTENTIAL_SQL = f"""{S.CHUNKS_SQL}, {KEY_TERMS_SQL}, po as (select c.id, book_id, header_path, lower(header_path) h, lower(substr(text, 1, 1200)) t, length(text) n, chunk_type, coalesce(len(key_terms), 0) nt, c.id % 3 nq from chunks c left join kt on kt.id = c.id),
  ps as (select id, book_id || '::' || lower(trim(split_part(header_path, '>', 1))) as key, greatest(0.0::double, round(case when chunk_type in ('algorithm', 'protocol') then 1.0::double when chunk_type = 'section' then 0.9::double when chunk_type = 'definition' then 0.65::double when chunk_type in ('theorem', 'example') then 0.6::double else 0.5::double end
    + case when n < 150 then -0.3::double when n < 400 then -0.1::double when n <= 1800 then 0.2::double when n > 2600 then -0.1::double else 0.0::double end + case when nt >= 4 then 0.1::double else 0 end + case when nt >= 8 then 0.05::double else 0 end
    + case when nq > 0 then 0.3::double else 0 end + case when nq > 1 then 0.05::double else 0 end + case when {_any('h', O.SHALLOW_HEADERS)} then -0.2::double else 0 end + case when {_any('h', O.DEPTH_TERMS)} or {_any('t', O.DEPTH_TERMS)} then 0.15::double else 0 end, 6)) score from po)"""


def _potential(spark, sf):
    """Of the key terms the score takes their number alone: the distinct tokens, eight at most. So no chunk is joined or grouped."""
    terms = F.least(F.size(F.array_distinct(X.tokens(F.col("text")))), F.lit(8))
    score = O.chunk_potential(F.col("chunk_type"), F.col("header_path"), F.col("text"), terms, F.col("id") % 3)
    return S.chunks(spark, sf).select("id", O.diversity_key(F.col("book_id"), F.col("header_path")).alias("key"), score.alias("score"))


@query("H8_chunk_potential", f"with {POTENTIAL_SQL} select id, score from ps")
def _(spark, sf):
    return _potential(spark, sf).select("id", "score")


@query("O13_diversity_key", f"with {POTENTIAL_SQL} select key, count(*) n from ps group by key")
def _(spark, sf):
    return _potential(spark, sf).groupBy("key").agg(F.count("*").alias("n"))


@query("E3_round_robin_selection", f"""with {POTENTIAL_SQL}, g as (select key, row_number() over (order by max(score) desc, key) g from ps group by key), t as (select id, key, row_number() over (partition by key order by score desc, id) turn from ps)
  select id, key, row_number() over (order by turn, g)::int as position from t join g using (key) qualify row_number() over (order by turn, g) <= 150""")
def _(spark, sf):
    return O.round_robin(_potential(spark, sf), 150)


QUESTIONS_SQL = """q0 as (select p_partkey::bigint id, p_name || case when p_partkey % 3 = 0 then ' explain this in detail' when p_partkey % 7 = 0 then ' generate a question' else '' end query, repeat(p_brand || ' ' || p_type || '. ', (p_partkey % 80)::int) answer,
  case when p_partkey % 9 = 0 then 'odd' else (['definition', 'procedural', 'comparative', 'factual'])[p_partkey % 4 + 1] end question_type, case when p_partkey % 10 = 3 then null else (['easy', 'medium', 'hard'])[p_size % 3 + 1] end difficulty,
  list_transform(range(1, (p_partkey % 9)::int + 1), lambda i: case when i = 8 then 'abc' else p_name || ' ' || i end) atomic_facts, case when p_partkey % 6 = 0 then 'n/a' else (40 + p_partkey % 60)::varchar end llm_interview_score,
  case when p_partkey % 8 = 0 then (p_partkey % 100)::varchar end quality_score, (['keep', 'Rewrite ', 'reject', 'keep', ''])[p_partkey % 5 + 1] llm_review_decision from part)"""


def _questions(spark, sf, deal: bool = False):
    """Parts as generated questions, with faults of every kind. deal: parts, short rows of few files, are written as many files before questions are made of them (Spark moves filters ahead of a mere exchange)."""
    k = F.col("p_partkey").cast("long")
    pick = lambda xs, i: F.element_at(F.array(*(F.lit(x) for x in xs)), (i + 1).cast("int"))
    parts = S.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return (written(parts.repartition(4 * spark.sparkContext.defaultParallelism)) if deal else parts).select(
        k.alias("id"),
        F.concat("p_name", F.when(k % 3 == 0, F.lit(" explain this in detail")).when(k % 7 == 0, F.lit(" generate a question")).otherwise(F.lit(""))).alias("query"),
        F.repeat(F.concat("p_brand", F.lit(" "), "p_type", F.lit(". ")), (k % 80).cast("int")).alias("answer"),
        F.when(k % 9 == 0, F.lit("odd")).otherwise(pick(O.TYPES, k % 4)).alias("question_type"),
        F.when(k % 10 == 3, F.lit(None)).otherwise(pick(O.DIFFICULTIES, F.col("p_size") % 3)).alias("difficulty"),
        F.when(k % 9 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (k % 9).cast("int"))), lambda i: F.when(i == 8, F.lit("abc")).otherwise(F.concat_ws(" ", "p_name", i.cast("string"))))).alias("atomic_facts"),
        F.when(k % 6 == 0, F.lit("n/a")).otherwise((40 + k % 60).cast("string")).alias("llm_interview_score"),
        F.when(k % 8 == 0, (k % 100).cast("string")).alias("quality_score"),
        pick(("keep", "Rewrite ", "reject", "keep", ""), k % 5).alias("llm_review_decision"),
    )


STRUCTURAL_SQL = f"""{QUESTIONS_SQL}, q1 as (select *, trim(coalesce(query, '')) qq, trim(coalesce(answer, '')) aa, lower(trim(coalesce(question_type, ''))) qt, lower(trim(coalesce(difficulty, ''))) df, list_filter(list_transform(atomic_facts, lambda f: trim(f)), lambda f: f <> '') fs from q0),
  q2 as (select *, case when qq = '' or aa = '' then 0 else greatest(0, least(100, 100 - case when qt not in ('definition', 'procedural', 'comparative', 'factual') then 30 else 0 end - case when df not in ('easy', 'medium', 'hard') then 20 else 0 end
    - case when length(qq) < 12 then 35 when length(qq) < 20 then 20 when length(qq) > 280 then 10 else 0 end - case when length(aa) < 50 then 35 when length(aa) < 90 then 15 when length(aa) > 1400 then 15 else 0 end
    - case when len(fs) < 2 then 20 when len(fs) > 6 then 6 else 0 end - case when len(list_filter(fs, lambda f: length(f) < 5)) > 0 then 8 else 0 end - case when starts_with(lower(qq), 'generate ') or contains(lower(qq), 'return only json') then 30 else 0 end)) end structural from q1)"""


@query("H9_structural_quality", f"with {STRUCTURAL_SQL} select id, structural from q2")
def _(spark, sf):
    return O.structural_quality(_questions(spark, sf)).select("id", "structural")


VALID_SQL = f"""{STRUCTURAL_SQL}, q3 as (select *, coalesce(try_cast(quality_score as int), try_cast(llm_interview_score as int)) eff, lower(trim(coalesce(llm_review_decision, ''))) dec from q2),
  q4 as (select id, query, (coalesce(query, '') = '')::int + (coalesce(answer, '') = '')::int + (coalesce(question_type, '') = '')::int + (coalesce(difficulty, '') = '')::int + (coalesce(question_type, '') not in ('definition', 'procedural', 'comparative', 'factual'))::int
    + (coalesce(difficulty, '') not in ('easy', 'medium', 'hard'))::int + (length(answer) < 50)::int + (length(answer) > 1000)::int + (length(query) < 10)::int + contains(lower(query), 'generate')::int + (len(atomic_facts) < 2)::int + (structural < 55)::int
    + (eff is null)::int + (dec not in ('keep', 'rewrite', 'reject'))::int + coalesce(eff < 70, false)::int + (dec = 'reject')::int errors from q3)"""


@query("H10_validate_questions", f"with {VALID_SQL} select id, errors, errors = 0 valid from q4")
def _(spark, sf):
    return O.validated(_questions(spark, sf)).select("id", F.size("errors").alias("errors"), (F.size("errors") == 0).alias("valid"))


@query("I19_dataset_validation", f"with {VALID_SQL} select errors, count(*) n from q4 group by errors")
def _(spark, sf):
    return O.validated(_questions(spark, sf)).groupBy(F.size("errors").alias("errors")).agg(F.count("*").alias("n"))


WORDS_SQL = "list_distinct(list_filter(regexp_split_to_array(lower(trim({})), '\\s+'), lambda w: w <> ''))"
PAIRS_SQL = f"""b0 as (select item_id id, coalesce(text, '') query from benchmark),
  bq as (select * from b0 union all select id + (select coalesce(max(id), 0) + 1 from b0), case id % 4 when 0 then query when 1 then query || ' now' else regexp_replace(query, '\\s*\\S+\\s*$', '') end from b0 where id % 4 < 3),
  ws as (select id, lower(trim(query)) t, {WORDS_SQL.format('query')} w from bq), prs as (select x.id a, y.id b, x.t ta, y.t tb from ws x join ws y on x.id < y.id where x.t = y.t or (len(x.w) > 0 and len(y.w) > 0 and len(list_intersect(x.w, y.w))::double / len(list_distinct(list_concat(x.w, y.w))) > 0.8))"""


def _whole_questions(spark, sf):
    """Every whole benchmark text, and after it three of four again: as it is, with one more word, or without its last word."""
    q = S.queries(spark, sf).select(F.col("query_id").alias("id"), "query")
    k, shorter = F.col("id") % 4, F.regexp_replace("query", r"\s*\S+\s*$", "")
    varied = F.when(k == 0, F.col("query")).when(k == 1, F.concat("query", F.lit(" now"))).otherwise(shorter)
    offset = q.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("after"))
    return q.unionByName(q.filter(k < 3).crossJoin(offset).select((F.col("id") + F.col("after")).alias("id"), varied.alias("query")))


JACCARD_SQL = f"with {PAIRS_SQL}, first_ as (select t, min(id) id from ws group by t) select a, b from prs where ta <> tb or a = (select id from first_ where t = tb)"


@query("O14_whole_texts", JACCARD_SQL)
@query("O14_jaccard_pairs", JACCARD_SQL)
def _(spark, sf):
    return O.similar_pairs(_whole_questions(spark, sf))


GREEDY_SQL = f"""with recursive {PAIRS_SQL}, o as (select id, row_number() over (order by id) n from bq), near as (select b, list(a) earlier from prs group by b),
  p as (select n, id, coalesce(earlier, []) earlier from o left join near on b = id),
  g as (select 0::bigint n, []::bigint[] kept union all select p.n, case when list_has_any(g.kept, p.earlier) then g.kept else list_append(g.kept, p.id) end from g join p on p.n = g.n + 1)
  select unnest(kept) id from g where n = (select count(*) from bq)"""


@query("H11_whole_texts", GREEDY_SQL)
@query("H11_greedy_dedup", GREEDY_SQL)
def _(spark, sf):
    return O.greedy_dedup(_whole_questions(spark, sf)).select("id")


@query("H12_validate_filter_dedup", f"""with {VALID_SQL}, v as (select id, lower(trim(query)) t from q4 where errors = 0) select count(*) valid, count(distinct t) unique_texts from v""")
def _(spark, sf):
    v = O.validated(_questions(spark, sf)).filter("size(errors) = 0").select("id", F.lower(F.trim("query")).alias("t"))
    return v.groupBy("t").agg(F.count("*").alias("n")).agg(F.sum("n").alias("valid"), F.count("*").alias("unique_texts"))


@query("H12_kept_questions")
def _(spark, sf):
    """The whole of H12: valid questions, each linked to its three best chunks, without near-duplicates of kept ones."""
    valid = O.validated(_questions(spark, sf, deal=True)).filter("size(errors) = 0")
    q = written(valid.select("id", "query", F.when(F.col("id") % 4 != 0, (F.col("id") * 2).cast("string")).alias("source_chunk_id")))  # validated once
    hits = R.bm25(S.chunks(spark, sf), q.select(F.col("id").alias("query_id"), "query"), 3).select(F.col("query_id").alias("id"), "rank", F.col("id").cast("string").alias("chunk_id"))
    return O.greedy_dedup(q.select("id", "query")).select("id").join(O.auto_linked(q, hits), "id").select("id", F.array_join("linked", ",").alias("linked"))


@query("H14_final_score", f"with {STRUCTURAL_SQL} select id, round_even(0.9::double * least(100, greatest(0, coalesce(try_cast(llm_interview_score as int), 0))) + 0.1::double * structural, 0)::int score from q2")
def _(spark, sf):
    llm = F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(F.col("llm_interview_score").try_cast("int"), F.lit(0))))
    return O.structural_quality(_questions(spark, sf)).select("id", F.bround(0.9 * llm + 0.1 * F.col("structural"), 0).cast("int").alias("score"))


@query("H15_mode_scores", f"with {STRUCTURAL_SQL}, p as (select id, structural s, coalesce(try_cast(llm_interview_score as int), 0) l, (id % 101)::int p, id % 3 m from q2) select id, (case m when 0 then l when 1 then round_even(0.35::double * p + 0.65::double * l, 0) else round_even(0.4::double * p + 0.6::double * s, 0) end)::int score from p")
def _(spark, sf):
    q = O.structural_quality(_questions(spark, sf))
    llm, p, m = F.coalesce(F.col("llm_interview_score").try_cast("int"), F.lit(0)), (F.col("id") % 101).cast("int"), F.col("id") % 3
    score = F.when(m == 0, llm.cast("double")).when(m == 1, F.bround(0.35 * p + 0.65 * llm, 0)).otherwise(F.bround(0.4 * p + 0.6 * F.col("structural"), 0))
    return q.select("id", score.cast("int").alias("score"))


@query("H16_review_merge", "select d.doc_id id, case when l.doc_id is null then 'reject' when toxic = 1 then 'reject' when quality = 1 then 'keep' else 'rewrite' end decision, coalesce(least(100, quality * 120 + 10), 0)::int score from documents d left join (select doc_id, min(quality) quality, max(toxic) toxic from labels group by doc_id) l on l.doc_id = d.doc_id")
def _(spark, sf):
    reviews = S.table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"), F.lit(True).alias("known"))
    rows = S.table(spark, sf, "documents").select("doc_id").join(reviews, "doc_id", "left")
    decision = F.when(F.col("known").isNull() | (F.col("toxic") == 1), F.lit("reject")).when(F.col("quality") == 1, F.lit("keep")).otherwise(F.lit("rewrite"))
    return rows.select(F.col("doc_id").alias("id"), decision.alias("decision"), F.coalesce(F.least(F.lit(100), F.col("quality") * 120 + 10), F.lit(0)).cast("int").alias("score"))


@query("B16_keep_rule", f"with {VALID_SQL} select id from q3 where dec in ('keep', 'rewrite') and eff >= 70")
def _(spark, sf):
    q = _questions(spark, sf)
    effective = F.coalesce(F.col("quality_score").try_cast("int"), F.col("llm_interview_score").try_cast("int"))
    return q.filter(F.lower(F.trim("llm_review_decision")).isin("keep", "rewrite") & (effective >= 70)).select("id")


@query("B15_missing_fields", f"with {QUESTIONS_SQL} select count(*) filter (coalesce(trim(query), '') = '') query, count(*) filter (coalesce(trim(answer), '') = '') answer, count(*) filter (difficulty is null) difficulty, count(*) filter (len(atomic_facts) = 0) atomic_facts from q0")
def _(spark, sf):
    blank = lambda c: F.count_if(F.coalesce(F.trim(c), F.lit("")) == "").alias(c)
    return _questions(spark, sf).agg(blank("query"), blank("answer"), F.count_if(F.col("difficulty").isNull()).alias("difficulty"), F.count_if(F.size("atomic_facts") == 0).alias("atomic_facts"))


@query("D6_frequency_tables", f"with {QUESTIONS_SQL} select question_type, coalesce(difficulty, 'none') difficulty, count(*) n, round(count(*) * 100.0::double / sum(count(*)) over (), 6) percent from q0 group by all")
def _(spark, sf):
    g = _questions(spark, sf).groupBy("question_type", F.coalesce("difficulty", F.lit("none")).alias("difficulty")).agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 6))  # one row for each kind


@query("D7_dataset_summary", f"with {QUESTIONS_SQL} select question_type, count(*) n, count(*) filter (len(atomic_facts) > 0) linked from q0 group by question_type")
def _(spark, sf):
    return _questions(spark, sf).groupBy("question_type").agg(F.count("*").alias("n"), F.count_if(F.size("atomic_facts") > 0).alias("linked"))


@query("H17_batch_packing", """with recursive d as (select source part, doc_id id, length(coalesce(text, '')) + 96 c, row_number() over (partition by source order by doc_id) n from documents),
  f as (select part, id, c, n, 0::int batch, 1 k, c::bigint total from d where n = 1 union all select d.part, d.id, d.c, d.n, case when f.k >= 20 or f.total + d.c > 24000 then f.batch + 1 else f.batch end, case when f.k >= 20 or f.total + d.c > 24000 then 1 else f.k + 1 end, case when f.k >= 20 or f.total + d.c > 24000 then d.c else f.total + d.c end
  from f join d on d.part = f.part and d.n = f.n + 1) select part, id, batch from f""")
def _(spark, sf):
    d = S.table(spark, sf, "documents").select(F.col("source").alias("part"), F.col("doc_id").alias("id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))
    return O.batches(d)


GRADES_SQL = """g as (select event_id id, case when event_id % 17 = 0 then 'not json' else '```json' || chr(10) || '{"score_0_5": ' || (floor(value)::bigint % 8 - 1) || ', "verdict": "' || (['Correct', 'partially correct', 'incorrect', ''])[event_id % 4 + 1] || '"}' || chr(10) || '```' end raw from events)"""


@query("H18_grade_normalisation", f"""with {GRADES_SQL}, j as (select id, raw, try_cast(json_extract_string(try_cast(regexp_extract(raw, '\\{{.*\\}}', 0) as json), '$.score_0_5') as int) s, lower(json_extract_string(try_cast(regexp_extract(raw, '\\{{.*\\}}', 0) as json), '$.verdict')) v from g)
  select id, case when s is null then -1 else least(5, greatest(0, s)) end score, case when s is null then 'grading_error' when contains(v, 'partial') then 'partial' when contains(v, 'incorrect') or contains(v, 'wrong') then 'incorrect' when contains(v, 'correct') then 'correct' when least(5, s) >= 5 then 'correct' when s >= 3 then 'partial' else 'incorrect' end verdict from j""")
def _(spark, sf):
    e = S.table(spark, sf, "events")
    pick = F.element_at(F.array(*map(F.lit, ("Correct", "partially correct", "incorrect", ""))), (F.col("event_id") % 4 + 1).cast("int"))
    body = F.concat(F.lit('```json\n{"score_0_5": '), (F.floor("value") % 8 - 1).cast("string"), F.lit(', "verdict": "'), pick, F.lit('"}\n```'))
    raw = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 17 == 0, F.lit("not json")).otherwise(body).alias("raw"))
    return graded(raw).select("id", "score", "verdict")


def graded(raw):
    """raw(id, raw) -> score 0 to 5 (-1 if the answer cannot be read), verdict, should_remediate."""
    j = F.from_json(F.regexp_extract("raw", r"(?s)\{.*\}", 0), "score_0_5 int, verdict string", {"mode": "PERMISSIVE"})
    rows = raw.withColumn("j", j).withColumn("s", F.least(F.lit(5), F.greatest(F.lit(0), F.col("j.score_0_5")))).withColumn("ok", F.col("j.score_0_5").isNotNull())
    v = F.lower(F.coalesce("j.verdict", F.lit("")))
    verdict = X.first_of((~F.col("ok"), F.lit("grading_error")), (F.contains(v, F.lit("partial")), F.lit("partial")), (X.contains_any(v, ("incorrect", "wrong")), F.lit("incorrect")), (F.contains(v, F.lit("correct")), F.lit("correct")), (F.col("s") >= 5, F.lit("correct")), (F.col("s") >= 3, F.lit("partial")), otherwise=F.lit("incorrect"))
    rows = rows.select("id", F.when(F.col("ok"), F.col("s")).otherwise(F.lit(-1)).alias("score"), verdict.alias("verdict"))
    return rows.withColumn("should_remediate", F.col("verdict") != "correct")


@query("G17_json_from_text", f"with {GRADES_SQL} select id, try_cast(regexp_extract(raw, '\\{{.*\\}}', 0) as json) is not null and regexp_extract(raw, '\\{{.*\\}}', 0) <> '' ok from g")
def _(spark, sf):
    e = S.table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 17 == 0, F.lit("not json")).otherwise(F.concat(F.lit('```json\n{"a": '), F.floor("value").cast("string"), F.lit("}\n```")))
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return e.select(F.col("event_id").alias("id"), (F.try_parse_json(F.nullif(body, F.lit(""))).isNotNull()).alias("ok"))


@query("H20_variant_gate", f"with {STRUCTURAL_SQL} select id, (structural >= 50 and trim(query) <> '' and lower(trim(query)) <> 'small ring' and qt in ('definition', 'procedural', 'comparative', 'factual')) ok from q2")
def _(spark, sf):
    q = O.structural_quality(_questions(spark, sf))
    ok = (F.col("structural") >= 50) & (F.trim("query") != "") & (F.lower(F.trim("query")) != "small ring") & F.col("question_type").isin(*O.TYPES)
    return q.select("id", ok.alias("ok"))


@query("O15_safe_int", f"with {QUESTIONS_SQL} select id, coalesce(try_cast(llm_interview_score as int), 0) score, substr(answer, 1, 240) answer from q0")
def _(spark, sf):
    return _questions(spark, sf).select("id", F.coalesce(F.col("llm_interview_score").try_cast("int"), F.lit(0)).alias("score"), F.substring("answer", 1, 240).alias("answer"))


# -- understanding -------------------------------------------------------------------------------------------------
ASK = ("What is the {}?", "Define {}", "explain {} step by step", "how do {} and {} differ", "compare {} vs {}; also {}", "it {}", "thanks!", "", "advantages of {} over paging", "b+ tree {} virtual memory", "please explain {} ?", "tcp handshake {}")
ASK_SQL = "qs as (select query_id, (" + repr([a for a in ASK]).replace("{}", "~") + ")[1 + query_id % 12] f, w from (select item_id query_id, coalesce(nullif(regexp_extract(text, '[A-Za-z]{4,}'), ''), 'x') w from benchmark)), ask as (select query_id, replace(f, '~', w) q from qs)"


def _asked(spark, sf):
    b = S.table(spark, sf, "benchmark")
    w = F.coalesce(F.nullif(F.regexp_extract("text", "[A-Za-z]{4,}", 0), F.lit("")), F.lit("x"))
    form = F.element_at(F.array(*(F.lit(a.replace("{}", "~")) for a in ASK)), (F.col("item_id") % 12 + 1).cast("int"))
    return b.select(F.col("item_id").alias("query_id"), F.replace(form, F.lit("~"), w).alias("q"))


DEF_RE = [p.replace("(?i)", "(?i)") for p in Q.DEFINITIONS]
CONCEPT_SQL = "case " + " ".join(f"when regexp_matches(trim(q), '{p}') then regexp_extract(trim(q), '{p}', 1)" for p in DEF_RE) + " end"
ISDEF_SQL = "(" + " or ".join(f"regexp_matches(trim(q), '{p}')" for p in DEF_RE) + ")"
ISPROC_SQL = "(regexp_matches(lower(trim(q)), '^(how to |how do |how does |explain how )') or contains(lower(q), ' step by step') or contains(lower(q), 'steps to') or contains(lower(q), 'algorithm for') or contains(lower(q), 'procedure for'))"
ISCOMP_SQL = "(contains(lower(q), 'compare ') or contains(lower(q), ' vs ') or contains(lower(q), ' versus ') or contains(lower(q), 'difference between') or (contains(lower(q), 'advantages of') and contains(lower(q), 'over')))"


@query("J1_definition_concept", f"with {ASK_SQL} select query_id, {ISDEF_SQL} is_definition, nullif(trim(rtrim(trim({CONCEPT_SQL}), '?')), '') concept from ask")
def _(spark, sf):
    return _asked(spark, sf).select("query_id", Q.is_definition(F.col("q")).alias("is_definition"), Q.concept(F.col("q")).alias("concept"))


@query("J2_negative_signals", f"""with {ASK_SQL} select query_id, array_to_string(case when contains(lower(q), 'tcp') and contains(lower(q), 'handshake') then ['tls', 'record protocol', 'authentication protocol'] else [] end ||
  case when contains(lower(q), 'b+ tree') then ['r tree', 'generalized search trees'] else [] end || case when contains(lower(q), 'virtual memory') then ['virtual machines', 'virtual machine'] else [] end, ',') signals from ask""")
def _(spark, sf):
    return _asked(spark, sf).select("query_id", F.array_join(Q.negative_signals(F.col("q")), ",").alias("signals"))


@query("J3_procedural_comparative", f"with {ASK_SQL} select query_id, {ISPROC_SQL} is_procedural, {ISCOMP_SQL} is_comparative from ask")
def _(spark, sf):
    return _asked(spark, sf).select("query_id", Q.is_procedural(F.col("q")).alias("is_procedural"), Q.is_comparative(F.col("q")).alias("is_comparative"))


EXPAND_SQL = "array_to_string(list_filter([trim(q)" + "".join(f", case when contains(lower(q), '{p}') then '{m}' end" for p, m in Q.EXPANSIONS.items()) + "], lambda x: x is not null), ' ')"


@query("J4_query_rewrite", f"with {ASK_SQL} select query_id, {EXPAND_SQL} bm25_query, trim(regexp_replace(case when starts_with(lower(trim(q)), 'please explain ') then substr(trim(q), 16) when starts_with(lower(trim(q)), 'explain ') then substr(trim(q), 9) else trim(q) end, '[ ?]+$', '')) semantic_query from ask")
def _(spark, sf):
    return _asked(spark, sf).select("query_id", Q.keyword_query(F.col("q")).alias("bm25_query"), Q.semantic_query(F.col("q")).alias("semantic_query"))


@query("J5_needs_retrieval", f"with {ASK_SQL} select query_id, trim(q) <> '' and not regexp_matches(trim(q), '(?i)^(hi|hello|hey|thanks|thank you|bye|ok|yes|no)[\\s!?.]*$') needs from ask")
def _(spark, sf):
    return _asked(spark, sf).select("query_id", Q.needs_retrieval(F.col("q")).alias("needs"))


MULTI_SQL = "(" + " or ".join(f"contains(trim(q), '{m}')" for m in Q.MULTI_PART) + ")"


@query("J6_decomposition", f"""with {ASK_SQL}, p as (select query_id, q, [list_filter(list_transform(string_split(trim(q), ' and '), lambda x: trim(x)), lambda x: x <> ''), list_filter(list_transform(string_split(trim(q), ' also '), lambda x: trim(x)), lambda x: x <> ''), list_filter(list_transform(string_split(trim(q), ' then '), lambda x: trim(x)), lambda x: x <> ''),
  list_filter(list_transform(string_split(trim(q), '; '), lambda x: trim(x)), lambda x: x <> ''), list_filter(list_transform(string_split(trim(q), '? '), lambda x: trim(x)), lambda x: x <> '')] ps from ask)
  select query_id, case when {MULTI_SQL} then 'multi-part' else 'simple' end complexity, array_to_string(case when {MULTI_SQL} then coalesce(list_filter(ps, lambda x: len(x) >= 2)[1], [trim(q)]) else [trim(q)] end, '|') parts from p""")
def _(spark, sf):
    return _asked(spark, sf).select("query_id", Q.complexity(F.col("q")).alias("complexity"), F.array_join(Q.sub_queries(F.col("q")), "|").alias("parts"))


@query("J7_intent", f"with {ASK_SQL} select query_id, case when {ISDEF_SQL} then 'definition' when {ISCOMP_SQL} then 'comparison' when {ISPROC_SQL} then 'procedural' else 'factual' end intent from ask")
def _(spark, sf):
    return _asked(spark, sf).select("query_id", Q.intent(F.col("q")).alias("intent"))


@query("J8_entities")
def _(spark, sf):
    return _asked(spark, sf).select("query_id", F.array_join(Q.entities(F.col("q")), "|").alias("entities"))


@query("J9_follow_up", "select conv_id, turn, turn > 0 and regexp_matches(trim(coalesce(text, '')), '(?i)\\b(it|its|they|them|their|this|that|these|those|the same|above|previous)\\b') follow_up from conversations where role = 'user'")
def _(spark, sf):
    t = S.table(spark, sf, "conversations").filter("role = 'user'")
    return t.select("conv_id", "turn", Q.is_follow_up(F.coalesce("text", F.lit("")), F.col("turn") > 0).alias("follow_up"))
