"""Queries around models, whose outputs are columns here: prompts out, responses in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import RetrievalConfig, violations
from ..operators import questions as O
from ..operators import retrieval as R
from ..operators.postings_index import PostingsIndex
from ..operators.vector_index import VectorIndex
from ..sources import relations as S
from ..sources.shared import folder, written
from .registry import query
from .retrieval import BM25_SQL, RANK_SQL, VEC_SQL, _answers, _bm25, _document_vectors, _vectors


@query("H13_auto_link", f"with {BM25_SQL}, r as (select *, {RANK_SQL} as rank from bm), l as (select query_id, list(id::varchar order by rank) f from r where rank <= 3 group by query_id) select item_id id, array_to_string(((case when item_id % 4 <> 0 and not list_contains(coalesce(f, []), (item_id * 2)::varchar) then [(item_id * 2)::varchar] else [] end) || coalesce(f, []))[1:3], ',') linked from benchmark left join l on l.query_id = item_id")
def _(spark, sf):
    q = S.queries(spark, sf).select(F.col("query_id").alias("id"), F.when(F.col("query_id") % 4 != 0, (F.col("query_id") * 2).cast("string")).alias("source_chunk_id"))
    hits = _bm25(spark, sf, 3).select(F.col("query_id").alias("id"), "rank", F.col("id").cast("string").alias("chunk_id"))
    return O.auto_linked(q, hits).select("id", F.array_join("linked", ",").alias("linked"))


@query("I11_iterative_widening")
def _(spark, sf):
    hits = written(_bm25(spark, sf, 15).join(S.chunks(spark, sf), "id"))  # one search for the answers and every round
    return R.widened(hits, written(_answers(hits).select("query_id", "answer")), max_tokens=800)


@query(
    "I12_hypothetical_answer",
    """with size_ as (select count(*) n from embeddings), dv as (select doc_id id, e.embedding v from documents, size_ join embeddings e on e.vec_id = doc_id % n),
    qv as (select item_id query_id, item_id % 3 = 0 hypothetical, e.embedding q from benchmark, size_ join embeddings e on e.vec_id = (item_id + case when item_id % 3 = 0 then 7 else 0 end) % n),
    ds as (select query_id, id, hypothetical, round(list_sum(list_transform(list_zip(v, q), lambda z: z[1]::double * z[2]::double)) / sqrt(list_sum(list_transform(v, lambda x: x::double * x::double)) * list_sum(list_transform(q, lambda x: x::double * x::double))), 6) score from dv, qv),
    r as (select *, row_number() over (partition by query_id order by score desc, id)::int as rank from ds) select query_id, rank, id, score, hypothetical from r where rank <= 5""",
)
def _(spark, sf):
    """The dense ranking by the vector of the hypothetical answer where a model gave one (every third query), and by the query's own elsewhere."""
    rows, asked, n = _document_vectors(spark, sf)
    given = F.when(F.col("query_id") % 3 == 0, F.col("query_id"))
    made = asked.select("query_id", F.pmod(F.coalesce(given + 7, F.col("query_id")), F.lit(n)).alias("_at"), given.isNotNull().alias("hypothetical"))
    vectors = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("_at"), F.col("embedding").alias("q"))
    hits = R.dense(rows, made.join(vectors, "_at").select("query_id", "q"), 5)
    return hits.join(made.select("query_id", "hypothetical"), "query_id").select("query_id", "rank", "id", "score", "hypothetical")


SEARCH_SQL = f"with {VEC_SQL}, r as (select *, {RANK_SQL} as rank from vq where score is not null) select query_id, rank::int as rank, id, score from r where rank <= 5"


@query("I20_search_all_vectors", SEARCH_SQL)
@query("I20_incremental_vector_search", SEARCH_SQL)
def _(spark, sf):
    """Exact search over the rows that have a vector at present; rows still to be filled, whose vector is null, take no part."""
    rows, asked = _vectors(spark, sf)
    return R.dense(rows.filter("v is not null"), asked.filter("q is not null"), 5).select("query_id", "rank", "id", "score")


@query("I20_inverted_file_search")
def _(spark, sf):
    """Approximate search: an index of 100 lists over all vectors, the 60 lists nearest to each query probed (the given vectors hardly cluster; README has recall by probes); what they hold is scored exactly. A third of the rows come as a later insert."""
    rows, asked = _vectors(spark, sf)
    rows, asked = rows.filter("v is not null"), asked.filter("q is not null")
    index = VectorIndex.build(rows.filter("id % 3 <> 0"), folder(spark, "vectors"))
    index.insert(rows.filter("id % 3 = 0"), 1)
    return index.search(asked, 5).select("query_id", "rank", "id", "score")


@query("J10_reformulated_query", "select conv_id, turn, case when turn % 4 = 2 and length('again ' || turn) > 5 then 'again ' || turn else text end query from conversations where role = 'user'")
def _(spark, sf):
    t = S.table(spark, sf, "conversations").filter("role = 'user'")
    said = F.when(F.col("turn") % 4 == 2, F.concat(F.lit("again "), F.col("turn").cast("string")))
    return t.select("conv_id", "turn", F.coalesce(F.when(F.length(F.trim(said)) > 5, F.trim(said)), F.col("text")).alias("query"))


@query("K5_token_frames", "select conv_id, turn, unnest(string_split(text, ' ')) token, generate_subscripts(string_split(text, ' '), 1)::int as position from conversations where role = 'assistant' and text is not null")
def _(spark, sf):
    t = S.table(spark, sf, "conversations").filter("role = 'assistant' and text is not null")
    return t.select("conv_id", "turn", F.posexplode(F.split("text", " ", -1)).alias("p", "token")).select("conv_id", "turn", "token", (F.col("p") + 1).alias("position"))


@query("O9_answer_prompt", f"with {BM25_SQL}, r as (select *, {RANK_SQL} as rank from bm) select item_id query_id, 'Answer from the numbered context only and cite it.' || chr(10) || 'Question: ' || coalesce(text, '') || chr(10) || 'Sources: ' || coalesce(s, '') prompt from benchmark left join (select query_id, string_agg('[' || rank || '] ' || id, ' ' order by rank) s from r where rank <= 3 group by query_id) x on x.query_id = item_id")
def _(spark, sf):
    hits = _bm25(spark, sf, 3).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda h: F.concat(F.lit("["), h["rank"].cast("string"), F.lit("] "), h["id"].cast("string"))), " ").alias("s"))
    q = S.queries(spark, sf).join(hits, "query_id", "left")
    return q.select("query_id", F.concat(F.lit("Answer from the numbered context only and cite it.\nQuestion: "), "query", F.lit("\nSources: "), F.coalesce("s", F.lit(""))).alias("prompt"))


@query("O10_grading_prompt", f"with {S.CARDS_SQL} select id, 'Grade from 0 to 5. Type: ' || question_type || chr(10) || 'Question: ' || question || chr(10) || 'Expected: ' || substr(answer, 1, 400) prompt from cards")
def _(spark, sf):
    return S.cards(spark, sf).select("id", F.concat(F.lit("Grade from 0 to 5. Type: "), "question_type", F.lit("\nQuestion: "), "question", F.lit("\nExpected: "), F.substring("answer", 1, 400)).alias("prompt"))


@query(
    "O5_ranking_choice",
    """with size_ as (select count(*) n from embeddings), d as (select doc_id id, lang, doc_id % 6 <> 0 or lang = 'en' stored from documents), c as (select lang, bool_and(stored) whole from d group by lang),
    dv as (select d.id, c.whole, e.embedding v from d join c on c.lang is not distinct from d.lang, size_ join embeddings e on e.vec_id = (d.id + case when c.whole then 0 else 1 end) % n),
    qv as (select item_id query_id, e.embedding q from benchmark, size_ join embeddings e on e.vec_id = item_id % n),
    ds as (select query_id, id, whole, round(list_sum(list_transform(list_zip(v, q), lambda z: z[1]::double * z[2]::double)) / sqrt(list_sum(list_transform(v, lambda x: x::double * x::double)) * list_sum(list_transform(q, lambda x: x::double * x::double))), 6) score from dv, qv),
    r as (select *, row_number() over (partition by query_id order by score desc, id)::int as rank from ds) select query_id, rank, id, score, case when whole then 'stored' else 'local' end ranking from r where rank <= 20""",
)
def _(spark, sf):
    """The dense ranking from stored vectors for languages whose chunks all have one, and from vectors that are made anew for the others."""
    rows, asked, n = _document_vectors(spark, sf)
    d = S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", ((F.col("doc_id") % 6 != 0) | F.coalesce(F.col("lang") == "en", F.lit(False))).alias("stored"))
    chosen = R.ranking_source(d.select("id", F.coalesce("lang", F.lit("")).alias("part"), "stored"))
    made = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("_at"), F.col("embedding").alias("v"))
    local = chosen.filter("ranking = 'local'").withColumn("_at", (F.col("id") + 1) % n).join(made, "_at").select("id", "v")
    kept = chosen.filter("ranking = 'stored'").select("id").join(rows, "id")
    hits = R.dense(kept.unionByName(local), asked, RetrievalConfig().depth)
    return hits.join(chosen.select("id", "ranking"), "id").select("query_id", "rank", "id", "score", "ranking")


@query("O5_kept_index", f"with {BM25_SQL}, r as (select *, {RANK_SQL} as rank from bm) select query_id, rank::int as rank, id, round(score, 6) score from r where rank <= 5")
def _(spark, sf):
    """A kept index after three batches of changes: some chunks come with another text first, some are taken away and come back. It ends with the whole corpus and scores as a new one would."""
    c = S.chunks(spark, sf).select("id", "text")
    other = F.when(F.col("id") % 5 == 0, F.concat(F.lit("formerly "), F.substring("text", 1, 200))).otherwise(F.col("text")).alias("text")
    index = PostingsIndex(spark, folder(spark, "postings"), buckets=16)
    index.apply(0, add=c.filter("id % 3 <> 0").select("id", other))
    index.apply(1, add=c.filter("id % 3 = 0 or id % 5 = 0"), remove=c.filter("id % 7 = 0 and id % 3 <> 0 and id % 5 <> 0").select("id"))
    for _ in range(2):
        index.apply(2, add=c.filter("id % 7 = 0"))
    return index.search(S.queries(spark, sf), 5).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(
    "O18_argument_limits",
    """select doc_id id, array_to_string(list_filter([case when coalesce(length(text) not between 1 and 2000, true) then 'query' end, case when doc_id % 23 not between 1 and 20 then 'top_k' end, case when doc_id % 104 not between 1 and 100 then 'limit' end,
      case when coalesce(length(text) > 4000, true) then 'user_answer' end, case when length(repeat(source, 8)) > 64 then 'conversation_id' end, case when length(repeat(lang, 17)) > 32 then 'action' end, case when doc_id % 9 - 1 < 0 then 'response_time_ms' end], lambda x: x is not null), ',') violations from documents""",
)
def _(spark, sf):
    """Every document as a request: which of its arguments lie outside the limits."""
    k = F.col("doc_id")
    found = violations(query=(F.col("text"), True), top_k=(k % 23, False), limit=(k % 104, False), user_answer=(F.col("text"), True), conversation_id=(F.repeat("source", F.lit(8)), True), action=(F.repeat("lang", F.lit(17)), True), response_time_ms=(k % 9 - 1, False))
    return S.table(spark, sf, "documents").select(k.alias("id"), F.array_join(found, ",").alias("violations"))


@query(
    "O16_linked_chunks",
    f"""with {BM25_SQL}, r as (select *, {RANK_SQL} as rank from bm), l as (select query_id, list(id::varchar order by rank) f from r where rank <= 10 group by query_id),
    s as (select item_id id, [(item_id % 12)::varchar, 'doc_' || item_id, '2', '0', '99'] t from benchmark), n as (select id, unnest(t) name, generate_subscripts(t, 1) pos from s),
    m as (select id, pos, case when regexp_full_match(name, '[0-9]+') then f[name::int] else name end c from n left join l on l.query_id = id)
    select id, coalesce(string_agg(c, ',' order by pos) filter (c is not null), '') linked from m group by id""",
)
def _(spark, sf):
    """Chunks that a selection names, by their rank in the question's results or by id."""
    q = S.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.concat((F.col("item_id") % 12).cast("string"), F.lit(", doc_"), F.col("item_id").cast("string"), F.lit(",2 , 0,99")).alias("selection"))
    hits = _bm25(spark, sf, 10).select(F.col("query_id").alias("id"), "rank", F.col("id").cast("string").alias("chunk_id"))
    return O.selected_chunks(q, hits).select("id", F.array_join("linked", ",").alias("linked"))
