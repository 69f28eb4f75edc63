"""Retrieval queries: every benchmark text against every document, every twentieth vector against all vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import query as Q
from ..functions import text as X
from ..operators import retrieval as R
from ..operators.order import numbered
from ..sources import relations as S
from ..sources.shared import written
from .registry import query

TOK_SQL = f"""{S.CHUNKS_SQL}, toks as (select id, unnest({S.tokens_sql('text')}) tok from chunks), tf as (select id, tok, count(*) tf from toks group by all),
  lens as (select id, len({S.tokens_sql('text')}) dl from chunks), whole as (select count(*) n, avg(dl) avgdl from lens),
  dfs as (select tok, count(*) df from tf group by tok), idf0 as (select tok, df, ln(n - df + 0.5) - ln(df + 0.5) idf from dfs, whole),
  idfs as (select tok, df, case when idf < 0 then 0.25 * (select avg(idf) from idf0) else idf end idf from idf0)"""
ASKED_SQL = f"asked as (select query_id, tok, count(*) qtf from (select item_id query_id, unnest({S.tokens_sql('text')}) tok from benchmark) group by all)"
BM25_SQL = f"""{TOK_SQL}, {ASKED_SQL},
  bm as (select query_id, id, round(sum(qtf * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))), 9) score from tf join asked using (tok) join idfs using (tok) join lens using (id), whole group by all having score > 0)"""
RANK_SQL = "row_number() over (partition by query_id order by score desc, id)"
VEC_SQL = """vq as (select q.vec_id query_id, v.vec_id id, round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: z[1]::double * z[2]::double)) /
  sqrt(list_sum(list_transform(v.embedding, lambda x: x::double * x::double)) * list_sum(list_transform(q.embedding, lambda x: x::double * x::double))), 6) score from embeddings v, embeddings q where q.vec_id % 20 = 0)"""


def _toks(spark, sf):
    """The corpus as tokens, made and written once for all that a query does with it."""
    return R.as_tokens(S.chunks(spark, sf))


def _bm25(spark, sf, k):
    return R.bm25(_toks(spark, sf), S.queries(spark, sf), k)


@query("G1_tokenize", f"with {S.CHUNKS_SQL} select id, len(t) n_tokens, array_to_string(t, ' ') tokens from (select id, {S.tokens_sql('text')} t from chunks)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return S.chunks(spark, sf).select("id", X.tokens(F.col("text")).alias("t")).select("id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("D11_bm25_statistics", f"with {TOK_SQL} select tok, df, round(idf, 6) idf from idfs")
def _(spark, sf):
    return R.bm25_statistics(_toks(spark, sf))[0].select("tok", "df", F.round("idf", 6).alias("idf"))


@query("I2_bm25_scores", f"with {BM25_SQL} select query_id, id, round(score, 6) score from bm")
def _(spark, sf):
    return R.bm25_scores(_toks(spark, sf), S.queries(spark, sf)).withColumn("score", F.round("score", 6))


@query("F1_bm25_topk", f"with {BM25_SQL}, r as (select *, {RANK_SQL} as rank from bm) select query_id, rank::int as rank, id, round(score, 6) score from r where rank <= 5")
def _(spark, sf):
    return _bm25(spark, sf, 5).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def _vectors(spark, sf):
    v = S.table(spark, sf, "embeddings")
    return v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query("F2_dense_topk", f"with {VEC_SQL}, r as (select *, {RANK_SQL} as rank from vq) select query_id, rank::int as rank, id, score from r where rank <= 5")
def _(spark, sf):
    return R.dense(*_vectors(spark, sf), 5).select("query_id", "rank", "id", "score")


@query("F3_vector_knn", f"with {VEC_SQL}, r as (select *, {RANK_SQL} as rank from vq) select query_id, rank::int as rank, id, round(1 - score, 6) distance from r where rank <= 10")
def _(spark, sf):
    return R.dense(*_vectors(spark, sf), 10).select("query_id", "rank", "id", F.round(1 - F.col("score"), 6).alias("distance"))


@query("I3_dense_relevance", f"with {VEC_SQL}, r as (select *, {RANK_SQL} as rank from vq) select r.query_id, count(*) filter (e.label = q.label) same_label, round(avg(score), 5) mean_score from r join embeddings e on e.vec_id = r.id join embeddings q on q.vec_id = r.query_id where rank <= 20 group by r.query_id")
def _(spark, sf):
    """Scores are summed by rank: a mean half-way between two roundings comes out the same, however the joins deal out the rows."""
    labels = S.table(spark, sf, "embeddings").select("vec_id", "label")
    hits = R.dense(*_vectors(spark, sf), 20).join(labels.toDF("id", "label"), "id").join(labels.toDF("query_id", "own"), "query_id")
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("rank", "score"))), F.lit(0.0), lambda s, h: s + h["score"])
    return hits.groupBy("query_id").agg(F.count_if(F.col("label") == F.col("own")).alias("same_label"), F.round(total / F.count("*"), 5).alias("mean_score"))


# The dense ranking: a vector for each chunk and each query, as a model would give them.
DENSE_SQL = """size_ as (select count(*) n from embeddings), dv as (select doc_id id, e.embedding v from documents, size_ join embeddings e on e.vec_id = doc_id % n), qv as (select item_id query_id, e.embedding q from benchmark, size_ join embeddings e on e.vec_id = item_id % n),
  ds as (select query_id, id, round(list_sum(list_transform(list_zip(v, q), lambda z: z[1]::double * z[2]::double)) / sqrt(list_sum(list_transform(v, lambda x: x::double * x::double)) * list_sum(list_transform(q, lambda x: x::double * x::double))), 6) score from dv, qv),
  dn as (select *, row_number() over (partition by query_id order by score desc, id) as rank from ds)"""


def _document_vectors(spark, sf):
    """(id, v) of every document, (query_id, q) of every query, and how many vectors there are."""
    v = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("_at"), F.col("embedding").alias("v"))
    n = v.count()
    rows = S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % n).alias("_at")).join(v, "_at").select("id", "v")
    asked = S.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % n).alias("_at")).join(v.withColumnRenamed("v", "q"), "_at").select("query_id", "q")
    return rows, asked, n


def _dense_list(spark, sf, k):
    return R.dense(*_document_vectors(spark, sf)[:2], k)


def _lists(spark, sf, k=20):
    """What a hybrid search fuses: the lexical and the dense list."""
    return [_bm25(spark, sf, k), _dense_list(spark, sf, k)]


RRF_SQL = f"""{BM25_SQL}, bmr as (select *, {RANK_SQL} as rank from bm), {DENSE_SQL},
  both_ as (select query_id, id, rank, 0 l from bmr where rank <= 20 union all select query_id, id, rank, 1 from dn where rank <= 20),
  rrf0 as (select query_id, id, round(sum(1.0::double / (60 + rank)), 9) score, min({{'l': l, 'r': rank}}) seen from both_ group by query_id, id),
  rrf as (select *, row_number() over (partition by query_id order by score desc, seen) as rank from rrf0)"""


@query("I4_rrf_merge", f"with {RRF_SQL} select query_id, rank::int as rank, id, round(score, 8) score from rrf where rank <= 10")
def _(spark, sf):
    return R.rrf(_lists(spark, sf), 10).select("query_id", "rank", "id", F.round("score", 8).alias("score"))


@query("D12_rrf_sums", f"with {RRF_SQL} select query_id, count(*) n, round(sum(score), 6) total from rrf group by query_id")
def _(spark, sf):
    return R.rrf(_lists(spark, sf), 1 << 30).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))


KEY_TERMS_SQL = "kt as (select id, list(tok order by n desc, f) key_terms from (select id, tok, n, f, row_number() over (partition by id order by n desc, f) r from (select id, tok, count(*) n, min(p) f from (select id, unnest(t) tok, generate_subscripts(t, 1) p from (select id, {} t from chunks)) group by id, tok)) where r <= 8 group by id)".format(S.tokens_sql("text"))


def key_terms(chunks: DataFrame, n: int = 8) -> DataFrame:
    """(id, key_terms): the n most frequent tokens of each chunk, ties by first place.

    A chunk's tokens are counted where its text is read, and n words of them go on. Chunks that share an id count as one; where there are such, words are grouped by a shuffle."""
    toks = chunks.select("id", X.tokens(F.col("text")).alias("toks"))
    if not chunks.groupBy("id").count().filter("count > 1").limit(1).isEmpty():
        counted = toks.select("id", F.posexplode("toks").alias("p", "tok")).groupBy("id", "tok").agg(F.count("*").alias("n"), F.min("p").alias("p"))
        top = counted.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "p"))).filter(F.col("r") <= n)
        return top.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "tok"))), lambda t: t["tok"]).alias("key_terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 128) for k in range(0, batch.num_rows, 128)):
                # equal counts come in order of first place
                terms = [[t for t, _ in Counter(own).most_common(n)] for own in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(terms, pa.list_(pa.string()))], names=["id", "key_terms"])

    return toks.filter(F.size("toks") > 0).mapInArrow(run, T.StructType([chunks.schema["id"], T.StructField("key_terms", T.ArrayType(T.StringType()))]))


def _intents(spark, sf):
    """Queries with alternating forms, so that every intent occurs."""
    q = S.queries(spark, sf)
    first = F.element_at(F.filter(X.tokens(F.col("query")), lambda t: F.length(t) > 3), 1)
    text = F.element_at(F.array(F.concat(F.lit("What is "), first, F.lit("?")), F.concat(F.lit("how to "), first), F.concat(F.lit("compare "), first, F.lit(" vs x")), F.col("query")), (F.col("query_id") % 4 + 1).cast("int"))
    q = q.select("query_id", text.alias("q"))
    return q.select("query_id", Q.is_definition(F.col("q")).alias("is_definition_seeking"), Q.concept(F.col("q")).alias("concept"), Q.negative_signals(F.col("q")).alias("negative_signals"), Q.is_procedural(F.col("q")).alias("is_procedural"), Q.is_comparative(F.col("q")).alias("is_comparative"))


FIRST_SQL = f"list_filter({S.tokens_sql('text')}, lambda t: length(t) > 3)[1]"
HYBRID_SQL = f"""{RRF_SQL}, {KEY_TERMS_SQL}, it as (select item_id query_id, item_id % 4 k, case when item_id % 4 = 0 then {FIRST_SQL} end concept from benchmark),
  hs as (select query_id, id, header_path, chunk_type, text, round(score * case when concept is not null and (contains(lower(header_path), 'non-' || concept) or contains(lower(header_path), 'non ' || concept) or contains(lower(header_path), 'no ' || concept) or contains(lower(header_path), 'without ' || concept)) then 0.25::double else 1.0::double end
    * case when k = 0 and chunk_type = 'definition' and (concept is null or len(list_filter(coalesce(key_terms, []), lambda t: contains(t, concept))) > 0) then 1.5::double else 1.0::double end
    * case when k = 1 and chunk_type in ('algorithm', 'section') then 1.1::double else 1.0::double end * case when k = 2 and chunk_type in ('protocol', 'comparison', 'section') then 1.05::double else 1.0::double end, 9) score
    from rrf join chunks using (id) join it using (query_id) left join kt using (id) where rank <= 20 and chunk_type not in ('exercise', 'references', 'bibliography', 'citations') and
    not (contains(lower(header_path), 'references') or contains(lower(header_path), 'bibliography') or contains(lower(header_path), 'further reading') or contains(lower(header_path), 'appendix') or contains(lower(header_path), 'exercises') or contains(lower(header_path), 'review questions'))),
  hy as (select *, {RANK_SQL}::int as rank from hs)"""


def _candidates(spark, sf, k):
    """The fused list and the chunks in it with their key terms; both are written once."""
    merged = written(R.rrf(_lists(spark, sf), k).drop("rank"))
    chunks = written(S.chunks(spark, sf).join(merged.select("id").distinct(), "id", "left_semi"))
    return chunks.join(key_terms(chunks), "id", "left").withColumn("key_terms", F.coalesce("key_terms", F.array().cast("array<string>"))), merged


def _hybrid(spark, sf, k=5, candidates=20):
    return R.hybrid(*_candidates(spark, sf, max(3 * k, candidates)), _intents(spark, sf), k)


@query("I5_hybrid_search", f"with {HYBRID_SQL} select query_id, rank, id, round(score, 8) score from hy where rank <= 5")
def _(spark, sf):
    return _hybrid(spark, sf).select("query_id", "rank", "id", F.round("score", 8).alias("score"))


@query("B6_noise_filter", f"with {S.CHUNKS_SQL} select chunk_type, count(*) n, count(*) filter (chunk_type in ('exercise', 'references', 'bibliography', 'citations') or regexp_matches(lower(header_path), 'references|bibliography|further reading|appendix|exercises|review questions')) noisy from chunks group by chunk_type")
def _(spark, sf):
    return S.chunks(spark, sf).groupBy("chunk_type").agg(F.count("*").alias("n"), F.count_if(R.noise(F.col("chunk_type"), F.col("header_path"))).alias("noisy"))


@query("I6_boosts", f"with {HYBRID_SQL} select query_id, id, round(score, 8) score from hs")
def _(spark, sf):
    return _boosted(spark, sf).select("query_id", "id", F.round("score", 8).alias("score"))


def _boosted(spark, sf):
    chunks, merged = _candidates(spark, sf, 20)
    found = R.boosted(R.drop_noise(merged.join(chunks, "id").join(_intents(spark, sf), "query_id")))
    return found.select("query_id", "id", F.round("score", 9).alias("score"))


@query("I7_about_concept", f"with {HYBRID_SQL} select it.query_id, count(*) n from it, kt where concept is not null and len(list_filter(key_terms, lambda t: contains(t, concept))) > 0 group by it.query_id")
def _(spark, sf):
    held = key_terms(S.chunks(spark, sf)).select("id", F.explode("key_terms").alias("t"))
    terms = held.select("t").distinct()
    asked = _intents(spark, sf).filter("concept is not null").select("query_id", "concept")
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 3), lambda i: F.substr(c, i, F.lit(4)))
    # substring containment as an equi-join on four-letter grams, then the test itself
    left = terms.filter("length(t) >= 4").select("t", F.explode(F.array_distinct(grams(F.col("t")))).alias("g"))
    right = asked.select("query_id", "concept", F.substring("concept", 1, 4).alias("g"))
    hit = left.join(right, "g").filter(F.contains("t", F.lower("concept"))).select("query_id", "t").distinct()
    hit = hit.join(held, "t").select("query_id", "id").distinct()  # rows of (term, id): no term's ids meet in one row
    return hit.groupBy("query_id").agg(F.count("*").alias("n"))


@query("I8_rerank_blend", f"with {HYBRID_SQL}, b as (select query_id, id, round(0.5::double * score + 0.5::double * ((id % 10) / 10.0::double), 6) score from hs) select query_id, rank::int as rank, id, score from (select *, {RANK_SQL} as rank from b) where rank <= 5")
def _(spark, sf):
    scored = _boosted(spark, sf).withColumn("ce", (F.col("id") % 10) / 10)
    return R.ranked(R.blended(scored).withColumn("score", F.round("score", 6)), 5).select("query_id", "rank", "id", "score")


PLACE_SQL = "placed as (select id, book_id, row_number() over (partition by book_id order by pos, id) place from chunks)"
NEIGHBOUR_SQL = f"""{BM25_SQL}, bmr as (select *, {RANK_SQL} as rank from bm), {PLACE_SQL},
  met as (select b.query_id, n.id, min({{'r': b.rank, 'p': n.place}}) m from bmr b join placed p using (id) join placed n on n.book_id = p.book_id and n.place between p.place - 1 and p.place + 1 where b.rank <= 5 group by b.query_id, n.id)"""


@query("E4_neighbour_expansion", f"with {NEIGHBOUR_SQL} select query_id, id, row_number() over (partition by query_id order by m, id)::int as position from met")
def _(spark, sf):
    return R.neighbours(S.chunks(spark, sf), _bm25(spark, sf, 5)).select("query_id", "id", "position")


@query("C13_neighbour_join", f"with {S.CHUNKS_SQL}, {PLACE_SQL} select a.id, b.id other, (b.place - a.place)::int off from placed a join placed b on a.book_id = b.book_id and b.place between a.place - 2 and a.place + 2")
def _(spark, sf):
    placed = numbered(S.chunks(spark, sf).select("id", "book_id", "pos"), "book_id", "pos", "id").select("id", "book_id", F.col("_n").alias("place"))
    wide = placed.select("id", "book_id", F.explode(F.array(*(F.struct(F.lit(d).alias("off"), (F.col("place") + d).alias("place")) for d in range(-2, 3)))).alias("n")).select("id", "book_id", "n.*")
    return wide.join(placed.withColumnRenamed("id", "other"), ["book_id", "place"]).select("id", "other", "off")


@query("C14_previous_next", f"with {S.CHUNKS_SQL} select id, lag(id) over w prev_id, lead(id) over w next_id from chunks window w as (partition by book_id order by pos, id)")
def _(spark, sf):
    w = Window.partitionBy("book_id").orderBy("pos", "id")
    return S.chunks(spark, sf).select("id", F.lag("id").over(w).alias("prev_id"), F.lead("id").over(w).alias("next_id"))


@query("I9_context_expanded_search", f"with {NEIGHBOUR_SQL} select query_id, count(*) n, min(id) first_id, max(id) last_id from met group by query_id")
def _(spark, sf):
    return R.neighbours(S.chunks(spark, sf), _bm25(spark, sf, 5)).groupBy("query_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


SUB_SQL = f"""{BM25_SQL}, bmr as (select query_id // 2 query_id, query_id % 2 sub, id, {RANK_SQL} as rank, score from bm),
  n as (select query_id, count(distinct sub) n from bmr where rank <= 5 group by query_id), best as (select query_id, id, max(score) score from bmr join n using (query_id) where rank <= 5 and rank <= greatest(2, 5 // n) group by query_id, id)"""


@query("I10_subquery_merge", f"with {SUB_SQL} select query_id, rank::int as rank, id, round(score, 6) score from (select *, {RANK_SQL} as rank from best) where rank <= 5")
def _(spark, sf):
    results = _bm25(spark, sf, 5).select((F.floor(F.col("query_id") / 2)).cast("long").alias("query_id"), (F.col("query_id") % 2).alias("sub"), "id", "rank", "score")
    return R.merged_subqueries(results, 5).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query("D13_max_over_subqueries", f"with {SUB_SQL} select query_id, id, round(score, 6) score from best")
def _(spark, sf):
    results = _bm25(spark, sf, 5).select((F.floor(F.col("query_id") / 2)).cast("long").alias("query_id"), (F.col("query_id") % 2).alias("sub"), "id", "rank", "score")
    parts = results.groupBy("query_id").agg(F.countDistinct("sub").alias("n"))
    each = results.join(parts, "query_id").filter(F.col("rank") <= F.greatest(F.lit(2), F.floor(F.lit(5) / F.col("n"))))
    return each.groupBy("query_id", "id").agg(F.round(F.max("score"), 6).alias("score"))


CTX_SQL = """r as (select query_id, rank, chunks.id, '[' || rank || '] ' || coalesce(nullif(header_path, ''), chunks.id::varchar) || ': ' head, trim(text) body from (select *, row_number() over (partition by query_id order by score desc, id) as rank from bm) b join chunks on b.id = chunks.id where rank <= 8),
  t as (select *, greatest(1, length(head || body) // 4) n from r), u as (select *, coalesce(sum(n) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0)::bigint used from t),
  v as (select *, min(case when used + n > 800 and rank > 1 then rank end) over (partition by query_id) stop from u),
  w as (select query_id, rank, case when rank = stop then head || substr(body, 1, (720 - used) * 4) || '...' else head || body end seg from v where stop is null or rank < stop or (rank = stop and 720 - used > 100 and body <> '')),
  l as (select query_id, list(seg order by rank) s from w group by query_id)"""


@query("I1_context_packing", f"with {BM25_SQL}, {CTX_SQL} select query_id, len(s)::int n, array_to_string(case when len(s) <= 2 then s else s[1:(len(s) + 1) // 2] || list_reverse(s[(len(s) + 1) // 2 + 1:]) end, chr(10) || chr(10)) context from l")
def _(spark, sf):
    hits = _bm25(spark, sf, 8).join(S.chunks(spark, sf), "id")
    return R.context(hits, 800).select("query_id", "n", "context")


@query("E5_token_budget", f"with {BM25_SQL}, {CTX_SQL} select query_id, count(*) segments, sum(length(seg))::bigint chars from w group by query_id")
def _(spark, sf):
    found = R.context(_bm25(spark, sf, 8).join(S.chunks(spark, sf), "id"), 800)
    return found.select("query_id", F.col("n").cast("long").alias("segments"), (F.length("context") - 2 * (F.col("n") - 1)).cast("long").alias("chars"))


@query("I13_citations", f"with {BM25_SQL}, r as (select *, {RANK_SQL} as rank from bm) select query_id, rank::int as index, r.id, trim(substr(text, 1, 200)) || case when length(text) > 200 then '...' else '' end snippet from r join chunks on r.id = chunks.id where rank <= 5 and rank in (1, 3, 1 + query_id % 5)")
def _(spark, sf):
    answers = S.queries(spark, sf).select("query_id", F.concat(F.lit("see [3] and [1], [99], [1] and ["), (F.col("query_id") % 5 + 1).cast("string"), F.lit("]")).alias("answer"))
    return R.citations(answers, _bm25(spark, sf, 5).join(S.chunks(spark, sf), "id")).select("query_id", "index", "id", "snippet")


def _answers(hits):
    """An answer, of several kinds, to each query from its eight best hits."""
    context = R.context(hits.filter(F.col("rank") <= 8), 800).select("query_id", "context")
    text = F.concat(F.lit("As the source says [1] "), F.substring("context", 20, 60 * (F.col("query_id") % 2).cast("int")), F.when(F.col("query_id") % 3 == 0, F.lit(" but [77]")).otherwise(F.lit(" quite zzzz wwww")))
    return context.withColumn("answer", F.when(F.col("query_id") % 5 == 0, F.lit("short")).otherwise(text))


@query("I14_answer_evaluation")
def _(spark, sf):
    return R.evaluated(_answers(_bm25(spark, sf, 8).join(S.chunks(spark, sf), "id"))).select("query_id", F.array_join("missing", ",").alias("missing"), "is_complete", "confidence")


@query("E2_rank_within_list", f"with {BM25_SQL} select query_id, id, ({RANK_SQL} - 1)::int rank0 from bm qualify {RANK_SQL} <= 20")
def _(spark, sf):
    return _bm25(spark, sf, 20).select("query_id", "id", (F.col("rank") - 1).alias("rank0"))


@query("C11_ranking_to_chunks", f"with {RRF_SQL} select query_id, rank::int as rank, chunks.id, book_id, chunk_type from rrf join chunks on rrf.id = chunks.id where rank <= 10")
def _(spark, sf):
    return R.rrf(_lists(spark, sf), 10).join(S.chunks(spark, sf), "id").select("query_id", "rank", "id", "book_id", "chunk_type")
