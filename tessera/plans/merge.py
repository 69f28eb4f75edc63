"""Change queries: yesterday's and today's state of customers, documents and conversations; retrieval evaluation; chat history."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import merge as M
from ..operators import retrieval as R
from ..operators.mastery import MasteryStore
from ..sources import relations as S
from ..sources.buckets import BucketTable
from ..sources.shared import folder, written
from .registry import query
from .retrieval import BM25_SQL, RANK_SQL, VEC_SQL, _vectors
from .reviews import MASTERY_SQL

OLD_SQL = "old as (select c_custkey k, c_acctbal w, c_mktsegment seg, 1 created from customer where c_custkey % 5 <> 0), new as (select c_custkey k, case when c_custkey % 7 = 0 then c_acctbal + 1 when c_custkey % 11 = 0 then c_acctbal + 1e-11::double else c_acctbal end w, c_mktsegment seg, 2 created from customer where c_custkey % 3 <> 0)"


def _old_new(spark, sf):
    c = S.table(spark, sf, "customer")
    k, w = F.col("c_custkey"), F.col("c_acctbal")
    old = c.filter(k % 5 != 0).select(k.alias("k"), w.alias("w"), F.col("c_mktsegment").alias("seg"), F.lit(1).alias("created"))
    moved = F.when(k % 7 == 0, w + 1).when(k % 11 == 0, w + 1e-11).otherwise(w)
    return old, c.filter(k % 3 != 0).select(k.alias("k"), moved.alias("w"), F.col("c_mktsegment").alias("seg"), F.lit(2).alias("created"))


@query("F14_upsert", f"with {OLD_SQL} select coalesce(o.k, n.k) k, case when n.k is null then o.w else n.w end w, coalesce(o.created, n.created) created from old o full join new n on o.k = n.k")
def _(spark, sf):
    """Today's rows are merged into a bucket table of yesterday's, twice; the first `created` stays."""
    old, new = (df.select("k", "w", "created") for df in _old_new(spark, sf))
    table = BucketTable(spark, folder(spark, "customers"), old.schema, ["k"], buckets=16)
    table.upsert(0, old)
    for _ in range(2):
        table.upsert(1, new, keep=("created",))
    return table.read()


CUTS = ("2024-01-11", "2024-01-21")


@query(
    "H4_refresh_upsert",
    f"""{MASTERY_SQL}, k as (select *, case when attempted_at < timestamp '{CUTS[0]}' then 0 when attempted_at < timestamp '{CUTS[1]}' then 1 else 2 end k from att),
    c as (select user_id, subject, topic_key, min(k) created from k group by all), u as (select user_id, max(k) updated from k group by all)
    select user_id, subject, topic_key, n attempt_count, dc due_count, oc overdue_count, lc lapse_count, round(m, 5) mastery, bucket, created, updated from sb join c using (user_id, subject, topic_key) join u using (user_id)""",
)
def _(spark, sf):
    """Attempts come in three batches, the second of them twice; each is merged into review states, partial sums and scores of the users that it names."""
    a, i = S.attempts(spark, sf), written(S.identities(S.cards(spark, sf), S.topics(spark, sf)))
    store = MasteryStore(spark, folder(spark, "mastery"), a.schema["attempted_at"].dataType.simpleString(), buckets=8)
    k = sum((F.when(F.col("attempted_at") >= F.lit(c).cast("timestamp"), 1).otherwise(0) for c in CUTS), F.lit(0))
    for batch in (0, 1, 1, 2):
        store.refresh(batch, a.filter(k == batch), i, F.lit(S.NOW).cast("timestamp"))
    return store.topics.read().select("user_id", "subject", "topic_key", "attempt_count", "due_count", "overdue_count", "lapse_count", F.round("mastery", 5).alias("mastery"), F.col("bucket_name").alias("bucket"), "created", "updated")


@query(
    "F15_vector_refresh",
    """with n as (select count(*) n from embeddings), v as (select doc_id id, e.embedding v from documents, n join embeddings e on e.vec_id = doc_id % n),
    vq as (select q.id query_id, c.id, round(list_sum(list_transform(list_zip(c.v, q.v), lambda z: z[1]::double * z[2]::double)) / sqrt(list_sum(list_transform(c.v, lambda x: x::double * x::double)) * list_sum(list_transform(q.v, lambda x: x::double * x::double))), 6) score
      from v c, v q where q.id % 20 = 0),
    r as (select *, row_number() over (partition by query_id order by score desc, id)::int as rank from vq),
    w as (select doc_id id, doc_id % 4 = 0 or doc_id % 3 = 0 filled from documents)
    select query_id, rank, r.id, score, filled from r join w on w.id = r.id where rank <= 5""",
)
def _(spark, sf):
    """Sync of a chunk store as one job: content hashes, the rows whose hash or model is another, their vectors anew, written to their buckets, and a search over the result.

    A third of the stored rows have another hash and a vector that is not theirs; a quarter of the documents are not stored yet."""
    d, e = S.table(spark, sf, "documents"), S.table(spark, sf, "embeddings")
    n = e.count()
    made = e.select(F.col("vec_id").alias("_at"), F.col("embedding").cast("array<double>").alias("made"))  # what the model says of each text
    texts = d.select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    k = F.col("id")
    stored = texts.filter(k % 4 != 0).withColumn("_at", F.when(k % 3 == 0, (k + 1) % n).otherwise(k % n)).join(made, "_at")
    stored = stored.select("id", F.lit("m1").alias("model"), F.when(k % 3 == 0, F.lit("stale")).otherwise(F.col("hash")).alias("hash"), F.col("made").alias("vector"), F.lit(False).alias("filled"))
    store = BucketTable(spark, folder(spark, "chunks"), stored.schema, ["id"], buckets=16)
    store.upsert(0, stored)
    fresh = M.refreshed_vectors(store.read(), texts, "m1")
    missing = fresh.filter("vector is null").withColumn("_at", k % n).join(made, "_at")
    store.upsert(1, missing.select("id", "model", "hash", F.col("made").alias("vector"), F.lit(True).alias("filled")))
    now = store.read()
    hits = R.dense(now.select("id", F.col("vector").alias("v")), now.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q")), 5)
    return hits.join(now.select("id", "filled"), "id").select("query_id", "rank", "id", "score", "filled")


@query("F16_graph_sync_diff", f"with {OLD_SQL} select coalesce(o.k, n.k) k, case when o.k is null then 'insert' when n.k is null then 'delete' when abs(o.w - n.w) <= 1e-9 then 'unchanged' else 'update' end op from old o full join new n on o.k = n.k")
def _(spark, sf):
    return M.differences(*_old_new(spark, sf), ["k"], ["w"], delete=True)


SEED_SQL = "rows_ as (select p_partkey ordinal, p_name question, case when p_partkey % 4 = 0 then null else p_brand end source, p_size > 5 complete from part), existing as (select distinct p_name question, case when p_partkey % 8 = 0 then null else p_brand end source from part where p_partkey % 10 = 0)"


@query("F17_seed_insert", f"with {SEED_SQL}, x as (select r.*, exists (select 1 from existing e where e.question = r.question and e.source is not distinct from r.source) known, row_number() over (partition by question, source, complete order by ordinal) n from rows_ r) select ordinal, case when not complete then 'skip_incomplete' when known or n > 1 then 'skip_existing' else 'insert' end action from x")
def _(spark, sf):
    p = S.table(spark, sf, "part")
    k = F.col("p_partkey")
    rows = p.select(k.alias("ordinal"), F.col("p_name").alias("question"), F.when(k % 4 != 0, F.col("p_brand")).alias("source"), (F.col("p_size") > 5).alias("complete"))
    existing = p.filter(k % 10 == 0).select(F.col("p_name").alias("question"), F.when(k % 8 != 0, F.col("p_brand")).alias("source"))
    return M.seeded(existing, rows).select("ordinal", "action")


@query("C12_null_safe_existence", f"with {SEED_SQL} select ordinal from rows_ r where not exists (select 1 from existing e where e.question = r.question and e.source is not distinct from r.source)")
def _(spark, sf):
    p = S.table(spark, sf, "part")
    k = F.col("p_partkey")
    r = p.select(k.alias("ordinal"), F.col("p_name").alias("question"), F.when(k % 4 != 0, F.col("p_brand")).alias("source"))
    e = p.filter(k % 10 == 0).select(F.col("p_name").alias("q"), F.when(k % 8 != 0, F.col("p_brand")).alias("s")).distinct()
    return r.join(e, (r["question"] == e["q"]) & r["source"].eqNullSafe(e["s"]), "left_anti").select("ordinal")


@query("F18_cascade_delete", "select conv_id, count(*) messages from conversations where conv_id % 5 <> 0 group by conv_id")
def _(spark, sf):
    t = S.table(spark, sf, "conversations")
    gone = t.select("conv_id").distinct().filter("conv_id % 5 = 0")
    return t.join(gone, "conv_id", "left_anti").groupBy("conv_id").agg(F.count("*").alias("messages"))


RESUME_SQL = "select p_partkey id, l.n from part left join (select event_id row_index, max(event_id) n from events group by 1) l on p_partkey = row_index"


@query("A9_resume_all_parts", RESUME_SQL)
@query("A9_checkpoint_resume", RESUME_SQL)
def _(spark, sf):
    """Every row of the table, with its last entry in the log, whose keys span the table."""
    log = S.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("n"))
    todo = S.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return todo.join(M.last_wins(log, "id", "n"), "id", "left").select("id", "n")


@query("A10_resume_anti_join", "select d.doc_id from documents d anti join labels l on l.doc_id = d.doc_id")
def _(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id").join(S.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("I18_import_questions", "select 'q' || lpad((row_number() over (order by item_id))::varchar, 5, '0') id, item_id from benchmark where item_id % 3 <> 0")
def _(spark, sf):
    b = S.table(spark, sf, "benchmark")
    known = b.filter("item_id % 3 = 0").select("item_id")
    fresh = b.select("item_id").join(known, "item_id", "left_anti")
    return fresh.select(F.format_string("q%05d", F.row_number().over(Window.orderBy("item_id"))).alias("id"), "item_id")  # ids of one import file


# -- evaluation ------------------------------------------------------------------------------------------------------
REL_SQL = f"{VEC_SQL}, rk as (select *, row_number() over (partition by query_id order by score desc, id) as rank from vq where id <> query_id), rel as (select q.vec_id query_id, e.vec_id id from embeddings q join embeddings e on e.label = q.label and e.vec_id <> q.vec_id where q.vec_id % 20 = 0)"


def _ranked_relevant(spark, sf, k):
    hits = R.dense(*_vectors(spark, sf), k + 1).filter("id <> query_id")
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    e = S.table(spark, sf, "embeddings").select("vec_id", "label")
    sizes = e.groupBy("label").agg((F.count("*") - 1).alias("relevant"))
    own = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")).join(sizes.withColumnRenamed("label", "own"), "own")
    return hits.join(e.toDF("id", "label"), "id").join(own, "query_id").withColumn("hit", (F.col("label") == F.col("own")).cast("int"))


METRICS_SQL = f"{REL_SQL}, m as (select rk.query_id, count(*) filter (rank <= 5 and rel.id is not null) h, count(*) filter (rank <= 5) got, min(rank) filter (rel.id is not null) first_, any_value(nrel.n) n from rk left join rel on rel.query_id = rk.query_id and rel.id = rk.id join (select q.vec_id query_id, count(e.vec_id) n from embeddings q left join embeddings e on e.label = q.label and e.vec_id <> q.vec_id where q.vec_id % 20 = 0 group by 1) nrel on nrel.query_id = rk.query_id where rank <= 10 group by rk.query_id)"


@query("I15_retrieval_metrics", f"with {METRICS_SQL} select query_id, round(h / got, 6) precision_at_5, case when n = 0 then 0 else round(h / n, 6) end recall_at_5, coalesce(round(1 / first_, 6), 0) mrr from m")
def _(spark, sf):
    return _metrics(spark, sf)


def _metrics(spark, sf):
    top = F.col("rank") <= 5
    g = _ranked_relevant(spark, sf, 10).groupBy("query_id").agg(F.sum(F.when(top, F.col("hit")).otherwise(F.lit(0))).alias("h"), F.count_if(top).alias("got"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.max("relevant").alias("n"))
    recall = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.round(F.col("h") / F.greatest("n", F.lit(1)), 6))
    return g.select("query_id", F.round(F.col("h") / F.col("got"), 6).alias("precision_at_5"), recall.alias("recall_at_5"), F.coalesce(F.round(1 / F.col("first"), 6), F.lit(0.0)).alias("mrr"))


@query("D10_mean_metrics", f"with {METRICS_SQL} select count(*) queries, round(avg(round(h / got, 6)), 5) precision_at_5, round(avg(coalesce(round(1 / first_, 6), 0)), 5) mrr from m where n > 0")
def _(spark, sf):
    return _metrics(spark, sf).agg(F.count("*").alias("queries"), F.round(F.avg("precision_at_5"), 5).alias("precision_at_5"), F.round(F.avg("mrr"), 5).alias("mrr"))


NOISE_SQL = f"with {BM25_SQL}, r as (select *, {RANK_SQL} as rank from bm), n as (select query_id, count(*) filter (chunk_type in ('references', 'exercise', 'appendix')) noise, count(*) filter (chunk_type = 'section' or chunk_type = 'algorithm') required from r join chunks on chunks.id = r.id where rank <= 5 group by query_id)"


@query("I16_noise_at_k", f"{NOISE_SQL} select query_id, noise, required, case when noise <= 1 and required >= 1 then 'PASS' else 'FAIL' end verdict from n")
def _(spark, sf):
    hits = R.bm25(S.chunks(spark, sf), S.queries(spark, sf), 5).join(S.chunks(spark, sf), "id")
    kind = F.col("chunk_type")
    g = hits.groupBy("query_id").agg(F.count_if(kind.isin("references", "exercise", "appendix")).alias("noise"), F.count_if(kind.isin("section", "algorithm")).alias("required"))
    return g.withColumn("verdict", F.when((F.col("noise") <= 1) & (F.col("required") >= 1), F.lit("PASS")).otherwise(F.lit("FAIL")))


@query("I17_queries_by_keyword", "select item_id from benchmark where contains(lower(text), 'tion') and (contains(lower(text), 'the') or contains(lower(text), 'ing'))")
def _(spark, sf):
    low = F.lower("text")
    return S.table(spark, sf, "benchmark").filter(F.contains(low, F.lit("tion")) & F.exists(F.array(F.lit("the"), F.lit("ing")), lambda w: F.contains(low, w))).select("item_id")


# -- conversations -----------------------------------------------------------------------------------------------------
@query("C10_conversation_counts", "select c.c_custkey conv_id, count(m.turn) messages from customer c left join conversations m on m.conv_id = c.c_custkey group by 1")
def _(spark, sf):
    c = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("conv_id"))
    counts = S.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("turn").alias("messages"))
    return c.join(counts, "conv_id", "left").select("conv_id", F.coalesce("messages", F.lit(0)).alias("messages"))


@query("C9_lookup_with_defaults", "select e.event_id, coalesce(d.source, '') header, coalesce(substr(d.text, 1, 300), '') snippet from events e left join documents d on d.doc_id = e.event_id * 3")
def _(spark, sf):
    e = S.table(spark, sf, "events").select("event_id", (F.col("event_id") * 3).alias("doc_id"))
    d = S.table(spark, sf, "documents").select("doc_id", "source", F.substring("text", 1, 300).alias("s"))
    return e.join(d, "doc_id", "left").select("event_id", F.coalesce("source", F.lit("")).alias("header"), F.coalesce("s", F.lit("")).alias("snippet"))


@query("E7_last_turns", "select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3")
def _(spark, sf):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return S.table(spark, sf, "conversations").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("conv_id", "turn", "role")


@query("F9_conversations_recent", "select user_id, max(ts) updated_at from events group by user_id order by updated_at desc, user_id")
def _(spark, sf):
    return S.table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("updated_at")).orderBy(F.desc("updated_at"), "user_id")


@query("B14_conversation_title", "select conv_id, case when length(text) > 60 then substr(text, 1, 60) || '...' else text end title from conversations where role = 'user' qualify row_number() over (partition by conv_id order by turn) = 1")
def _(spark, sf):
    first = S.table(spark, sf, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    return first.select("conv_id", F.when(F.length("t") > 60, F.concat(F.substring("t", 1, 60), F.lit("..."))).otherwise(F.col("t")).alias("title"))


@query("A17_event_stream_frames", "select event_id, 'event: ' || event_type || chr(10) || 'data: {\"id\":' || event_id || '}' || chr(10) || chr(10) frame from events")
def _(spark, sf):
    return S.table(spark, sf, "events").select("event_id", F.concat(F.lit("event: "), "event_type", F.lit("\ndata: "), F.to_json(F.struct(F.col("event_id").alias("id"))), F.lit("\n\n")).alias("frame"))


@query("O17_message_json", "select conv_id, turn, '{\"role\":\"' || role || '\",\"turn\":' || turn || '}' message from conversations")
def _(spark, sf):
    return S.table(spark, sf, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", "turn")).alias("message"))


@query("K8_rate_per_minute", "select user_id, date_trunc('minute', ts) as minute, count(*) n, count(*) > 1 limited from events group by 1, 2")
def _(spark, sf):
    g = S.table(spark, sf, "events").groupBy("user_id", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("minute"), "n", (F.col("n") > 1).alias("limited"))


@query("K4_session_windows", "with g as (select user_id, ts, case when date_diff('microsecond', lag(ts) over (partition by user_id order by ts), ts) >= 7200000000 or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end s from events), c as (select *, sum(s) over (partition by user_id order by ts) k from g) select user_id, min(ts) started, count(*) n from c group by user_id, k")
def _(spark, sf):
    g = S.table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("started"), "n")
