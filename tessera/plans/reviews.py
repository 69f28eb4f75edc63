"""Review queries: events as attempts, parts as cards, regions as topics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import reviews as R
from ..sources import relations as S
from .registry import query

N = f"timestamp '{S.NOW}'"
STATES_SQL = f"""{S.ATTEMPTS_SQL}, seq as (select *, row_number() over (partition by user_id, card_id order by attempted_at, id) n from attempts),
  fold as (select user_id, card_id, 0::bigint n, 0::int repetitions, 0::int interval_days, 2.5::double ease_factor, 0::int lapses from (select distinct user_id, card_id from seq)
    union all select f.user_id, f.card_id, s.n, case when s.quality < 3 then 0 else f.repetitions + 1 end,
      case when s.quality < 3 then case when f.interval_days > 1 then greatest(1, least(f.interval_days // 2, 7)) else 1 end when f.repetitions = 0 then 1 when f.repetitions = 1 then 6 when f.interval_days = 0 then 6
        else greatest(1, round_even(f.interval_days * greatest(1.3::double, f.ease_factor + (0.1::double - (5 - s.quality) * (0.08::double + (5 - s.quality) * 0.02::double))), 0)::int) end,
      case when s.quality < 3 then f.ease_factor else greatest(1.3::double, f.ease_factor + (0.1::double - (5 - s.quality) * (0.08::double + (5 - s.quality) * 0.02::double))) end,
      case when s.quality < 3 then f.lapses + 1 else f.lapses end from fold f join seq s on s.user_id = f.user_id and s.card_id = f.card_id and s.n = f.n + 1),
  lasts as (select user_id, card_id, max(attempted_at) last_reviewed_at, count(*) reviews from attempts group by all),
  states as (select f.user_id, f.card_id, repetitions, interval_days, ease_factor, lapses, last_reviewed_at, last_reviewed_at + to_days(interval_days) due_at, reviews
    from fold f join lasts l on l.user_id = f.user_id and l.card_id = f.card_id and l.reviews = f.n)"""


def _now():
    return F.lit(S.NOW).cast("timestamp")


BASE = f"with recursive {STATES_SQL}, {S.TOPICS_SQL}, {S.CARDS_SQL}, {S.IDENTITIES_SQL}"
MASTERY_SQL = f"""{BASE}, att as (select a.*, subject, topic_key, row_number() over (partition by user_id, subject, topic_key order by attempted_at desc, a.id desc) r from attempts a join identities i using (card_id)),
  tried as (select user_id, subject, topic_key, count(*) attempt_count, avg(quality) avg_quality, avg(quality) filter (r <= 3) - avg(quality) recent_trend, max(attempted_at) last_reviewed_at from att group by all),
  held as (select user_id, subject, topic_key, sum(greatest(lapses, 0)) lapse_count, count(*) filter (due_at <= {N}) due_count, count(*) filter (due_at::date < {N}::date) overdue_count from states join identities using (card_id) group by all),
  base as (select u.user_id, t.subject, t.topic_key, coalesce(attempt_count, 0) n, coalesce(avg_quality, 0) aq, coalesce(recent_trend, 0) tr, coalesce(lapse_count, 0)::bigint lc, coalesce(due_count, 0) dc, coalesce(overdue_count, 0) oc
    from (select distinct user_id from attempts) u cross join (select distinct subject, topic_key from identities) t left join tried using (user_id, subject, topic_key) left join held using (user_id, subject, topic_key)),
  m as (select *, least(1.0::double, lc / greatest(1, n)) lr from base),
  mm as (select *, least(100.0::double, greatest(0.0::double, 60::double * aq / 5 + 20::double * (1 - lr) + least(20.0::double, greatest(0.0::double, (tr / 2 + 1) * 10)) - least(30.0::double, 6.0::double * oc))) m from m),
  sw as (select *, least(100.0::double, greatest(0.0::double, m * (1 - 0.4::double * least(1.0::double, oc / greatest(1, dc + 1))))) s,
    least(100.0::double, greatest(0.0::double, 0.65::double * (100 - m) + 35::double * lr)) w, least(100.0::double, greatest(0.0::double, 60::double * (1 - least(1.0::double, n / 6)) + 0.4::double * greatest(0.0::double, 70 - m))) o,
    least(100.0::double, greatest(0.0::double, least(70.0::double, 14.0::double * oc) + 12::double * greatest(0.0::double, -tr))) t from mm),
  sb as (select *, case greatest(s, w, o, t) when s then 'strength' when w then 'weakness' when o then 'opportunity' else 'threat' end bucket from sw)"""


def _states(spark, sf):
    return R.review_states(S.attempts(spark, sf))


def _mastery(spark, sf):
    return R.mastery(S.attempts(spark, sf), _states(spark, sf), S.identities(S.cards(spark, sf), S.topics(spark, sf)), _now())


@query("H5_sm2_states", f"{BASE} select user_id, card_id, repetitions, interval_days, round(ease_factor, 6) ease_factor, lapses, due_at from states")
def _(spark, sf):
    return _states(spark, sf).select("user_id", "card_id", "repetitions", "interval_days", F.round("ease_factor", 6).alias("ease_factor"), "lapses", "due_at")


@query("F4_next_cards", f"""{BASE}, c as (select u.user_id, c.id card_id, s.due_at, s.card_id is null is_new from (select distinct user_id from attempts) u cross join cards c left join states s on s.user_id = u.user_id and s.card_id = c.id where s.card_id is null or s.due_at <= {N})
  select user_id, position, card_id, is_new from (select *, row_number() over (partition by user_id order by is_new, due_at, card_id)::int as position from c) where position <= 40""")
def _(spark, sf):
    return R.next_cards(S.attempts(spark, sf).select("user_id").distinct(), S.cards(spark, sf), _states(spark, sf), _now(), 40)


@query("C4_new_cards_anti_join", f"{BASE} select c.id from cards c anti join states s on s.card_id = c.id")
def _(spark, sf):
    return S.cards(spark, sf).join(_states(spark, sf).withColumnRenamed("card_id", "id"), "id", "left_anti").select("id")


@query("C3_due_left_join", f"{BASE} select c.id, count(s.user_id) states, count(*) filter (s.due_at <= {N}) due from cards c left join states s on s.card_id = c.id group by c.id")
def _(spark, sf):
    s = _states(spark, sf).withColumnRenamed("card_id", "id")
    return S.cards(spark, sf).select("id").join(s, "id", "left").groupBy("id").agg(F.count("user_id").alias("states"), F.count_if(F.col("due_at") <= _now()).alias("due"))


@query("C2_states_semi_join", f"{BASE} select user_id, card_id, lapses from states semi join (select id from cards where difficulty = 'hard') c on states.card_id = c.id")
def _(spark, sf):
    hard = S.cards(spark, sf).filter("difficulty = 'hard'").select(F.col("id").alias("card_id"))
    return _states(spark, sf).join(hard, "card_id", "left_semi").select("user_id", "card_id", "lapses")


@query("C1_cards_with_topics", f"with {S.TOPICS_SQL}, {S.CARDS_SQL} select c.id, t.name, c.difficulty from cards c join topics t on t.id = c.topic_id")
def _(spark, sf):
    return S.cards(spark, sf).join(F.broadcast(S.topics(spark, sf).select(F.col("id").alias("topic_id"), "name")), "topic_id").select("id", "name", "difficulty")  # topics: one row a region


@query("C5_attempt_identities", f"with {S.ATTEMPTS_SQL}, {S.TOPICS_SQL}, {S.CARDS_SQL}, {S.IDENTITIES_SQL} select a.id, subject, topic_key from attempts a join identities i using (card_id)")
def _(spark, sf):
    return S.attempts(spark, sf).join(S.identities(S.cards(spark, sf), S.topics(spark, sf)), "card_id").select("id", "subject", "topic_key")


@query("C8_variants_self_join", f"with {S.CARDS_SQL} select a.id, b.id variant_id, a.question = b.question same_question from cards a join cards b on b.variant_of_card_id = a.id")
def _(spark, sf):
    c = S.cards(spark, sf)
    v = c.filter("variant_of_card_id is not null").select(F.col("variant_of_card_id").alias("id"), F.col("id").alias("variant_id"), F.col("question").alias("q2"))
    return c.join(v, "id").select("id", "variant_id", (F.col("question") == F.col("q2")).alias("same_question"))


@query("D1_cards_by_topic", f"with {S.TOPICS_SQL}, {S.CARDS_SQL} select t.id, t.name, count(*) n from topics t join cards c on c.topic_id = t.id group by all order by name")
def _(spark, sf):
    t = S.topics(spark, sf).select(F.col("id").alias("topic_id"), "name")
    counted = S.cards(spark, sf).groupBy("topic_id").agg(F.count("*").alias("n"))
    return counted.join(t, "topic_id").select(F.col("topic_id").alias("id"), "name", "n").orderBy("name")


@query("D2_topic_stats", f"""{BASE}, named as (select c.id card_id, coalesce(t.name, 'unknown') topic from cards c left join topics t on t.id = c.topic_id), totals as (select topic, count(*) total from named group by topic)
  select user_id, topic, any_value(total) total, count(*) filter (repetitions > 0) learned, count(*) filter (due_at::date = {N}::date) due_today, count(*) filter (due_at::date < {N}::date) overdue from states join named using (card_id) join totals using (topic) group by user_id, topic""")
def _(spark, sf):
    return R.topic_stats(S.cards(spark, sf), S.topics(spark, sf), _states(spark, sf), _now())


@query("D4_due_counts", f"{BASE} select user_id, count(*) filter (due_at <= {N}) due_count, count(*) filter (due_at::date < {N}::date) overdue_count from states group by user_id")
def _(spark, sf):
    return _states(spark, sf).groupBy("user_id").agg(F.count_if(F.col("due_at") <= _now()).alias("due_count"), F.count_if(F.to_date("due_at") < F.to_date(_now())).alias("overdue_count"))


@query("E1_recent_trend", f"{MASTERY_SQL} select user_id, subject, topic_key, attempt_count, round(avg_quality, 6) avg_quality, round(recent_trend, 6) recent_trend from tried")
def _(spark, sf):
    tried = R.recent_trend(S.attempts(spark, sf).join(S.identities(S.cards(spark, sf), S.topics(spark, sf)), "card_id"))
    return tried.select("user_id", "subject", "topic_key", "attempt_count", F.round("avg_quality", 6).alias("avg_quality"), F.round("recent_trend", 6).alias("recent_trend"))


@query("H1_mastery", f"{MASTERY_SQL} select user_id, subject, topic_key, n attempt_count, dc due_count, oc overdue_count, lc lapse_count, round(m, 5) mastery from mm")
def _(spark, sf):
    return _mastery(spark, sf).select("user_id", "subject", "topic_key", "attempt_count", "due_count", "overdue_count", "lapse_count", F.round("mastery", 5).alias("mastery"))


@query("D3_mastery_by_topic", f"{MASTERY_SQL} select subject, topic_key, count(*) users, round(avg(m), 4) mastery, sum(n)::bigint attempts from mm group by all")
def _(spark, sf):
    return _mastery(spark, sf).groupBy("subject", "topic_key").agg(F.count("*").alias("users"), F.round(F.avg("mastery"), 4).alias("mastery"), F.sum("attempt_count").alias("attempts"))


@query("H2_swot", f"{MASTERY_SQL} select user_id, subject, topic_key, round(s, 5) strength, round(w, 5) weakness, round(o, 5) opportunity, round(t, 5) threat, bucket from sb")
def _(spark, sf):
    r = R.swot(_mastery(spark, sf))
    return r.select("user_id", "subject", "topic_key", *(F.round(c, 5).alias(c) for c in ("strength", "weakness", "opportunity", "threat")), "bucket")


@query("H3_rationale")
def _(spark, sf):
    text = F.format_string("mastery=%.1f, avg_quality=%.2f, attempts=%d, lapses=%d, due=%d, overdue=%d, trend=%.2f", "mastery", "avg_quality", "attempt_count", "lapse_count", "due_count", "overdue_count", "recent_trend")
    return _mastery(spark, sf).select("user_id", "subject", "topic_key", text.alias("rationale"))


PRIORITY_SQL = "greatest(0.0::double, 100 - m) + case bucket when 'weakness' then 28.0::double when 'threat' then 22.0::double when 'opportunity' then 14.0::double when 'strength' then 4.0::double else 12.0::double end"


@query("H7_priority", f"{MASTERY_SQL} select user_id, subject, topic_key, round({PRIORITY_SQL}, 5) priority from sb")
def _(spark, sf):
    return R.swot(_mastery(spark, sf)).select("user_id", "subject", "topic_key", F.round(R.priority(F.col("mastery"), F.col("bucket")), 5).alias("priority"))


@query("F7_priority_order", f"{MASTERY_SQL} select user_id, topic_key, row_number() over (partition by user_id order by round({PRIORITY_SQL}, 5) desc, topic_key, subject)::int as position from sb")
def _(spark, sf):
    r = R.swot(_mastery(spark, sf)).withColumn("p", F.round(R.priority(F.col("mastery"), F.col("bucket")), 5))
    return r.select("user_id", "topic_key", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("p"), "topic_key", "subject")).alias("position"))


@query("H6_state_defaults", "select event_id id, case when event_id % 3 = 0 then 0 else coalesce(nullif(event_id % 5, 0), 0) end::bigint reps, coalesce(nullif(case when event_id % 4 = 0 then 0.0::double else round(value, 2) end, 0), 2.5)::double ease from events")
def _(spark, sf):
    e = S.table(spark, sf, "events")
    ease = F.when(F.col("event_id") % 4 == 0, F.lit(0.0)).otherwise(F.round("value", 2))
    return e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("event_id") % 5).cast("long").alias("reps"), F.coalesce(F.nullif(ease, F.lit(0.0)), F.lit(2.5)).alias("ease"))


@query("E6_served_variant", f"""with {S.ATTEMPTS_SQL}, {S.CARDS_SQL}, l as (select * from attempts qualify row_number() over (partition by user_id order by attempted_at desc, id desc) <= 30),
  seen as (select user_id, card_id variant, max(attempted_at) seen_at from l group by all), r as (select u.user_id, v.variant_of_card_id canonical, v.id variant, seen_at from (select distinct user_id, card_id from attempts) u join cards v on v.variant_of_card_id = u.card_id left join seen on seen.user_id = u.user_id and seen.variant = v.id)
  select user_id, canonical, variant, seen_at is null unseen from r qualify row_number() over (partition by user_id, canonical order by seen_at nulls first, variant) = 1""")
def _(spark, sf):
    return R.served_variants(S.cards(spark, sf), S.attempts(spark, sf))


@query("E8_latest_per_user", f"with {S.ATTEMPTS_SQL} select user_id, max(attempted_at) updated_at, date_diff('second', max(attempted_at), {N}) > 300 stale from attempts group by user_id")
def _(spark, sf):
    a = S.attempts(spark, sf).groupBy("user_id").agg(F.max("attempted_at").alias("updated_at"))
    return a.withColumn("stale", F.timestamp_diff("SECOND", F.col("updated_at"), _now()) > 300)


@query("B12_card_projection", f"with {S.CARDS_SQL} select id, coalesce(variant_of_card_id, id) canonical_id, coalesce(variant_of_card_id, id) <> id is_variant, question from cards")
def _(spark, sf):
    canonical = F.coalesce("variant_of_card_id", "id")
    return S.cards(spark, sf).select("id", canonical.alias("canonical_id"), (canonical != F.col("id")).alias("is_variant"), "question")


@query("B1_equality_filters", f"with {S.TOPICS_SQL}, {S.CARDS_SQL} select c.id from cards c join topics t on t.id = c.topic_id where lower(trim(t.name)) = 'asia' and difficulty = 'easy'")
def _(spark, sf):
    t = S.topics(spark, sf).filter(F.lower(F.trim("name")) == "asia").select(F.col("id").alias("topic_id"))
    return S.cards(spark, sf).filter("difficulty = 'easy'").join(t, "topic_id", "left_semi").select("id")


SCOPE = [" Asia ", "", "EUROPE:core", "  ", "key:t3"]


@query("B3_normalise_scope", "select p_partkey id, array_to_string(list_filter(list_transform([' ' || p_brand || ' ', case when p_partkey % 3 = 0 then null else '' end, upper(p_name), '  ', p_type], lambda x: lower(trim(x))), lambda x: x <> ''), '|') scope_values from part")
def _(spark, sf):
    """A scope for each part, of names with blanks around them, blank ones and null ones."""
    given = F.array(F.concat(F.lit(" "), "p_brand", F.lit(" ")), F.when(F.col("p_partkey") % 3 != 0, F.lit("")), F.upper("p_name"), F.lit("  "), F.col("p_type"))
    return S.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(R.normalised_scope(given), "|").alias("scope_values"))


@query("B2_scope_filter", f"with {S.TOPICS_SQL}, {S.CARDS_SQL}, {S.IDENTITIES_SQL} select card_id from identities where subject in ('asia', 'europe', 'key') or topic_key in ('asia', 'europe:core', 'key:t3')")
def _(spark, sf):
    scope = [x.strip().lower() for x in SCOPE if x.strip()]
    names = {x.split(":")[0] for x in scope}
    i = S.identities(S.cards(spark, sf), S.topics(spark, sf))
    return i.filter(F.col("subject").isin(*sorted(names)) | F.col("topic_key").isin(*scope)).select("card_id")


@query("F5_session_order", f"{MASTERY_SQL}, pp as (select subject, topic_key, round({PRIORITY_SQL}, 5) p from sb where user_id = (select min(user_id) from attempts)), pr as (select subject, topic_key, row_number() over (order by p desc, topic_key, subject) r from pp) select card_id, r::int path_rank from identities left join pr using (subject, topic_key)")
def _(spark, sf):
    r = R.swot(_mastery(spark, sf)).withColumn("p", F.round(R.priority(F.col("mastery"), F.col("bucket")), 5))
    first = S.attempts(spark, sf).agg(F.min("user_id").alias("user_id"))
    own = r.join(F.broadcast(first), "user_id", "left_semi").groupBy("subject", "topic_key").agg(F.max("p").alias("p"))
    ranks = own.select("subject", "topic_key", F.row_number().over(Window.orderBy(F.desc("p"), "topic_key", "subject")).alias("path_rank"))  # topics of one user
    return S.identities(S.cards(spark, sf), S.topics(spark, sf)).join(ranks, ["subject", "topic_key"], "left").select("card_id", "path_rank")


@query("F6_client_path_rank", "select session, topic, max(pos)::int path_rank from (select user_id session, event_type || event_id % 7 topic, row_number() over (partition by user_id order by event_id) - 1 pos from events) group by session, topic")
def _(spark, sf):
    """Each user's events as the path that a client sends: topics in order, many of them several times."""
    steps = S.table(spark, sf, "events").select(F.col("user_id").alias("session"), "event_id", F.concat("event_type", (F.col("event_id") % 7).cast("string")).alias("topic"))
    return R.path_ranks(steps, "session", "event_id", "topic")


@query("H19_attempt_quality", f"with {S.ATTEMPTS_SQL} select id, case when id % 7 = 0 then 0 else greatest(quality - 2, 0) end::int quality from attempts where id % 5 <> 0")
def _(spark, sf):
    a = S.attempts(spark, sf).filter("id % 5 <> 0")  # skipped ones leave no row
    return a.select("id", F.when(F.col("id") % 7 == 0, F.lit(0)).otherwise(F.greatest(F.col("quality") - 2, F.lit(0))).cast("int").alias("quality"))


@query("L1_dashboard_totals", f"""{BASE}, t as (select user_id, count(*) total, count(*) filter (repetitions > 0) learned from states group by user_id) select user_id, total, learned, floor(learned * 100.0::double / total + 0.5)::int completion from t""")
def _(spark, sf):
    t = _states(spark, sf).groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("repetitions") > 0).alias("learned"))
    return t.withColumn("completion", F.floor(F.col("learned") * 100 / F.col("total") + 0.5).cast("int"))


TOPIC_ROWS = f"""{BASE}, named as (select c.id card_id, t.name topic from cards c join topics t on t.id = c.topic_id),
  st as (select user_id, topic, count(*) total, count(*) filter (repetitions > 0) learned, count(*) filter (due_at::date = {N}::date) due_today, count(*) filter (due_at::date < {N}::date) overdue from states join named using (card_id) group by all)"""


@query("L3_topic_rows", f"{TOPIC_ROWS} select user_id, topic, due_today + overdue queue, floor(learned * 100.0::double / total + 0.5)::int progress, case when overdue > 0 then 'Overdue' when due_today > 0 then 'Due' else 'Stable' end label from st")
def _(spark, sf):
    return _topic_rows(spark, sf)


def _topic_rows(spark, sf):
    t = S.topics(spark, sf).select(F.col("id").alias("topic_id"), F.col("name").alias("topic"))
    named = S.cards(spark, sf).select(F.col("id").alias("card_id"), "topic_id").join(t, "topic_id")
    day, today = F.to_date("due_at"), F.to_date(_now())
    st = _states(spark, sf).join(named, "card_id").groupBy("user_id", "topic").agg(F.count("*").alias("total"), F.count_if(F.col("repetitions") > 0).alias("learned"), F.count_if(day == today).alias("due_today"), F.count_if(day < today).alias("overdue"))
    label = F.when(F.col("overdue") > 0, F.lit("Overdue")).when(F.col("due_today") > 0, F.lit("Due")).otherwise(F.lit("Stable"))
    return st.select("user_id", "topic", (F.col("due_today") + F.col("overdue")).alias("queue"), F.floor(F.col("learned") * 100 / F.col("total") + 0.5).cast("int").alias("progress"), label.alias("label"))


@query("L2_topics_with_queue", f"{TOPIC_ROWS} select user_id, count(*) topics from st where due_today + overdue > 0 group by user_id")
def _(spark, sf):
    return _topic_rows(spark, sf).filter("queue > 0").groupBy("user_id").agg(F.count("*").alias("topics"))


@query("F10_topic_table_order", f"{TOPIC_ROWS} select user_id, topic, row_number() over (partition by user_id order by due_today + overdue desc, topic)::int as position from st")
def _(spark, sf):
    return _topic_rows(spark, sf).select("user_id", "topic", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("queue"), "topic")).alias("position"))


@query("L5_swot_buckets", f"{MASTERY_SQL} select user_id, subject, bucket, array_to_string(list(topic_key order by round({PRIORITY_SQL}, 5) desc, topic_key), ',') topics from sb group by all")
def _(spark, sf):
    r = R.swot(_mastery(spark, sf)).withColumn("p", F.round(R.priority(F.col("mastery"), F.col("bucket")), 5))
    rows = r.groupBy("user_id", "subject", "bucket").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("p"), "topic_key"))).alias("t"))
    return rows.select("user_id", "subject", "bucket", F.array_join(F.transform("t", lambda x: x["topic_key"]), ",").alias("topics"))


@query("F11_priority_queue", f"{MASTERY_SQL} select user_id, array_to_string(list(subject || '/' || topic_key order by round({PRIORITY_SQL}, 5) desc, topic_key, subject), ',') queue from sb group by user_id")
def _(spark, sf):
    r = R.swot(_mastery(spark, sf)).withColumn("p", F.round(R.priority(F.col("mastery"), F.col("bucket")), 5))
    rows = r.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("p"), "topic_key", "subject"))).alias("t"))
    return rows.select("user_id", F.array_join(F.transform("t", lambda x: F.concat_ws("/", x["subject"], x["topic_key"])), ",").alias("queue"))


SUMMARY_SQL = f"with {S.ATTEMPTS_SQL}, v as (select user_id, card_id, case when quality = 0 then -1 else quality end score, case when quality >= 5 then 'correct' when quality >= 3 then 'partial' else 'incorrect' end verdict from attempts)"


@query("L6_session_summary", f"{SUMMARY_SQL} select user_id, count(*) answered, count(*) filter (verdict = 'correct') correct, count(*) filter (verdict = 'partial') partial, count(*) filter (verdict <> 'correct') remediation, round(avg(score), 6) mean_score, count(distinct card_id) cards from v group by user_id")
def _(spark, sf):
    q = F.col("quality")
    v = S.attempts(spark, sf).select("user_id", "card_id", F.when(q == 0, F.lit(-1)).otherwise(q).alias("score"), F.when(q >= 5, F.lit("correct")).when(q >= 3, F.lit("partial")).otherwise(F.lit("incorrect")).alias("verdict"))
    return v.groupBy("user_id").agg(F.count("*").alias("answered"), F.count_if(F.col("verdict") == "correct").alias("correct"), F.count_if(F.col("verdict") == "partial").alias("partial"), F.count_if(F.col("verdict") != "correct").alias("remediation"), F.round(F.avg("score"), 6).alias("mean_score"), F.countDistinct("card_id").alias("cards"))


@query("L7_summary_percent", f"{SUMMARY_SQL} select user_id, floor(count(*) filter (verdict = 'correct') * 100.0::double / count(*) + 0.5)::int percent, least(100.0::double, greatest(0.0::double, round(avg(score) * 20, 6))) score_percent from v group by user_id")
def _(spark, sf):
    q = F.col("quality")
    v = S.attempts(spark, sf).groupBy("user_id").agg((F.count_if(q >= 5) * 100 / F.count("*")).alias("p"), F.avg(F.when(q == 0, F.lit(-1)).otherwise(q)).alias("m"))
    return v.select("user_id", F.floor(F.col("p") + 0.5).cast("int").alias("percent"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.round(F.col("m") * 20, 6))).alias("score_percent"))


STAGE_SQL = f"""{MASTERY_SQL}, p as (select user_id, topic_key, row_number() over (partition by user_id order by round({PRIORITY_SQL}, 5) desc, topic_key, subject) - 1 pos, m from sb),
  st as (select user_id, topic_key, case when m >= 80 then 'completed' when pos = user_id % 7 then 'current' when pos > user_id % 7 + 5 then 'locked' else 'upcoming' end status from p)"""


def _stages(spark, sf):
    r = R.swot(_mastery(spark, sf)).withColumn("p", F.round(R.priority(F.col("mastery"), F.col("bucket")), 5))
    r = r.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("p"), "topic_key", "subject")) - 1)
    cursor = F.col("user_id") % 7
    status = F.when(F.col("mastery") >= 80, F.lit("completed")).when(F.col("pos") == cursor, F.lit("current")).when(F.col("pos") > cursor + 5, F.lit("locked")).otherwise(F.lit("upcoming"))
    return r.select("user_id", "topic_key", status.alias("status"))


@query("E9_stage_status", f"{STAGE_SQL} select user_id, topic_key, status from st")
def _(spark, sf):
    return _stages(spark, sf)


@query("L4_path_progress", f"{STAGE_SQL} select user_id, count(*) filter (status = 'completed') completed, count(*) filter (status = 'locked') locked, floor(count(*) filter (status = 'completed') * 100.0::double / count(*) + 0.5)::int progress from st group by user_id")
def _(spark, sf):
    s = F.col("status")
    g = _stages(spark, sf).groupBy("user_id").agg(F.count_if(s == "completed").alias("completed"), F.count_if(s == "locked").alias("locked"), F.count("*").alias("n"))
    return g.select("user_id", "completed", "locked", F.floor(F.col("completed") * 100 / F.col("n") + 0.5).cast("int").alias("progress"))


@query("O3_progress", f"with {S.ATTEMPTS_SQL}, c as (select user_id, count(*) total, count(*) filter (quality > 0) as cursor from attempts group by user_id) select user_id, cursor as position, total, cursor >= total completed from c")
def _(spark, sf):
    c = S.attempts(spark, sf).groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("quality") > 0).alias("position"))
    return c.withColumn("completed", F.col("position") >= F.col("total"))


@query("C6_full_outer_nodes", f"""{MASTERY_SQL}, a as (select distinct subject, topic_key from identities where card_id % 2 = 0), b as (select distinct subject, topic_key, 0.5::double w from identities where card_id % 3 = 0)
  select coalesce(a.subject, b.subject) subject, coalesce(a.topic_key, b.topic_key) topic_key, a.subject is not null in_a, coalesce(w, 0.0::double) w from a full join b on a.subject = b.subject and a.topic_key = b.topic_key""")
def _(spark, sf):
    i = S.identities(S.cards(spark, sf), S.topics(spark, sf))
    a = i.filter("card_id % 2 = 0").select("subject", "topic_key").distinct().withColumn("in_a", F.lit(True))
    b = i.filter("card_id % 3 = 0").select("subject", "topic_key").distinct().withColumn("w", F.lit(0.5))
    return a.join(b, ["subject", "topic_key"], "full").select("subject", "topic_key", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("w", F.lit(0.0)).alias("w"))


@query("F12_key_set_union", f"with {S.TOPICS_SQL}, {S.CARDS_SQL}, {S.IDENTITIES_SQL} select topic_key from identities where card_id % 2 = 0 union select topic_key from identities where card_id % 5 = 0")
def _(spark, sf):
    i = S.identities(S.cards(spark, sf), S.topics(spark, sf))
    return i.filter("card_id % 2 = 0").select("topic_key").union(i.filter("card_id % 5 = 0").select("topic_key")).distinct()


@query("F19_record_attempt", f"{BASE} select user_id, count(*) cards, sum(reviews)::bigint attempts, sum(interval_days)::bigint interval_days from states group by user_id")
def _(spark, sf):
    return _states(spark, sf).groupBy("user_id").agg(F.count("*").alias("cards"), F.sum("reviews").alias("attempts"), F.sum("interval_days").alias("interval_days"))
