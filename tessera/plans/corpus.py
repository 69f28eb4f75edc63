"""Corpus queries: documents and web pages as books."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus as C
from ..sources import relations as S
from .registry import query
from .retrieval import KEY_TERMS_SQL, key_terms

LINES_SQL = "ln as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos from documents)"
W_SQL = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"


def _lines(spark, sf):
    d = S.table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


@query("A5_line_scan", f"with {LINES_SQL} select doc_id, pos::int pos, line from ln")
def _(spark, sf):
    return _lines(spark, sf)


@query("G2_collapse_repeats", f"with {LINES_SQL}, w as (select doc_id, pos, {W_SQL.format('line')} w from ln) select doc_id, pos::int pos, array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: case when i > 2 and w[i] = w[i - 1] and w[i] = w[i - 2] then null else w[i] end), lambda x: x is not null), ' ') line from w")
def _(spark, sf):
    return _lines(spark, sf).select("doc_id", "pos", C.collapse_repeats(F.col("line")).alias("line"))


SENT_SQL = "list_filter(list_transform(regexp_extract_all(trim(line), '[^.!?]*[.!?]'), lambda s: trim(s)), lambda s: s <> '')"


@query("G3_sentence_dedup", f"with {LINES_SQL}, s as (select doc_id, pos, line, {SENT_SQL} s from ln) select doc_id, pos::int pos, case when len(s) = 0 then line else array_to_string(list_filter(list_transform(range(1, len(s) + 1), lambda i: case when i > 1 and s[i] = s[i - 1] then null else s[i] end), lambda x: x is not null), ' ') end line from s")
def _(spark, sf):
    return _lines(spark, sf).select("doc_id", "pos", C.dedup_sentences(F.col("line")).alias("line"))


@query("G4_noisy_lines", f"with {LINES_SQL} select doc_id, count(*) filter (trim(line) <> '' and not regexp_matches(trim(line), '^[#*+-]') and length(trim(line)) < 8) noisy, count(*) filter (regexp_matches(trim(line), '^(Figure|Table)\\s+\\d')) captions from ln group by doc_id")
def _(spark, sf):
    return _lines(spark, sf).groupBy("doc_id").agg(F.count_if(C.noisy_line(F.col("line"))).alias("noisy"), F.count_if(C.caption_line(F.col("line"))).alias("captions"))


@query("D9_dominant_token", f"with w as (select doc_id, {W_SQL.format('trim(coalesce(text, chr(32)))')} w from documents), c as (select doc_id, t, count(*) n from (select doc_id, unnest(w) t from w) group by all), m as (select doc_id, max(n) best, sum(n) total from c group by doc_id) select w.doc_id, round(coalesce(best / total, 0), 9) ratio from w left join m using (doc_id)")
def _(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", F.round(C.dominant_ratio(F.coalesce("text", F.lit(" "))), 9).alias("ratio"))


@query("G5_noisy_paragraph", f"""with p as (select doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') j from documents), w as (select doc_id, j, {W_SQL.format('j')} w from p),
  c as (select doc_id, max(n) top from (select doc_id, t, count(*) n from (select doc_id, unnest(w) t from w) group by all) group by doc_id)
  select w.doc_id, length(j) >= 80 and (coalesce(top, 0) / greatest(len(w), 1) >= 0.4 or (coalesce(top, 0) >= 20 and len(w) > 40)) noisy from w left join c using (doc_id)""")
def _(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", C.noisy_paragraph(F.split(F.coalesce("text", F.lit("")), "\n")).alias("noisy"))


def _books(spark, sf):
    """Documents as books: every fifth line becomes a heading, whose level follows from its place."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    made = F.transform(lines, lambda x, i: F.when(i % 5 == 4, F.concat(F.repeat(F.lit("#"), i % 4 + 1), F.lit(" "), F.substring(x, 1, 30))).when(i % 7 == 6, F.concat(F.lit("\n"), x)).otherwise(x))
    return S.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("book_id"), F.concat(F.lit("## Start here\n"), F.array_join(made, "\n")).alias("text"))


BOOKS_SQL = """bl as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 i from documents),
  books as (select doc_id::varchar book_id, '## Start here' || chr(10) || string_agg(case when i % 5 = 4 then repeat('#', (i % 4 + 1)::int) || ' ' || substr(x, 1, 30) when i % 7 = 6 then chr(10) || x else x end, chr(10) order by i) as text from bl group by doc_id)"""


@query("G6_clean_books", f"""with {BOOKS_SQL}, pg as (select book_id, p, unnest(string_split(b, chr(10))) line, generate_subscripts(string_split(b, chr(10)), 1) pos from (select book_id, unnest(ps) b, generate_subscripts(ps, 1) p from (select book_id, regexp_split_to_array(text, '\\n[ \\t\\r]*(?:\\n[ \\t\\r]*)+') ps from books))),
  l as (select * from pg where trim(line) <> ''), j as (select book_id, p, string_agg(trim(line), ' ' order by pos) j from l group by all), w as (select book_id, p, j, {W_SQL.format('j')} w from j),
  t as (select book_id, p, max(n) top from (select book_id, p, t, count(*) n from (select book_id, p, unnest(w) t from w) group by all) group by all),
  ok as (select w.book_id, w.p from w join t using (book_id, p) where not (length(j) >= 80 and (top / greatest(len(w), 1) >= 0.4 or (top >= 20 and len(w) > 40)))),
  k as (select l.book_id, l.p, l.pos, {W_SQL.format('line')} w from l join ok using (book_id, p) where not (not regexp_matches(trim(line), '^[#*+-]') and length(trim(line)) < 8) and not regexp_matches(trim(line), '^(Figure|Table)\\s+\\d')),
  c as (select book_id, p, pos, array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: case when i > 2 and w[i] = w[i - 1] and w[i] = w[i - 2] then null else w[i] end), lambda x: x is not null), ' ') line from k),
  s as (select book_id, p, pos, line, {SENT_SQL} s from c), d as (select book_id, p, pos, case when len(s) = 0 then line else array_to_string(list_filter(list_transform(range(1, len(s) + 1), lambda i: case when i > 1 and s[i] = s[i - 1] then null else s[i] end), lambda x: x is not null), ' ') end line from s),
  pp as (select ok.book_id, ok.p, coalesce(string_agg(line, chr(10) order by pos) || chr(10), '') as text from ok left join d using (book_id, p) group by all)
  select b.book_id, coalesce(string_agg(pp.text, chr(10) order by p), '') as text from books b left join pp using (book_id) group by b.book_id""")
def _(spark, sf):
    return C.cleaned(_books(spark, sf)).select("book_id", "text")


SECTIONS_SQL = f"""{BOOKS_SQL}, sl as (select book_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) pos from books),
  s1 as (select *, case when regexp_matches(line, '^#{{2,4}}\\s+') then length(regexp_extract(line, '^(#{{2,4}})\\s', 1)) end lv, trim(regexp_extract(line, '^#{{2,4}}\\s+(.*)', 1)) head from sl),
  s2 as (select *, count(lv) over (partition by book_id order by pos) sec from s1),
  hd as (select book_id, sec, lv, head, max(case when lv = 2 then sec end) over w a, max(case when lv = 3 then sec end) over w b, max(case when lv = 4 then sec end) over w c from s2 where lv is not null window w as (partition by book_id order by sec)),
  hp as (select h.book_id, h.sec, h.head, coalesce(x.head, '') || case when h.lv >= 3 then ' > ' || coalesce(case when h.b >= coalesce(h.a, 0) then y.head end, '') else '' end || case when h.lv >= 4 then ' > ' || h.head else '' end header_path
    from hd h left join hd x on x.book_id = h.book_id and x.sec = h.a left join hd y on y.book_id = h.book_id and y.sec = h.b),
  bo as (select book_id, sec, regexp_replace(string_agg(line, chr(10) order by pos), '^\\s+|\\s+$', '', 'g') as text from s2 where sec > 0 and lv is null group by all),
  secs as (select book_id, row_number() over (partition by book_id order by sec) - 1 n, header_path, head, text from hp join bo using (book_id, sec) where text <> '')"""


@query("G7_structural_sections", f"with {SECTIONS_SQL} select book_id, n::int n, book_id || '::chunk_' || lpad(n::varchar, 5, '0') id, header_path, text from secs")
def _(spark, sf):
    return C.sections(_books(spark, sf)).select("book_id", "n", "id", "header_path", "text")


@query("E10_header_stack", f"with {SECTIONS_SQL} select book_id, count(*) sections, count(distinct header_path) paths, max(length(header_path) - length(replace(header_path, ' > ', '')))::int // 3 depth from secs group by book_id")
def _(spark, sf):
    s = C.sections(_books(spark, sf))
    return s.groupBy("book_id").agg(F.count("*").alias("sections"), F.countDistinct("header_path").alias("paths"), F.floor(F.max(F.length("header_path") - F.length(F.replace("header_path", F.lit(" > "), F.lit("")))) / 3).cast("int").alias("depth"))


@query("G8_chunk_type", f"with {S.CHUNKS_SQL} select id, chunk_type from chunks")
def _(spark, sf):
    return S.chunks(spark, sf).select("id", "chunk_type")


EXCL_SQL = f"(chunk_type in {C.EXCLUDED_TYPES!r} or " + " or ".join(f"contains(lower(header_path), '{h}')" for h in C.EXCLUDED_HEADERS) + ")"


@query("B4_qa_excluded", f"with {S.CHUNKS_SQL} select id, {EXCL_SQL} excluded from chunks")
def _(spark, sf):
    return S.chunks(spark, sf).select("id", C.excluded(F.col("chunk_type"), F.col("header_path")).alias("excluded"))


@query("D8_key_terms", f"with {S.CHUNKS_SQL}, {KEY_TERMS_SQL} select id, array_to_string(key_terms, ' ') key_terms from kt")
def _(spark, sf):
    return key_terms(S.chunks(spark, sf)).select("id", F.array_join("key_terms", " ").alias("key_terms"))


CONCEPT_SQL = """cc as (select *, regexp_replace(trim(split_part(header_path, '>', -1)), '^[0-9.\\s]+', '') seg from chunks), cn as (select *, trim(case when starts_with(lower(seg), 'what is ') then substr(seg, 9) when starts_with(lower(seg), 'definition of ') then substr(seg, 15)
  when starts_with(lower(seg), 'introduction to ') then substr(seg, 17) when starts_with(lower(seg), 'overview of ') then substr(seg, 13) else seg end) concept from cc)"""


@query("G9_main_concept", f"with {S.CHUNKS_SQL}, {CONCEPT_SQL} select id, concept from cn")
def _(spark, sf):
    return S.chunks(spark, sf).select("id", X.main_concept(F.col("header_path")).alias("concept"))


QUESTION_SQL = f"""{S.CHUNKS_SQL}, {CONCEPT_SQL}, {KEY_TERMS_SQL}, pq as (select cn.id, book_id, subject, header_path, chunk_type, key_terms, case when concept = '' then case when len(coalesce(key_terms, [])) > 0 then ['Explain ' || array_to_string(key_terms[1:2], ' ') || '.'] else [] end
  when chunk_type = 'definition' then ['Why is ' || concept || ' important in real systems?', 'What trade-offs are involved in ' || concept || '?'] when chunk_type = 'algorithm' then ['How does ' || concept || ' work?', 'What are the key steps and edge cases in ' || concept || '?']
  when chunk_type = 'protocol' then ['How does the ' || concept || ' protocol work end-to-end?', 'What design trade-offs does the ' || concept || ' protocol make?'] else ['Explain how ' || concept || ' behaves in practice.'] end pq from cn left join kt on kt.id = cn.id)"""


def _with_questions(spark, sf):
    c = S.chunks(spark, sf)
    c = c.join(key_terms(c), "id", "left")
    return c.withColumn("pq", C.potential_questions(F.col("header_path"), F.col("chunk_type"), F.col("key_terms")))


@query("G10_potential_questions", f"with {QUESTION_SQL} select id, array_to_string(pq, '|') questions from pq")
def _(spark, sf):
    return _with_questions(spark, sf).select("id", F.array_join("pq", "|").alias("questions"))


@query("G11_corpus_build", f"with {QUESTION_SQL} select id, book_id, chunk_type, array_to_string(coalesce(key_terms, []), ' ') key_terms, array_to_string(pq, '|') questions from pq where not {EXCL_SQL}")
def _(spark, sf):
    c = _with_questions(spark, sf).filter(~C.excluded(F.col("chunk_type"), F.col("header_path")))
    return c.select("id", "book_id", "chunk_type", F.coalesce(F.array_join("key_terms", " "), F.lit("")).alias("key_terms"), F.array_join("pq", "|").alias("questions"))


@query("B7_book_subject", "select doc_id, case when contains(b, 'computer networking') then 'cn' when contains(b, 'database system') then 'dbms' when contains(b, 'modern operating') then 'os' else 'os' end subject from (select doc_id, lower((['Computer Networking 6', 'Database Systems', 'Modern Operating', 'Other'])[doc_id % 4 + 1]) b from documents)")
def _(spark, sf):
    book = F.element_at(F.array(*map(F.lit, ("Computer Networking 6", "Database Systems", "Modern Operating", "Other"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return S.table(spark, sf, "documents").select("doc_id", C.book_subject(book).alias("subject"))


def _terms(col, terms):
    return "(" + " or ".join(f"contains({col}, '{t}')" for t in terms) + ")"


@query("B8_text_subject", f"with {S.CHUNKS_SQL}, t as (select id, case when id % 3 = 0 then subject else '' end tag, lower(header_path) h, lower(substr(text, 1, 500)) t from chunks) select id, case when tag <> '' then tag when {_terms('h', C.DBMS_TERMS)} or {_terms('t', C.DBMS_TERMS)} then 'dbms' when {_terms('h', C.CN_TERMS)} or {_terms('t', C.CN_TERMS)} then 'cn' else 'os' end subject from t")
def _(spark, sf):
    c = S.chunks(spark, sf)
    return c.select("id", C.text_subject(F.when(F.col("id") % 3 == 0, F.col("subject")).otherwise(F.lit("")), F.col("header_path"), F.col("text")).alias("subject"))


@query("B5_generation_filter", f"with {S.CHUNKS_SQL} select id from chunks where chunk_type not in ('exercise', 'references', 'bibliography', 'citations') and not regexp_matches(lower(header_path), 'references|bibliography|further reading|exercises') and chunk_type in ('section', 'definition', 'algorithm', 'protocol', 'theorem', 'example') and subject = 'en'")
def _(spark, sf):
    c = S.chunks(spark, sf)
    kinds = F.col("chunk_type").isin("section", "definition", "algorithm", "protocol", "theorem", "example")
    return c.filter(kinds & (F.col("subject") == "en") & ~X.contains_any(F.lower("header_path"), ("references", "bibliography", "further reading", "exercises"))).select("id")


SLUG_SQL = "coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '-+$', ''), ''), 'core')"


@query("G12_slug_and_display", f"with {S.CHUNKS_SQL}, s as (select id, subject || ':' || {SLUG_SQL.format('header_path')} as key from chunks) select id, key from s")
def _(spark, sf):
    return S.chunks(spark, sf).select("id", X.topic_key(F.col("subject"), F.col("header_path")).alias("key"))


@query("B9_seed_topic_key", f"with {S.CHUNKS_SQL} select id, case when id % 4 = 0 then 'given:key' else subject || ':' || {SLUG_SQL.format('trim(split_part(header_path, chr(62), -1))')} end topic_key from chunks")
def _(spark, sf):
    c = S.chunks(spark, sf)
    explicit = F.when(F.col("id") % 4 == 0, F.lit("given:key"))
    return c.select("id", F.coalesce(explicit, X.topic_key(F.col("subject"), X.last_header(F.col("header_path")))).alias("topic_key"))


@query("B10_backfill_topic_key", f"with {S.CARDS_SQL} select id, case when topic_key is null then 'os:' || {SLUG_SQL.format('question')} else topic_key end topic_key from cards")
def _(spark, sf):
    c = S.cards(spark, sf)
    return c.select("id", F.coalesce("topic_key", X.topic_key(F.lit("os"), F.col("question"))).alias("topic_key"))


REMAP = [("os:paging", ("small", "page")), ("os:memory", ("red", "paging")), ("cn:routing", ("widget", "route")), ("dbms:keys", ("key:t3", "blue")), ("os:core", ("memory",))]


def _remap_sql(sql="topic_key"):
    for to, found in REMAP:
        hit = " or ".join(f"contains(lower(coalesce(question, '')), '{w}') or contains(lower(coalesce({sql}, '')), '{w}')" for w in found)
        sql = f"(case when ({hit}) and {sql} is distinct from '{to}' then '{to}' else {sql} end)"
    return sql


@query("B11_topic_remap", f"with {S.CARDS_SQL} select id, {_remap_sql()} topic_key from cards")
def _(spark, sf):
    rules = [(to, tuple(f"%{w}%" for w in found)) for to, found in REMAP]
    return C.remapped(S.cards(spark, sf), rules, text="question").select("id", "topic_key")


def _remap_rules() -> list[tuple[str, tuple[str, ...]]]:
    """As many rules as a migration of three subjects has: 70 with 440 patterns. Later rules match keys that earlier ones write."""
    out = []
    for subject, rules, patterns in (("cn", 32, 160), ("dbms", 19, 130), ("os", 19, 150)):
        sizes = [patterns // rules + (k < patterns % rules) for k in range(rules)]
        out += [(f"{subject}:topic-{k}", tuple(f"{subject}:%{('w', 'topic-')[i % 5 == 4]}{(7 * k + 3 * i) % 97}%" for i in range(n))) for k, n in enumerate(sizes)]
    return out


def _remap_steps() -> str:
    steps = ["k0 as (select p_partkey::bigint id, (['cn', 'dbms', 'os'])[p_partkey % 3 + 1] || ':w' || (p_partkey % 97)::varchar || '-' || (p_partkey % 7)::varchar k from part)"]
    for n, (to, found) in enumerate(_remap_rules()):
        hit = " or ".join(f"k like '{p}'" for p in found)
        steps.append(f"k{n + 1} as (select id, case when k <> '{to}' and ({hit}) then '{to}' else k end k from k{n})")
    return ", ".join(steps)


@query("B11_remap_rule_table", f"with {_remap_steps()} select id, k topic_key from k{len(_remap_rules())}")
def _(spark, sf):
    p = F.col("p_partkey")
    subject = F.element_at(F.array(*(F.lit(x) for x in ("cn", "dbms", "os"))), (p % 3 + 1).cast("int"))
    keys = S.table(spark, sf, "part").select(p.cast("long").alias("id"), F.concat(subject, F.lit(":w"), (p % 97).cast("string"), F.lit("-"), (p % 7).cast("string")).alias("topic_key"))
    return C.remapped(keys, _remap_rules())


@query("B13_snippets", f"with {S.CHUNKS_SQL} select id, case when length(text) > 300 then substr(text, 1, 300) || '...' else text end s300, substr(text, 1, 600) s600, case when length(text) > 200 then substr(text, 1, 200) || '…' else text end s200 from chunks")
def _(spark, sf):
    t = F.col("text")
    return S.chunks(spark, sf).select("id", X.snippet(t, 300).alias("s300"), F.substring(t, 1, 600).alias("s600"), X.snippet(t, 200, "…").alias("s200"))


@query("O2_answer_projection", f"with {S.CHUNKS_SQL} select id, header_path, substr(text, 1, 600) explanation, id % 2 = 0 correct from chunks")
def _(spark, sf):
    return S.chunks(spark, sf).select("id", "header_path", F.substring("text", 1, 600).alias("explanation"), (F.col("id") % 2 == 0).alias("correct"))


@query("G13_subject_context", f"with {S.CHUNKS_SQL}, r as (select subject, trim(split_part(header_path, '>', -1)) h, row_number() over (partition by subject order by pos) r from chunks) select subject, array_to_string(list_sort(list_distinct(list(h))), '|') headers from r where r <= 120 group by subject")
def _(spark, sf):
    c = S.chunks(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("subject").orderBy("pos"))).filter("r <= 120")
    return c.groupBy("subject").agg(F.array_join(F.array_sort(F.collect_set(X.last_header(F.col("header_path")))), "|").alias("headers"))


@query("G14_candidate_topics", f"with {S.CHUNKS_SQL}, k as (select subject, subject || ':' || {SLUG_SQL.format('trim(split_part(header_path, chr(62), -1))')} topic_key, min(pos) p from chunks group by all) select subject, topic_key, row_number() over (partition by subject order by p)::int as position from k qualify row_number() over (partition by subject order by p) <= 60")
def _(spark, sf):
    k = S.chunks(spark, sf).groupBy("subject", X.topic_key(F.col("subject"), X.last_header(F.col("header_path"))).alias("topic_key")).agg(F.min("pos").alias("p"))
    return k.withColumn("position", F.row_number().over(Window.partitionBy("subject").orderBy("p"))).filter("position <= 60").select("subject", "topic_key", "position")


@query("G15_content_hash")
def _(spark, sf):
    return S.chunks(spark, sf).select("id", C.content_hash("id", "book_id", "header_path", "chunk_type", "text", "subject").alias("hash"))


@query("G16_vector_literal", "select vec_id, embedding[1]::double v from embeddings")
def _(spark, sf):
    v = S.table(spark, sf, "embeddings")
    text = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: F.format_string("%.8f", x.cast("double"))), ","), F.lit("]"))
    # the literal is read back: its first component agrees to eight places
    first = F.regexp_extract(text, r"^\[([^,]+)", 1).cast("double")
    return v.select("vec_id", F.when(F.abs(first - F.col("embedding")[0].cast("double")) < 1e-8, F.col("embedding")[0].cast("double")).alias("v"))


@query("G18_prompt_text", f"with {S.CHUNKS_SQL} select id, 'Subject: ' || subject || chr(10) || 'Section: ' || header_path || chr(10) || 'Before: ' || coalesce(lag(header_path) over w, '') || chr(10) || 'Text: ' || substr(text, 1, 400) prompt from chunks window w as (partition by book_id order by pos, id)")
def _(spark, sf):
    w = Window.partitionBy("book_id").orderBy("pos", "id")
    return S.chunks(spark, sf).select("id", F.concat(F.lit("Subject: "), "subject", F.lit("\nSection: "), "header_path", F.lit("\nBefore: "), F.coalesce(F.lag("header_path").over(w), F.lit("")), F.lit("\nText: "), F.substring("text", 1, 400)).alias("prompt"))


@query("O6_dimension_check", "select len(embedding)::int dims, count(*) n from embeddings group by all")
def _(spark, sf):
    return S.table(spark, sf, "embeddings").groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"))


@query("O11_subject_list", "select distinct coalesce(nullif(lower(trim(lang)), ''), 'unknown') subject from documents order by 1")
def _(spark, sf):
    return S.table(spark, sf, "documents").select(F.coalesce(F.nullif(F.lower(F.trim("lang")), F.lit("")), F.lit("unknown")).alias("subject")).distinct().orderBy("subject")
