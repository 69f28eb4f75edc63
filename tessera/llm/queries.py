"""The dealt queries: thin digests of what the operators of this subpackage return, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, codes, lines, merkle, mixing, quality, secrets, simhash, substring, topk, warc
from .common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its fingerprint, and the smallest doc_id that links of at most 4 bits reach."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, seed=42, max_bits=4).select("doc_id", "fingerprint", "component_id")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hundredth vector's ten best partners among all others, by integer inner product."""
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024.0).select("query_id", "rank", "vec_id", "score")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats every conversation, and digests what is read back from the windows."""
    odd = "</s>[INST] ok [/INST]"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql(f"select -7L conv_id, 0L turn, 'user' role, '{odd}' text union all select -7L, 1L, 'assistant', '{odd}'")
    back = chat.read_back(chat.windows(turns.unionByName(more)))
    whole = back.groupBy("conv_id").agg(
        F.sum(F.size("turns")).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"),
        F.sum("chars").alias("formatted_chars"),
    )
    said = F.array_join(F.transform(F.flatten(F.transform("w", lambda w: w["turns"])), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.flatten(F.transform("w", lambda w: w["targets"])), "")
    return whole.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes the words of every 13-word window that a document with a smaller id has too."""
    return substring.dedup(_table(spark, sf_dir, "documents"), length=13).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, how alike they and the next document's are, and where the tree locates the edit."""
    return merkle.with_next(_table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edit_at")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document; digests of the ids and of the decoded bytes."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, vocabulary, public_tokenizers.PATTERN, keep=["doc_id"], decoded_col="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes lines that occur on ten sites or more out of every document, but for their first occurrence."""
    found = lines.dedup(_table(spark, sf_dir, "documents"), min_sites=10)
    return found.select("doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_removed").alias("n_removed"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of 150 % of all sizes takes of every document."""
    mix = mixing.Mix(_table(spark, sf_dir, "documents"))
    sources = spark.createDataFrame([(s.name, s.size, s.target) for s in mix.sources], "source string, source_size long, target double")
    taken = mix.taken().withColumn("source", F.element_at(F.from_json("pattern", "array<string>"), 1))
    return taken.join(F.broadcast(sources), taken["source"].eqNullSafe(sources["source"])).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; learns from labels that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the secrets in every document."""
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE_RULES]

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *(F.expr(f"size(filter(secrets, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in base),
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes every vector by four codebooks of 256 entries, with its error and its label's."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = codes.fit(vectors)
    coded = Scratch(spark).table(codes.encode(vectors, books, keep=["vec_id", "label"]), "codes")
    total = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    code = F.concat_ws("", F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return coded.join(total, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligns the tokens of two tokenizers in every document, and scores its links by corpus counts."""
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = align.align(_table(spark, sf_dir, "documents").select("doc_id", "text"), a, b, keep=["doc_id"], pattern=public_tokenizers.PATTERN)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.encode("alignment", "UTF-8"), 256)).otherwise("")
    kept = Scratch(spark).table(found.withColumn("groups_sha256", digest).drop("alignment"), "aligned")
    return align.scored(kept, align.piece_count(b)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page to WARC archives and reads them back, revisits resolved."""
    scratch = Scratch(spark)
    archives = warc.write(_table(spark, sf_dir, "pages"), f"{scratch.root}/archives")
    found = scratch.table(warc.read(archives).drop("fields", "payload"), "records")
    return warc.resolved(found).select(F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_exact_topk, op3_chat_format, op4_substring_dedup, op5_merkle_fingerprints, op6_byte_bpe, op7_line_dedup, op8_source_mixing, op9_quality_classifier, op10_secret_scan, op11_vector_codes, op12_tokenizer_alignment, op13_warc_archives)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat_format": r"""
            with c as (select conv_id id, turn, coalesce(role, '') role, coalesce(text, '') txt from conversations
                       union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
            e as (select *, coalesce(floor(turn / 256.0)::bigint, -4611686018427387904) chunk,
                  regexp_replace(replace(txt, '\', '\\'), '(<)(/?s>|<SYS>>|</SYS>>|\|[a-z_]+\|>)|(\[)(/?INST\])', '\1\3\\-\2\4', 'g') body,
                  '<|im_start|>' || replace(regexp_replace(replace(role, '\', '\\'), '(<)(/?s>|<SYS>>|</SYS>>|\|[a-z_]+\|>)|(\[)(/?INST\])', '\1\3\\-\2\4', 'g'), chr(10), '\n') || chr(10) head from c),
            n as (select *, (ceil(length(head || body) / 4.0) + 4)::bigint n, row_number() over (partition by id order by turn nulls first, role, txt) o,
                  min(chunk) over (partition by id) = max(chunk) over (partition by id) one from e),
            s as (select *, case when role = 'system' and o = min(case when role = 'system' then o end) over (partition by id) then 1 else 0 end sy from n),
            b as (select *, coalesce(sum(n) over (partition by id order by o rows between unbounded preceding and 1 preceding), 0)::bigint p,
                  coalesce(max(case when sy = 1 then o end) over (partition by id), 1e18) so, max(sy * length(head || body || '<|im_end|>.')) over (partition by id) sl,
                  greatest(1024 - 256 - max(sy * n) over (partition by id), 64) step from s),
            w as (select *, 2 * (p // step) + case when (p + n - 1) // step > p // step then 1 else 0 end win from b),
            g as (select *, win is distinct from lag(win) over (partition by id order by o) opens from w),
            h as (select a.id, sum(length(b.head || b.body || '<|im_end|>.')) chars from g a join g b on a.id = b.id and a.opens and b.sy = 0 and b.o between a.o - 4 and a.o - 1 and a.p - b.p <= 256 group by a.id),
            r as (select id, count(*) n_turns, sha256(string_agg(role || chr(10) || txt || chr(10), '' order by o)) turns_sha256,
                  coalesce(string_agg(txt, '' order by o) filter (role = 'assistant'), '') loss,
                  sum(length(head || body || '<|im_end|>.') + case when opens and so < o then sl else 0 end)::bigint chars, bool_and(one) one from g group by id)
            select r.id conv_id, n_turns, turns_sha256, length(loss) loss_chars, sha256(loss) loss_sha256, (r.chars + coalesce(h.chars, 0))::bigint formatted_chars
            from r left join h using (id)""",
        "op7_line_dedup": """
            with l as (select doc_id, coalesce(source, chr(0)) source, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) pos from documents),
            b as (select line, min({'d': doc_id, 'p': pos}) first from l where trim(line) <> '' group by line having count(distinct source) >= 10),
            k as (select l.doc_id, count(*) n_lines, count(*) filter (gone) n_removed, coalesce(string_agg(l.line, chr(10) order by l.pos) filter (not gone), '') kept
                  from (select l.*, b.first is not null and b.first <> {'d': l.doc_id, 'p': l.pos} gone from l left join b using (line)) l group by l.doc_id)
            select d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from documents d left join k using (doc_id)""",
        "op8_source_mixing": """
            with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint size, ('0x' || substr(md5('7:' || doc_id), 1, 15))::bigint u from documents),
            s as (select source, sum(size)::bigint source_size, [3, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3] w from d group by source),
            o as (select *, row_number() over (order by 2 * source_size / w, source nulls last) k from s),
            f as (select *, (3 * sum(source_size) over () - 2 * coalesce(sum(2 * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0))::double
                  / (2 * sum(w) over (order by k rows between current row and unbounded following))::double as level from o),
            m as (select coalesce(min_by(level, k) filter (level <= 2 * source_size / w), max_by(level, k)) as level from f),
            t as (select o.source, source_size, least(2.0 * source_size, m.level * w)::double target from o, m),
            q as (select *, floor(target + 0.5)::bigint quota, case when source_size = 0 then 0 else floor(target + 0.5)::bigint // source_size end passes from t),
            r as (select *, quota - passes * source_size rest from q),
            c as (select d.*, r.source_size, r.target, r.passes, r.rest, sum(d.size) over (partition by d.source order by u, doc_id::varchar, d.size) as total from d join r on d.source is not distinct from r.source),
            g0 as (select source, rest - coalesce(max(total) filter (total <= rest), 0) gap, []::struct(u bigint, k varchar)[] more from c where rest > 0 group by source, rest),
            """
        + ",\n            ".join(
            f"""e{i} as (select c.source, min({{'off': {off}, 'u': u, 'k': doc_id::varchar, 's': c.size}}) b from c join g{i - 1} g on c.source is not distinct from g.source
                  where c.total > c.rest and c.size > 0 and g.gap > 0 and {fits} and not list_contains(g.more, {{'u': u, 'k': doc_id::varchar}}) group by c.source),
            g{i} as (select g.source, gap - coalesce(b.s, 0) gap, case when b is null then more else list_append(more, {{'u': b.u, 'k': b.k}}) end more from g{i - 1} g left join e{i} e on g.source is not distinct from e.source)"""
            for i, off, fits in [*((k, "-c.size", "c.size <= g.gap") for k in range(1, mixing.GAP_ROUNDS)), (mixing.GAP_ROUNDS, "abs(c.size - g.gap)", "c.size < 2 * g.gap")]
        )
        + """
            select c.doc_id, c.size, c.source_size, c.target, (c.size * (passes + case when (rest > 0 and total <= rest) or list_contains(g.more, {'u': u, 'k': doc_id::varchar}) then 1 else 0 end))::bigint taken
            from c left join g"""
        + str(mixing.GAP_ROUNDS)
        + " g on c.source is not distinct from g.source",
        "op2_exact_topk": """
            with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) e from embeddings
                       where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
            s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint score
                  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
            r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
            select query_id, rank, vec_id, score from r where rank <= 10""",
        "op11_vector_codes": _codes_sql(),
        "op13_warc_archives": """
            with p as (select page_id, coalesce(html, '') h from pages),
            t as (select page_id, strlen(h)::bigint n, sha1(h) s, case when strlen(h) >= 1000 then max(page_id) over (partition by h) end top from p),
            r as (select *, top is not null and page_id is distinct from top again from t)
            select page_id, n payload_bytes, s payload_digest, case when again then 'revisit' else 'response' end record_type, case when again then top end refers_to from r""",
    }


def _codes_sql(rounds: int = 4) -> str:
    """Distances as |x|^2 - 2 x.c + |c|^2 over whole doubles, which are exact here."""
    near = """select p.part, p.id, min({{'d': list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x), 'i': b.i}}) m from p join b{k} b on p.part = b.part group by p.part, p.id"""
    step = (
        """a{k} as materialized ("""
        + near
        + """),
            s{k} as (select part, i, list(floor(t / n) order by pos) x from (select a.part, m.i i, pos, sum(p.x[pos]) t, count(*) n from a{k} a join p on p.part = a.part and p.id = a.id, (select unnest(range(1, 1 + (select len(x) from p limit 1))) pos) group by a.part, m.i, pos) group by part, i),
            b{n} as materialized (select b.part, b.i, coalesce(s.x, b.x) x from b{k} b left join s{k} s on b.part = s.part and b.i = s.i),
            """
    )
    return (
        """
            with v as materialized (select row_number() over (order by vec_id nulls last, embedding) id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) e from embeddings
                  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
            p as materialized (select id, part, e[part * len(e) // 4 + 1 : (part + 1) * len(e) // 4] x from v, (select unnest(range(4)) part)),
            b0 as materialized (select part, id - 1 i, x from p where id <= 256),
            """
        + "".join(step.format(k=k, n=k + 1) for k in range(rounds))
        + f"z as materialized ({near.format(k=rounds)}),"
        + """
            c as (select id, string_agg(lower(lpad(to_hex(m.i), 2, '0')), '' order by part) code, sum(m.d)::bigint error from z group by id),
            l as (select v.label, sum(error)::bigint label_error from c join v using (id) group by v.label),
            h as (select sha256(string_agg(list_aggregate(list_transform(x, lambda y: y::bigint::varchar), 'string_agg', ','), ',' order by part, i)) books from b"""
        + str(rounds)
        + """)
            select v.vec_id, c.code, c.error, l.label_error, h.books codebooks_sha256 from c join v using (id) join l on v.label is not distinct from l.label, h"""
    )
