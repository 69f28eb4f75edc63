"""Ranked retrieval: BM25, dense cosine, rank fusion, filters and boosts, neighbours, context and citations.

Every operator takes a set of queries at once. A stated set of queries goes to the texts, whose tokens are scored where they lie; for
larger sets tokens are cut down to the queries' own terms, by a semi-join, before they are
grouped into postings. Document frequencies come from each text's distinct tokens, counted before the shuffle. Per-query top-k lists are row_number filters, which Spark turns into partial limits before the
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X
from ..sources.shared import written
from .order import numbered

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
#: So many distinct query terms at most are broadcast.
FEW_TERMS = 200_000
#: So many pairs of queries and their terms at most are sent to the texts of a BM25 search.
FEW_ASKED = 1 << 16
#: So many numbers (queries x components) at most are sent to the rows of a dense search: 1 MB.
FEW_QUERIES = 1 << 17
#: So many scores of so many queries are worked out at once (8 MB), and so many numbers of vectors are in a block (64 MB).
TILE, ASKED, BLOCK = 1 << 20, 1024, 1 << 23
NEGATIVE_PENALTY, DEFINITION_BOOST = 0.25, 1.5
#: Kinds and headings that retrieval leaves out.
NOISE_TYPES = ("exercise", "references", "bibliography", "citations")
NOISE_HEADERS = ("references", "selected bibliography", "bibliography", "further reading", "appendix", "exercises", "review questions")


def tokenized(chunks: DataFrame) -> DataFrame:
    """(id, toks, dl), dl the number of tokens, 0 included."""
    found = chunks.select("id", X.tokens(F.col("text")).alias("toks"))
    return found.withColumn("dl", F.size("toks"))


def as_tokens(chunks: DataFrame) -> DataFrame:
    """(id, toks, dl), written where the chunks still hold texts, since what follows reads it several times."""
    return chunks if "toks" in chunks.columns else written(tokenized(chunks))


def idf_of(df: DataFrame, whole: DataFrame) -> DataFrame:
    """df(tok, df) of the whole vocabulary, one row whole(n) -> (tok, df, idf). Negative idf is replaced by a quarter of the vocabulary's mean idf."""
    idf = df.crossJoin(F.broadcast(whole.select("n"))).select("tok", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))  # one row of totals
    mean = idf.agg((F.avg("idf") * EPSILON).alias("floor"))
    return idf.crossJoin(F.broadcast(mean)).select("tok", "df", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"))


def bm25_statistics(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chunks(id, text) or as_tokens() of them -> (tok, df, idf) and one row (n, avgdl).

    Each text hands on its distinct tokens, which are counted before the shuffle: what moves is a row for each word and task, no postings."""
    toks = as_tokens(chunks)
    whole = toks.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = written(toks.select(F.explode(F.array_distinct("toks")).alias("tok")).groupBy("tok").agg(F.count("*").alias("df")))  # read for the mean, too
    return idf_of(df, whole), whole


def asked_terms(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, tok, qtf) and the distinct terms (tok); these are broadcast if they are few, and else joined by shuffles."""
    asked = queries.select("query_id", F.explode(X.tokens(F.col("query"))).alias("tok")).groupBy("query_id", "tok").agg(F.count("*").alias("qtf"))
    terms = asked.select("tok").distinct()
    return asked, F.broadcast(terms) if terms.count() <= FEW_TERMS else terms


def postings(toks: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, tok, tf, dl) of the terms(tok) alone: other tokens go before anything is grouped."""
    found = toks.select("id", "dl", F.explode("toks").alias("tok")).join(terms, "tok", "left_semi")
    return found.groupBy("id", "tok").agg(F.count("*").alias("tf"), F.any_value("dl").alias("dl"))


def ranked(scored: DataFrame, k: int, *tie: Column | str, score: str = "score", by: str = "query_id") -> DataFrame:
    """The k rows of highest score for each query, with `rank` from 1."""
    order = Window.partitionBy(by).orderBy(F.desc(score), *(tie or ("id",)))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25_sums(hits: DataFrame) -> DataFrame:
    """hits(query_id, id, qtf, idf, tf, dl, avgdl) -> (query_id, id, score): a term that a query repeats counts each time; only positive scores."""
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score")).filter("score > 0")


def bm25_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """chunks(id, text) or as_tokens() of them -> (query_id, id, score)."""
    toks = as_tokens(chunks)
    terms, known, whole = _known_terms(toks, queries)
    return _bm25_shuffled(toks, terms, known, whole)


def _known_terms(toks: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """terms(tok), known(query_id, tok, qtf, idf) of those that occur, and one row whole(n, avgdl)."""
    asked, terms = asked_terms(queries)
    idf, whole = bm25_statistics(toks)
    return terms, asked.join(idf.join(terms, "tok", "left_semi"), "tok").select("query_id", "tok", "qtf", "idf"), whole


def _bm25_shuffled(toks: DataFrame, terms: DataFrame, known: DataFrame, whole: DataFrame) -> DataFrame:
    return bm25_sums(postings(toks, terms).join(known, "tok").crossJoin(F.broadcast(whole)))  # one row of totals


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """chunks(id, text) or as_tokens() of them -> the k best for each query.

    Up to FEW_ASKED pairs of queries and terms are sent to the texts: each batch keeps its k best for each query, and no posting is shuffled.
    More of them, or texts that share an id, meet by postings and sums."""
    toks = as_tokens(chunks)
    terms, known, whole = _known_terms(toks, queries)
    pairs = known.limit(FEW_ASKED + 1).toArrow()
    if k < 1 or pairs.num_rows > FEW_ASKED or not toks.groupBy("id").count().filter("count > 1").limit(1).isEmpty():
        return ranked(_bm25_shuffled(toks, terms, known, whole), k)
    return ranked(_bm25_few(toks, queries.schema["query_id"], pairs, whole.first()["avgdl"] or 1.0, k).withColumn("score", F.round("score", 9)).filter("score > 0"), k)


def _bm25_few(toks: DataFrame, query_id: T.StructField, pairs: pa.Table, avgdl: float, k: int) -> DataFrame:
    """(query_id, id, score): of each slice of texts the k best for each query and those within rounding of the k-th; of equal scores the first k by id."""
    ids, vocabulary = (pc.unique(pairs.column(c).combine_chunks()) for c in ("query_id", "tok"))
    query, term = (pc.index_in(pairs.column(c), value_set=v).to_numpy() for c, v in (("query_id", ids), ("tok", vocabulary)))
    order = np.lexsort((query, term))  # the queries of each term lie together
    query, weight = query[order], (pairs.column("qtf").to_numpy() * pairs.column("idf").to_numpy())[order]
    count = np.bincount(term, minlength=len(vocabulary))
    begin, step = np.cumsum(count) - count, max(1, TILE // max(1, len(ids)))

    def scores(row: np.ndarray, tok: np.ndarray, dl: np.ndarray) -> np.ndarray:
        """(queries, rows), from the row and the term of each token that is asked for; TILE products at once."""
        both, tf = np.unique(row * len(vocabulary) + tok, return_counts=True)
        row, tok = np.divmod(both, len(vocabulary))
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avgdl))
        out, ends = np.zeros(len(ids) * len(dl)), np.cumsum(count[tok])
        at = 0
        while at < len(tok):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TILE, "right")))
            n = count[tok[at:end]]
            place = np.repeat(begin[tok[at:end]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out += np.bincount(query[place] * len(dl) + np.repeat(row[at:end], n), np.repeat(part[at:end], n) * weight[place], len(out))
            at = end
        return out.reshape(len(ids), len(dl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, step) for a in range(0, whole.num_rows, step)) if len(ids) else ():
                batch = batch.take(pc.sort_indices(batch.column(0), null_placement="at_start"))
                code = pc.fill_null(pc.index_in(batch.column(1).flatten(), value_set=vocabulary), -1).to_numpy().astype(np.int64)
                dl = batch.column(2).to_numpy()
                row = np.repeat(np.arange(len(dl)), dl)[code >= 0]
                found = scores(row, code[code >= 0], dl)
                least = np.partition(found, -k, axis=1)[:, -k] - 1e-8 if len(dl) > k else np.zeros(len(ids))
                q, r = np.nonzero((found >= least[:, None]) & (found > 0))  # ties of rounded scores are settled behind
                score = found[q, r]
                order = np.lexsort((r, -score, q))
                q, r, score = q[order], r[order], score[order]
                new = np.append(True, (np.diff(q) != 0) | (np.diff(score) != 0))[: len(q)]
                good = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0)) < k
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[good])), batch.column(0).take(pa.array(r[good])), pa.array(score[good])], names=["query_id", "id", "score"])

    return toks.select("id", "toks", "dl").mapInArrow(run, T.StructType([query_id, toks.schema["id"], T.StructField("score", T.DoubleType())]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _unit(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length of a list column, and which rows have one: not those that are null, zero, of another width or with null components."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes, out = np.diff(col.offsets.to_numpy()), np.zeros((len(col), width))
    right = (sizes == width) & col.is_valid().to_numpy(zero_copy_only=False)
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64)
    out[right] = flat[np.repeat(right, np.where(col.is_valid().to_numpy(zero_copy_only=False), sizes, 0))].reshape(-1, width)
    norms = np.linalg.norm(out, axis=1)
    has = right & (norms > 0) & np.isfinite(norms)
    return out / np.where(has, norms, 1)[:, None], has


def _best(rows: np.ndarray, wanted: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of queries, places of rows, scores): for each query its k best rows of unit length and those within rounding of the k-th; of equal scores the first k.

    TILE scores are worked out at once, ASKED queries each time; what is kept of them is cut down whenever it has doubled."""
    for first in range(0, len(wanted), ASKED):
        asked = wanted[first : first + ASKED]
        least, query, row, score = np.full(len(asked), -1.5), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        step, limit = max(8 * k, TILE // len(asked)), 4 * k * len(asked)
        for at in range(0, len(rows), step):
            tile = asked @ rows[at : at + step].T
            if not at and tile.shape[1] > k:
                least = np.partition(tile, tile.shape[1] - k, axis=1)[:, tile.shape[1] - k]
            q, r = np.nonzero(tile >= (least - 1e-6)[:, None])  # ties of rounded scores are settled behind
            query, row, score = np.concatenate([query, q]), np.concatenate([row, at + r]), np.concatenate([score, tile[q, r]])
            if len(query) > limit or at + step >= len(rows):
                order = np.lexsort((row, -score, query))
                query, row, score = query[order], row[order], score[order]
                sizes = np.bincount(query, minlength=len(asked))
                full = sizes >= k
                least[full] = np.maximum(least[full], score[(np.cumsum(sizes) - sizes)[full] + k - 1])
                new = np.append(True, (np.diff(query) != 0) | (np.diff(score) != 0))[: len(query)]
                nth = np.arange(len(query)) - np.maximum.accumulate(np.where(new, np.arange(len(query)), 0))
                good = (nth < k) & (score >= least[query] - 1e-6)
                query, row, score = query[good], row[good], score[good]
                limit = max(limit, 2 * len(query))
        yield first + query, row, score


def _dense_few(vectors: DataFrame, queries: DataFrame, asked: list, k: int) -> DataFrame:
    """The queries go to the rows: each batch of rows keeps its k best for each query, by matrix products of TILE scores."""
    width = len(asked[0].q)
    ids = pa.array([r.query_id for r in asked], to_arrow_type(queries.schema["query_id"].dataType))
    wanted, has = _unit(pa.array([r.q for r in asked], pa.list_(pa.float64())), width)
    ids, wanted = ids.take(pa.array(np.flatnonzero(has))), wanted[has]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, good = _unit(batch.column(1), width)
            places = pc.sort_indices(batch.column(0)).to_numpy()
            places = places[good[places]]
            for q, r, score in _best(rows[places], wanted, k):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), batch.column(0).take(pa.array(places[r])), pa.array(score)], names=["query_id", "id", "score"])

    schema = T.StructType([queries.schema["query_id"], vectors.schema["id"], T.StructField("score", T.DoubleType())])
    found = vectors.select("id", "v").mapInArrow(run, schema)
    return ranked(found.select("query_id", "id", F.round("score", 6).alias("score")), k)


def _dense_blocks(vectors: DataFrame, queries: DataFrame, width: int, k: int, blocks: int) -> DataFrame:
    """Each query goes once to each block of rows. A task holds its block's vectors, the queries stream past them, and k rows for each query and block go on."""
    rows = vectors.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), F.col("id").alias("id"), F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), F.col("v").cast("array<double>").alias("v"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), F.lit(None).cast(vectors.schema["id"].dataType).alias("id"), "query_id", F.col("q").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, size = None, [], [], 0
        for batch in batches:
            block, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(block)], strict=True):
                part = batch.slice(a, b - a)
                if block[a] != now:
                    now, ids, held, size = block[a], [], [], 0
                unit, good = _unit(part.column(4), width)
                if not asks[a]:
                    ids, held, size = [*ids, part.column(2).take(pa.array(np.flatnonzero(good)))], [*held, unit[good]], size + int(good.sum())
                    continue
                if not size:
                    continue
                if len(held) > 1:
                    ids, held = [pa.concat_arrays(ids)], [np.concatenate(held)]
                names = part.column(3).take(pa.array(np.flatnonzero(good)))
                for q, r, score in _best(held[0], unit[good], k):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), ids[0].take(pa.array(r)), pa.array(score)], names=["query_id", "id", "score"])

    schema = T.StructType([queries.schema["query_id"], vectors.schema["id"], T.StructField("score", T.DoubleType())])
    both = rows.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "asks", "id")  # a block's rows by id, then its queries
    return ranked(both.mapInArrow(run, schema).select("query_id", "id", F.round("score", 6).alias("score")), k)


def dense(vectors: DataFrame, queries: DataFrame, k: int = 5, blocks: int | None = None) -> DataFrame:
    """vectors(id, v), queries(query_id, q) -> the k nearest by cosine. Up to FEW_QUERIES numbers of queries are sent to the rows. More of them meet the rows in blocks,
    of which each query sees every one; there are as many blocks as keep a block's vectors under BLOCK numbers, and four at least for each core, so what is shuffled
    are the rows once and the queries once for each block. The exact job is a product of both; what a task holds is bounded."""
    first = queries.filter("q is not null").select("query_id", F.col("q").cast("array<double>").alias("q"))
    one = first.limit(1).collect()
    width = len(one[0].q) if one else 0
    if k < 1 or not width:
        return first.join(vectors.select("id"), F.lit(False)).select("query_id", "id", F.lit(None).cast("double").alias("score"), F.lit(0).alias("rank"))
    if blocks is None:
        most = max(1, FEW_QUERIES // width)
        asked = first.limit(most + 1).collect()
        if len(asked) <= most:
            return _dense_few(vectors, queries, asked, k)
        blocks = max(4 * vectors.sparkSession.sparkContext.defaultParallelism, -(-vectors.count() * width // BLOCK))
    return _dense_blocks(vectors, first, width, k, blocks)


def ranking_source(chunks: DataFrame) -> DataFrame:
    """chunks(id, part, stored) with `ranking`: stored if every chunk of the part has a stored vector, else local."""
    whole = chunks.groupBy("part").agg(F.bool_and("stored").alias("whole"))
    return chunks.join(whole, "part").withColumn("ranking", F.when(F.col("whole"), F.lit("stored")).otherwise(F.lit("local"))).drop("whole")


def rrf(lists: list[DataFrame], k: int = 10, k_rrf: int = RRF_K) -> DataFrame:
    """Ranked lists (query_id, id, rank) -> (query_id, id, score): sum of 1 / (k_rrf + rank); ties keep the order in which ids were first seen."""
    parts = [x.select("query_id", "id", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)]
    merged = reduce(DataFrame.unionByName, parts).groupBy("query_id", "id").agg(
        F.round(F.sum(1 / (k_rrf + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("seen")
    )
    return ranked(merged, k, "seen.list", "seen.rank").drop("seen")


def noise(chunk_type: Column, header: Column) -> Column:
    return chunk_type.isin(*NOISE_TYPES) | X.contains_any(F.lower(header), NOISE_HEADERS)


def drop_noise(scored: DataFrame) -> DataFrame:
    """Without noisy kinds and headings, and without chunks whose beginning holds one of the query's negative signals."""
    start = F.lower(F.concat("header_path", F.lit(" "), F.substring("text", 1, 200)))
    return scored.filter(~noise(F.col("chunk_type"), F.col("header_path")) & ~F.exists("negative_signals", lambda s: F.contains(start, s)))


def boosted(scored: DataFrame) -> DataFrame:
    """Multiplies score by what the query's intent says of the chunk's kind; all factors apply together."""
    concept, kind = F.lower(F.trim("concept")), F.col("chunk_type")
    head = F.lower("header_path")
    negates = reduce(lambda a, b: a | b, (F.contains(head, F.concat(F.lit(p), concept)) for p in ("non-", "non ", "no ", "without ")))
    about = F.exists("key_terms", lambda t: F.contains(F.lower(t), concept))
    factor = lambda c, x: F.when(F.coalesce(c, F.lit(False)), F.lit(x)).otherwise(F.lit(1.0))
    return scored.withColumn(
        "score",
        F.col("score")
        * factor(negates, NEGATIVE_PENALTY)
        * factor(F.col("is_definition_seeking") & (kind == "definition") & (F.col("concept").isNull() | about), DEFINITION_BOOST)
        * factor(F.col("is_procedural") & kind.isin("algorithm", "section"), 1.10)
        * factor(F.col("is_comparative") & kind.isin("protocol", "comparison", "section"), 1.05),
    )


def hybrid(chunks: DataFrame, merged: DataFrame, intents: DataFrame, k: int = 5) -> DataFrame:
    """chunks with key_terms, merged(query_id, id, score) of rrf() and intents by query -> (query_id, rank, id, score): filter, boosts, top k."""
    scored = boosted(drop_noise(merged.join(chunks, "id").join(intents, "query_id")))
    return ranked(scored.withColumn("score", F.round("score", 9)).select("query_id", "id", "score"), k)


def blended(scored: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Reranking: the cross-encoder's score (a column, ce) mixed with the retrieval score."""
    return scored.withColumn("score", (1 - alpha) * F.col("score") + alpha * F.col("ce"))


def neighbours(chunks: DataFrame, hits: DataFrame, window: int = 1) -> DataFrame:
    """hits(query_id, id, rank) -> each hit's chunks up to `window` places off in its book, in the order in which they are first met.

    Places are numbered by ranges of a book, so none lies in one task; a hit is turned into its 2 * window + 1 places, which are joined by equality.
    """
    placed = numbered(chunks.select("id", "book_id", "pos"), "book_id", "pos", "id").select("id", "book_id", F.col("_n").alias("place"))
    wide = hits.join(placed, "id").select("query_id", "rank", "book_id", F.explode(F.sequence(F.col("place") - window, F.col("place") + window)).alias("place"))
    met = wide.join(placed, ["book_id", "place"]).groupBy("query_id", "id").agg(F.min(F.struct("rank", "place")).alias("met"))
    order = Window.partitionBy("query_id").orderBy("met.rank", "met.place", "id")
    return met.withColumn("position", F.row_number().over(order)).select("query_id", "id", "position")


def merged_subqueries(results: DataFrame, k: int) -> DataFrame:
    """results(query_id, sub, id, rank, score) -> best score for each chunk over the sub-queries; the first list wins ties."""
    parts = results.select("query_id", "sub").distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    each = results.join(parts, "query_id").filter(F.col("rank") <= F.greatest(F.lit(2), F.floor(F.lit(k) / F.col("n"))))
    best = each.groupBy("query_id", "id").agg(F.max(F.struct("score", -F.col("sub"), -F.col("rank"))).alias("b"))
    return ranked(best.select("query_id", "id", F.col("b.score").alias("score")), k)


def context(results: DataFrame, max_tokens: int = 2000) -> DataFrame:
    """results(query_id, rank, id, header_path, text) -> (query_id, context, n): numbered segments up to the token budget.

    Segments are taken whole up to the first that overflows; that one is cut if over 100 tokens are left after a margin of 80.
    The later half is then reversed, so that the best segments stand at the ends.
    """
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce(F.nullif("header_path", F.lit("")), F.col("id").cast("string")), F.lit(": "))
    body = F.trim(F.coalesce("text", F.lit("")))
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = results.select("query_id", "rank", head.alias("head"), body.alias("body")).withColumn("n", X.approx_tokens(F.concat("head", "body")))
    rows = rows.withColumn("used", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("over", (F.col("used") + F.col("n") > max_tokens) & (F.col("rank") > 1))
    rows = rows.withColumn("stop", F.min(F.when(F.col("over"), F.col("rank"))).over(Window.partitionBy("query_id")))
    left = F.lit(max_tokens - 80) - F.col("used")
    cut = F.concat("head", F.substr(F.col("body"), F.lit(1), (left * 4).cast("int")), F.lit("..."))
    taken = rows.filter(F.col("stop").isNull() | (F.col("rank") < F.col("stop")) | ((F.col("rank") == F.col("stop")) & (left > 100) & (F.col("body") != "")))
    taken = taken.select("query_id", "rank", F.when(F.col("rank") == F.col("stop"), cut).otherwise(F.concat("head", "body")).alias("segment"))
    found = taken.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "segment"))), lambda s: s["segment"]).alias("s"))
    half = F.ceil(F.size("s") / 2).cast("int")
    shown = F.when(F.size("s") <= 2, F.col("s")).otherwise(F.concat(F.slice("s", F.lit(1), half), F.reverse(F.slice("s", half + 1, F.size("s")))))
    return found.select("query_id", F.array_join(shown, "\n\n").alias("context"), F.size("s").alias("n"))


def citations(answers: DataFrame, results: DataFrame) -> DataFrame:
    """answers(query_id, answer) -> (query_id, index, id, snippet): each [n] that names one of the query's results, once."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.try_cast("int")))
    cited = answers.select("query_id", F.explode(F.filter(found, lambda n: n.isNotNull())).alias("index"))
    text = F.coalesce("text", F.lit(""))
    short = F.concat(F.trim(F.substring(text, 1, 200)), F.when(F.length(text) > 200, F.lit("...")).otherwise(F.lit("")))
    return cited.join(results.withColumnRenamed("rank", "index"), ["query_id", "index"]).select("query_id", "index", "id", short.alias("snippet"))


def evaluated(answers: DataFrame) -> DataFrame:
    """(query_id, answer, context) -> missing aspects, is_complete, confidence.

    A citation is grounded if at least 0.15 of the words of four letters or more in the 150 characters behind its first place occur in
    the context segment that it names.
    """
    refs = lambda c, p: F.array_distinct(F.regexp_extract_all(c, F.lit(p), F.lit(1)))
    rows = answers.withColumn("cited", refs(F.col("answer"), r"\[(\d+)\]")).withColumn("known", refs(F.col("context"), r"(?m)^\[(\d+)\]"))
    segments = F.transform(F.split("context", r"(?m)(?=^\[\d+\])"), lambda s: F.lower(F.trim(s)))
    rows = rows.withColumn("segments", segments)

    def loose(n: Column) -> Column:
        mark = F.concat(F.lit("["), n, F.lit("]"))
        near = F.lower(F.substr(F.col("answer"), F.position(mark, F.col("answer")) + F.length(mark), F.lit(150)))
        found = F.array_distinct(F.regexp_extract_all(near, F.lit("[a-z]{4,}"), F.lit(0)))
        source = F.element_at(F.filter("segments", lambda s: F.startswith(s, mark)), -1)
        return (F.size(found) > 0) & (F.size(F.filter(found, lambda w: F.contains(source, w))) / F.size(found) < 0.15)

    both = F.array_intersect("cited", "known")
    missing = F.array(
        F.when(F.length(F.trim("answer")) < 30, F.lit("answer_too_short")),
        F.when(F.size("cited") == 0, F.lit("no_citations")),
        F.when(F.trim("context") == "", F.lit("empty_context")),
        F.when(F.size(F.array_except("cited", "known")) > 0, F.lit("invalid_citation")),
        F.when(F.exists(both, loose), F.lit("ungrounded_citation")),
    )
    rows = rows.withColumn("missing", F.filter(missing, lambda m: m.isNotNull()))
    return rows.select("query_id", "missing", (F.size("missing") == 0).alias("is_complete"), F.round(F.greatest(F.lit(0.0), 1 - 0.15 * F.size("missing")), 6).alias("confidence"))


def widened(hits: DataFrame, answers: DataFrame, k: int = 5, step: int = 5, rounds: int = 2, max_tokens: int = 2000) -> DataFrame:
    """(query_id, k): how many results a query ends up with if an answer judged incomplete is given `step` more, at most `rounds` times.

    hits(query_id, rank, id, header_path, text) are ranked as deep as k + rounds * step. The rounds are fixed, so they are part of one plan.
    """
    now = answers.select("query_id", "answer", F.lit(k).alias("k"))
    for _ in range(rounds):
        shown = context(hits.join(now.select("query_id", "k"), "query_id").filter(F.col("rank") <= F.col("k")).drop("k"), max_tokens)
        judged = evaluated(now.join(shown.select("query_id", "context"), "query_id", "left").withColumn("context", F.coalesce("context", F.lit(""))))
        now = now.join(judged.select("query_id", "is_complete"), "query_id").select("query_id", "answer", (F.col("k") + F.when(F.col("is_complete"), F.lit(0)).otherwise(F.lit(step))).alias("k"))
    return now.select("query_id", "k")
