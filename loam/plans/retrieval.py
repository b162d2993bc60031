"""Queries of retrieval: dense and keyword search, fusion, reranking, packing, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions import vectors as V
from loam.functions.text import STOPWORDS
from loam.operators import ann, autopilot, caches, context, dense, evals, fusion, keyword, storage
from loam.plans.registry import Catalogue, table

C = Catalogue()
#: Words at which a text and a passage meet.
MET = 4
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _points(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), "embedding", "label")


def _asked(spark, sf):
    """The stated queries: every vector whose id is divisible by 100."""
    return table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def _dense(spark, sf, metric, k=10, where=None):
    out = dense.nearest(_points(spark, sf), _asked(spark, sf), k, metric, where)
    return out.select("query_id", "point_id", F.round("score", 9).alias("score"))


_SCORE = {"cosine": "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])", "dot": "list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])", "euclid": "list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"}


def _dense_sql(metric, where="true", k=10):
    return f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS point_id, {_SCORE[metric]} AS score
      FROM embeddings q JOIN embeddings e ON true WHERE q.vec_id % 100 = 0 AND {where})
    SELECT query_id, point_id, round(score, 9) AS score FROM s
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score {"ASC" if metric == "euclid" else "DESC"}, point_id) <= {k}"""


@C.query(_dense_sql("cosine"))
def dense_topk_cosine(spark, sf):
    return _dense(spark, sf, "cosine")


@C.query(_dense_sql("dot"))
def dense_topk_dot(spark, sf):
    return _dense(spark, sf, "dot")


@C.query(_dense_sql("euclid"))
def dense_topk_euclid(spark, sf):
    return _dense(spark, sf, "euclid")


@C.query(_dense_sql("cosine", "e.label IN (1, 2, 3)"))
def dense_topk_filtered(spark, sf):
    return _dense(spark, sf, "cosine", where=F.col("label").isin(1, 2, 3))


@C.query(_dense_sql("cosine", k=5))
def dense_topk_batch(spark, sf):
    return _dense(spark, sf, "cosine", k=5)


def _index(spark, sf):
    return ann.build(_points(spark, sf), storage.shared_folder(spark, "ann"))


@C.query(_dense_sql("cosine"))
def dense_topk_indexed(spark, sf):
    """Exactly, by the index: only cells whose bound reaches a query's k-th score are looked into."""
    return ann.search(_index(spark, sf), _asked(spark, sf), 10, None).select("query_id", "point_id", F.round("score", 9).alias("score"))


@C.query()
def dense_topk_approximate(spark, sf):
    """By the codes of as many cells and rows as hold 0.98 of the true neighbours of 100 other vectors, rescored."""
    index = _index(spark, sf)
    others = table(spark, sf, "embeddings").filter("vec_id % 100 != 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return ann.search(index, _asked(spark, sf), 10, *ann.tuned(index, others, 10, 0.98)).select("query_id", "point_id", "rank", F.round("score", 9).alias("score"))


@C.query("""SELECT a.vec_id AS asked_id, max_by(b.vec_id, (round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), -b.vec_id)) AS entry_id,
    max(round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)) AS similarity
  FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0 AND a.label = b.label
  WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) >= 0.2 GROUP BY a.vec_id""")
def semantic_cache_lookup(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("tenant", F.col("label").cast("string"))
    return caches.semantic_lookup(rows.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "asked_id"), rows.filter("vec_id % 20 <> 0").withColumnRenamed("vec_id", "entry_id"), 0.2).select("asked_id", "entry_id", "similarity")


@C.query("""WITH k AS (SELECT doc_id, 'emb:hash:1:' || sha256(text) AS key FROM documents), c AS (SELECT DISTINCT key FROM k WHERE doc_id % 3 = 0)
  SELECT k.key IN (SELECT key FROM c) AS cached, count(*) AS n_rows, count(DISTINCT k.key) AS n_keys FROM k GROUP BY 1""")
def embedding_cache_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cache = docs.filter("doc_id % 3 = 0").select(caches.embedding_key("hash", "1", F.col("text")).alias("key"), F.lit(1).alias("vector")).dropDuplicates(["key"])
    hits, misses = caches.split_by_cache(docs, cache, "hash", "1")
    found = hits.groupBy(F.col("vector").isNotNull().alias("cached")).agg(F.count("*").alias("n_rows"), F.count_distinct("key").alias("n_keys"))
    to_embed = misses.agg(F.count("*").alias("embedded"))
    return found.crossJoin(F.broadcast(to_embed)).select("cached", "n_rows", F.when(F.col("cached"), F.col("n_keys")).otherwise(F.col("embedded")).alias("n_keys"))


@C.query("""SELECT p.label, round(avg(list_inner_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[])), 6) AS mean_square, count(*) AS n FROM embeddings p GROUP BY p.label""")
def dimension_check(spark, sf):
    rows = dense.checked_dimensions(_points(spark, sf), 64)
    return rows.groupBy("label").agg(F.round(F.avg(V.dot(F.col("embedding"), F.col("embedding"))), 6).alias("mean_square"), F.count("*").alias("n"))


# keyword search

_TERMS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:[._-][a-z0-9]+)*'), lambda t: length(t) >= 2 AND t NOT IN ({_STOP}))"
_POSTINGS = f"""listed AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
  counted AS (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM listed),
  postings AS (SELECT doc_id, term, count(*) AS tf, count(*) * 2.2::DOUBLE / (count(*) + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * any_value(length) / 256)) AS weight FROM counted GROUP BY doc_id, term)"""
_ASKED = f"""asked AS (SELECT DISTINCT item_id AS query_id, unnest({_TERMS}) AS term FROM benchmark)"""
_SEARCH = """weighed AS (SELECT term, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM postings GROUP BY term)"""


def _scored(where="true"):
    return f"""scored AS (SELECT query_id, doc_id, round(sum(weight * idf), 9) AS score FROM asked JOIN weighed USING (term) JOIN postings USING (term)
      WHERE {where} GROUP BY query_id, doc_id)"""


def _chunks(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("point_id"), "text", "lang", "source")


def _questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _keyword(spark, sf, k=10, stems=False, allowed=None):
    chunks = _chunks(spark, sf)
    asked = keyword.query_terms(_questions(spark, sf), stems)
    return keyword.search(keyword.postings(chunks, stems=stems, only=asked), asked, chunks.agg(F.count("*").alias("n")), k, allowed)


@C.query(f"WITH {_POSTINGS} SELECT doc_id AS point_id, term, tf, round(weight, 9) AS weight FROM postings")
def bm25_postings(spark, sf):
    return keyword.postings(_chunks(spark, sf), stems=False).select("point_id", "term", "tf", F.round("weight", 9).alias("weight"))


@C.query(f"""WITH {_POSTINGS}, {_ASKED}, {_SEARCH}, {_scored()}
  SELECT query_id, doc_id AS point_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, round(score, 6) AS score FROM scored QUALIFY rank <= 10""")
def bm25_topk(spark, sf):
    return _keyword(spark, sf).select("query_id", "point_id", "rank", F.round("score", 6).alias("score"))


@C.query(f"""WITH {_POSTINGS}, {_ASKED}, {_SEARCH}, {_scored()}
  SELECT query_id, doc_id AS point_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, round(score, 6) AS score FROM scored QUALIFY rank <= 10""")
def bm25_topk_stored(spark, sf):
    """From a stored table of blocks; blocks whose bound is under a query's k-th score are not scored."""
    chunks, path = _chunks(spark, sf), storage.shared_folder(spark, "postings")
    total = chunks.count()
    keyword.store(keyword.postings(chunks, stems=False), path, total)
    found = keyword.search_stored(spark, path, keyword.query_terms(_questions(spark, sf), False), total, 10)
    return found.select("query_id", "point_id", "rank", F.round("score", 6).alias("score"))


@C.query(f"""WITH {_POSTINGS}, {_ASKED}, {_SEARCH}, {_scored("doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")}
  SELECT query_id, doc_id AS point_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, round(score, 6) AS score FROM scored QUALIFY rank <= 10""")
def bm25_filtered(spark, sf):
    return _keyword(spark, sf, allowed=_chunks(spark, sf).filter("lang = 'en'").select("point_id")).select("query_id", "point_id", "rank", F.round("score", 6).alias("score"))


@C.query()
def bm25_stemmed(spark, sf):
    return _keyword(spark, sf, stems=True)


# fusion

_RANKS = """SELECT q.vec_id AS query_id, e.vec_id AS point_id, {score} AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {score} {way}, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND {where}"""


def _leg_sql(metric, where="true"):
    return _RANKS.format(where=where, score=f"round({_SCORE[metric]}, 9)", way="ASC" if metric == "euclid" else "DESC")


def _fused_sql(w1, w2):
    return f"""WITH a AS (SELECT * FROM ({_leg_sql("cosine")}) WHERE rank <= 20), b AS (SELECT * FROM ({_leg_sql("dot")}) WHERE rank <= 40),
      f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.point_id, b.point_id) AS point_id, a.rank AS a_rank, b.rank AS b_rank,
        round({"coalesce(%s::DOUBLE / (60 + a.rank), 0)" % w1 if w1 else "0"} + {"coalesce(%s::DOUBLE / (60 + b.rank), 0)" % w2 if w2 else "0"}, 12) AS score
        FROM a FULL OUTER JOIN b ON a.query_id = b.query_id AND a.point_id = b.point_id)
    SELECT query_id, point_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id)::INT AS final_rank,
      coalesce(a_rank, 0)::INT AS dense_rank, coalesce(b_rank, 0)::INT AS sparse_rank FROM f WHERE {"a_rank IS NOT NULL" if not w2 else "true"}"""


def _legs(spark, sf):
    asked = _asked(spark, sf)
    rounded = lambda m, k: dense.nearest(_points(spark, sf), asked, k, m).withColumn("score", F.round("score", 9))
    return rounded("cosine", 20), rounded("dot", 40)


def _fused(spark, sf, w1, w2):
    a, b = _legs(spark, sf)
    out = fusion.fused({"dense": (a, w1), "sparse": (b, w2)})
    return out.select("query_id", "point_id", "score", "final_rank", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("dense_rank", "sparse_rank")])


@C.query(_fused_sql(1.0, 0.5))
def rrf_hybrid(spark, sf):
    return _fused(spark, sf, 1.0, 0.5)


@C.query(_fused_sql(1.0, 0))
def rrf_zero_weight(spark, sf):
    return _fused(spark, sf, 1.0, 0.0)


@C.query(f"""WITH a AS (SELECT * FROM ({_leg_sql("cosine")}) WHERE rank <= 10),
    d AS (SELECT query_id, point_id, rank FROM a UNION ALL SELECT query_id, point_id, rank + 7 FROM a)
  SELECT query_id, point_id, round(1::DOUBLE / (60 + min(rank)), 12) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(1::DOUBLE / (60 + min(rank)), 12) DESC, point_id)::INT AS final_rank,
    min(rank)::INT AS dense_rank FROM d GROUP BY query_id, point_id""")
def rrf_duplicates(spark, sf):
    a, _ = _legs(spark, sf)
    a = a.filter("rank <= 10")
    twice = a.unionByName(a.withColumn("rank", F.col("rank") + 7))
    return fusion.fused({"dense": (twice, 1.0)}).select("query_id", "point_id", "score", "final_rank", "dense_rank")


def hashed_vectors(rows: DataFrame, id: str, buckets: int = 64) -> DataFrame:
    """id, embedding: terms counted in crc32 buckets, a deterministic stand-in for a model."""
    terms = rows.select(id, F.explode(T.raw_terms(F.col("text"))).alias("term"))
    counts = terms.groupBy(id, F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(buckets)).alias("b")).agg(F.count("*").alias("n"))
    maps = counts.groupBy(id).agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    return maps.select(id, F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(0)).cast("float")).alias("embedding"))


@C.query()
def hybrid_flagship(spark, sf):
    """Keyword and dense legs over documents for every benchmark passage, fused, then reranked by word overlap."""
    chunks, asked = _chunks(spark, sf), _questions(spark, sf)
    vectors, wanted = hashed_vectors(chunks, "point_id"), hashed_vectors(asked, "query_id").withColumnRenamed("embedding", "query_vector")

    def overlap(short):
        texts = short.join(chunks.select("point_id", "text"), "point_id").join(_few(asked.withColumnRenamed("text", "question")), "query_id")
        return texts.withColumn("rerank_score", fusion.word_overlap(F.col("question"), F.col("text")))

    legs = {"dense": (lambda n, where: dense.nearest(vectors, wanted, n, "cosine", where), 1.0), "bm25": (lambda n, where: _keyword(spark, sf, k=n), 1.0)}
    out = fusion.hybrid(legs, 10, 20, score=overlap)
    return out.select("query_id", "point_id", "final_rank", F.round("score", 9).alias("score"), F.round("rerank_score", 9).alias("rerank_score"), "found_by_both", "mode")


def _few(rows):
    """Query rows, to be broadcast up to as many as dense search broadcasts."""
    return F.broadcast(rows) if rows.count() <= dense.MOST_QUERIES else rows


@C.query(f"""WITH a AS (SELECT * FROM ({_leg_sql("cosine", "e.label < 10")}) WHERE rank <= 20), b AS (SELECT * FROM ({_leg_sql("dot", "e.label < 10")}) WHERE rank <= 20),
  f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.point_id, b.point_id) AS point_id, a.rank IS NOT NULL AND b.rank IS NOT NULL AS found_by_both,
    round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(0.5::DOUBLE / (60 + b.rank), 0), 12) AS score FROM a FULL OUTER JOIN b ON a.query_id = b.query_id AND a.point_id = b.point_id),
  s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS fused FROM f QUALIFY fused <= 20),
  r AS (SELECT *, query_id % 200 = 0 AND true AS failed, (point_id % 7)::DOUBLE AS rerank FROM s)
  SELECT query_id, point_id, score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN failed THEN 0 ELSE rerank END DESC, fused)::INT AS final_rank, found_by_both, CASE WHEN failed THEN 'hybrid_only' ELSE 'full' END AS mode, failed AS degraded
  FROM r QUALIFY final_rank <= 8""")
def hybrid_modes(spark, sf):
    """Both legs under one filter; every other query's reranker fails, and these keep the fused order."""
    asked = _asked(spark, sf)
    points = _points(spark, sf)
    leg = lambda metric: lambda n, where: dense.nearest(points, asked, n, metric, where).withColumn("score", F.round("score", 9))
    score = lambda short: short.withColumn("rerank_score", F.when(F.col("query_id") % 200 != 0, (F.col("point_id") % 7).cast("double")))
    out = fusion.hybrid({"dense": (leg("cosine"), 1.0), "sparse": (leg("dot"), 0.5)}, 8, 20, F.col("label") < 10, score)
    return out.select("query_id", "point_id", "score", "final_rank", "found_by_both", "mode", "degraded")


_WORDS = "list_distinct(list_filter(string_split_regex(lower({}), '\\s+'), lambda w: w <> ''))"


@C.query(f"""WITH {_POSTINGS}, {_ASKED}, {_SEARCH}, {_scored()},
  short AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10),
  w AS (SELECT s.query_id, s.doc_id, s.rank, {_WORDS.format("d.text")} AS x, {_WORDS.format("b.text")} AS y FROM short s JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = s.query_id),
  o AS (SELECT *, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 9) AS rerank_score FROM w)
  SELECT query_id, doc_id AS point_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank)::INT AS final_rank FROM o QUALIFY final_rank <= 5""")
def rerank_lexical(spark, sf):
    rows = _keyword(spark, sf).withColumnRenamed("rank", "final_rank").join(_chunks(spark, sf).select("point_id", "text"), "point_id").join(_few(_questions(spark, sf).withColumnRenamed("text", "question")), "query_id")
    return fusion.reranked(rows, F.round(fusion.word_overlap(F.col("text"), F.col("question")), 9), 5).select("query_id", "point_id", "rerank_score", "final_rank")


# contexts


def _shortlist(spark, sf):
    docs = table(spark, sf, "documents")
    order = W.partitionBy("source").orderBy(F.length("text").desc(), "doc_id")
    return docs.withColumn("rank", F.row_number().over(order)).filter("rank <= 12").select(F.col("source").alias("query_id"), "rank", F.col("doc_id").alias("chunk_id"), "text")


_EST = "(CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE greatest(length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) // 4, len(string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+'))) END)"


_PACK = f"""WITH RECURSIVE r AS (SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id)::INT AS rank, doc_id AS chunk_id, text,
      greatest({_EST}, 1)::BIGINT AS tokens, {_WORDS.format("text")} AS words FROM documents QUALIFY rank <= 12),
  fold AS (SELECT query_id, 0 AS rank, NULL::BIGINT AS chunk_id, 0::BIGINT AS tokens, 'start' AS verdict, 0::BIGINT AS spent, []::VARCHAR[][] AS seen FROM (SELECT DISTINCT query_id FROM r)
    UNION ALL
    SELECT r.query_id, r.rank, r.chunk_id, r.tokens, v.verdict, f.spent + CASE WHEN v.verdict = 'used' THEN r.tokens ELSE 0 END, CASE WHEN v.verdict = 'used' THEN list_append(f.seen, r.words) ELSE f.seen END
    FROM fold f JOIN r ON r.query_id = f.query_id AND r.rank = f.rank + 1,
    LATERAL (SELECT CASE WHEN len(r.words) = 0 THEN 'empty'
      WHEN len(list_filter(f.seen, lambda s: len(list_intersect(s, r.words))::DOUBLE / len(list_distinct(list_concat(s, r.words))) >= 0.9)) > 0 THEN 'duplicate'
      WHEN f.spent + r.tokens > 4000 THEN 'budget' ELSE 'used' END AS verdict) v)
  SELECT query_id, rank, chunk_id, tokens, verdict FROM fold WHERE rank > 0"""


@C.query(_PACK)
def context_pack(spark, sf):
    return context.packed(_shortlist(spark, sf))


@C.query(f"""SELECT query_id, count(*) FILTER (verdict = 'used') AS used, count(*) FILTER (verdict = 'duplicate') AS dropped_duplicate, count(*) FILTER (verdict = 'budget') AS dropped_budget,
    count(*) FILTER (verdict = 'empty') AS dropped_empty, coalesce(sum(tokens) FILTER (verdict = 'used'), 0)::BIGINT AS tokens FROM ({_PACK}) GROUP BY query_id""")
def context_tallies(spark, sf):
    return context.tallies(context.packed(_shortlist(spark, sf)))


@C.query("""SELECT source AS query_id, string_agg('[^' || doc_id || '] (source: ' || source || CASE WHEN doc_id % 2 = 0 THEN ', page: ' || (doc_id % 9) ELSE '' END || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS prompt
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rank FROM documents QUALIFY rank <= 12) GROUP BY source""")
def prompt_build(spark, sf):
    page = F.when(F.col("chunk_id") % 2 == 0, F.col("chunk_id") % 9)
    rows = _shortlist(spark, sf).select("query_id", "rank", context.block(F.col("chunk_id").cast("string"), F.col("query_id"), page, F.col("text")).alias("block"))
    return context.prompts(rows)


@C.query("""WITH a AS (SELECT conv_id AS answer_id, string_agg(text || ' [^c' || (turn % 3) || '] [^x' || turn || ']', ' ' ORDER BY turn) AS answer FROM conversations GROUP BY conv_id),
  m AS (SELECT answer_id, unnest(regexp_extract_all(answer, '\\[\\^([^\\]\\s]+)\\]', 1)) AS chunk_id, generate_subscripts(regexp_extract_all(answer, '\\[\\^([^\\]\\s]+)\\]', 1), 1) AS place FROM a)
  SELECT answer_id, chunk_id, row_number() OVER (PARTITION BY answer_id ORDER BY min(place))::INT AS position FROM m WHERE chunk_id IN ('c0', 'c1', 'c2') GROUP BY answer_id, chunk_id""")
def citations_resolve(spark, sf):
    turns = table(spark, sf, "conversations")
    said = F.concat("text", F.lit(" [^c"), (F.col("turn") % 3).cast("string"), F.lit("] [^x"), F.col("turn").cast("string"), F.lit("]"))
    answers = turns.groupBy(F.col("conv_id").alias("answer_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("s")))), lambda x: x["s"]), " ").alias("answer"))
    known = answers.select("answer_id", F.explode(F.array(*map(F.lit, ("c0", "c1", "c2")))).alias("chunk_id"))
    return context.resolved(answers, known)


@C.query("""SELECT doc_id, CASE WHEN quality = 1 THEN least(0.5 + toxic, 1) END::DOUBLE AS score, coalesce(CASE WHEN quality = 1 THEN least(0.5 + toxic, 1) END >= 0.7, true) AS passes FROM labels""")
def grader_verdicts(spark, sf):
    score = F.when(F.col("quality") == 1, F.concat(F.lit('```json\n{"score": '), (F.col("toxic") + F.lit(0.5)).cast("string"), F.lit("}\n```"))).otherwise(F.lit('{"score": true}'))
    graded = table(spark, sf, "labels").select("doc_id", context.verdict(score).alias("score"))
    return graded.select("doc_id", "score", context.grounded(F.col("score"), 0.7).alias("passes"))


# evaluation

_GOLDEN = "golden AS (SELECT item_id AS query_id, (SELECT list(d.doc_id::VARCHAR ORDER BY d.doc_id) FROM documents d WHERE contains(d.text, b.text)) AS docs FROM benchmark b)"


def _golden(spark, sf):
    """Documents that hold a passage word for word are relevant to it. They meet at the MET words behind its first one (what stands between single spaces), and are then checked; passages of fewer words meet all documents."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    words, long = F.split("passage", " "), F.size(F.split("passage", " ")) >= MET + 2
    keyed = items.filter(long).withColumn("start", F.array_join(F.slice(words, 2, MET), " "))
    parts = docs.select("doc_id", F.split("text", " ").alias("parts")).filter(F.size("parts") >= MET)
    runs = F.transform(F.sequence(F.lit(1), F.size("parts") - MET + 1), lambda i: F.array_join(F.slice("parts", i, F.lit(MET)), " "))
    starts = parts.select("doc_id", F.explode(F.array_distinct(runs)).alias("start"))
    met = starts.join(F.broadcast(keyed.select("start").distinct()) if keyed.count() <= dense.MOST_QUERIES else keyed.select("start").distinct(), "start", "left_semi").join(keyed, "start").select("doc_id", "query_id", "passage")
    hold = met.join(docs, "doc_id").filter(F.contains("text", F.col("passage"))).select("doc_id", "query_id")
    short = items.filter(~long)
    if short.head(1):
        hold = hold.unionByName(docs.join(short, F.contains("text", F.col("passage"))).select("doc_id", "query_id"))
    relevant = hold.groupBy("query_id").agg(F.array_sort(F.collect_list(F.col("doc_id").cast("string"))).alias("documents"))
    return items.select("query_id").join(relevant, "query_id", "left").withColumn("chunks", F.array().cast("array<string>"))


def _results(spark, sf, k=10):
    return _keyword(spark, sf, k).select("query_id", "rank", F.col("point_id").cast("string").alias("document_id"), F.lit(None).cast("string").alias("chunk_id"))


_EVAL = f"""{_POSTINGS}, {_ASKED}, {_SEARCH}, {_scored()}, {_GOLDEN},
  results AS (SELECT query_id, doc_id::VARCHAR AS document_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 5),
  hits AS (SELECT g.query_id, coalesce(len(g.docs), 0) AS total, r.rank, coalesce(list_contains(g.docs, r.document_id), false) AS hit FROM golden g LEFT JOIN results r USING (query_id)),
  per AS (SELECT query_id, total, count(*) FILTER (hit) AS hits, min(rank) FILTER (hit) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (hit), 0) AS dcg FROM hits GROUP BY query_id, total),
  scores AS (SELECT query_id, total, hits, CASE WHEN total > 0 THEN least(hits::DOUBLE / total, 1) ELSE 0 END AS recall, coalesce(1.0::DOUBLE / first, 0) AS rr,
    CASE WHEN total > 0 THEN least(dcg / list_sum(list_transform(range(1, least(total, 5) + 1), lambda i: 1 / log2(i + 1))), 1) ELSE 0 END AS ndcg FROM per)"""


@C.query(f"WITH {_EVAL} SELECT query_id, total::INT AS total, hits, round(recall, 9) AS recall, round(rr, 9) AS reciprocal_rank, round(ndcg, 9) AS ndcg FROM scores")
def eval_query_scores(spark, sf):
    s = evals.query_scores(_golden(spark, sf), _results(spark, sf), 5)
    return s.select("query_id", "total", "hits", *[F.round(c, 9).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")])


@C.query(f"""WITH {_EVAL} SELECT count(*) FILTER (total > 0) AS scored, count(*) FILTER (total = 0) AS adversarial, round(coalesce(avg(recall) FILTER (total > 0), 0), 9) AS recall,
  round(coalesce(avg(rr) FILTER (total > 0), 0), 9) AS mrr, round(coalesce(avg(ndcg) FILTER (total > 0), 0), 9) AS ndcg, count(*) FILTER (total > 0 AND hits = 0) AS missed FROM scores""")
def eval_recall_mrr_ndcg(spark, sf):
    return evals.report(evals.query_scores(_golden(spark, sf), _results(spark, sf), 5))


@C.query(f"WITH {_EVAL} SELECT query_id FROM scores WHERE total > 0 AND hits = 0")
def eval_misses(spark, sf):
    return evals.query_scores(_golden(spark, sf), _results(spark, sf), 5).filter("total > 0 AND hits = 0").select("query_id")


@C.query("""WITH s AS (SELECT label, avg(vec_id % 7)::DOUBLE AS recall, avg(vec_id % 5)::DOUBLE AS ndcg FROM embeddings GROUP BY label), b AS (SELECT * FROM s WHERE label < 8)
  SELECT s.label AS suite, CASE WHEN b.label IS NULL THEN 'no baseline' WHEN s.label = 7 THEN 'other model' WHEN s.label = 6 THEN 'other settings' WHEN s.label = 5 THEN 'other k'
    WHEN s.label % 4 = 3 THEN 'recall and ndcg fell' WHEN s.label % 4 = 1 THEN 'recall fell' WHEN s.label % 4 = 2 THEN 'ndcg fell' ELSE 'held' END AS reason,
    b.label IS NOT NULL AND s.label NOT IN (5, 6, 7) AND s.label % 4 = 0 AS passed FROM s LEFT JOIN b ON s.label = b.label""")
def regression_gate(spark, sf):
    s = table(spark, sf, "embeddings").groupBy(F.col("label").alias("suite")).agg(F.avg(F.col("vec_id") % 7).alias("recall"), F.avg(F.col("vec_id") % 5).alias("ndcg"))
    now = s.select("suite", F.lit("m").alias("model"), F.lit("h").alias("config_hash"), F.lit(5).alias("k"), "recall", "ndcg")
    worse = lambda bits: F.when((F.col("suite") % 4).isin(*bits), 0.5).otherwise(0.01)
    base = s.filter("suite < 8").select("suite", F.when(F.col("suite") == 7, "x").otherwise("m").alias("model"), F.when(F.col("suite") == 6, "x").otherwise("h").alias("config_hash"), F.when(F.col("suite") == 5, 9).otherwise(5).alias("k"), (F.col("recall") + worse((1, 3))).alias("recall"), (F.col("ndcg") + worse((2, 3))).alias("ndcg"))
    return evals.gate(now, base).select("suite", "reason", "passed")


def _grid(spark, sf):
    """All candidates of weights and k in one plan: the legs are searched once."""
    a, b = _legs(spark, sf)
    found = fusion.fused({"dense": (a, 1.0), "sparse": (b, 1.0)}).select("query_id", "point_id", "dense_rank", "sparse_rank")
    grid = spark.createDataFrame([(i, *c) for i, c in enumerate([(1.0, 1.0, 60), (2.0, 1.0, 60), (1.0, 2.0, 60), (1.0, 0.5, 60), (1.0, 1.0, 20), (1.0, 1.0, 100)])], "candidate int, w1 double, w2 double, k int")
    score = F.coalesce(F.col("w1") / (F.col("k") + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(F.col("w2") / (F.col("k") + F.col("sparse_rank")), F.lit(0.0))
    all_scores = found.crossJoin(F.broadcast(grid)).withColumn("score", F.round(score, 12))
    ranks = all_scores.withColumn("rank", F.row_number().over(W.partitionBy("candidate", "query_id").orderBy(F.desc("score"), "point_id"))).filter("rank <= 10")
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), "label")
    asked = labels.filter("point_id % 100 = 0").select(F.col("point_id").alias("query_id"), F.col("label").alias("wanted"))
    return ranks.join(labels, "point_id").join(F.broadcast(asked), "query_id").groupBy("candidate").agg(F.round(F.avg((F.col("label") == F.col("wanted")).cast("double")), 9).alias("precision"), F.count("*").alias("n"))


@C.query(f"""WITH a AS (SELECT * FROM ({_leg_sql("cosine")}) WHERE rank <= 20), b AS (SELECT * FROM ({_leg_sql("dot")}) WHERE rank <= 40),
  f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.point_id, b.point_id) AS point_id, a.rank AS a_rank, b.rank AS b_rank FROM a FULL OUTER JOIN b ON a.query_id = b.query_id AND a.point_id = b.point_id),
  g(candidate, w1, w2, k) AS (VALUES (0, 1.0::DOUBLE, 1.0::DOUBLE, 60), (1, 2.0, 1.0, 60), (2, 1.0, 2.0, 60), (3, 1.0, 0.5, 60), (4, 1.0, 1.0, 20), (5, 1.0, 1.0, 100)),
  s AS (SELECT candidate, query_id, point_id, round(coalesce(w1 / (k + a_rank), 0) + coalesce(w2 / (k + b_rank), 0), 12) AS score FROM f, g),
  r AS (SELECT *, row_number() OVER (PARTITION BY candidate, query_id ORDER BY score DESC, point_id) AS rank FROM s QUALIFY rank <= 10)
  SELECT candidate, round(avg((e.label = q.label)::INT), 9) AS precision, count(*) AS n FROM r JOIN embeddings e ON e.vec_id = point_id JOIN embeddings q ON q.vec_id = query_id GROUP BY candidate""")
def autopilot_grid(spark, sf):
    return _grid(spark, sf)


@C.query("""WITH r AS (SELECT source AS document_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY md5('s1|' || doc_id), doc_id)::INT AS depth FROM documents),
  p AS (SELECT * FROM r ORDER BY depth, md5('s1|' || document_id), document_id LIMIT 50)
  SELECT document_id, chunk_id, depth, row_number() OVER (ORDER BY depth, md5('s1|' || document_id), document_id)::INT AS position FROM p""")
def stratified_sample(spark, sf):
    return evals.stratified(table(spark, sf, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_id")), 50, "s1")


@C.query("""WITH r AS (SELECT source AS document_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY md5('s1|' || doc_id), doc_id) AS depth FROM documents),
  p AS (SELECT chunk_id FROM r ORDER BY depth, md5('s1|' || document_id), document_id LIMIT 50)
  SELECT chunk_id, row_number() OVER (ORDER BY md5('adversarial|' || chunk_id), chunk_id) <= 10 AS adversarial FROM p""")
def adversarial_subset(spark, sf):
    sampled = evals.stratified(table(spark, sf, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_id")), 50, "s1")
    return sampled.select("chunk_id", evals.adversarial(sampled).alias("adversarial"))


#: Settings in use, which the search for better ones starts from, and what each candidate of its grid changes.
IN_USE = autopilot.Retrieval(1.0, 1.0, 60.0, True, 20)
_GRID = """g(candidate, w1, w2, k, rerank, depth) AS (VALUES (0, 1.0, 1.0, 60, true, 20), (1, 1.0, 0.5, 60, true, 20), (2, 0.5, 1.0, 60, true, 20), (3, 1.0, 0.25, 60, true, 20), (4, 0.25, 1.0, 60, true, 20),
    (5, 1.0, 1.0, 10, true, 20), (6, 1.0, 1.0, 30, true, 20), (7, 1.0, 1.0, 60, false, 10))"""
_TRIALS = f"""WITH a AS (SELECT * FROM ({_leg_sql("cosine")}) WHERE rank <= 20), b AS (SELECT * FROM ({_leg_sql("dot")}) WHERE rank <= 40),
  f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.point_id, b.point_id) AS point_id, a.rank AS a_rank, b.rank AS b_rank FROM a FULL OUTER JOIN b ON a.query_id = b.query_id AND a.point_id = b.point_id), {_GRID},
  p AS (SELECT candidate, query_id, point_id, rerank, depth, CASE WHEN a_rank <= depth THEN w1::DOUBLE / (k + a_rank) END AS x, CASE WHEN b_rank <= depth THEN w2::DOUBLE / (k + b_rank) END AS y FROM f, g),
  s AS (SELECT *, row_number() OVER (PARTITION BY candidate, query_id ORDER BY round(coalesce(x, 0) + coalesce(y, 0), 12) DESC, point_id) AS place FROM p WHERE x IS NOT NULL OR y IS NOT NULL QUALIFY place <= depth),
  r AS (SELECT *, row_number() OVER (PARTITION BY candidate, query_id ORDER BY CASE WHEN rerank THEN point_id % 3 END DESC, place) AS rank FROM s QUALIFY rank <= 10),
  h AS (SELECT g.candidate, q.vec_id AS query_id, r.rank, coalesce(e.label = q.label, false) AS hit FROM g JOIN embeddings q ON q.vec_id % 100 = 0 LEFT JOIN r ON r.candidate = g.candidate AND r.query_id = q.vec_id LEFT JOIN embeddings e ON e.vec_id = r.point_id),
  per AS (SELECT candidate, query_id, count(*) FILTER (hit) AS hits, min(rank) FILTER (hit) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (hit), 0) AS dcg FROM h GROUP BY candidate, query_id),
  measured AS (SELECT candidate, count(*) AS scored, 0::BIGINT AS adversarial, round(avg(least(hits, 1)), 9) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 9) AS mrr, round(avg(least(dcg, 1)), 9) AS ndcg, count(*) FILTER (hits = 0) AS missed FROM per GROUP BY candidate)"""


def _trials(spark, sf):
    """A label stands for a document and its points for chunks: what is relevant to a query is its own label's document."""
    points = table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("label").alias("document_id"))
    golden = points.filter("point_id % 100 = 0").select(F.col("point_id").alias("query_id"), F.array().cast("array<string>").alias("chunks"), F.array(F.col("document_id").cast("string")).alias("documents"))
    dense_leg, sparse_leg = _legs(spark, sf)
    score = lambda pairs: pairs.withColumn("rerank_score", (F.col("point_id") % 3).cast("double"))
    tried = autopilot.candidates(IN_USE)
    return autopilot.trials(dense_leg, sparse_leg, golden, points, tried, 10, score), tried


@C.query(f"{_TRIALS} SELECT * FROM measured")
def autopilot_trials(spark, sf):
    return _trials(spark, sf)[0]


_FOUR = "printf('ndcg@10 %.4f, recall %.4f, mrr %.4f', {0}.ndcg, {0}.recall, {0}.mrr)"


@C.query(f"""{_TRIALS}, base AS (SELECT * FROM measured WHERE candidate = 0), best AS (SELECT * FROM measured ORDER BY ndcg DESC, recall DESC, mrr DESC, candidate LIMIT 1),
  changed(candidate, yaml) AS (VALUES (0, ''), (1, '  bm25_weight: 0.5'), (2, '  dense_weight: 0.5'), (3, '  bm25_weight: 0.25'), (4, '  dense_weight: 0.25'), (5, '  rrf_k: 10.0'), (6, '  rrf_k: 30.0'), (7, '  rerank: false'))
  SELECT best.candidate, best.ndcg > base.ndcg AS improves, round(best.recall - base.recall, 4) AS recall, round(best.mrr - base.mrr, 4) AS mrr, round(best.ndcg - base.ndcg, 4) AS ndcg, 8::BIGINT AS evaluated, 0::BIGINT AS skipped,
    '# a suggestion, not applied; in use: ' || {_FOUR.format("base")} || CASE WHEN best.ndcg > base.ndcg THEN chr(10) || '# suggested: ' || {_FOUR.format("best")} || chr(10) || 'retrieval:' || chr(10) || yaml || chr(10) ELSE chr(10) || '# nothing measures better' || chr(10) || '{{}}' || chr(10) END AS yaml
  FROM best JOIN changed USING (candidate), base""")
def autopilot_suggestion(spark, sf):
    return autopilot.suggestion(*_trials(spark, sf), 10)


@C.query(f"""WITH f AS ({_fused_sql(1.0, 0.5)}), q AS (SELECT vec_id AS query_id, CASE WHEN label % 4 <> 3 THEN (vec_id % 1000) / 1000.0::DOUBLE END AS grade FROM embeddings WHERE vec_id % 100 = 0)
  SELECT q.query_id, coalesce(grade < 0.7, false) AS refused, CASE WHEN coalesce(grade >= 0.7, true) THEN 'said' END AS answer, f.final_rank AS place, f.point_id AS chunk_id, 's' || f.point_id % 5 AS source, round(CASE WHEN f.point_id % 2 = 0 THEN f.point_id % 7 / 7.0::DOUBLE ELSE f.score END, 6) AS score
  FROM q LEFT JOIN f ON f.query_id = q.query_id AND f.final_rank <= 5 AND grade < 0.7""")
def grounded_refusals(spark, sf):
    answers = table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("answer_id"), F.lit("said").alias("answer"), F.when(F.col("label") % 4 != 3, F.col("vec_id") % 1000 / 1000).alias("score"))
    id = F.col("point_id")
    chunks = _fused(spark, sf, 1.0, 0.5).select(F.col("query_id").alias("answer_id"), "final_rank", id.alias("chunk_id"), F.concat(F.lit("s"), (id % 5).cast("string")).alias("source"), F.when(id % 2 == 0, id % 7 / 7).alias("rerank_score"), F.col("score").alias("rrf_score"))
    rows = context.grounded_or_refused(answers, chunks, 0.7).select(F.col("answer_id").alias("query_id"), "refused", "answer", F.posexplode_outer("candidates").alias("place", "c"))
    return rows.select("query_id", "refused", "answer", (F.col("place") + 1).alias("place"), "c.chunk_id", "c.source", "c.score")


@C.query(f"""WITH listed AS (SELECT doc_id, {_TERMS} AS terms FROM documents), t AS (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM listed),
  one AS (SELECT doc_id, length, ('0x' || left(md5(term), 3))::BIGINT AS term_id, min(term) AS term, count(*) AS tf FROM t GROUP BY ALL)
  SELECT doc_id AS point_id, term_id, term, tf, round(tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / 256)), 9) AS weight FROM one""")
def bm25_vectors(spark, sf):
    """Under an index of 4,096 places, so that terms of one document collide."""
    index = lambda term: F.conv(F.substring(F.md5(term), 1, 3), 16, 10).cast("long")
    return keyword.encoded(_chunks(spark, sf), stems=False, index=index).select("point_id", "term_id", "term", "tf", F.round("weight", 9).alias("weight"))
