"""Passage retrieval: dense, lexical and ranked-text search, fusion, grading, diagnostics."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import text as t
from strata.functions.stemming import stems
from strata.operators import ranked
from strata.operators.shared import shared_folder, spread

RRF_K, DEPTH = 60, 24
#: What a cover without other words adds to the rank of a passage.
COVER = 0.1
#: Vectors and queries of a block.
BLOCK, ASKED = 2048, 2048


def _top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def refused_vectors(vectors: DataFrame, width: int) -> DataFrame:
    """(reason, n) of the vectors (chunk, v) that no search takes: null, without length, of another width."""
    v = F.col("v").cast("array<double>")
    reason = F.when(v.isNull(), "null").when(F.size(v) != width, "another width").when(_norm(v) == 0, "no length")
    return vectors.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _matrix(packed: pa.Table, name: str, id_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the vectors at length one of a packed block, without a Python object a number."""
    rows = packed[name].combine_chunks().flatten()
    ids, v = rows.field(id_col).to_numpy(), rows.field("v").flatten().to_numpy().reshape(len(rows), -1)
    return ids, v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _best(k: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        (ids, c), (own, q) = _matrix(left, "vectors", "chunk"), _matrix(right, "asked", "query")
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(len(own)):
            score = np.round((c * q[i]).sum(axis=1), 12)  # a row's sum doesn't depend on the block it is in
            best = np.lexsort((ids, -score))[:k]
            found.append((np.full(len(best), own[i]), ids[best], score[best]))
        return pa.table([pa.array(np.concatenate(x), kind) for x, kind in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query", "chunk", "score"])

    return run


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int, *, least: float | None = None, others_only: bool = False) -> DataFrame:
    """(query, chunk, score, rank) of (query, v) against (chunk, v), ids being longs; scores to 12 places.

    Null, zero and other-width vectors are no candidates (`refused_vectors` counts them). `least` cuts after the k best
    are known, not before; `others_only` leaves out the chunk of the query's own id. Blocks of queries meet blocks of
    vectors, and each pair of blocks gives the k best of each query; a Python worker holds one pair at a time.
    """

    def usable(df: DataFrame, id_col: str) -> DataFrame:
        df = df.select(F.col(id_col).cast("bigint").alias(id_col), F.col("v").cast("array<double>").alias("v")).where("v IS NOT NULL")
        return df.where((F.size("v") > 0) & (_norm(F.col("v")) > 0)).withColumn("width", F.size("v"))

    def packed(df: DataFrame, id_col: str, size: int, name: str, number: str) -> DataFrame:
        blocks = df.groupBy("width").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_blocks"))  # a row a width
        dealt = df.join(F.broadcast(blocks), "width").withColumn(number, F.pmod(F.xxhash64(id_col), F.col("_blocks")).cast("int"))
        return dealt.groupBy("width", number).agg(F.collect_list(F.struct(id_col, "v")).alias(name))  # about `size` rows

    c, q = packed(usable(vectors, "chunk"), "chunk", BLOCK, "vectors", "block"), packed(usable(queries, "query"), "query", ASKED, "asked", "q_block")
    keys = ["width", "block", "q_block"]
    other = lambda df, number: df.select("width", (F.col(number) + 0).alias(number))  # noqa: E731  a column of its own: both sides are grouped by it
    left, right = c.join(other(q, "q_block"), "width"), q.join(other(c, "block"), "width")
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best(k + 1 if others_only else k), "query bigint, chunk bigint, score double")
    if others_only:
        pairs = pairs.where("chunk <> query")
    top = _top(pairs, k, F.desc("score"), F.col("chunk"))
    return top.where(F.col("score") >= least) if least is not None else top


def questioned(queries: DataFrame) -> DataFrame:
    """(query, terms, scale) of the questions that have terms; scale is their number."""
    return queries.select("query", t.terms(F.col("question")).alias("terms")).where(F.size("terms") > 0).withColumn("scale", F.size("terms"))


def substring_posts(asked: DataFrame, passages: DataFrame) -> DataFrame:
    """(term, chunk, hits) of the terms that stand in title or text as substrings.

    A term lies within a run of the characters that terms are made of. So terms are looked for in the different runs of
    the corpus, by their first three characters, and passages are reached over the runs that they hold.
    """
    shared_folder(passages.sparkSession)
    found = F.regexp_extract_all(F.lower(F.concat_ws("\n", "title", "text")), F.lit(r"([a-z0-9.\-_/]+)"), 1)
    runs = spread(passages.select("chunk", "title", "text")).select(F.col("chunk").cast("bigint").alias("chunk"), F.explode(found).alias("run")).groupBy("chunk", "run").agg(F.count(F.lit(1)).alias("n"))
    terms = asked.select(F.explode("terms").alias("term")).distinct().withColumn("start", F.substring("term", 1, 3)).checkpoint()
    terms = F.broadcast(terms) if terms.limit(ranked.FEW + 1).count() <= ranked.FEW else terms
    starts = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("run") - k + 1)), lambda i: F.col("run").substr(i, F.lit(k)))
    different = runs.select("run").distinct().select("run", F.explode(F.array_distinct(F.concat(starts(2), starts(3)))).alias("start"))
    inside = different.join(terms, "start").where(F.contains("run", "term")).select("run", "term", t.occurrences(F.col("run"), F.col("term")).alias("times"))
    return runs.join(inside, "run").groupBy("chunk", "term").agg(F.sum(F.col("n") * F.col("times")).alias("hits"))


def term_hits(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """(query, chunk, coverage, hits): how much of a question's terms each passage holds as substrings, passages without any left out.

    All pairs with a term in common: `lexical_top_k` finds the best without them.
    """
    asked = questioned(queries)
    rows = substring_posts(asked, passages).join(asked.select("query", "scale", F.explode("terms").alias("term")), "term")
    return rows.groupBy("query", "chunk").agg((F.count(F.lit(1)) / F.max("scale")).alias("coverage"), F.sum("hits").alias("hits"))


def lexical_top_k(queries: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """(query, chunk, score, rank): coverage plus a hundredth of at most twenty occurrences; ties to the smaller chunk."""
    asked = questioned(queries)
    found = ranked.searched(asked, ranked.substrings(asked, passages, covered=True), k, most_o=20.0, places=None)
    return ranked.best(found, k, places=None).drop("held")


def quotes_in(quotes: DataFrame, sources: DataFrame, *, words: int = 5) -> DataFrame:
    """(quote_id, source_id) of the quotes that stand in the sources but for case and white space.

    The inner words of a quote are whole words of a text that holds it, so the two meet on the hash of the first of them,
    at most `words`; the whole quote decides. Quotes without inner words meet on a part of a word, and so all texts.
    """
    q = quotes.select("quote_id", F.lower(t.squeezed(F.col("quote"))).alias("_q")).where(F.length("_q") > 0).withColumn("_w", F.split("_q", " "))
    s = sources.select("source_id", F.lower(t.squeezed(F.col("text"))).alias("_t"))
    cut = s.select("source_id", F.split("_t", " ").alias("_w"))
    q = q.withColumn("_k", F.least(F.lit(words), F.size("_w") - 2))
    long = q.where("_k > 0").select("quote_id", "_q", "_k", F.xxhash64(F.array_join(F.slice("_w", F.lit(2), F.col("_k")), " ")).alias("_h"))
    sizes = F.broadcast(long.select("_k").distinct())  # at most `words` numbers
    places = F.sequence(F.lit(1), F.size("_w") - F.col("_k") + 1)
    grams = cut.join(sizes, F.size("_w") >= F.col("_k")).select("source_id", "_k", F.explode(F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice("_w", i, F.col("_k")), " ")))).alias("_h"))
    met = grams.join(long, ["_h", "_k"]).select("quote_id", "source_id", "_q").distinct()
    found = met.join(s, "source_id").where(F.contains("_t", "_q")).select("quote_id", "source_id")
    short = q.where("_k <= 0").select("quote_id", "_q")
    return found if short.isEmpty() else found.unionByName(s.join(short, F.contains("_t", "_q")).select("quote_id", "source_id"))


def stemmed(words: DataFrame, *, light: bool = False) -> DataFrame:
    """(word, term) of the different words of a table (word): their English stems, or only without plural endings."""
    words = words.select("word").distinct()
    return words.select("word", t.stem(F.col("word")).alias("term")) if light else stems(words).withColumnRenamed("stem", "term")


def index(passages: DataFrame, *, only: DataFrame | None = None, light: bool = False) -> DataFrame:
    """(term, chunk, pos): the positions of every word of title and text under its stem; with `only` (term) of those terms alone.

    Different words are stemmed once; with `only` the few words behind its terms are all that the positions meet.
    """
    words = F.regexp_extract_all(F.lower(F.concat_ws("\n", "title", "text")), F.lit("([a-z0-9]+)"), 1)
    places = passages.select("chunk", F.posexplode(words).alias("pos", "word"))
    of = stemmed(passages.select(F.explode(F.array_distinct(words)).alias("word")), light=light)
    if only is not None:
        of = of.join(F.broadcast(only.select("term").distinct()) if only.limit(ranked.FEW + 1).count() <= ranked.FEW else only.select("term").distinct(), "term", "left_semi")
        shared_folder(passages.sparkSession)
        of = of.checkpoint()
        of = F.broadcast(of) if of.limit(ranked.FEW + 1).count() <= ranked.FEW else of
    return places.join(of, "word").select("term", "chunk", "pos")


def stem_terms(queries: DataFrame, *, light: bool = False) -> DataFrame:
    """(query, term): the different stems of the words of each question's terms."""
    words = queries.select("query", F.explode(t.terms(F.col("question"))).alias("term")).select("query", F.explode(F.regexp_extract_all("term", F.lit("([a-z0-9]+)"), 1)).alias("word"))
    return words.join(stemmed(words, light=light), "word").select("query", "term").distinct()


def precise(queries: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """(query, chunk, score, rank) of passages that hold all terms, ranked by cover density; ties to the smaller chunk.

    The passages that hold all terms are found first, over those of a question's rarest term; only their places are met
    with questions. A cover is a stretch of a passage that holds all terms and no shorter one that does; it adds COVER
    over one more than the words in it that are no terms. A place of a term begins a cover if, at some end, the term
    doesn't come again up to there, all places before come again, and every term has come once. The least such end is the
    greatest of the place itself, the next places of the terms of all earlier ones, and the last of the terms' first
    places: running values over the places, so rows are the places of terms and no more.
    """
    shared_folder(queries.sparkSession)
    q = stem_terms(queries).checkpoint()
    held = postings.select("term", "chunk").distinct().checkpoint()
    df = q.join(held.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term", "left").na.fill(0, ["df"])
    rarest = df.groupBy("query").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.count(F.lit(1)).alias("need"))
    asked = held.join(rarest, "term").select("query", "chunk", "need").join(q, "query")  # only passages with a question's rarest term can hold all
    whole = asked.join(held, ["term", "chunk"], "left_semi").groupBy("query", "chunk", "need").agg(F.count(F.lit(1)).alias("n")).where("n = need").select("query", "chunk").checkpoint()
    chunks = whole.select("chunk").distinct()
    postings = postings.join(F.broadcast(chunks) if chunks.limit(ranked.FEW + 1).count() <= ranked.FEW else chunks, "chunk", "left_semi")
    met = postings.join(whole.join(q, "query"), ["chunk", "term"])
    own = Window.partitionBy("query", "chunk")
    placed = met.withColumn("place", F.row_number().over(own.orderBy("pos")))
    again = Window.partitionBy("query", "chunk", "term").orderBy("place")
    never = F.lit(2**31 - 1)  # beyond the last place
    placed = placed.withColumns({"first": F.lag("place").over(again).isNull(), "next": F.coalesce(F.lead("place").over(again), never), "next_pos": F.coalesce(F.lead("pos").over(again), never)})
    earlier, to = own.orderBy("place").rowsBetween(Window.unboundedPreceding, -1), own.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    end = lambda c, after: F.greatest(c, F.coalesce(F.max(after).over(earlier), F.lit(0)), F.max(F.when(F.col("first"), F.col(c))).over(to))
    covers = placed.withColumns({"end": end("pos", "next_pos"), "last": end("place", "next")}).where("last < next")
    noise = (F.col("end") - F.col("pos")) - (F.col("last") - F.col("place"))
    return _top(covers.groupBy("query", "chunk").agg(F.sum(COVER / (1 + noise)).alias("score")), k, F.round("score", 9).desc(), F.col("chunk"))


def relaxed(queries: DataFrame, passages: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query, chunk, score, rank): any-term search for the questions that the precise stage found nothing for: a pool of 4k by occurrences, ranked anew by coverage."""
    asked = questioned(queries.join(found.select("query").distinct(), "query", "left_anti"))
    found = ranked.searched(asked.drop("scale"), ranked.substrings(asked, passages, covered=False), 4 * k)
    pool = ranked.best(found, 4 * k).withColumnRenamed("rank", "pool").join(asked.select("query", "scale"), "query")
    return _top(pool.select("query", "chunk", (F.col("held") / F.col("scale")).alias("score"), "pool"), k, F.desc("score"), F.col("pool")).drop("pool")


def fulltext_top_k(queries: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """(query, chunk, score, rank, stage): the precise stage, and for the questions that it finds nothing for the relaxed one."""
    shared_folder(passages.sparkSession)
    found = precise(queries, index(passages, only=stem_terms(queries)), k).checkpoint()
    return found.withColumn("stage", F.lit("precise")).unionByName(relaxed(queries, passages, found, k).withColumn("stage", F.lit("relaxed")))


def bm25(queries: DataFrame, passages: DataFrame, k: int, *, columns: dict[str, float] | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, chunk, score, rank) by BM25 over the questions' terms, without scoring every passage that holds one. `columns` weighs columns of the passages, by default `text` alone."""
    asked, index = bm25_index(queries, passages, columns or {"text": 1.0}, k1, b)
    return ranked.best(ranked.searched(asked, index, k), k).drop("held")


def bm25_index(queries: DataFrame, passages: DataFrame, columns: dict[str, float], k1: float = 1.2, b: float = 0.75, title: Column | None = None) -> tuple[DataFrame, list]:
    """The questions with their terms, and the packed postings of these: a term's weighted frequency over the columns, its rarity, and the length of all columns."""
    asked = questioned(queries).drop("scale")
    return asked, ranked.bm25(asked, passages, columns, k1, b, title)


def few(rows: DataFrame) -> DataFrame:
    """Rows that are k a question, marked for a broadcast if they are few, so that texts that they meet stay where they are."""
    shared_folder(rows.sparkSession)
    rows = rows.checkpoint()
    return F.broadcast(rows) if rows.limit(ranked.FEW + 1).count() <= ranked.FEW else rows


def section_search(queries: DataFrame, passages: DataFrame, k: int = 8, *, columns: dict[str, float], family: Column | None = None) -> DataFrame:
    """(query, chunk, score, place, rank, snippet): at most twelve sections a question, of the passages that `family` allows.

    First those whose title is the question (place 0), then those that hold all its terms (1), then those that hold some
    (2), each by BM25 over the weighted columns: a search among the passages of the question's title, one for passages
    with all terms and one for any find the best. The snippet is the text around the first term that it holds.
    """
    allowed, k = passages if family is None else passages.where(family), min(k, 12)
    asked, index = bm25_index(queries, allowed, columns, title=t.alias_norm(F.col("title")))
    names = queries.select("query", t.alias_norm(F.col("question")).alias("_name")).join(asked, "query").checkpoint()
    rows = [ranked.best(ranked.searched(names, index, k, **of), k) for of in ({"title": "_name"}, {"whole": True}, {})]
    rows = few(reduce(DataFrame.unionByName, rows).groupBy("query", "chunk").agg(F.max("score").alias("score"), F.max("held").alias("held")).join(names, "query"))
    rows = allowed.select("chunk", "title", "text").join(rows, "chunk")
    place = F.when(t.alias_norm(F.col("title")) == F.col("_name"), 0).when(F.col("held") == F.size("terms"), 1).otherwise(2)
    top = _top(rows.withColumn("place", place), k, F.col("place"), F.round("score", 9).desc(), F.col("chunk"))
    at = F.array_min(F.filter(F.transform("terms", lambda x: F.instr(F.lower("text"), x)), lambda i: i > 0))
    return top.select("query", "chunk", "score", "place", "rank", F.substring("text", F.greatest(F.lit(1), F.coalesce(at, F.lit(1)) - 40), F.lit(120)).alias("snippet"))


def fuse(*ranked: DataFrame | None, k: int = RRF_K) -> DataFrame:
    """(query, chunk, rrf, found_by, similarity, rank_1..): reciprocal rank fusion of rankings (query, chunk, rank); similarity is the score of the first, null where it has none.

    A leg that is absent, or has nothing for a question, adds nothing.
    """
    legs = [r.select("query", "chunk", F.lit(i).alias("leg"), "rank", (F.col("score") if i == 1 and "score" in r.columns else F.lit(None)).cast("double").alias("score")) for i, r in enumerate(ranked, 1) if r is not None]
    rows = reduce(DataFrame.union, legs)
    ranks = [F.max(F.when(F.col("leg") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(1, len(ranked) + 1)]
    return rows.groupBy("query", "chunk").agg(F.sum(1 / (k + F.col("rank"))).alias("rrf"), F.count(F.lit(1)).alias("found_by"), F.max("score").alias("similarity"), *ranks)


def fused_top_k(fused: DataFrame, k: int) -> DataFrame:
    """By fused score; ties by how many legs found it, then by similarity, then to the smaller chunk."""
    return _top(fused, k, F.round("rrf", 12).desc(), F.desc("found_by"), F.desc_nulls_last("similarity"), F.col("chunk"))


def hybrid_top_k(queries: DataFrame, passages: DataFrame, asked: DataFrame | None, vectors: DataFrame | None, k: int = 6, *, depth: int = DEPTH, techniques: list[str] | None = None) -> DataFrame:
    """The fusion of a dense leg, (query, v) against (chunk, v), and a lexical one, `depth` hits each, over the passages of `techniques`; without vectors the lexical leg is alone."""
    if techniques is not None:
        passages = passages.where(F.col("technique").isin(techniques))
        vectors = None if vectors is None else vectors.join(passages.select("chunk"), "chunk", "left_semi")
    dense = None if asked is None or vectors is None else cosine_top_k(asked, vectors, depth)
    return fused_top_k(fuse(dense, lexical_top_k(queries, passages, depth)), k)


def graded(hits: DataFrame, queries: DataFrame, passages: DataFrame, *, structured: float = 1.0) -> DataFrame:
    """The hits with coverage, grade, useful and position: by grade, then fused score times a weight for tables and captions."""
    q = queries.select("query", t.terms(F.col("question")).alias("terms"))
    rows = passages.select("chunk", "text").join(few(hits), "chunk").join(q, "query")
    cover = t.coverage(F.col("text"), F.col("terms"))
    rows = rows.withColumns({"coverage": cover, "grade": t.grade(cover), "weight": F.when(t.looks_structured(F.col("text")), structured).otherwise(1.0)})
    at = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), F.round(F.col("rrf") * F.col("weight"), 12).desc(), F.col("chunk")))
    return rows.withColumns({"useful": F.col("grade") >= 2, "position": at}).drop("text", "terms")


def rescued(grades: DataFrame) -> DataFrame:
    """(query, chunk, grade): the best grade over a question and its parts; a part never lowers one."""
    return grades.groupBy("query", "chunk").agg(F.max("grade").alias("grade"))


def corpus_stats(passages: DataFrame) -> DataFrame:
    """(technique, chunks, embedded) with passages of no technique under 'none'."""
    return passages.groupBy(F.coalesce("technique", F.lit("none")).alias("technique")).agg(F.count(F.lit(1)).alias("chunks"), F.count("text").alias("embedded"))
