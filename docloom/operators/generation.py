"""Context assembly, citations and answer metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions.scores import quantize, topk

# Stop words of quote matching and of the answer metrics.
QUOTE_STOPWORDS = (
    "the a an is was were are be been being have has had do does did will would could should may might can to of in on at by "
    "for with and or but from that this it as no yes also about patient patients").split()
METRIC_STOPWORDS = (
    "the a an is was were are be been being have has had do does did will would could should may might shall can to of in on "
    "at by for with and or not but from that this it its as so if then when who what which there their they he she we you i "
    "no yes also about after before between into through during patient patients").split()
# The notice of a context without a chunk, and the flags told in a header.
NO_EVIDENCE = "No relevant evidence found in the document."
CONTEXT_FLAGS = ("medication", "lab", "diagnosis", "vital")
CITATION = r"\[([0-9]+)\]"
WEIGHTS = {"faithfulness": 0.35, "relevance": 0.20, "precision": 0.20, "coverage": 0.15, "recall": 0.10}


def content_tokens(text: Column | str, stop: list[str] = METRIC_STOPWORDS) -> Column:
    return F.array_except(tx.distinct_tokens(text), F.array(*[F.lit(w) for w in stop]))


def _ordered(results: DataFrame, ordering: str) -> DataFrame:
    """Best row per chunk with its place ``pos`` and the tokens up to it."""
    key = ["query_id"]
    u = topk(results, ["query_id", "chunk_id"], [F.desc("score"), F.asc("page_start")], 1, "_d").drop("_d")
    u = u.withColumn("token_count", F.size(tx.words("text")))
    w = Window.partitionBy(*key)
    by_score = w.orderBy(F.desc("score"), "chunk_id")
    if ordering == "page":
        u = u.withColumn("pos", F.row_number().over(w.orderBy("page_start", "chunk_id")))
    elif ordering == "mixed":
        u = u.withColumn("_s", F.row_number().over(by_score)).withColumn("_n", F.count("*").over(w))
        top = F.col("_s") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 2))
        u = u.withColumn("pos", F.row_number().over(w.orderBy(F.when(top, 0).otherwise(1), F.when(top, F.col("_s")).otherwise(F.col("page_start")), "_s"))).drop("_s", "_n")
    elif ordering == "score":
        u = u.withColumn("pos", F.row_number().over(by_score))
    else:
        raise ValueError("ordering must be score, page or mixed")
    run = w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn("used_tokens", F.sum("token_count").over(run))


def assemble(results: DataFrame, budget: int, ordering: str = "score") -> DataFrame:
    """Context chunks per query under a token budget.

    ``results``: query_id, chunk_id, score, page_start, text.  Best row per
    chunk, ordered, cut at the first chunk that overflows, numbered from 1."""
    # token counts are not negative, so the first overflow cuts everything after
    return _ordered(results, ordering).filter(F.col("used_tokens") <= budget).withColumnRenamed("pos", "citation_number")


def source_label(page_start: Column, page_end: Column, section: Column, sentence_index: Column | None = None) -> Column:
    """``Sentence 3 | Pages 2-4 | section``, pages and sentences counted from one;
    parts that are null or empty are left out."""
    first, last = F.coalesce(page_start, F.lit(0)), F.coalesce(page_end, page_start, F.lit(0))
    number = lambda c: (c + 1).cast("int").cast("string")
    pages = F.when(first == last, F.concat(F.lit("Page "), number(first))).otherwise(F.concat(F.lit("Pages "), number(first), F.lit("\u2013"), number(last)))
    sentence = F.lit(None) if sentence_index is None else F.concat(F.lit("Sentence "), number(sentence_index))
    return F.concat_ws(" | ", sentence, pages, F.when(section != "", section))


def _block(chunks: DataFrame, number: str, flags: bool) -> Column:
    """A chunk as an evidence block: its header between two rules, then its text."""
    has = lambda c, kind: F.col(c) if c in chunks.columns else F.lit(None).cast(kind)
    label = source_label(has("page_start", "int"), has("page_end", "int"), has("section", "string"), has("sentence_index", "int"))
    told = F.concat_ws(", ", *[F.when(has(f"contains_{f}", "boolean"), F.lit(f)) for f in CONTEXT_FLAGS]) if flags else F.lit("")
    header = F.concat(F.lit("["), F.col(number).cast("string"), F.lit("] "), label, F.when(told != "", F.concat(F.lit(" ("), told, F.lit(")"))).otherwise(""))
    rule = F.repeat(F.lit("\u2500"), F.least(F.lit(60), F.length(header) + 4))
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$", "")
    return F.concat_ws("\n", rule, header, rule, body)


def _joined(blocks: Column) -> Column:
    return F.regexp_replace(F.array_join(F.transform(F.array_sort(blocks), lambda r: r["t"]), "\n\n"), "\n+$", "")


def format_context(chunks: DataFrame, flags: bool = True) -> DataFrame:
    """Context text per query (bounded by the token budget): an evidence block
    for each chunk, in citation order.  ``page_start``, ``page_end``, ``section``,
    ``sentence_index`` and the ``contains_`` flags enter where they are given."""
    g = chunks.select("query_id", F.struct("citation_number", _block(chunks, "citation_number", flags).alias("t")).alias("b")).groupBy("query_id")
    return g.agg(_joined(F.collect_list("b")).alias("formatted_text"))


def contexts(queries: DataFrame, results: DataFrame, budget: int, ordering: str = "score", flags: bool = True) -> DataFrame:
    """One row per query: ``formatted_text``, ``total_tokens``, ``truncated``,
    ``truncated_count`` (chunks left out by the budget) and ``citation_map``
    (chunk_id to number).  A query without a chunk gets the fixed notice."""
    u = _ordered(results, ordering)
    fits = F.col("used_tokens") <= budget
    # only what fits carries its text into the aggregate
    u = u.select("query_id", "token_count", fits.alias("fits"), F.when(fits, F.struct("pos", _block(u, "pos", flags).alias("t"), "chunk_id")).alias("b"))
    g = u.groupBy("query_id").agg(F.sum(F.when(F.col("fits"), F.col("token_count"))).alias("total"), F.count_if(~F.col("fits")).alias("cut"), F.collect_list("b").alias("b"))
    out = queries.select("query_id").join(g, "query_id", "left")
    cited = F.map_from_entries(F.transform(F.array_sort("b"), lambda r: F.struct(r["chunk_id"], r["pos"])))
    return out.select("query_id", F.when(F.size("b") > 0, _joined(F.col("b"))).otherwise(F.lit(NO_EVIDENCE)).alias("formatted_text"),
                      F.coalesce("total", F.lit(0)).cast("bigint").alias("total_tokens"), (F.coalesce("cut", F.lit(0)) > 0).alias("truncated"),
                      F.coalesce("cut", F.lit(0)).alias("truncated_count"), cited.alias("citation_map"))


def citation_numbers(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), lambda x: x.cast("int"))


def _sentences(text: Column | str, longer_than: int) -> Column:
    return F.filter(F.transform(tx.sentences(text), lambda s: F.trim(s)), lambda s: F.length(s) > longer_than)


def _candidates(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, answer sentence, chunk) rows; a query's context is bounded by
    the token budget, its answer by the generator's output length."""
    s = answers.select("query_id", F.posexplode(_sentences("answer", 0)).alias("sentence_idx", "sentence"))
    s = s.withColumn("cited", F.array_distinct(citation_numbers(F.col("sentence"))))
    return s.join(chunks.select("query_id", "citation_number", "chunk_id", "text"), "query_id")


def best_quotes(pairs: DataFrame) -> DataFrame:
    """Best chunk sentence (F1 on content words) per answer sentence and chunk;
    the runner-up joins when it scores at least 60 % of the best and 0.15."""
    key = ["query_id", "sentence_idx", "citation_number"]
    p = pairs.withColumn("at", content_tokens("sentence", QUOTE_STOPWORDS))
    ex = p.select(*key, "chunk_id", "sentence", "cited", "at", F.posexplode(F.filter(_sentences("text", 0), lambda s: F.length(s) >= 8)).alias("i", "quote"))
    ex = ex.withColumn("score", tx.f1(F.col("at"), content_tokens("quote", QUOTE_STOPWORDS)))
    ex = topk(ex, key, [F.desc("score"), F.asc("i")], 2, "r")
    g = ex.groupBy(*key, "chunk_id", "sentence", "cited").agg(
        F.max(F.when(F.col("r") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("r") == 1, F.col("quote"))).alias("q1"),
        F.max(F.when(F.col("r") == 2, F.col("score"))).alias("s2"), F.max(F.when(F.col("r") == 2, F.col("quote"))).alias("q2"))
    both = (F.col("s2") >= 0.6 * F.col("score")) & (F.col("s2") >= 0.15)
    return g.withColumn("quote", F.substring(F.when(both, F.concat_ws(" ", "q1", "q2")).otherwise(F.col("q1")), 1, 500)).drop("q1", "q2", "s2")


def sentence_citations(answers: DataFrame, chunks: DataFrame, min_score: float = 0.12, inferred: int = 2) -> DataFrame:
    """Citations per answer sentence: the marked ones, else the best two inferred."""
    q = best_quotes(_candidates(answers, chunks))
    marked = q.filter(F.array_contains("cited", F.col("citation_number"))).withColumn("inferred", F.lit(False))
    free = q.filter((F.size("cited") == 0) & (F.col("score") >= min_score))
    guess = topk(free, ["query_id", "sentence_idx"], [F.desc("score"), F.asc("citation_number")], inferred, "_r").drop("_r").withColumn("inferred", F.lit(True))
    return marked.unionByName(guess).select("query_id", "sentence_idx", "citation_number", "chunk_id", "quote", quantize(F.col("score"), 3).alias("score"), "inferred")


def resolve_citations(answers: DataFrame, chunks: DataFrame, min_confidence: float = 0.05) -> DataFrame:
    """One row per cited chunk: the best quote over the sentences citing it,
    falling back to the chunk's first 300 characters."""
    q = sentence_citations(answers, chunks).filter(~F.col("inferred"))
    best = topk(q, ["query_id", "citation_number"], [F.desc("score"), F.asc("sentence_idx")], 1, "_r").drop("_r")
    c = chunks.select("query_id", "citation_number", "chunk_id", F.trim(F.substring("text", 1, 300)).alias("head"))
    cited = answers.select("query_id", F.explode(F.array_distinct(citation_numbers(F.col("answer")))).alias("citation_number"))
    j = c.join(cited, ["query_id", "citation_number"], "left_semi").join(best.select("query_id", "citation_number", "quote", "score"), ["query_id", "citation_number"], "left")
    weak = F.coalesce(F.col("score") < min_confidence, F.lit(True))
    return j.select("query_id", "citation_number", "chunk_id", F.when(weak, F.col("head")).otherwise(F.col("quote")).alias("quote"),
                    F.when(weak, 0.0).otherwise(F.col("score")).alias("confidence"))


def answer_metrics(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Faithfulness, relevance, context precision / recall, citation coverage,
    hallucination risk and the weighted overall score per query.

    ``answers``: query_id, query, answer.  Context tokens are a set union per
    query, bounded by the context's token budget."""
    ctx = chunks.groupBy("query_id").agg(
        F.array_distinct(F.flatten(F.collect_list(tx.distinct_tokens("text")))).alias("ctx"), F.array_sort(F.collect_set("citation_number")).alias("numbers"))
    a = answers.join(ctx, "query_id", "left")
    none = F.array().cast("array<string>")
    a = a.withColumn("ctx", F.coalesce("ctx", none)).withColumn("numbers", F.coalesce("numbers", F.array().cast("array<int>")))
    a = a.withColumn("cited", F.array_distinct(citation_numbers(F.col("answer")))).withColumn("at", content_tokens("answer")).withColumn("qt", content_tokens("query"))
    a = a.withColumn("cctx", F.array_except("ctx", F.array(*[F.lit(w) for w in METRIC_STOPWORDS])))
    s = a.select("query_id", "ctx", "cctx", F.explode(_sentences("answer", 15)).alias("s"))
    s = s.withColumn("marked", F.col("s").rlike(CITATION)).withColumn("tok", tx.distinct_tokens("s")).withColumn("ct", content_tokens("s"))
    share = F.when(F.size("tok") > 0, F.size(F.array_intersect("tok", "ctx")) / F.size("tok")).otherwise(0.0)
    long = F.length("s") > 20
    risk = F.when(F.col("marked") | (F.size("ct") < 4), 0.0).otherwise(quantize(F.greatest(F.lit(0.0), 1.0 - 2.5 * tx.overlap(F.col("ct"), F.col("cctx"))), 3))
    per = s.groupBy("query_id").agg(
        F.avg(F.when(long, F.when(F.col("marked") | (share >= 0.4), 1.0).otherwise(0.0))).alias("faithfulness"), F.avg(risk).alias("hallucination_risk"))
    used = a.select("query_id", "cited", "at").join(chunks.select("query_id", "citation_number", content_tokens("text").alias("kt")), "query_id")
    hit = F.array_contains("cited", F.col("citation_number")) | (tx.overlap(F.col("kt"), F.col("at")) >= 0.15)
    prec = used.groupBy("query_id").agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("precision"))
    m = a.join(per, "query_id", "left").join(prec, "query_id", "left")
    cov = F.when(F.size("cited") == 0, 1.0).otherwise(F.size(F.array_intersect("cited", "numbers")) / F.size("cited"))
    rec = F.when(F.size("qt") == 0, 1.0).otherwise(tx.overlap(F.col("qt"), F.col("cctx")))
    m = m.select("query_id", quantize(F.coalesce("faithfulness", F.lit(1.0)), 3).alias("faithfulness"), quantize(tx.overlap(F.col("at"), F.col("qt")), 3).alias("relevance"),
                 quantize(F.coalesce("precision", F.lit(0.0)), 3).alias("precision"), quantize(cov, 3).alias("coverage"), quantize(rec, 3).alias("recall"),
                 quantize(F.coalesce("hallucination_risk", F.lit(0.0)), 3).alias("hallucination_risk"))
    return m.withColumn("overall", quantize(sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)), 3))
