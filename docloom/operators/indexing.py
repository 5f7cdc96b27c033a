"""Index builders: a wide ``docs`` relation in, named relations out.

``docs`` has one row per retrieval unit (a chunk of any strategy, or a whole
document) keyed by ``doc_idx``.  Every builder is a lazy plan; ``postings``
relations are explode + group-by, so map-side combine runs before the shuffle.
Pairwise relations (same section, same bucket) are kept as group memberships
instead of pair lists: a group of n units costs n rows, not n².
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions.scores import quantize, range_join
from docloom.functions.udfs import char_gram_counts
from docloom.sources.schemas import FLAGS

Relations = dict[str, DataFrame]

K1, B = 1.5, 0.75  # fixed values of the ranking formula
PREVIEW_CHARS = 1000

# Unit -> context class, in order.
UNIT_CLASS = {
    "mg": "dose", "mcg": "dose", "g": "dose", "ml": "dose", "l": "dose",
    "mmhg": "vital", "bpm": "vital", "rpm": "vital",
    "mgdl": "lab", "mmoll": "lab", "iu": "lab", "iul": "lab", "%": "lab", "meql": "lab",
    "celsius": "vital", "fahrenheit": "vital", "c": "vital", "f": "vital",
    "kg": "demographic", "lb": "demographic", "lbs": "demographic",
    "cm": "demographic", "m": "demographic", "in": "demographic",
}
# Flag -> entity type it stands for.
FLAG_TYPE = {
    "contains_medication": "medication_candidate",
    "contains_diagnosis": "diagnosis_or_problem_candidate",
    "contains_vital": "vital",
    "contains_lab": "lab_result",
    "contains_date": "date",
    "contains_imaging": "imaging_candidate",
    "contains_procedure": "procedure_candidate",
}


def truthy_flags(cols: list[str]) -> Column:
    """Names of the flags that are true, in report order."""
    have = [f for f in FLAGS if f in cols]
    return F.filter(F.array(*[F.when(F.col(f), F.lit(f)) for f in have]), lambda x: x.isNotNull())


def doc_records(docs: DataFrame, preview: int = PREVIEW_CHARS) -> DataFrame:
    """Unit metadata with a text preview instead of the text."""
    keep = [c for c in docs.columns if c not in ("text", "tokens", "entities")]
    return docs.select(*keep, F.substring("text", 1, preview).alias("text_preview"))


def term_stats(docs: DataFrame, length_chars: int | None = None) -> DataFrame:
    """One row: number of units and mean length (for length normalisation)."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(doc_length(length_chars)).alias("avg_doc_len"))


def doc_length(length_chars: int | None = None) -> Column:
    """Token count of the unit, or of its first ``length_chars`` characters
    (the stored-preview variant some callers need for parity)."""
    body = F.col("text") if length_chars is None else F.substring("text", 1, length_chars)
    return F.size(tx.tokens(body))


def exploded_terms(docs: DataFrame, terms: Column | None = None, only: DataFrame | None = None, *carry: Column) -> DataFrame:
    """(doc_idx, term) occurrences.  ``only`` (a ``term`` relation, typically the
    terms of a query batch) filters occurrences before anything is grouped."""
    # token array and carried values first: an expression next to explode() would
    # be evaluated once per exploded row
    base = docs.select("doc_idx", *carry, (tx.tokens("text") if terms is None else terms).alias("_t"))
    kept = [c for c in base.columns if c != "_t"]
    ex = base.select(*kept, F.explode("_t").alias("term"))
    if only is None:
        return ex
    # few occurrences are left: placing them by unit once lets counting, scoring
    # and the per-unit sums of a query batch run without another exchange
    return ex.join(only.select("term").distinct(), "term", "left_semi").repartition("doc_idx")


def tf_postings(docs: DataFrame, terms: Column | None = None, only: DataFrame | None = None) -> DataFrame:
    return exploded_terms(docs, terms, only).groupBy("doc_idx", "term").agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Distinct terms inside the row first: no per-document shuffle."""
    ex = exploded_terms(docs, tx.distinct_tokens("text"))
    if only is not None:
        ex = ex.join(only.select("term").distinct(), "term", "left_semi")
    return ex.groupBy("term").agg(F.count("*").alias("df"))


def bm25_index(docs: DataFrame, only: DataFrame | None = None, length_chars: int | None = None) -> Relations:
    """Postings carry the unit length, so scoring needs no join back to the
    units.  With ``only`` the index holds just the terms of a query batch, and
    ``units``, from which the batch is scored."""
    dl = doc_length(length_chars).cast("bigint").alias("doc_len")
    postings = exploded_terms(docs, None, only, dl).groupBy("doc_idx", "doc_len", "term").agg(F.count("*").alias("tf"))
    stats = term_stats(docs, length_chars)
    n = stats.select("n_docs").scalar()
    vocab = document_frequency(docs, only).withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    index = {"docs": doc_records(docs), "postings": postings, "vocab": vocab, "stats": stats}
    return index if only is None else index | {"units": unit_tokens(docs, length_chars)}


def unit_tokens(docs: DataFrame, length_chars: int | None = None) -> DataFrame:
    """The postings by unit: one row per ``doc_idx`` with the length and tokens of its
    texts (one text, unless keys repeat).  Texts travel once, tokens never."""
    own = [] if length_chars is None else [doc_length(length_chars).alias("doc_len")]
    u = docs.select("doc_idx", F.struct("text", *own).alias("t")).groupBy("doc_idx").agg(F.collect_list("t").alias("t"))
    toks = F.transform("t", lambda t: F.struct(tx.tokens(t["text"]).alias("tokens"), *([t["doc_len"].alias("doc_len")] if own else [])))
    if own:
        return u.select("doc_idx", toks.alias("texts"))
    u = u.select("doc_idx", toks.alias("t"))
    return u.select("doc_idx", F.transform("t", lambda t: F.struct(t["tokens"].alias("tokens"), F.size(t["tokens"]).alias("doc_len"))).alias("texts"))


def keyword_index(docs: DataFrame, only: DataFrame | None = None) -> Relations:
    return {"docs": doc_records(docs), "postings": tf_postings(docs, only=only)}


def field_values(docs: DataFrame, entity_types: bool = True) -> DataFrame:
    """(field, value, doc) rows for metadata lookup."""
    cols = docs.columns
    flags = [f for f in FLAGS if f in cols]
    text_flag = lambda c: F.when(c, "True").otherwise("False")
    scalars = [
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
        for c in ("document_type", "primary_section") if c in cols
    ] + [
        F.struct(F.lit(f).alias("field"), F.when(F.col(f).isNotNull(), text_flag(F.col(f))).alias("value"))
        for f in flags
    ]
    parts = [F.array(*scalars)]
    if entity_types and "entities" in cols:
        types = F.array_distinct(F.transform("entities", lambda e: e["entity_type"]))
        parts.append(F.transform(types, lambda t: F.struct(F.lit("entity_type").alias("field"), t.alias("value"))))
    if "section_names" in cols:
        names = F.array_distinct("section_names")
        parts.append(F.transform(names, lambda s: F.struct(F.lit("section_name").alias("field"), s.alias("value"))))
    parts = [F.coalesce(p, F.array().cast("array<struct<field:string,value:string>>")) for p in parts]
    ex = docs.select("doc_idx", F.inline(F.concat(*parts)))
    return ex.filter(F.col("value").isNotNull() & (F.col("value") != ""))


def metadata_index(docs: DataFrame) -> Relations:
    return {"docs": doc_records(docs), "postings": field_values(docs)}


def tfidf_index(docs: DataFrame) -> Relations:
    n = docs.agg(F.count("*").alias("n")).scalar()
    vocab = document_frequency(docs).withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)
    by_doc = Window.partitionBy("doc_idx")
    w = tf_postings(docs).join(vocab.select("term", "idf"), "term")
    w = w.withColumn("w", (0.5 + 0.5 * F.col("tf") / F.max("tf").over(by_doc)) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(by_doc))
    postings = w.select("doc_idx", "term", "tf", F.when(norm > 0, F.col("w") / norm).otherwise(0.0).alias("weight"))
    return {"docs": doc_records(docs), "postings": postings, "vocab": vocab}


def phrase_index(docs: DataFrame, only: DataFrame | None = None) -> Relations:
    toks = tx.tokens("text")
    grams = F.concat(tx.word_ngrams(toks, 2), tx.word_ngrams(toks, 3))
    postings = tf_postings(docs, grams, only).withColumnRenamed("term", "phrase")
    vocab = postings.groupBy("phrase").agg(F.count("*").alias("df"))
    return {"docs": doc_records(docs), "postings": postings, "vocab": vocab}


def char_index(docs: DataFrame, only: DataFrame | None = None) -> Relations:
    """Postings come from units with their grams and counts.  With ``only`` the index
    holds just the grams of a query batch, and ``units``, from which it is scored."""
    lines = docs.select("doc_idx", F.concat_ws(" ", tx.tokens("text")).alias("line")).groupBy("doc_idx").agg(F.collect_list("line").alias("lines"))
    units = char_gram_counts(lines)
    postings = units.select("doc_idx", F.inline(F.arrays_zip(F.col("grams").alias("gram"), F.col("tfs").alias("tf"))))
    if only is not None:
        postings = postings.join(only.select(F.col("term").alias("gram")).distinct(), "gram", "left_semi")
    postings = postings.select("doc_idx", "gram", "tf")
    vocab = postings.groupBy("gram").agg(F.count("*").alias("df"))
    index = {"docs": doc_records(docs), "postings": postings, "vocab": vocab}
    return index if only is None else index | {"units": units}


def fielded_terms(docs: DataFrame) -> DataFrame:
    """(doc, field, term) occurrences over body and metadata fields."""
    cols = docs.columns
    empty = F.array().cast("array<string>")

    def tagged(field: str, toks: Column) -> Column:
        return F.transform(F.coalesce(toks, empty), lambda t: F.struct(F.lit(field).alias("field"), t.alias("term")))

    parts = [tagged("body", tx.tokens("text"))]
    parts += [tagged(c, tx.tokens(c)) for c in ("document_type", "primary_section") if c in cols]
    if "section_names" in cols:
        parts.append(tagged("section_name", tx.tokens(F.array_join("section_names", " "))))
    if "entities" in cols:
        for field, attr in (("entity_type", "entity_type"), ("entity_text", "text"), ("entity_normalized", "normalized_value")):
            parts.append(tagged(field, tx.tokens(F.array_join(F.col("entities").getField(attr), " "))))
    if any(f in cols for f in FLAGS):
        parts.append(tagged("clinical_flag", tx.tokens(F.translate(F.array_join(truthy_flags(cols), " "), "_", " "))))
    return docs.select("doc_idx", F.inline(F.concat(*parts)))


def fielded_index(docs: DataFrame, only: DataFrame | None = None) -> Relations:
    p = fielded_terms(docs)
    if only is not None:
        p = p.join(only.select("term").distinct(), "term", "left_semi").repartition("doc_idx")
    p = p.groupBy("field", "term", "doc_idx").agg(F.count("*").alias("tf"))
    return {"docs": doc_records(docs), "postings": p}


def entity_index(docs: DataFrame) -> Relations:
    p = docs.select("doc_idx", F.inline("entities"))
    p = p.withColumnRenamed("text", "entity_text")
    types = p.groupBy("doc_idx", "entity_type").agg(F.count("*").alias("count"))
    return {"docs": doc_records(docs), "postings": p, "types": types}


def section_page_index(docs: DataFrame) -> Relations:
    cols = docs.columns
    parts = [
        F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
                  for c in ("primary_section", "document_type") if c in cols])
    ]
    none = F.array().cast("array<struct<field:string,value:string>>")
    if "page_start" in cols:
        pages = F.when(F.col("page_end") >= F.col("page_start"), F.sequence("page_start", "page_end"))
        parts.append(F.coalesce(F.transform(pages, lambda p: F.struct(F.lit("page").alias("field"), p.cast("string").alias("value"))), none))
    if "section_names" in cols:
        parts.append(F.coalesce(F.transform("section_names", lambda s: F.struct(F.lit("section_name").alias("field"), s.alias("value"))), none))
    p = docs.select("doc_idx", F.inline(F.concat(*parts)))
    p = p.filter(F.col("value").isNotNull() & (F.col("value") != "")).select("field", "value", "doc_idx")
    return {"docs": doc_records(docs), "postings": p}


def chunk_graph_index(chunks: DataFrame, width: int = 512, parity: bool = False) -> Relations:
    """Relations between the chunks of one document and strategy.

    ``edges``: sequence neighbours, token overlap and parent links.  Overlap is
    an interval self-join on token bins, so only chunks that share tokens meet.
    ``groups``: (edge_type, weight, group_key, doc_idx) for same page and same
    section, where every pair of members is an edge; see ``graph_neighbours``."""
    unit = ["document_id", "chunk_strategy_name"]
    w = Window.partitionBy(*unit).orderBy("start_index", "end_index", "doc_idx")
    seq = chunks.select("doc_idx", F.lead("doc_idx").over(w).alias("next")).filter(F.col("next").isNotNull())
    back = seq.select(F.col("next").alias("doc_idx"), F.col("doc_idx").alias("next")) if not parity else seq
    edges = seq.select(
        F.col("doc_idx").alias("source_doc_idx"), F.col("next").alias("target_doc_idx"),
        F.lit("previous_next").alias("edge_type"), F.lit(1.0).alias("weight"),
    ).unionByName(back.select(
        F.col("doc_idx").alias("source_doc_idx"), F.col("next").alias("target_doc_idx"),
        F.lit("next_previous").alias("edge_type"), F.lit(1.0).alias("weight"),
    ))
    c = chunks.select(*unit, "doc_idx", "start_index", "end_index", "token_length")
    l = c.toDF(*unit, "l_idx", "l_start", "l_end", "l_len")
    r = c.toDF(*unit, "r_idx", "r_start", "r_end", "r_len")
    hit = range_join(l, r, unit, "l_start", "l_end", "r_start", "r_end", width).filter("l_idx <> r_idx")
    shared = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    edges = edges.unionByName(hit.select(
        F.col("l_idx").alias("source_doc_idx"), F.col("r_idx").alias("target_doc_idx"),
        F.lit("token_overlap").alias("edge_type"),
        (shared / F.greatest(F.least("l_len", "r_len"), F.lit(1))).alias("weight"),
    ))
    if "parent_id" in chunks.columns:
        child = chunks.filter(F.col("parent_id").isNotNull()).select(*unit, F.col("parent_id").alias("chunk_id"), F.col("doc_idx").alias("child"))
        link = child.join(chunks.select(*unit, "chunk_id", F.col("doc_idx").alias("par")), [*unit, "chunk_id"]).filter("child <> par")
        for kind, a, b in (("parent", "child", "par"), ("child", "par", "child")):
            edges = edges.unionByName(link.select(
                F.col(a).alias("source_doc_idx"), F.col(b).alias("target_doc_idx"),
                F.lit(kind).alias("edge_type"), F.lit(1.0).alias("weight")))
    key = lambda *c: F.concat_ws("|", *[F.col(x).cast("string") for x in (*unit, *c)])
    page = chunks.filter("page_start is not null and page_end >= page_start").select(
        "*", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    groups = page.select(
        F.lit("same_page").alias("edge_type"), F.lit(0.25).alias("weight"), key("page").alias("group_key"), "doc_idx",
    ).unionByName(chunks.filter("primary_section is not null and primary_section <> ''").select(
        F.lit("same_primary_section").alias("edge_type"), F.lit(0.35).alias("weight"),
        key("primary_section").alias("group_key"), "doc_idx",
    ))
    return {"docs": doc_records(chunks), "edges": edges, "groups": groups}


def positional_index(docs: DataFrame, only: DataFrame | None = None) -> Relations:
    p = docs.select("doc_idx", F.posexplode(tx.tokens("text")).alias("position", "term"))
    if only is not None:
        # by unit once: neither the lists nor what a query batch makes of them travel again
        p = p.join(only.select("term").distinct(), "term", "left_semi").repartition("doc_idx")
    p = p.groupBy("doc_idx", "term").agg(
        F.count("*").alias("tf"), F.min("position").alias("first_position"), F.max("position").alias("last_position"),
        F.sort_array(F.collect_list("position")).alias("positions"),
    )
    vocab = document_frequency(docs, only)
    return {"docs": doc_records(docs), "postings": p, "vocab": vocab}


def boolean_index(docs: DataFrame, only: DataFrame | None = None) -> Relations:
    terms = F.array_sort(tx.distinct_tokens("text"))
    base = doc_records(docs.withColumn("terms", terms)).withColumn("term_count", F.size("terms"))
    p = exploded_terms(docs, tx.distinct_tokens("text"), only)
    return {"docs": base, "postings": p, "vocab": p.groupBy("term").agg(F.count("*").alias("df"))}


def date_values(docs: DataFrame) -> Column:
    """Distinct dates of a unit: given values, date entities, then raw text."""
    empty = F.array().cast("array<string>")
    parts = []
    if "date_values" in docs.columns:
        parts.append(F.coalesce(F.col("date_values"), empty))
    if "entities" in docs.columns:
        dates = F.filter("entities", lambda e: e["entity_type"] == "date")
        parts.append(F.coalesce(F.transform(dates, lambda e: F.coalesce(e["normalized_value"], e["text"], F.lit(""))), empty))
    raw = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?<![0-9A-Za-z_])(?:" + tx.DATE + ")(?![0-9A-Za-z_])"), F.lit(0))
    parts.append(raw)
    trimmed = F.transform(F.concat(*parts), lambda v: F.trim(v))
    return F.array_distinct(F.filter(trimmed, lambda v: v != ""))


def temporal_index(docs: DataFrame) -> Relations:
    extra = [c for c in ("page_start", "page_end", "primary_section") if c in docs.columns]
    p = docs.select(F.explode(date_values(docs)).alias("date_value"), "doc_idx", *extra)
    return {"docs": doc_records(docs), "postings": p}


def norm_bin(v: Column, bins: int = 10) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(v * bins))).cast("int")


def zone(y: Column) -> Column:
    return F.when(y < 0.2, "top").when(y > 0.8, "bottom").when(y.isNotNull(), "middle")


def layout_index(docs: DataFrame, elements: DataFrame, id_col: str = "source_element_ids") -> Relations:
    """Units joined to the layout boxes of their source elements."""
    ids = docs.select("doc_idx", "document_id", F.explode(id_col).alias("element_id"))
    p = ids.join(elements.select(
        "document_id", "element_id", "element_type", "page_number",
        norm_bin(F.col("center_x_norm")).alias("x_bin"), norm_bin(F.col("center_y_norm")).alias("y_bin"),
        zone(F.col("center_y_norm")).alias("zone"), "x0_norm", "y0_norm", "x1_norm", "y1_norm",
    ), ["document_id", "element_id"])
    return {"docs": doc_records(docs), "postings": p.drop("document_id")}


def shingles(toks: Column, size: int = 5) -> Column:
    return F.when(F.size(toks) < size, toks).otherwise(tx.word_ngrams(toks, size))


MERSENNE31 = 2**31 - 1


def affine_seed(s: int) -> tuple[int, int]:
    """Coefficients of seed ``s`` from one multiplicative generator."""
    return pow(48271, 2 * s + 1, MERSENNE31), pow(48271, 2 * s + 2, MERSENNE31)


def minhash_signatures(
    docs: DataFrame, shingle_size: int = 5, signature_size: int = 64, family: str = "affine"
) -> DataFrame:
    """(doc, shingle_count, signature) with one minimum per seed.

    ``affine`` digests every shingle once and derives the seeds as
    ``(a*h + b) mod (2^31 - 1)``: one digest per shingle instead of one per
    shingle and seed.  ``md5`` digests ``seed:shingle`` for each seed and
    ``blake2b`` does so with 64-bit BLAKE2b.  The minima are plain aggregates,
    so partial minima combine before the shuffle."""
    seeds = range(signature_size)
    if family == "affine":
        # one unit is one row: its minima need neither an explode nor a shuffle
        d = docs.select("doc_idx", shingles(tx.tokens("text"), shingle_size).alias("sh"))
        d = d.select("doc_idx", F.size("sh").cast("bigint").alias("shingle_count"),
                     F.transform("sh", lambda x: tx.md5_hash60(x, 0) % MERSENNE31).alias("h"))

        def least(s: int) -> Column:
            m, c = affine_seed(s)
            return F.coalesce(F.array_min(F.transform("h", lambda v: (v * m + c) % MERSENNE31)), F.lit(0)).cast("string")

        return d.select("doc_idx", "shingle_count", F.array(*[least(s) for s in seeds]).alias("signature"))
    sh = docs.select("doc_idx", F.explode(shingles(tx.tokens("text"), shingle_size)).alias("sh"))
    if family == "md5":
        mins = [F.min(tx.md5_hash60(F.col("sh"), s)).alias(f"m{s}") for s in seeds]
    elif family == "blake2b":
        from docloom.functions.udfs import blake2b_hash64

        mins = [F.min(blake2b_hash64("sh", F.lit(s))).alias(f"m{s}") for s in seeds]
    else:
        raise ValueError(f"unknown hash family: {family}")
    sig = sh.groupBy("doc_idx").agg(F.count("*").alias("shingle_count"), *mins)
    out = sig.select("doc_idx", "shingle_count", F.array(*[F.col(f"m{s}").cast("string") for s in seeds]).alias("signature"))
    # units without tokens keep an all-zero signature
    none = docs.filter(F.size(tx.tokens("text")) == 0).select(
        "doc_idx", F.lit(0).cast("bigint").alias("shingle_count"), F.array_repeat(F.lit("0"), signature_size).alias("signature"))
    return out.unionByName(none)


def lsh_buckets(signatures: DataFrame, band_size: int = 8, signature_size: int = 64) -> DataFrame:
    bands = [
        F.struct(
            F.lit(b).alias("band_id"),
            F.concat(F.lit(f"{b}:"), tx.md5_hash60(F.array_join(F.slice("signature", b * band_size + 1, band_size), ","), b).cast("string")).alias("bucket"),
        )
        for b in range(signature_size // band_size)
    ]
    return signatures.select("doc_idx", F.inline(F.array(*bands)))


def minhash_index(docs: DataFrame, **kw) -> Relations:
    """``buckets`` is the candidate relation: two units are candidates exactly
    when they share a bucket.  ``links`` ties every member of a shared bucket to
    its first member, one row per member, so a bucket holding a third of the
    corpus stays linear; neighbours of a seed are read from ``buckets``."""
    sig = minhash_signatures(docs, **kw)
    b = lsh_buckets(sig)
    head = b.groupBy("bucket").agg(F.min("doc_idx").alias("left_doc_idx"), F.count("*").alias("bucket_size"))
    links = b.join(head.filter("bucket_size > 1"), "bucket").filter("doc_idx <> left_doc_idx")
    links = links.groupBy("left_doc_idx", F.col("doc_idx").alias("right_doc_idx")).agg(F.count("*").alias("shared_bucket_count"))
    return {"docs": doc_records(docs), "signatures": sig, "buckets": b, "links": links}


def sentence_index(docs: DataFrame) -> Relations:
    s = docs.select("doc_idx", F.posexplode(tx.sentences("text")).alias("sentence_idx", "sentence"))
    p = s.select("doc_idx", "sentence_idx", F.explode(tx.tokens("sentence")).alias("term"))
    p = p.groupBy("term", "doc_idx", "sentence_idx").agg(F.count("*").alias("tf_in_sentence"))
    # postings are already unique per (term, doc, sentence); fold docs first
    per_doc = p.groupBy("term", "doc_idx").agg(F.count("*").alias("n"))
    vocab = per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("sentence_df"))
    return {"docs": doc_records(docs), "postings": p, "vocab": vocab}


def unit_class(unit: Column, strip_slash: bool = True) -> Column:
    u = F.regexp_replace(unit, "/", "") if strip_slash else unit
    pairs = [F.lit(x) for kv in UNIT_CLASS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), u), F.lit("generic"))


def value_key(v: Column) -> Column:
    """Values equal to 3 digits count as one (large ones have no digits left)."""
    return F.when(v < 1e12, quantize(v, 3)).otherwise(v)


def numeric_index(docs: DataFrame, parity: bool = False) -> Relations:
    """Numbers with unit, class and surrounding text, one row per distinct
    (unit, value rounded to 3 digits) of a document, plus numbers in entities.

    Offsets come from splitting around the matches: piece i of the split
    precedes match i, so the running length is the match position."""
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = F.regexp_extract_all(text, F.lit(tx.NUMBER_UNIT), F.lit(0))
    ex = docs.select("doc_idx", text.alias("_t"), F.posexplode(whole).alias("i", "m"))
    num = F.regexp_extract("m", tx.NUMBER_UNIT, 1)
    ex = ex.select("doc_idx", "i", num.cast("double").alias("numeric_value"),
                   F.lower(F.regexp_extract("m", tx.NUMBER_UNIT, 2)).alias("unit"))
    first = ex.groupBy("doc_idx", value_key(F.col("numeric_value")).alias("_v"), "unit").agg(
        F.min_by("numeric_value", "i").alias("numeric_value"), F.min("i").alias("i"))
    p = first.select("doc_idx", "numeric_value", "unit", unit_class(F.col("unit"), not parity).alias("context_type"),
                     tx.magnitude_class(F.col("numeric_value")).alias("magnitude_class"))
    if "entities" in docs.columns:
        e = docs.select("doc_idx", F.inline("entities"))
        norm = F.coalesce("normalized_value", "text", F.lit(""))
        e = e.withColumn("numeric_value", F.regexp_extract(norm, "([0-9]+(?:[.][0-9]+)?)", 1).try_cast("double"))
        e = e.filter(F.col("numeric_value").isNotNull()).groupBy("doc_idx", "entity_type", value_key(F.col("numeric_value")).alias("_v")).agg(
            F.min("numeric_value").alias("numeric_value"))
        kind = F.when(F.col("entity_type") == "vital", "vital").when(F.col("entity_type") == "lab_result", "lab").otherwise("entity")
        p = p.unionByName(e.select("doc_idx", "numeric_value", F.col("entity_type").alias("unit"), kind.alias("context_type"),
                                   tx.magnitude_class(F.col("numeric_value")).alias("magnitude_class")))
    return {"docs": doc_records(docs), "postings": p}


def numeric_context(docs: DataFrame, before: int = 32, after: int = 32, limit: int = 80) -> DataFrame:
    """Every number with its match offset and surrounding text.  The text is cut
    at the matches; running lengths of pieces and matches give the offsets."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mark = tx.UNIT_SEPARATOR
    gaps = F.split(F.regexp_replace(text, tx.NUMBER_UNIT, mark), mark)
    hits = F.regexp_extract_all(text, F.lit(tx.NUMBER_UNIT), F.lit(0))
    z = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    ex = docs.select("doc_idx", text.alias("_t"), F.posexplode(z).alias("i", "z")).filter("z.hit is not null")
    w = Window.partitionBy("doc_idx").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("z.gap") + F.length("z.hit")).over(w)
    ex = ex.withColumn("end", end).withColumn("start", F.col("end") - F.length("z.hit"))
    lo = F.greatest(F.col("start") - before, F.lit(0))
    around = F.substring(F.col("_t"), (lo + 1).cast("int"), (F.col("end") + after - lo).cast("int"))
    return ex.select("doc_idx", "start", "end", F.regexp_extract("z.hit", tx.NUMBER_UNIT, 1).cast("double").alias("numeric_value"),
                     F.substring(around, 1, limit).alias("surrounding_text"))


def cooccurrence_index(docs: DataFrame) -> Relations:
    """Unordered entity-type pairs per unit.  Types are a closed set, so the
    pairs are built inside the row from the distinct types of that unit."""
    empty = F.array().cast("array<string>")
    types = F.coalesce(F.transform("entities", lambda e: F.trim(e["entity_type"])), empty)
    types = F.filter(types, lambda t: t != "")
    flags = F.filter(
        F.array(*[F.when(F.col(f), F.lit(t)) for f, t in FLAG_TYPE.items() if f in docs.columns]).cast("array<string>"),
        lambda t: t.isNotNull(),
    )
    all_types = F.concat(types, F.array_except(flags, types))
    counts = docs.select("doc_idx", F.explode(all_types).alias("type")).groupBy("doc_idx", "type").agg(F.count("*").alias("n"))
    listed = counts.groupBy("doc_idx").agg(F.array_sort(F.collect_list(F.struct("type", "n"))).alias("ts"))
    pairs = F.flatten(F.transform("ts", lambda a: F.transform(
        F.filter("ts", lambda b: b["type"] > a["type"]),
        lambda b: F.struct(a["type"].alias("type_a"), b["type"].alias("type_b"), F.least(a["n"], b["n"]).alias("pair_count")))))
    p = listed.select("doc_idx", F.inline(pairs))
    vocab = p.groupBy(F.concat_ws("|", "type_a", "type_b").alias("pair")).agg(
        F.count("*").alias("pair_df"), F.sum("pair_count").alias("total_count"))
    return {"docs": doc_records(docs), "postings": p, "vocab": vocab}


# Registered names, in report order.
DEFAULT_INDEXERS: dict[str, Callable[..., Relations]] = {
    "bm25": bm25_index,
    "keyword_inverted": keyword_index,
    "metadata_inverted": metadata_index,
    "tfidf": tfidf_index,
    "phrase_ngram": phrase_index,
    "char_ngram": char_index,
    "fielded_lexical": fielded_index,
    "entity": entity_index,
    "section_page": section_page_index,
    "chunk_graph": chunk_graph_index,
    "positional": positional_index,
    "boolean_set": boolean_index,
    "temporal": temporal_index,
    "layout_spatial": layout_index,
    "minhash_lsh": minhash_index,
    "sentence_inverted": sentence_index,
    "numeric_range": numeric_index,
    "concept_cooccurrence": cooccurrence_index,
}


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, quantize(F.col(c), digits))
    return df
