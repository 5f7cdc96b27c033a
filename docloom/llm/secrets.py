"""Secret scans: corpus-wide ownership frequency.

Spans are found in every whole text with built-in functions only.  The hash of
each candidate value is then counted over the corpus by distinct repositories
and owners: a value many owners publish is a copied example, a value of one or
two owners that looks random is a live credential.  ``redact`` asks base kinds
only for a value that is no placeholder, by a test relative to its length;
``scan`` asks all kinds for the strict test its query is defined by.

Defined cases: a null or empty text has no spans; a null owner or repository
counts as one unnamed owner or repository; repeated rows keep one result each
and count as one repository; an empty table gives an empty result; extra
columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import aside, cut

# The base kinds, in the order in which they are listed.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex")
# Added kind: long mixed tokens, kept where ownership says live.
OPAQUE = "[A-Za-z0-9_-]{20,}"

# A value of up to 64 characters, all such words and at most three closing digits, is nobody's credential.
PLACEHOLDER = ("(?i)^[._/+=-]*((your|my|the|some|insert|enter|replace|change|put|goes|here|this|with|me|it|example|sample|dummy|fake|placeholder|default|required|optional|"
               "undefined|null|none|true|false|string|value|redacted|hidden|todo|password|passwd|secret|token|api|key|access|user|name|x{3,}+)[._/+=-]*+)+[0-9]{0,3}$")

EXAMPLE_OWNERS = 3
SPAN = "array<struct<start:int,stop:int,kind:int,value:string>>"


def none() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def _spans(text: Column, pattern: str, kind: int, value, keep) -> Column:
    """Spans of the leftmost non-overlapping matches: the pieces between the
    matches and the matches themselves give the offsets as running sums."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.aggregate(
        F.zip_with(gaps, found, lambda g, m: F.struct(F.coalesce(F.length(g), F.lit(0)).alias("g"), m.alias("m"))),
        F.struct(F.lit(0).alias("at"), none().alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["g"] + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
            F.when(x["m"].isNotNull() & keep(x["m"]), F.concat(a["out"], F.array(F.struct(
                (a["at"] + x["g"]).alias("start"), (a["at"] + x["g"] + F.length(x["m"])).alias("stop"),
                F.lit(kind).alias("kind"), value(x["m"]).alias("value"))))).otherwise(a["out"]).alias("out")),
        lambda a: a["out"])
    return F.when(text.rlike(pattern), start).otherwise(none())


def found_spans(text: Column) -> Column:
    """All candidate spans of a text, by start, then kind.  Kind 3 is the added
    one and never overlaps a base span."""
    t = F.coalesce(text, F.lit(""))
    secret = lambda m: F.regexp_extract(m, ASSIGN, 2)
    whole = lambda m: m
    base = F.concat(
        _spans(t, ASSIGN, 0, secret, lambda m: F.length(secret(m)) >= 8),
        _spans(t, ACCESS, 1, whole, lambda m: F.length(m) >= 16),
        _spans(t, HEX, 2, whole, lambda m: F.lit(True)))
    mixed = _spans(t, OPAQUE, 3, whole, lambda m: m.rlike("[0-9].*[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]"))
    return F.array_sort(F.concat(base, F.filter(mixed, lambda s: ~F.exists(
        base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "opaque")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def looks_random(value: Column, kind: Column | None = None) -> Column:
    """The strict test: at least eight different characters, not letters only."""
    return (F.size(F.array_distinct(F.split(value, ""))) >= 8) & value.rlike("[0-9]")


def no_placeholder(value: Column, kind: Column) -> Column:
    """Base kinds: half as many different characters as the value is long, eight
    at most, and not made of placeholder words alone; a hex value also holds a
    digit.  Added kind: the strict test."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= F.least(F.lit(8), F.ceil(F.length(value) / 2))
    return F.when(kind == 3, looks_random(value)).otherwise(varied & F.when(F.length(value) > 64, True).otherwise(~value.rlike(PLACEHOLDER)) & ((kind != 2) | value.rlike("[0-9]")))


def ownership(candidates: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(value_hash, n_owners, n_repositories, live) of candidate rows
    (value_hash, random, owner, repository).  Each level is aggregated before
    the next shuffle, so a value copied everywhere is no hot group."""
    c = candidates.groupBy("value_hash", "owner", "repository").agg(F.max("random").alias("random"))
    c = c.groupBy("value_hash", "owner").agg(F.max("random").alias("random"), F.count("*").alias("r"))
    c = c.groupBy("value_hash").agg(F.max("random").alias("random"), F.count("*").alias("n_owners"), F.sum("r").alias("n_repositories"))
    return c.select("value_hash", "n_owners", "n_repositories", (F.col("random") & (F.col("n_owners") < example_owners)).alias("live"))


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
         example_owners: int = EXAMPLE_OWNERS, judge: Callable[[Column, Column], Column] = looks_random) -> DataFrame:
    """(doc_id, spans, verdicts) per row: ``spans`` the base spans and the live
    added ones, ``verdicts`` (n_owners, n_repositories, live) of each.  ``judge``
    tells of (value, kind) whether few owners make it live."""
    owner = F.col("source") if owner is None else owner
    repository = F.col(id_col) if repository is None else repository
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = cut(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), name(owner).alias("owner"),
                           name(repository).alias("repository"), found_spans(F.col(text_col)).alias("s")))
    each = rows.filter(F.size("s") > 0).select("_row", "owner", "repository", F.explode("s").alias("s")).select(
        "_row", "owner", "repository", F.struct("s.start", "s.stop", "s.kind").alias("s"), F.sha2(F.col("s.value"), 256).alias("value_hash"),
        judge(F.col("s.value"), F.col("s.kind")).alias("random"))
    # written first, so that both sides of the join come from plain exchanges and a hot value can be split
    owned = cut(ownership(each, example_owners))
    judged = each.join(owned, "value_hash").filter((F.col("s.kind") < 3) | F.col("live"))
    judged = judged.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("s", F.struct("n_owners", "n_repositories", "live").alias("v")))).alias("j"))
    out = rows.select("_row", "doc_id").join(judged, "_row", "left")
    return out.select("doc_id", F.coalesce(F.transform("j", lambda x: x["s"]), F.expr("cast(array() as array<struct<start:int,stop:int,kind:int>>)")).alias("spans"),
                      F.coalesce(F.transform("j", lambda x: x["v"]), F.expr("cast(array() as array<struct<n_owners:bigint,n_repositories:bigint,live:boolean>>)")).alias("verdicts"))


def redact(docs: DataFrame, mark: str = "[secret]", owner: Column | None = None, repository: Column | None = None,
           example_owners: int = EXAMPLE_OWNERS, judge: Callable[[Column, Column], Column] = no_placeholder) -> DataFrame:
    """``docs`` with every live value replaced by ``mark``; copied examples and
    clean rows stay as they are, and so do all other columns, whatever their
    names; ``n_chars``, where there is one, follows the text.  Rows without a candidate never leave their
    task; only rows with one are joined."""
    owner = F.col("source") if owner is None else owner
    repository = F.col("doc_id") if repository is None else repository
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    named, back = aside(docs, "text", more={"__owner": name(owner), "__repository": name(repository)})
    some = F.coalesce(F.col("text"), F.lit("")).rlike(f"{ASSIGN}|(?-i:{ACCESS}|{HEX}|{OPAQUE})")
    rows = named.filter(some).withColumn("_spans", found_spans(F.col("text"))).withColumn("_row", F.struct(F.sha2("text", 256), "__owner", "__repository"))
    each = rows.select("_row", F.col("__owner").alias("owner"), F.col("__repository").alias("repository"), F.explode("_spans").alias("s"))
    # written once: ownership and masking both read the spans
    each = cut(each.withColumn("value_hash", F.sha2(F.col("s.value"), 256)).withColumn("random", judge(F.col("s.value"), F.col("s.kind"))))
    owned = cut(ownership(each, example_owners))
    live = each.join(owned.filter("live"), "value_hash").groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("s.start", "s.stop"))).alias("_live"))
    live = cut(live)
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    pieces = F.aggregate("_live", empty, lambda a, s: F.when(s["stop"] <= a["at"], a).otherwise(F.struct(
        s["stop"].alias("at"), F.concat(a["out"], F.when(s["start"] >= a["at"], F.array(
            F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(F.expr("cast(array() as array<string>)"))).alias("out"))),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    text = F.when(F.col("_live").isNull(), F.col("text")).otherwise(pieces)
    hit = rows.drop("_spans").join(live, "_row", "left").withColumn("text", text).select(named.columns)
    out = back(named.filter(~some).unionByName(hit))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query."""
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    verdict = lambda f: F.size(F.filter("verdicts", f)).cast("bigint")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(spelled(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"),
        verdict(lambda v: v["live"]).alias("n_live"), verdict(lambda v: v["n_owners"] >= EXAMPLE_OWNERS).alias("n_example"),
        F.coalesce(F.array_max(F.transform("verdicts", lambda v: v["n_owners"])), F.lit(0)).cast("bigint").alias("most_owners"),
        F.coalesce(F.array_max(F.transform("verdicts", lambda v: v["n_repositories"])), F.lit(0)).cast("bigint").alias("most_repositories"))
