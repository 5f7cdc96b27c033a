"""Queries of the training-data operators over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import collocations, decontaminate, fptree, licenses, linear, minmax, mixing, quality, repeats, secrets, simhash, toxicity, urls
from docloom.llm.common import held_out, table

DOMAINS = {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}
LANGS = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}


def domain() -> F.Column:
    """Sources stand in groups of five."""
    n = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1), F.lit(""))
    return F.concat(F.lit("d"), F.floor(F.when(n == "", "0").otherwise(n).cast("bigint") / 5 % 4).cast("string"))


def mixed(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    levels = {"domain": domain(), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mix(docs, levels, {"domain": DOMAINS, "lang": LANGS}, share=0.6, max_epochs=2, seed=17, keep=keep)


def op1_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, d, "documents")))


def op2_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixed(table(spark, d, "documents"))


def op3_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels"))


def op4_minmax(spark: SparkSession, d: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, d, "documents").select("doc_id", "text"))


def captures(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a fetch day spread over two years by their number."""
    return table(spark, d, "pages").select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), (F.col("page_id") * 37 % 730).cast("int")).alias("fetched"))


def listed(spark: SparkSession, d: str) -> DataFrame:
    """A dated list out of the pages' own hosts: each fifth number of a page
    lists or delists its host, each seventh its first path step."""
    p = table(spark, d, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("page_id") * 53 % 730).cast("int")).alias("day")
    action = F.when(F.floor(F.col("page_id") / 5) % 2 == 0, "add").otherwise("remove").alias("action")
    name = urls.host(F.col("url"))
    step = F.regexp_extract(urls.path(F.col("url")), "^/+([^/]+)", 1)
    a = p.filter("page_id % 5 = 0").filter(name != "").select(F.concat(F.lit("d:"), name).alias("key"), day, action)
    b = p.filter("page_id % 7 = 0").filter((name != "") & (step != "")).select(F.concat(F.lit("p:"), name, F.lit("/"), step).alias("key"), day, action)
    return a.unionByName(b)


def op5_urls(spark: SparkSession, d: str) -> DataFrame:
    return urls.evaluate(captures(spark, d), listed(spark, d)).select(
        "page_id", F.col("fetched").cast("string").alias("fetched"), "blocked", "n_entries", "by_key", F.col("listed_since").cast("string").alias("listed_since"))


def op6_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.digest(table(spark, d, "documents").select("doc_id", "text"))


def op7_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.classify(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels"))


def op8_repeats(spark: SparkSession, d: str) -> DataFrame:
    return repeats.digest(table(spark, d, "documents").select("doc_id", "text"))


def op9_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.digest(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op10_language(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    out = linear.predict(docs.select("doc_id", "text"), linear.fit(linear.train_rows(docs)))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op11_fptree(spark: SparkSession, d: str) -> DataFrame:
    return fptree.search(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op12_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.digest(table(spark, d, "documents"))


def op13_collocations(spark: SparkSession, d: str) -> DataFrame:
    return collocations.mine(table(spark, d, "documents"))


_SECRET = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _found(kind: int, pattern: str, keep: str, value: str) -> str:
    return f"""select r, {kind} kind, start, start + length(m) stop, {value} v from (
        select r, m[i] m, (select sum(length(x)) from (select unnest(g[1:i]) x)) + coalesce((select sum(length(x)) from (select unnest(m[1:i - 1]) x)), 0) start
        from (select r, m, g, unnest(range(1, len(m) + 1)) i from (
            select r, regexp_extract_all(t, '{pattern}') m, string_split_regex(t, '{pattern}') g from d where regexp_matches(t, '{pattern}')))) where {keep}"""


SECRETS_SQL = f"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t, coalesce(source, '') owner from documents),
base as ({_found(0, _SECRET, f"length(regexp_extract(m, '{_SECRET}', 2)) >= 8", f"regexp_extract(m, '{_SECRET}', 2)")}
  union all {_found(1, 'AKIA[A-Z0-9]+', 'length(m) >= 16', 'm')}
  union all {_found(2, '[0-9a-f]{32,}', 'true', 'm')}),
opaque as ({_found(3, '[A-Za-z0-9_-]{20,}', "regexp_matches(m, '[0-9].*[0-9]') and regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]')", 'm')}),
every as (select * from base union all
  select * from opaque o where not exists (select 1 from base b where b.r = o.r and b.start < o.stop and o.start < b.stop)),
owned as (select v, count(distinct owner) owners, count(distinct owner || chr(1) || doc_id) repositories,
    len(list_distinct(string_split(v, ''))) >= 8 and regexp_matches(v, '[0-9]') and count(distinct owner) < 3 live from every join d using (r) group by v),
judged as (select * from every join owned using (v) where kind < 3 or live),
told as (select r, count(*) filter (kind = 0) n_assign, count(*) filter (kind = 1) n_access, count(*) filter (kind = 2) n_hex,
    coalesce(string_agg((['assign', 'access', 'hex'])[kind + 1] || ':' || start::bigint || ':' || stop::bigint, ',' order by start, kind) filter (kind < 3), '') b,
    string_agg((['assign', 'access', 'hex', 'opaque'])[kind + 1] || ':' || start::bigint || ':' || stop::bigint, ',' order by start, kind) spans,
    count(*) filter (live) n_live, count(*) filter (owners >= 3) n_example, max(owners) most_owners, max(repositories) most_repositories from judged group by r)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(b, '')) base_sha256, coalesce(spans, '') spans,
  coalesce(n_live, 0) n_live, coalesce(n_example, 0) n_example, coalesce(most_owners, 0) most_owners, coalesce(most_repositories, 0) most_repositories
from d left join told using (r)
"""


def _level(src: str, k: int, weight: str) -> str:
    """Nodes of level k with their tokens, out of ``src`` (path, amount)."""
    names = ["domain", "lang", "source"]
    path, parent = ", ".join(names[: k + 1]), ", ".join(names[:k]) or "1"
    return f"""
n{k} as (select {path}, sum(cap) cap, max(amount) amount, {weight} weight from {src} group by {path}),
f{k} as (select *, coalesce(sum(cap) over (partition by {parent} order by cap / weight, {names[k]} rows between unbounded preceding and 1 preceding), 0)
    + cap / weight * sum(weight) over (partition by {parent} order by cap / weight, {names[k]} rows between current row and unbounded following) <= amount as fl from n{k}),
g{k} as (select {path}, case when fl then cap::double else (amount - coalesce(sum(cap) filter (fl) over (partition by {parent}), 0)) * weight
    / sum(weight) filter (not fl) over (partition by {parent}) end amount from f{k}),
l{k} as (select l.domain, l.lang, l.source, l.tokens, l.cap, g{k}.amount from leaf l join g{k} on {' and '.join(f'l.{n} is not distinct from g{k}.{n}' for n in names[: k + 1])})"""


MIXING_SQL = f"""
with t as (select doc_id, lang, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) n_tokens, md5(text) tx,
    'd' || (coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') as bigint), 0) // 5 % 4) as domain from documents where text is not null),
d as (select * from t where n_tokens > 0),
leaf as (select domain, lang, source, sum(n_tokens)::bigint tokens, sum(n_tokens)::bigint * 2 cap from d group by all),
top as (select l.*, floor((select sum(tokens) from leaf) * 0.6)::double amount from leaf l),
{_level('top', 0, "case domain when 'd0' then 4.0 when 'd1' then 3.0 when 'd2' then 2.0 else 1.0 end::double")},
{_level('l0', 1, "case lang when 'en' then 5.0 when 'de' then 2.0 when 'fr' then 2.0 else 1.0 end::double")},
{_level('l1', 2, '1.0::double')},
plan as (select *, floor(least(amount, cap) + 1e-6)::bigint alloc from l2),
p2 as (select *, alloc // tokens full_, alloc % tokens rest from plan),
r as (select d.*, full_, rest, md5('17:' || full_ || ':' || doc_id) || tx place from d join p2
    on d.domain is not distinct from p2.domain and d.lang is not distinct from p2.lang and d.source is not distinct from p2.source),
q as (select *, sum(n_tokens) over (partition by domain, lang, source order by place range between unbounded preceding and current row) run from r)
select doc_id, domain, lang, source, n_tokens, unnest(range(0, full_))::int epoch from q
union all select doc_id, domain, lang, source, n_tokens, full_::int from q where run <= rest
"""

URLS_SQL = r"""
with h as (select page_id, url, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)) host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) path from pages),
c as (select *, date '2023-01-01' + (page_id * 37 % 730)::int fetched, date '2023-01-01' + (page_id * 53 % 730)::int "day",
    case when page_id // 5 % 2 = 0 then 1 else 0 end on_, regexp_extract(path, '^/+([^/]+)', 1) step,
    string_split(host, '.') labels, list_filter(string_split(path, '/'), lambda x: x <> '') steps from h),
e as (select 'd:' || host k, "day", on_ from c where page_id % 5 = 0 and host <> ''
    union all select 'p:' || host || '/' || step, "day", on_ from c where page_id % 7 = 0 and host <> '' and step <> ''),
e1 as (select k, "day", min(on_) on_ from e group by all),
e2 as (select * from (select *, coalesce(lag(on_) over (partition by k order by "day"), 0) was from e1) where on_ <> was),
iv as (select * from (select k, on_, "day" a, coalesce(lead("day") over (partition by k order by "day"), date '9999-12-31') b from e2) where on_ = 1),
ks as (select distinct page_id, fetched, 'd:' || array_to_string(labels[i:], '.') k from (select *, unnest(range(1, greatest(len(labels), 2))) i from c where host <> '')
    union select distinct page_id, fetched, 'p:' || host || '/' || array_to_string(steps[1:i], '/') from (select *, unnest(range(1, len(steps) + 1)) i from c where host <> '')),
m as (select page_id, count(*) n, min(k) k, arg_min(a, k) a from ks join iv using (k) where fetched >= a and fetched < b group by page_id)
select c.page_id, fetched::varchar fetched, m.k is not null blocked, coalesce(n, 0) n_entries, m.k by_key, a::varchar listed_since from c left join m using (page_id)
"""

_WORDS9 = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
DECONTAMINATE_SQL = f"""
with d as (select row_number() over () r, doc_id, {_WORDS9} w from documents),
b as (select item_id, {_WORDS9} w from benchmark),
bw as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') k from (
    select item_id, w, least(10, len(w)) n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from b where len(w) > 0)),
hit as (select r, i, bw.n, item_id from (select r, n, i, array_to_string(w[i:i + n - 1], ' ') k from (
    select r, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from bw) where len(w) >= n)) x join bw using (n, k)),
pos as (select r, count(distinct p) n_hit from (select distinct r, unnest(range(i, i + n)) p from hit) group by r),
items as (select r, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) s from (select distinct r, item_id from hit where item_id is not null) group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join pos using (r) left join items using (r)
"""

# All links by an inverted list of shingles, then least reachable ids.
MINMAX_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, sh from (select doc_id, unnest(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) sh from w)),
n as (select doc_id, count(*) n from s group by doc_id),
i as (select a.doc_id x, b.doc_id y, count(*) k from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
l as (select x, y from i join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 80 * (p.n + q.n - k)),
e as (select x, y from l union select y, x from l),
c as (select doc_id, doc_id root from w union select e.y, c.root from c join e on e.x = c.doc_id where c.root < e.y)
select w.doc_id, coalesce(n.n, 0) n_shingles, r.component_id, r.component_id = w.doc_id kept
from w left join n using (doc_id) join (select doc_id, min(root) component_id from c group by doc_id) r using (doc_id)
"""

FPTREE_SQL = f"""
with d as (select row_number() over () r, doc_id, w from (select doc_id, {_WORDS9} w from documents) where len(w) > 0),
s as (select count(*) nd, sum(len(w))::bigint nt from d),
b as (select row_number() over () q, item_id, {_WORDS9} w from benchmark),
bt as (select distinct q, item_id, t from (select q, item_id, unnest(w) t from b)),
p as (select r, t, count(*) tf from (select r, unnest(w) t from d) where t in (select t from bt) group by all),
f as (select t, floor(1000 * ln((2 * nd + 2)::double / (2 * count(*) + 1)))::bigint wt from p, s group by t, nd),
sc as (select q, item_id, r, doc_id, sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * len(w) * nd) // nt)))))::bigint score
    from bt join f using (t) join p using (t) join d using (r), s group by all),
k as (select *, row_number() over (partition by q order by score desc, doc_id) rk from sc where score > 0)
select item_id, rk::int "rank", doc_id, score from k where rk <= 50
"""

_PIECES13 = "string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')"
COLLOCATIONS_SQL = f"""
with p as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') w from (select coalesce(lang, 'und') lang, unnest({_PIECES13}) piece from documents)),
g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from p, (select unnest([1, 2, 3]) k) where len(w) >= k)),
f as (select lang, k size, phrase, count(*) a from g group by all),
n as (select lang, sum(a)::bigint n from f where size = 1 group by lang),
c as (select * from f where size > 1 and a >= 10),
x as (select c.*, k, string_split(phrase, ' ') w from c, (select unnest([1, 2]) k) where k < size),
y as (select x.lang, x.size, x.phrase, x.a, x.k, p1.a l, p2.a r, ((1000000::hugeint * x.a * x.a) // (p1.a::hugeint * p2.a))::bigint score from x
    join f p1 on p1.lang = x.lang and p1.phrase = array_to_string(x.w[:x.k], ' ') join f p2 on p2.lang = x.lang and p2.phrase = array_to_string(x.w[x.k + 1:], ' ')),
z as (select * from y qualify row_number() over (partition by lang, phrase order by score, k) = 1),
o as (select lang, phrase, max(a) longer from (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) phrase from x where size = 3 and k = 1) group by all),
t as (select z.*, row_number() over (partition by lang order by score desc, a desc, phrase) rk from z left join o using (lang, phrase) where o.longer is null or 100 * longer < 50 * a)
select lang, rk "rank", phrase, a, l, r, n, score from t join n using (lang) where rk <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_secrets, op2_mixing, op3_quality, op4_minmax, op5_urls, op6_simhash, op7_toxicity, op8_repeats, op9_decontaminate, op10_language, op11_fptree, op12_licenses, op13_collocations)}
ORACLES = {"op1_secrets": SECRETS_SQL, "op2_mixing": MIXING_SQL, "op4_minmax": MINMAX_SQL, "op5_urls": URLS_SQL, "op9_decontaminate": DECONTAMINATE_SQL,
           "op11_fptree": FPTREE_SQL, "op13_collocations": COLLOCATIONS_SQL}
