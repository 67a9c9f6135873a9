"""Thin queries over the corpus operators with production parameters, on whole tables, and SQL where it can say the same."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm import codes, exact, extraction, licences, lines, mixing, neighbours, packing, quality, simhash, spelling, topk, toxicity
from sonoframe.llm.supervised import id_remainder

QUERIES: dict = {}
ORACLES: dict = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the text that is left, and the positions of its lines that went."""
    cleaned = lines.dedup_lines(_table(spark, sf_dir, "documents"), to="removed_at")
    removed = F.coalesce("removed_at", F.array().cast("array<int>"))
    return cleaned.select("doc_id", "text", F.size(removed).alias("n_removed"), removed.alias("removed_lines"))


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_on_labels(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model, to="score")
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_on_labels(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs.select("doc_id", "text"), model, to="score")
    held_out = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "times")


@_query
def op8_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op8_top_products"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.x, c.x)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""


@_query
def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@_query
def op4_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    found = extraction.extract(pages, extraction.fit_extractor(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query
def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licences.find_licences(docs, licences.fit_licences(docs))


@_query
def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(_table(spark, sf_dir, "embeddings"))


@_query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"), delete_every=97)


def _codes_sql(rounds: int = 4) -> str:
    """Codebooks and codes with one assignment and one update a round; products of these integers are exact in DOUBLE."""
    assigned = """as materialized (
  select part, vec_id, x, best // 256 as away, best % 256 as entry from (
    select p.part, p.vec_id, any_value(p.x) as x,
           min((list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, b.c) + list_dot_product(b.c, b.c))::bigint * 256 + b.entry) as best
    from p join {books} b on p.part = b.part group by p.part, p.vec_id))"""
    updated = """as materialized (
  select b.part, b.entry, coalesce(m.c, b.c) as c from {books} b left join (
    select part, entry, list(mean order by i) as c from (
      select part, entry, i, floor(sum(x[i]) / count(*)) as mean from {codes}, range(1, 17) r(i) group by part, entry, i)
    group by part, entry) m on b.part = m.part and b.entry = m.entry)"""
    steps = []
    for r in range(rounds):
        steps += [f"a{r} {assigned.format(books=f'b{r}')}", f"b{r + 1} {updated.format(books=f'b{r}', codes=f'a{r}')}"]
    steps.append(f"a{rounds} {assigned.format(books=f'b{rounds}')}")
    return f"""
with v as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select vec_id, part::int as part, x[part * 16 + 1:part * 16 + 16] as x from v, range(4) r(part)),
s as (select vec_id, row_number() over (order by vec_id) - 1 as entry from v qualify entry < 256),
b0 as materialized (select part, entry, x as c from p join s using (vec_id)),
{", ".join(steps)},
e as (select vec_id, string_agg(printf('%02x', entry::int), '' order by part) as code, sum(away)::bigint as error from a{rounds} group by vec_id),
d as (select sha256(string_agg(whole, ',' order by part, entry, i)) as digest from (
  select part, entry, i, c[i]::bigint::varchar as whole from b{rounds}, range(1, 17) r(i)))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, digest as codebooks_sha256
from e join v using (vec_id), d
"""


ORACLES["op11_codes"] = _codes_sql()

# the checksum goes byte by byte through its table of 256 remainders; a letter of this alphabet is one or two bytes of UTF-8
ORACLES["op12_spelling"] = """
with recursive k as (
  select list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) as t
  from range(256) r(n)),
r as (
  select doc_id, run, count(*) as k from (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run
    from documents) where length(run) >= 5 group by doc_id, run),
y as (
  select doc_id, run, k, [4294967295::bigint] || flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c:
    case when unicode(c) < 128 then [unicode(c)::bigint] else [192 + (unicode(c) >> 6)::bigint, 128 + (unicode(c) & 63)::bigint] end)) as b from r),
h as (select run, y.k, xor(4294967295::bigint, list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) as h from y, k),
w as materialized (
  select word, sum(k)::bigint as n from (
    select k, case when h % 97 = 0 then substring(run, 1, (h % length(run))::int) || substring(run, (h % length(run))::int + 2) else run end as word from h)
  where length(word) >= 5 group by word having sum(k) >= 3),
g as (select word, substring(word, 1, i::int - 1) || '*' || substring(word, i::int + 1) as key, substring(word, 1, i::int - 1) || substring(word, i::int + 1) as short
      from w, range(1, 1000) x(i) where i <= length(word)),
pairs as (
  select a.word, b.word as near from g a join g b on a.key = b.key and a.word <> b.word
  union select g.word, w.word from g join w on g.short = w.word
  union select w.word, g.word from g join w on g.short = w.word),
best as (
  select word, near, n as near_n, count(*) over (partition by word) as n_near, row_number() over (partition by word order by n desc, near) as place
  from (select p.word, p.near, w.n from pairs p join w on p.near = w.word)),
f as materialized (
  select w.word, w.n, coalesce(b.n_near, 0)::bigint as n_near, case when near_n >= 2 * n then near end as form, case when near_n >= 2 * n then near_n end as form_n
  from w left join best b on w.word = b.word and b.place = 1),
way as (
  select word, word as last, 0 as steps from f
  union all select way.word, f.form, steps + 1 from way join f on way.last = f.word where f.form is not null),
root as (select word, arg_max(last, steps) as root from way group by word)
select word, form, root, n, n_near, form_n from f join root using (word)
"""


@_query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


ORACLES["op13_exact_dedup"] = """
with d as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept, sha256(t) as text_sha256
from d window same as (partition by t)
"""
