"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import ann, lm_scoring, mixing, packing, quality_classifier, quality_rules, sharding, simhash, substring, token_counts
from vertexloom.llm._shared import table

SHARDS = [f"shard-{k:04d}" for k in range(1000)]


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", *quality_rules._text.COUNTS, "base_failed", "kept")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.shard(docs, F.col("doc_id"), SHARDS)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"), tokenizer())


def queries() -> dict:
    return {f.__name__: f for f in (op1_lm_scoring, op2_quality_rules, op3_quality_classifier, op4_simhash, op5_nearest, op6_sharding, op7_packing, op8_mixing, op9_substring, op10_token_counts)}


MIXING_SQL = r"""with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, substr(md5(doc_id::varchar || ':17'), 1, 15) as key from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5.0::double, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight, 2.0::double * source_size as cap from s),
l as (select *, (1.5::double * (sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
/ sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from w),
t as (select source, source_size, least(cap, weight * max(level) over ()) as target from l),
p as (select *, sum(size) over (partition by source order by key, doc_id, size rows between unbounded preceding and current row)::bigint - size as prior from d),
e as (select p.*, t.source_size, t.target, floor(t.target)::bigint as budget, case when t.source_size > 0 then floor(floor(t.target) / t.source_size)::bigint else 0 end as epochs from p join t on p.source is not distinct from t.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - prior)))::bigint as taken from e"""

SUBSTRING_SQL = r"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
x as (select doc_id, len(w) as n, unnest(w) as word, generate_subscripts(w, 1) as i from d),
s as (select doc_id, i, n, word, string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 49 following) as s from x),
f as (select s, min(doc_id) as m from s where i <= n - 49 group by s),
h as (select s.doc_id, s.i, s.word, case when s.i <= s.n - 49 and f.m < s.doc_id then 1 else 0 end as hit from s left join f on f.s = s.s),
g as (select *, max(hit) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from h),
k as (select doc_id, sum(gone)::bigint as n_removed, string_agg(word, ' ' order by i) filter (where gone = 0) as kept from g group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256 from d left join k using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """Of the operators whose results SQL can express; the others' are tested against brute force (tests/llm)."""
    return {"op8_mixing": MIXING_SQL, "op9_substring": SUBSTRING_SQL}
