"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import archive, bag_search, drift_means, hamming, jaccard, licenses, mixing, packing, pii, quality, toxicity, tree_search, urls
from gridspark.llm.common import Kept, table


def op1_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


# Sources by the number in their name, and the weights of domains and languages.
SOURCE_DOMAIN = "case when cast(substring(source, 4) as int) < 1 then 'crawl' when cast(substring(source, 4) as int) < 10 then 'web' else 'curated' end"
DOMAIN_WEIGHT = {"crawl": 1, "web": 3, "curated": 4}
LANG_WEIGHT = {"en": 4, "de": 2, "fr": 2, "es": 1}



def mix_settings(docs: DataFrame):
    """(domain of a document, weights of the leaves) of the mixture."""
    domain = F.expr(SOURCE_DOMAIN)
    leaves = docs.select(domain.alias("domain"), "lang", "source")
    return domain, mixing.weights_by_rule(leaves, DOMAIN_WEIGHT, LANG_WEIGHT)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mixture(docs, *mix_settings(docs), share=0.6, epochs=2)


def op3_itq_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))[0]


def op5_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op6_url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge_pages(pages, urls.fit(pages))


def op7_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_documents(docs, pii.fit(docs))


def op8_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_search.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op9_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op11_drift_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_means.k_means(table(spark, sf_dir, "embeddings")).drop("scans")


def op12_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.read_pages(archive.write_archive(table(spark, sf_dir, "pages"), Kept(spark)))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxic_segments, op2_mix_sources, op3_itq_near_duplicates, op4_jaccard_join, op5_license_templates, op6_url_words,
        op7_boosted_pii, op8_kmeans_tree_search, op9_quadratic_discriminant, op10_best_fit_packing,
        op11_drift_means, op12_bag_search, op13_content_archive,
    )
}


def k_means_sql(rounds: int = 3, k: int = 16) -> str:
    """Plain rounds over integer vectors, a few CTEs for each."""
    parts = [
        "q as (select vec_id, list_transform(embedding, lambda x: cast(floor(64*cast(x as double)) as bigint)) as v from embeddings where len(embedding)=64"
        " and len(list_filter(embedding, lambda x: x is not null and isfinite(x)))=64)",
        "e as materialized (select vec_id, generate_subscripts(v,1) as p, unnest(v) as x from q)",
        "s as (select vec_id, row_number() over (order by sha256(concat('1:', vec_id)))-1 as c from q)",
        f"c0 as materialized (select c, p, x as y from e join s using (vec_id) where c<{k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} as (select vec_id, c, cast(sum((x-y)*(x-y)) as bigint) as d from e join c{r} using (p) group by vec_id, c)")
        parts.append(f"a{r} as materialized (select vec_id, min(d) as distance, arg_min(c, (d,c)) as c from d{r} group by vec_id)")
        if r < rounds:
            parts.append(
                f"n{r} as (select c, p, cast(floor(cast(sum(x)-((sum(x)%count(*))+count(*))%count(*) as hugeint)//count(*)) as bigint) as y from e join a{r} using (vec_id) group by c, p)"
            )
            parts.append(f"c{r + 1} as materialized (select o.c, o.p, coalesce(n.y, o.y) as y from c{r} o left join n{r} n on n.c=o.c and n.p=o.p)")
    parts.append(f"h as (select c, sha256(string_agg(cast(y as varchar), ',' order by p)) as centroid_sha256 from c{rounds} group by c)")
    return (
        "with " + ",\n".join(parts) + "\nselect vec_id, cast(c as int) as cluster, distance, cast(sum(distance) over (partition by c) as bigint) as cluster_inertia,"
        f" cast(sum(distance) over () as bigint) as inertia, centroid_sha256 from a{rounds} join h using (c)"
    )


TERMS = r"regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op11_drift_means": k_means_sql(),
    "op12_bag_search": f"""with t as (select doc_id, unnest({TERMS}) as term from documents), b as (select item_id, unnest({TERMS}) as term from benchmark),
f as (select doc_id, term, count(*) as tf from t group by all), d as (select doc_id, count(*) as n from t group by all), z as (select count(*) as nn, cast(sum(n) as bigint) as ll from d),
w as (select term, cast(floor(1000*ln((2*nn+2)/(2*count(*)+1))) as bigint) as w from f, z group by term, nn), m as (select doc_id, 25+(75*n*nn)//ll as m from d, z),
s as (select item_id, doc_id, cast(sum(w*((1000000000*tf)//(1000*tf+8*m))) as bigint) as score from b join f using (term) join w using (term) join m using (doc_id) group by all),
r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from s where score>0) select * from r where rank<=10""",
    "op13_content_archive": """with p as (select page_id, coalesce(html,'') as html from pages), f as (select *, min(page_id) over (partition by html) as first from p)
select page_id, cast(strlen(html) as bigint) as payload_bytes, sha256(html) as payload_digest, case when strlen(html)>=100 and first<>page_id then 'revisit' else 'response' end as record_type,
 case when strlen(html)>=100 and first<>page_id then first end as refers_to from f""",
}
