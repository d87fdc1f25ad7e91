"""The queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selenite.llm import bpe, cdc, crf, ego_join, html_blocks, late_overwrite, licenses, ppm, rns_whiten, rp_forest, sharding, simhash, tiling
from selenite.llm.common import materialize, read_table, shared_dir, text_key

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    handle = bpe.prepare(docs, public_tokenizers.path("word_bpe_49k.json"))
    coded = bpe.encode(docs, handle, keep=["doc_id"], decoded=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op3_gear_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", text_key().alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes"))
    found = cdc.with_spans(sizes, cdc.duplicate_spans(docs), key="key")
    cut = F.aggregate("spans", F.lit(0), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id",
        "n_bytes",
        F.coalesce(cut, F.lit(0)).alias("removed_bytes"),
        F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"),
        F.col("spans").isNotNull().alias("has_repeats"),
        "spans",
    )


@query
def op6_deletion_variant_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    marks = materialize(simhash.fingerprints(docs, keep=["doc_id"]))
    found = simhash.near_duplicates(marks, "doc_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = crf.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = crf.score(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        crf.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query
def op9_greedy_tiling_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = tiling.coverage(docs, read_table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.withColumn("contaminated", F.col("coverage") >= tiling.THRESHOLD)


@query
def op4_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    dealt = sharding.shuffle(rows, 16)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op7_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", licenses.scan(F.col("text")).alias("found")).select("doc_id", "found.*")


@query
def op5_block_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    found = html_blocks.extract(pages, keep=["page_id", "url"])
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op8_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_vectors(read_table(spark, sf_dir, "embeddings"))


@query
def op2_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(read_table(spark, sf_dir, "documents"))


@query
def op11_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: 2024-04-10 00:00 UTC in microseconds: rows that arrived before are early.
EARLY = 1_712_707_200_000_000


@query
def op12_late_arrival_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = read_table(spark, sf_dir, "sales")
    h = F.crc32(F.col("sale_id").cast("string"))
    day = F.floor(late_overwrite.micros(sales, "sold_at") / late_overwrite.DAY)
    copied = F.coalesce((h % 3 == 0) & (day % 7 == 0), F.lit(False))
    copies = sales.where(copied).withColumns({
        "total": F.col("total") + 1,
        "sold_at": F.col("sold_at") + F.make_dt_interval((h % 2).cast("int")),
        "arrived_at": F.col("arrived_at") + F.make_dt_interval((1 + h % 97).cast("int")),
    })
    rows = sales.unionByName(copies)
    arrived = late_overwrite.micros(rows, "arrived_at")
    early = F.coalesce(arrived < EARLY, F.lit(False))
    path = f"{shared_dir(spark)}/selenite-sales-{uuid.uuid4().hex}"
    layout = late_overwrite.Layout(path, sales.schema, "sale_id", "sold_at", "arrived_at", 1 + sales.count() // 700)
    late_overwrite.create(rows.where(early), layout)
    days = late_overwrite.overwrite_late(spark, rows.where(~early), layout)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    moments = [text(late_overwrite.micros(sales, c)) for c in ("sold_at", "arrived_at")]
    sums = {
        "cents": F.coalesce(F.floor(100 * F.col("total") + 0.5), F.lit(0)),
        "rows_crc": F.crc32(F.concat_ws(":", text(F.col("sale_id")), *moments)),
    }
    return late_overwrite.file_report(spark, layout, sums).withColumn("rewritten", F.col("day").isin(days))


@query
def op13_residue_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rns_whiten.whiten(read_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation as long)"))


ORACLE_SQL["op8_epsilon_grid_join"] = """
with recursive v as (
    select vec_id, cast(embedding as double[]) as e from embeddings
),
ok as (
    select * from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0
),
pairs as (
    select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_cosine_similarity(a.e, b.e) >= 0.9
),
reach as (
    select vec_id as a, vec_id as b from v
    union
    select r.a, p.b from reach r join pairs p on p.a = r.b
)
select vec_id, (select count(*) from pairs where a = vec_id) as n_links,
    (select min(b) from reach where a = vec_id) as component_id, vec_id = (select min(b) from reach where a = vec_id) as kept
from v
"""
