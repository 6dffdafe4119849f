"""The registered queries: each applies one operator to its whole table and derives the digest columns from its output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, lexical_search, license_scan, near_dedup, order_minhash, packing, quality_classifier, quality_rules, sharding, suffix_dedup, token_counts, tokenizer_alignment

QUALITY_THRESHOLD = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_classifier.Model | None:
    """Trained on the labelled rows of docs that aren't held out."""
    return quality_classifier.train(docs, table(spark, sf_dir, "labels").where(~held_out()))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything but the ids is parsed back from the formatted windows and their masks."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], turns.schema)

    def digests(windows: DataFrame) -> DataFrame:
        back = chat_format.read_back(windows)
        whole = back.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum("n_chars").alias("formatted_chars"))
        said = F.flatten(F.transform("w", lambda w: w["turns"]))
        text = F.array_join(F.transform(said, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
        loss = F.array_join(F.flatten(F.transform("w", lambda w: w["targets"])), "")
        return whole.select(F.col("conv").alias("conv_id"), F.size(said).cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")

    # each part for itself, so that the one that is dealt by conversation needn't be dealt again
    return reduce(DataFrame.unionByName, map(digests, chat_format.format_parts(turns.union(extra))))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=None).withColumnRenamed("id", "doc_id")


def packed_pieces(docs: DataFrame) -> DataFrame:
    """All documents in sequences of 1024 tokens, each document closed by id 2; the digest is of the written ids."""
    import public_tokenizers

    pieces = packing.encode_pieces(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("<|endoftext|>", 50_256), vocabulary("byte_bpe_50k.json"), final_id=2, capacity=1024)
    placed = packing.pack(pieces.select("piece_key", "length"), capacity=1024)
    digest = pieces.select("piece_key", F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digest.join(placed, "piece_key").drop("piece_key")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = license_scan.scan_licenses(docs, license_scan.train(docs))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda x: x["family"]))), ",")
    return out.select(F.col("id").alias("doc_id"), "n_paragraphs", "n_lines", F.size("findings").cast("long").alias("n_findings"), families.alias("families"), "findings")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    group = F.struct(F.unhex(F.md5("text")).alias("md5"), F.crc32("text").alias("crc32"))
    out = sharding.byte_shards(docs, group, F.octet_length("text").cast("long") + 1, shards=16)
    return out.select(F.col("id").alias("doc_id"), "size", F.col("grp.crc32").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counts.withColumnRenamed("id", "doc_id").withColumn("over_limit", F.col("n_tokens") > 512)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_classifier.score(docs, quality_model(spark, docs, sf_dir)).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return out.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(table(spark, sf_dir, "documents"))
    found = lexical_search.search(index, table(spark, sf_dir, "benchmark"), k=50)
    lexical_search.drop_index(index)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def _two_vocabularies() -> tuple[tokenizer_alignment.Vocabulary, tokenizer_alignment.Vocabulary]:
    import public_tokenizers

    return tokenizer_alignment.byte_level(vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, vocabulary("byte_bpe_50k.json")), tokenizer_alignment.sentence_pieces(vocabulary("piece_bpe_32k.model"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_alignment.align(table(spark, sf_dir, "documents"), _two_vocabularies).withColumnRenamed("id", "doc_id")


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.document_fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_chat_format, op3_quality_rules, op4_best_fit_packing, op5_near_dedup, op6_license_scan, op7_sharding, op8_token_counts, op9_quality_classifier, op10_suffix_dedup, op11_lexical_search, op12_tokenizer_alignment, op13_document_fingerprints)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sql_words(gaps: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{gaps}'), lambda x: x <> '')"


ORACLE_SQL: dict[str, str] = {
    "op11_lexical_search": f"""
with d as (select doc_id, {_sql_words("[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")} as w from documents),
i as (select distinct item_id, unnest({_sql_words("[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")}) as term from benchmark),
s as (select count(*) filter (where len(w) > 0) as big_n, sum(len(w))::bigint as big_l from d),
p as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from d) group by 1, 2),
f as (select term, floor(1000 * ln((2.0::double * big_n + 2) / (2 * count(*) + 1)))::bigint as weight from p, s group by term, big_n),
m as (select doc_id, 50 + (50 * len(w) * big_n) // big_l as m from d, s),
r as (select item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score from i join f using (term) join p using (term) join m using (doc_id) group by 1, 2),
k as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from r where score > 0)
select item_id, rank, doc_id, score from k where rank <= 50""",
    "op1_decontamination": f"""
with d as (select doc_id, {_sql_words("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} as w from documents),
i as (select item_id::varchar as item, {_sql_words("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} as w from benchmark),
x as (select distinct item, array_to_string(w[k::int:k::int + 12], ' ') as win, least(len(w), 13) as n from (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as k from i where len(w) > 0)),
p as (select doc_id, n, k, array_to_string(w[k::int:(k + n - 1)::int], ' ') as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from x))),
h as (select doc_id, k, p.n, item from p join x using (win, n)),
c as (select doc_id, count(distinct k + j) as n_hit from (select doc_id, k, unnest(range(0, n)) as j from h) group by 1),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join c using (doc_id) left join t using (doc_id)""",
    "op5_near_dedup": f"""
with recursive d as (select doc_id, {_sql_words("[\\x09-\\x0D\\x20]+")} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) < 2 then [w] else list_transform(range(1, len(w)), lambda k: [w[k::int], w[k::int + 1]]) end) as g from d where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1),
b as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from b join n p on p.doc_id = x join n q on q.doc_id = y where 100 * shared >= 80 * (p.n + q.n - shared)),
l as (select x, y from e union all select y, x from e),
r(doc_id, other) as (select doc_id, doc_id from d union select r.doc_id, l.y from r join l on l.x = r.other),
c as (select doc_id, min(other) as component_id from r group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from c left join n using (doc_id)""",
}
