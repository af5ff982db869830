"""The registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, importance, language_id, line_dedup, near_dup, packing, quality_classifier, quality_rules, secrets, sentencepiece_viterbi, url_filter, vector_codes
from .common import crc_bucket, table

#: Vocabulary files of public tokenizers (parameters of the operators).
CHAT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

# Fixed values of the contract.
URL_RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]
PROBE_CHAT = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    each = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string")))
    names = [r.kind for r in secrets.BASE_RULES]
    base = F.filter(each, lambda s: F.substring_index(s, ":", 1).isin(names))
    counts = [(F.size("kinds") - F.size(F.array_remove("kinds", n))).cast("long").alias(f"n_{n}") for n in names]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(each, ",").alias("spans"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "log_perplexity")


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_classifier.Neighbours:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(crc_bucket(F.col("doc_id"), 5) != 0)
    return quality_classifier.train(docs, labels)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_classifier.score_quality(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.flag_leaks(docs, table(spark, sf_dir, "benchmark"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE_CHAT, rows.schema)
    return chat.digest(chat.format_chats(rows.unionByName(probe), CHAT_TOKENIZER))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(crc_bucket(F.col("doc_id"), 4) != 2))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    links = F.aggregate("line_classes", F.lit(0).cast("long"), lambda n, x: n + x["linked_lines"])
    classes = F.transform("line_classes", lambda x: F.concat_ws(":", *(x[c].cast("string") for c in ("line", "class_id", "copies", "linked_classes", "linked_lines"))))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), digest.alias("text_sha256"), links.alias("n_links"), F.array_join(classes, ",").alias("line_classes"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_viterbi.encode_decode(docs, PIECE_MODEL)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(ids, 256).alias("ids_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), keep=("label",))
    coded = vector_codes.with_group_sum(coded, "label", "error", "label_error")
    code = F.array_join(F.transform("code", lambda i: F.lpad(F.lower(F.hex(i.cast("long"))), 2, "0")), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.sha2(F.lit(books.text()), 256).alias("codebooks_sha256"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), CHAT_TOKENIZER)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_scan, op2_quality_rules, op3_quality_classifier, op4_decontamination, op5_chat_format, op6_language_id, op7_line_dedup, op8_minhash_near_dedup, op9_sentencepiece, op10_url_filter, op11_vector_codes, op12_best_fit_packing, op13_importance_resampling)}


# A conversation's texts in order; escapes add a character before each backslash and each "<".
_OP5 = r"""
with turns as (
  select conv_id, case when conv_id is null then row_number() over () end as alone, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, null, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, null, 1, 'assistant', '\### Assistant: </turn> ok'),
sized as (
  select *, length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '<', '')))
    + length(role) + 6 + 2 + 8 as size from turns)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(size) as bigint) as formatted_chars
from sized group by conv_id, alone
"""

_OP10 = r"""
with cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
bare as (select page_id, regexp_extract(rest, '^[^?#]*') as rest from cut),
parts as (
  select page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) as path from bare),
rules(rule_host, rule_path, rule_verdict) as (values
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit as (
  select p.*, rule_host || rule_path as rule, rule_verdict,
    row_number() over (partition by page_id order by length(rule_host) desc, length(rule_path) desc) as place
  from parts p left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict from fit where place = 1
"""


def _op11() -> str:
    """Lloyd rounds over parts, by brute force."""
    steps = []
    for i in range(5):
        # Each part's nearest entry of codebook i.
        steps.append(f"""near{i} as materialized (
  select vec_id, part, min_by(entry, (d, entry)) as entry, min(d) as d from (
    select c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) as d
    from comp c join book{i} b on c.part = b.part and c.pos = b.pos group by c.vec_id, c.part, b.entry) group by vec_id, part)""")
        if i < 4:
            steps.append(f"""mean{i} as (
  select n.part, n.entry, c.pos, sum(c.x)::bigint as s, count(*) as k from near{i} n join comp c on c.vec_id = n.vec_id and c.part = n.part group by n.part, n.entry, c.pos),
book{i + 1} as materialized (
  select b.part, b.entry, b.pos, case when m.k is null then b.x else (m.s - ((m.s % m.k) + m.k) % m.k) // m.k end as x
  from book{i} b left join mean{i} m on b.part = m.part and b.entry = m.entry and b.pos = m.pos)""")
    return f"""
with kept as materialized (
  select vec_id, label, embedding, len(embedding) // 4 as w, row_number() over (order by vec_id) - 1 as place from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
comp as materialized (
  select vec_id, place, (i - 1) // w as part, (i - 1) % w as pos, floor(1024 * embedding[i]::double)::bigint as x
  from (select *, unnest(range(1, len(embedding) + 1)) as i from kept)),
book0 as materialized (select part, place as entry, pos, x from comp where place < 256),
{", ".join(steps)},
coded as (
  select vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' order by part) as code, sum(d)::bigint as error from near4 group by vec_id),
hashed as (select sha256(string_agg(x::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from book4)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from coded join kept using (vec_id), hashed
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_format": _OP5, "op10_url_filter": _OP10, "op11_vector_codes": _op11()}
