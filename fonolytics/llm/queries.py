"""Registered queries of the operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fonolytics.llm.textarrays import crc_bucket


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fonolytics.llm.langid import language, learn_profiles

    docs = _read(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.where(crc_bucket("doc_id", 5) != 0))
    found = docs.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), language(profiles).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


# A key for the test tables. A real run takes its key from a secret store.
PSEUDONYM_KEY = b"test tables only"


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fonolytics.llm.pii import pseudonymised

    found = pseudonymised(_read(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct("found.kind")), ",").alias("kinds")
    return found.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), kinds)


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fonolytics.llm.kneserney import score, train

    docs = _read(spark, sf_dir, "documents")
    model = train(docs.where(crc_bucket("doc_id", 7) != 2))
    found = score(docs, model)
    held_out = (crc_bucket("doc_id", 7) == 2).alias("held_out")
    return found.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fonolytics.llm.toxicity import fit, score

    docs = _read(spark, sf_dir, "documents")
    model = fit(docs, _read(spark, sf_dir, "labels").where(crc_bucket("doc_id", 4) != 2))
    return score(docs, model).select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fonolytics.llm.linetemplates import drop_recurring_lines

    found = drop_recurring_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("dropped_lines").cast("long").alias("n_dropped"), "text")


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fonolytics.llm.dartminhash import near_duplicate_classes

    return near_duplicate_classes(_read(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fonolytics.llm.wumanber import find_benchmark

    found = find_benchmark(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fonolytics.llm.winnowing import edited_pairs

    rows = edited_pairs(_read(spark, sf_dir, "documents"))
    sha = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return rows.select("doc_id", "n_chars", sha, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from fonolytics.llm.packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fonolytics.llm.licenses import scan

    return scan(_read(spark, sf_dir, "documents"))


def op11_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from fonolytics.llm.recordfiles import read_records, write_records
    from fonolytics.llm.store import fresh_folder

    folder = fresh_folder(spark, "records")
    write_records(_read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_records(spark, folder)


def planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts (by crc32 of the id) repeat a part of their words up to their end.

    With h = crc32 of the id and g = h div 10: if h mod 10 is 0, each word i >= a becomes word a + (i - a) mod p,
    where a = g mod n and p = 1 + (n - a) div (3 + g mod 8) for n words. A null id counts as the empty text.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.select("*", F.expr("h div 10").alias("g"), F.size("words").alias("n"))
    rows = rows.select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int").alias("a"))
    rows = rows.select("*", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)").alias("p"))
    again = F.expr("concat(slice(words, 1, a), flatten(array_repeat(slice(words, a + 1, p), cast((n - a) div p as int))), slice(words, a + 1, cast((n - a) % p as int)))")
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fonolytics.llm.repeatruns import collapse_repeats

    found = collapse_repeats(planted_repeats(_read(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    rows = found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), F.array_join(lines, "").alias("lines"), longest.alias("top"))
    return rows.select(
        "doc_id",
        "n_runs",
        (-F.col("top.s")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.p")).alias("period"),
        F.expr("1000 * top.length div -top.p").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_dqds_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fonolytics.llm.whitening import whitened_components

    return whitened_components(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_feistel_pseudonyms": op2_feistel_pseudonyms,
    "op3_kneser_ney": op3_kneser_ney,
    "op4_toxicity": op4_toxicity,
    "op5_line_templates": op5_line_templates,
    "op6_dart_minhash": op6_dart_minhash,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_winnowing": op8_winnowing,
    "op9_sum_of_squares_packing": op9_sum_of_squares_packing,
    "op10_license_scan": op10_license_scan,
    "op11_record_files": op11_record_files,
    "op12_lyndon_runs": op12_lyndon_runs,
    "op13_dqds_whitening": op13_dqds_whitening,
}

_OP7_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP7_SQL = f"""with d as (
  select row_number() over () as row_no, doc_id, regexp_extract_all({_LOWER}, '{_OP7_WORDS}') as words from documents
), b as (
  select item_id, words, least(10, len(words)) as m
  from (select item_id, regexp_extract_all({_LOWER}, '{_OP7_WORDS}') as words from benchmark) where len(words) > 0
), pattern as (
  select distinct m, item_id, array_to_string(words[i : i + m - 1], ' ') as window_text
  from b, unnest(range(1, len(words) - m + 2)) as u(i)
), place as (
  select row_no, i, m, array_to_string(words[i : i + m - 1], ' ') as window_text
  from d, (select distinct m from pattern) as ms, unnest(range(1, len(words) - m + 2)) as u(i)
), found as (
  select row_no, i, m, item_id from place join pattern using (m, window_text)
), hit as (
  select row_no, count(distinct w) as n_hit
  from (select distinct row_no, i, m from found) as f, unnest(range(i, i + m)) as u(w) group by 1
), item as (
  select row_no, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct row_no, cast(item_id as varchar) as id from found where item_id is not null) group by 1
)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (row_no) left join item using (row_no)"""



def _op10_sql() -> str:
    from fonolytics.llm.licenses import PHRASES, TEMPLATES, THRESHOLD

    phrases = ", ".join(f"(string_split('{p}', ' '), '{label}')" for p, label in PHRASES)
    notices = ", ".join(f"('{label}', [{', '.join(repr(w) for w in telling)}]::varchar[], string_split('{t}', ' '))" for label, telling, t in TEMPLATES)
    pairs = "list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])"
    return f"""with d as (
  select row_number() over () as row_no, doc_id, regexp_extract_all({_LOWER}, '{_OP7_WORDS}') as words from documents
), phrase(words, label) as (values {phrases}), notice(label, telling, words) as (values {notices}),
place as (
  select row_no, i - 1 as start, phrase.label
  from d, phrase, unnest(range(1, len(d.words) - len(phrase.words) + 2)) as u(i)
  where d.words[i] = phrase.words[1] and d.words[i : i + len(phrase.words) - 1] = phrase.words
), base as (
  select row_no, count(*) as n_base, min(start) as first_word, max(start) as last_word, list(distinct label) as labels from place group by 1
), template as (
  select label, list_distinct({pairs}) as own, cast(ceil(len(words) / {THRESHOLD} - 1e-9) as bigint) as run,
         list_distinct(list_filter({pairs}, lambda p: len(list_intersect(string_split(p, ' '), telling)) > 0)) as must
  from notice
), paired as (select row_no, {pairs} as pairs from d),
hopeful as (
  select row_no, pairs, template.* from paired, template where len(list_intersect(pairs, own)) >= {THRESHOLD} * len(own) - 1e-9
), block as (
  select row_no, label, own, must, list_intersect(pairs[i : i + run - 2], own) as had
  from hopeful, unnest(range(1, len(pairs) + 1)) as u(i)
), met as (
  select row_no, label, len(had) / len(own) as containment
  from block where len(had) >= {THRESHOLD} * len(own) - 1e-9 and len(list_intersect(had, must)) = len(must)
), more as (select row_no, list(distinct label) as labels, max(containment) as most from met group by 1)
select doc_id, cast(len(d.words) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') as labels,
       case when n_base > 0 then 1.0::double else coalesce(most, 0)::double end as score
from d left join base using (row_no) left join more using (row_no)"""


ORACLE_SQL: dict[str, str] = {"op7_benchmark_decontamination": _OP7_SQL, "op10_license_scan": _op10_sql()}
