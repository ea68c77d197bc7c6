"""Queries over the driver's tables and the SQL that each is compared with.

Bindings: training and evaluation rows of ``samples`` (split by ``source_registry``) are the
corpus and the evaluation sets, ``outputs`` the answers of runs, ``dpo_samples`` the preference
data, ``cmexam_raw`` the raw rows, ``events`` the request log (value = latency, user_id % 7 =
level). Verdicts that only serve the reports are derived from row keys, alike in both dialects;
rule verdicts on the real answers use look-around patterns that the SQL dialect lacks and are
tested on fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.functions.extract import first_declared, judge_reply
from corpuloom.functions.stats import nice_max, short_count, verdict_name
from corpuloom.functions.text import first_clause, norm_text
from corpuloom.operators import decontaminate, evaluation, grading, loadtest, multivalue, sampling
from corpuloom.operators.ranks import numbered
from corpuloom.runtime import materialise, spread, stage_path, table
from corpuloom.sources import adapters, chat
from corpuloom.sources.readers import last_wins, read_jsonl, write_jsonl
from corpuloom.streaming.resume import remaining

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- shared inputs ----------------------------------------------------------------------------


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples with their split, each id once."""
    registry = table(spark, d, "source_registry").select("source", "split")
    return spread(table(spark, d, "samples").where("id is not null")).dropDuplicates(["id"]).join(registry, "source")


def _train_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = _samples(spark, d)
    train = s.where("split = 'train'").select("id", F.col("question").alias("text"), "source")
    items = s.where("split <> 'train'").select("id", F.col("question").alias("text"), F.col("source").alias("eval_set"))
    return train, items


_CTE_SAMPLES = """
s AS (SELECT DISTINCT ON (x.id) x.*, r.split FROM samples x JOIN source_registry r USING (source) WHERE x.id IS NOT NULL ORDER BY x.id),
train AS (SELECT id, question AS text, source FROM s WHERE split = 'train'),
items AS (SELECT id, question AS text, source AS eval_set FROM s WHERE split <> 'train')"""


def _scan_sql(n: int = 10, least: float = 0.3, top: str = "WHERE rank <= 20", cap: str = "HAVING count(*) <= (SELECT greatest(20, CAST(floor(count(*) * 0.005::DOUBLE) AS BIGINT)) FROM train)") -> str:
    def norm(t: str) -> str:
        return f"lower(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"

    def grams(t: str) -> str:
        return f"SELECT DISTINCT id, CASE WHEN length(t) >= {n} THEN substr(t, CAST(i AS INT), {n}) ELSE t END AS gram FROM (SELECT id, {norm('text')} AS t FROM {t}), generate_series(1, greatest(length(t) - {n - 1}, 1)) AS g(i) WHERE length(t) > 0"

    return f"""{_CTE_SAMPLES},
eg AS (SELECT * FROM ({grams('items')}) WHERE id IN (SELECT id FROM items WHERE length({norm('text')}) >= {n})),
tg AS ({grams('train')}),
total AS (SELECT id, count(*) AS total FROM eg GROUP BY id),
rare AS (SELECT gram FROM tg GROUP BY gram {cap}),
pairs AS (SELECT eg.id AS item_id, tg.id AS train_id, count(*) AS shared FROM eg JOIN rare USING (gram) JOIN tg USING (gram) GROUP BY ALL),
rated AS (SELECT item_id, train_id, shared, total, shared / total AS ratio FROM pairs JOIN total ON total.id = item_id),
ranked AS (SELECT *, CASE WHEN ratio >= 0.8::DOUBLE THEN 'contaminated' ELSE 'suspicious' END AS level, row_number() OVER (PARTITION BY item_id ORDER BY round(ratio, 3) DESC, train_id) AS rank FROM rated WHERE ratio >= {least}::DOUBLE),
hits AS (SELECT item_id, train_id, shared, total, ratio, level FROM ranked {top})"""


# ---- decontamination --------------------------------------------------------------------------


@query(f"WITH {_scan_sql()} SELECT * FROM hits")
def decontam_hits(spark: SparkSession, d: str) -> DataFrame:
    train, items = _train_items(spark, d)
    return decontaminate.scan(train, items)


@query(f"WITH {_scan_sql(5, 0.01)} SELECT * FROM hits")
def decontam_hits_n5(spark: SparkSession, d: str) -> DataFrame:
    """Short shingles and a low threshold: the top 20 of an item are cut."""
    train, items = _train_items(spark, d)
    return decontaminate.scan(train, items, n=5, suspicious=0.01)


@query(f"WITH {_scan_sql()} SELECT item_id, train_id, ratio, row_number() OVER (ORDER BY ratio DESC, item_id, train_id) - 1 AS pos FROM hits")
def decontam_hits_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The place of every hit in the order of all."""
    train, items = _train_items(spark, d)
    return decontaminate.ordered(decontaminate.scan(train, items)).select("item_id", "train_id", "ratio", F.col("pos").cast("bigint").alias("pos"))


@query(f"""WITH {_scan_sql()}, short AS (SELECT id FROM items WHERE length(lower(regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))) < 10)
SELECT eval_set, count(*) AS size, coalesce((SELECT count(*) FROM hits h JOIN items j ON j.id = h.item_id WHERE j.eval_set = i.eval_set AND level = 'contaminated'), 0) AS contaminated,
coalesce((SELECT count(*) FROM hits h JOIN items j ON j.id = h.item_id WHERE j.eval_set = i.eval_set AND level = 'suspicious'), 0) AS suspicious,
coalesce((SELECT count(*) FROM short h JOIN items j ON j.id = h.id WHERE j.eval_set = i.eval_set), 0) AS unscannable FROM items i GROUP BY eval_set""")
def decontam_report(spark: SparkSession, d: str) -> DataFrame:
    train, items = _train_items(spark, d)
    return decontaminate.report(decontaminate.scan(train, items), items)


@query(f"WITH {_scan_sql(top='', cap='')} SELECT id, source FROM train WHERE id NOT IN (SELECT train_id FROM hits WHERE level = 'contaminated')")
def clean_pool(spark: SparkSession, d: str) -> DataFrame:
    """Training rows without any that covers an item, however many cover it and however frequent its shingles are."""
    train, items = _train_items(spark, d)
    return decontaminate.clean_pool(train.select("id", "source"), decontaminate.contaminating(train, items))


@query(f"WITH {_scan_sql(top='')} SELECT id, source FROM train WHERE id NOT IN (SELECT train_id FROM hits WHERE level = 'contaminated')")
def clean_pool_all_hits(spark: SparkSession, d: str) -> DataFrame:
    """As clean_pool, but shingles above the document-frequency cap bring no hits."""
    train, items = _train_items(spark, d)
    return decontaminate.clean_pool(train.select("id", "source"), decontaminate.scan(train, items, top=None))


@query(f"""WITH {_scan_sql(5, 0.2)} SELECT eval_set, rank, item_id, train_id, ratio FROM (SELECT eval_set, item_id, train_id, ratio,
row_number() OVER (PARTITION BY eval_set ORDER BY ratio DESC, item_id, train_id) AS rank FROM hits JOIN items ON items.id = item_id WHERE level = 'suspicious') WHERE rank <= 20""")
def top_suspicious(spark: SparkSession, d: str) -> DataFrame:
    train, items = _train_items(spark, d)
    return decontaminate.top_suspicious(decontaminate.scan(train, items, n=5, suspicious=0.2), items)


@query("""SELECT doc_id FROM documents WHERE length(lower(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]+', '', 'g'))) < 10""")
def unscannable_short(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return decontaminate.unscannable(docs).withColumnRenamed("id", "doc_id")


@query(f"""WITH {_scan_sql()} SELECT gram, df FROM (SELECT gram, count(*) AS df FROM tg WHERE gram IN (SELECT gram FROM eg) GROUP BY gram)
WHERE df > (SELECT greatest(20, CAST(floor(count(*) * 0.005::DOUBLE) AS BIGINT)) FROM train)""")
def gram_df_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    """Boilerplate shingles of the evaluation items and their document frequency."""
    train, items = _train_items(spark, d)
    scannable = items.where(F.length(norm_text(F.col("text"))) >= decontaminate.NGRAM)
    seen = decontaminate.grams(train).join(decontaminate.grams(scannable).select("gram").distinct(), "gram", "left_semi")
    return seen.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > decontaminate.df_cap(train))


@query("""SELECT source, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')))) AS BIGINT) AS norm_chars FROM documents GROUP BY source""")
def norm_text_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"), F.sum(F.length(norm_text(F.col("text")))).alias("norm_chars"))


# ---- adapters ---------------------------------------------------------------------------------

_GOLD = "CASE WHEN length(up) = 0 THEN '' ELSE array_to_string(list_sort(list_distinct(regexp_extract_all(up, '(?s).'))), '') END"
_RAW = f"""
raw AS (SELECT DISTINCT row_no, split, question, options, answer FROM cmexam_raw),
up AS (SELECT *, regexp_replace(upper(coalesce(answer, '')), '[\\s,，、;/]+', '', 'g') AS up FROM raw),
g AS (SELECT *, {_GOLD} AS gold, CASE WHEN ltrim(options)[1] = '[' THEN regexp_extract_all(options, '"key": "([^"]*)"', 1) WHEN ltrim(options)[1] = '{{' THEN json_keys(options) END AS keys FROM up),
v AS (SELECT *, gold <> '' AND keys IS NOT NULL AND question IS NOT NULL AND len(list_filter(regexp_extract_all(gold, '(?s).'), lambda c: NOT list_contains(keys, c))) = 0 AS ok FROM g)"""


def _cmexam(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    raw = table(spark, d, "cmexam_raw").dropDuplicates(["row_no"])
    return adapters.cmexam(raw.select(F.col("row_no").alias("ord"), F.col("question").alias("Question"), F.col("options").alias("Options"), F.col("answer").alias("Answer")), "cmexam")


_STRIP = r"^[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$"


@query(f"WITH {_RAW} SELECT 'cmexam-' || row_no AS id, regexp_replace(question, '{_STRIP}', '', 'g') AS question, gold, CAST(len(keys) AS INT) AS n_options FROM v WHERE ok")
def adapt_exam(spark: SparkSession, d: str) -> DataFrame:
    return _cmexam(spark, d)[0].select("id", "question", "gold", F.size("options").alias("n_options"))


@query(f"WITH {_RAW} SELECT CAST(row_no AS BIGINT) AS ord, 'answer is no option' AS reason, gold AS detail FROM v WHERE NOT coalesce(ok, false)")
def quarantine_exam(spark: SparkSession, d: str) -> DataFrame:
    return _cmexam(spark, d)[1].select("ord", "reason", "detail")


@query(f"WITH {_RAW} SELECT 'cmexam' AS source, count(*) AS dropped FROM v WHERE NOT coalesce(ok, false)")
def drop_counts(spark: SparkSession, d: str) -> DataFrame:
    return adapters.drop_counts(_cmexam(spark, d)[1])


@query(f"WITH {_RAW} SELECT ord, detail FROM (SELECT CAST(row_no AS BIGINT) AS ord, gold AS detail, row_number() OVER (ORDER BY row_no) AS n FROM v WHERE NOT coalesce(ok, false)) WHERE n <= 3")
def first_dropped(spark: SparkSession, d: str) -> DataFrame:
    return adapters.first_dropped(_cmexam(spark, d)[1]).select("ord", "detail")


_CTE_RAW = f"s AS (SELECT DISTINCT ON (id) * FROM samples WHERE id IS NOT NULL ORDER BY id), x AS (SELECT *, regexp_replace(question, '{_STRIP}', '', 'g') AS q, regexp_replace(gold, '{_STRIP}', '', 'g') AS g, regexp_replace(cot, '{_STRIP}', '', 'g') AS c FROM s)"


def _open_query(name: str, source: str, with_cot: bool, adapter: Callable, fields: dict[str, str]) -> None:
    """An adapter of open questions over raw rows made of all samples; rows without question or answer go to quarantine."""
    cot = "c AS cot" if with_cot else "CAST(NULL AS VARCHAR) AS cot"
    kept = f"q IS NOT NULL AND g IS NOT NULL{' ' if with_cot else ''}"
    sql = f"WITH {_CTE_RAW} SELECT '{source}-' || id AS id, q AS question, g AS gold, {cot}, false AS dropped FROM x WHERE {kept} UNION ALL SELECT id, NULL, NULL, NULL, true FROM x WHERE NOT ({kept})"

    def run(spark: SparkSession, d: str) -> DataFrame:
        raw = table(spark, d, "samples").where("id is not null").dropDuplicates(["id"]).select(F.col("id").alias("ord"), *(F.col(c).alias(f) for c, f in fields.items()))
        good, bad = adapter(raw, source)
        none = F.lit(None).cast("string")
        return good.select("id", "question", "gold", "cot", F.lit(False).alias("dropped")).unionByName(bad.select(F.col("ord").alias("id"), none.alias("question"), none.alias("gold"), none.alias("cot"), F.lit(True).alias("dropped")))

    run.__name__ = name
    query(sql)(run)


_open_query("adapt_verifiable", "med-o1-verifiable", False, adapters.verifiable, {"question": "Open-ended Verifiable Question", "gold": "Ground-True Answer"})
_open_query("adapt_reasoning", "med-o1-sft-zh", True, adapters.reasoning, {"question": "Question", "gold": "Response", "cot": "Complex_CoT"})
_open_query("adapt_distilled", "med-r1-zh", True, adapters.distilled, {"question": "question", "gold": "response (content)", "cot": "reasoning (reasoning_content)"})


def _map_query(name: str, source: str, blank: bool, adapter: Callable, fields: dict[str, str], meta: dict[str, str]) -> None:
    """An adapter of choice questions with an option map over raw rows made of all samples."""
    keys = "map_keys(options)" if blank else f"list_transform(list_filter(map_entries(options), lambda e: regexp_replace(coalesce(e.value, ''), '{_STRIP}', '', 'g') <> ''), lambda e: e.key)"
    gold = f"array_to_string(list_sort(list_distinct(regexp_extract_all(upper(g), '(?s).'))), '')"
    names = list(meta)
    sql = f"""WITH {_CTE_RAW}, y AS (SELECT *, coalesce({gold}, '') AS letters, {keys} AS keys FROM x), z AS (SELECT *, q IS NOT NULL AND letters <> '' AND keys IS NOT NULL AND len(list_filter(regexp_extract_all(letters, '(?s).'), lambda c: NOT list_contains(keys, c))) = 0 AS ok FROM y)
SELECT '{source}-' || id AS id, q AS question, letters AS gold, CAST(len(keys) AS INT) AS n_options, coalesce({meta[names[0]]}, '') AS {names[0]}, coalesce({meta[names[1]]}, '') AS {names[1]} FROM z WHERE coalesce(ok, false)"""

    def run(spark: SparkSession, d: str) -> DataFrame:
        raw = table(spark, d, "samples").where("id is not null").dropDuplicates(["id"]).select(F.col("id").alias("ord"), *(F.col(c).alias(f) for c, f in fields.items()), *(F.col(c).alias(n) for n, c in meta.items()))
        good, _ = adapter(raw, source)
        return good.select("id", "question", "gold", F.size("options").alias("n_options"), *(F.col("meta")[n].alias(n) for n in names))

    run.__name__ = name
    query(sql)(run)


_map_query("adapt_cmb", "cmb-val", False, adapters.cmb, {"question": "question", "options": "option", "gold": "answer"}, {"exam_subject": "source", "question_type": "cot"})
_map_query("adapt_medxpertqa", "medxpertqa", True, adapters.medxpertqa, {"question": "question", "options": "options", "gold": "label"}, {"medical_task": "source", "body_system": "cot"})


@query(f"""WITH {_CTE_SAMPLES} SELECT id, question || coalesce(list_reduce(list_transform(list_sort(map_entries(options)), lambda e: chr(10) || e.key || '. ' || coalesce(e.value, '')), lambda a, b: a || b), '') AS rendered FROM s
WHERE options IS NOT NULL AND cardinality(options) > 0 AND question IS NOT NULL UNION ALL SELECT id, question FROM s WHERE (options IS NULL OR cardinality(options) = 0) OR question IS NULL""")
def render_question(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).select("id", adapters.render_question(F.col("question"), F.col("options")).alias("rendered"))


@query("SELECT source, count(*) AS n, count(DISTINCT id) AS ids FROM samples WHERE source = 'med-r1-zh' GROUP BY source")
def pool_of_source(spark: SparkSession, d: str) -> DataFrame:
    return adapters.by_source(table(spark, d, "samples"), "med-r1-zh").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query(f"WITH {_CTE_SAMPLES} SELECT split, source, count(*) AS n FROM s GROUP BY ALL")
def union_of_sources(spark: SparkSession, d: str) -> DataFrame:
    s = _samples(spark, d)
    parts = s.where("split = 'train'").unionByName(s.where("split <> 'train'"))
    return parts.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"))


# ---- fine-tuning data -------------------------------------------------------------------------


@query("""SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text""")
def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    """First document of each content and how many there are; contents meet by 128 bits of hash, so that no text is shuffled."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    return docs.groupBy("h", "g").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@query(f"""WITH {_scan_sql()}, pool AS (SELECT id FROM train WHERE id NOT IN (SELECT train_id FROM hits WHERE level = 'contaminated'))
SELECT min(id) AS id, question AS user_text, '<think>' || chr(10) || cot || chr(10) || '</think>' || chr(10) || chr(10) || gold AS assistant_text FROM s WHERE coalesce(cot, '') <> '' AND id IN (SELECT id FROM pool) GROUP BY question, cot, gold""")
def sft_think_messages(spark: SparkSession, d: str) -> DataFrame:
    train, items = _train_items(spark, d)
    pool = decontaminate.clean_pool(train, decontaminate.scan(train, items))
    made = grading.reasoning_rows(_samples(spark, d).select("id", "question", "cot", "gold"), pool)
    return made.select("id", F.col("messages")[0]["content"].alias("user_text"), F.col("messages")[1]["content"].alias("assistant_text"))


@query(f"WITH {_CTE_SAMPLES} SELECT id, regexp_replace(question, '{_STRIP}', '', 'g') AS user_text, regexp_replace(gold, '{_STRIP}', '', 'g') AS assistant_text FROM s WHERE options IS NULL")
def sft_single_turn(spark: SparkSession, d: str) -> DataFrame:
    """Conversations made of samples: one turn each for open questions, three turns for choice questions."""

    def turn(who: str, c: Column) -> Column:
        return F.struct(F.lit(who).alias("from"), c.alias("value"))

    ask, answer = turn("human", F.col("question")), turn("gpt", F.col("gold"))
    talks = _samples(spark, d).select(F.col("id").alias("ord"), F.when(F.col("options").isNull(), F.array(ask, answer)).otherwise(F.array(ask, answer, ask)).alias("conversations"))
    return grading.single_turn(talks).select(F.col("ord").alias("id"), F.col("messages")[0]["content"].alias("user_text"), F.col("messages")[1]["content"].alias("assistant_text"))


@query(f"""WITH {_CTE_SAMPLES}, main AS (SELECT id AS key FROM s WHERE coalesce(cot, '') <> ''), general AS (SELECT CAST(doc_id AS VARCHAR) AS key FROM documents),
need AS (SELECT CAST(floor(count(*) * 0.15::DOUBLE / (1 - 0.15::DOUBLE)) AS BIGINT) AS n FROM main),
chosen AS (SELECT key FROM (SELECT key, row_number() OVER (ORDER BY md5('42:' || key), key) AS r FROM general) WHERE r <= (SELECT n FROM need)),
mixed AS (SELECT key, 'main' AS origin FROM main UNION ALL SELECT key, 'general' FROM chosen) SELECT key, origin, md5('42:' || origin || ':' || key) AS shuffle_key FROM mixed""")
def sft_mix(spark: SparkSession, d: str) -> DataFrame:
    main = _samples(spark, d).where(F.coalesce("cot", F.lit("")) != "").select(F.col("id").alias("key"))
    general = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"))
    return sampling.ratio_mix(main, general, "key", 0.15)


@query(f"""WITH {_CTE_SAMPLES}, main AS (SELECT id FROM s WHERE coalesce(cot, '') <> ''), n AS (SELECT count(*) AS m, CAST(floor(count(*) * 0.15::DOUBLE / (1 - 0.15::DOUBLE)) AS BIGINT) AS g FROM main)
SELECT 'main' AS origin, m AS rows, m / (m + g) AS share FROM n UNION ALL SELECT 'general', g, g / (m + g) FROM n WHERE g > 0""")
def mix_composition(spark: SparkSession, d: str) -> DataFrame:
    """Rows and shares of the parts of a mix."""
    return sampling.composition(sft_mix(spark, d))


@query("""WITH once AS (SELECT DISTINCT source, question, gold, cot FROM samples WHERE source IS NOT NULL) SELECT source, a.n AS rows, b.n AS kept, a.n - b.n AS duplicates FROM (SELECT source, count(*) AS n FROM samples GROUP BY source) a JOIN (SELECT source, count(*) AS n FROM once GROUP BY source) b USING (source)""")
def duplicate_counter(spark: SparkSession, d: str) -> DataFrame:
    """Rows, different contents and rows that repeat one, per source; contents meet by 128 bits of hash."""
    c = ["question", "gold", "cot"]
    marks = [m for x in c for m in (F.col(x).isNull(), F.coalesce(x, F.lit("")))]  # nulls are contents of their own
    rows = table(spark, d, "samples").where("source is not null").select("source", F.xxhash64(*marks).alias("h"), F.xxhash64(F.lit(1), *marks).alias("g"))
    per = rows.groupBy("source", "h", "g").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("kept"))
    return per.withColumn("duplicates", F.col("rows") - F.col("kept"))


@query(f"WITH {_scan_sql()} SELECT source, count(*) AS n FROM s WHERE split = 'train' AND coalesce(cot, '') <> '' AND id NOT IN (SELECT train_id FROM hits WHERE level = 'contaminated') GROUP BY source")
def pool_semi_join(spark: SparkSession, d: str) -> DataFrame:
    train, items = _train_items(spark, d)
    pool = decontaminate.clean_pool(train, decontaminate.scan(train, items)).select("id")
    return _samples(spark, d).where(F.coalesce("cot", F.lit("")) != "").join(pool, "id", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# ---- sampling ---------------------------------------------------------------------------------


@query(f"WITH {_CTE_SAMPLES} SELECT id, pos FROM (SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS pos FROM s WHERE split <> 'train') WHERE pos >= 100 AND pos < 300")
def eval_sample_hash(spark: SparkSession, d: str) -> DataFrame:
    """A shard of a prefix-stable sample: positions 100 to 299."""
    rows = _samples(spark, d).where("split <> 'train'").select("id")
    return sampling.sample(rows, "id", 200, offset=100).select("id", F.col("pos").cast("bigint").alias("pos"))


@query(f"""WITH {_CTE_SAMPLES} SELECT id, stratum FROM (SELECT id, CASE WHEN options IS NULL THEN 'open' ELSE 'choice' END AS stratum,
row_number() OVER (PARTITION BY options IS NULL ORDER BY md5('42:' || id), id) AS r FROM s) WHERE r <= CASE WHEN stratum = 'open' THEN 120 ELSE 80 END""")
def calibration_strata(spark: SparkSession, d: str) -> DataFrame:
    rows = _samples(spark, d).select("id", F.when(F.col("options").isNull(), "open").otherwise("choice").alias("stratum"))
    parts = [sampling.sample(rows.where(F.col("stratum") == s), "id", n) for s, n in (("open", 120), ("choice", 80))]
    return parts[0].unionByName(parts[1]).select("id", "stratum")


@query(f"WITH {_CTE_SAMPLES} SELECT id, pos FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM s WHERE split = 'test') WHERE pos < 500")
def set_limit(spark: SparkSession, d: str) -> DataFrame:
    """The first 500 items of one evaluation split in the order of ids."""
    items = numbered(_samples(spark, d).where("split = 'test'").select("id"), [F.col("id")])
    return sampling.head(items, 500, "pos").select("id", F.col("pos").cast("bigint").alias("pos"))


@query()
def key_seeds(spark: SparkSession, d: str) -> DataFrame:
    """CRC-32 of every id and the seed of its draws; the SQL dialect has no such function."""
    ids = table(spark, d, "samples").where("id is not null").select("id").distinct()
    crc = F.crc32(F.col("id").cast("binary"))
    return ids.select("id", crc.alias("crc"), (crc % 10000 + 42).alias("seed"))


@query()
def first_declarations(spark: SparkSession, d: str) -> DataFrame:
    """The first declaration of every answer, for display; its pattern looks ahead, which the SQL dialect cannot."""
    return table(spark, d, "outputs").select("out_id", first_declared(F.col("output")).alias("shown")).distinct()


# ---- answers and verdicts ---------------------------------------------------------------------


@query()
def grade_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Rule verdict on every answer of every run."""
    asked = _samples(spark, d).select("id", "gold", "options")
    answers = spread(table(spark, d, "outputs")).dropDuplicates(["out_id"]).join(asked, "id")
    declared = grading.declared(F.col("output"), F.col("options"))
    return answers.select("out_id", "run_name", "gold", "options", declared.alias("declaration")).select(
        "out_id", "run_name", "gold", "options", "declaration", grading.rule_verdict(F.col("gold"), F.col("options"), F.col("declaration")).alias("correct")
    )



@query(f"""WITH {_CTE_SAMPLES}, w AS (SELECT id, gold, left(gold, 1) AS letter, ascii(right(id, 1)) % 4 AS form FROM s WHERE options IS NOT NULL AND gold <> '')
SELECT id, CASE WHEN form < 3 THEN letter END AS declaration, CASE WHEN form < 3 THEN letter = gold END AS correct FROM w""")
def extract_choice_grade(spark: SparkSession, d: str) -> DataFrame:
    """Answers written in known forms: what is read back, and the verdict. A full-width colon declares nothing."""
    letter, form = F.left("gold", F.lit(1)), F.ascii(F.right("id", F.lit(1))) % 4
    text = F.when(form == 0, F.concat(F.lit("最终答案:"), letter)).when(form == 1, F.concat(F.lit("x \\boxed{"), letter, F.lit("}"))).when(form == 2, F.concat(F.lit("the answer is ("), letter, F.lit(")."))).otherwise(F.concat(F.lit("答案："), letter))
    rows = _samples(spark, d).where("options is not null and gold <> ''").select("id", "gold", "options", text.alias("output"))
    read = rows.withColumn("declaration", grading.declared(F.col("output"), F.col("options")))
    return read.select("id", "declaration", grading.rule_verdict(F.col("gold"), F.col("options"), F.col("declaration")).alias("correct"))


_NORM = "lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


def _declared_sql(text: str) -> str:
    """The declared text of an answer to an open question; its patterns look around nowhere, so the SQL dialect has them, too."""
    space = _STRIP.split("]+|")[0][1:] + "]"
    tail = rf"regexp_replace(right({text}, 2000), '\\(?:text|mathrm|mathbf)\{{([^{{}}]*)\}}', '\1', 'g')"
    boxed = rf"list_last(regexp_extract_all({tail}, '\\boxed\{{([^{{}}]+)\}}', 1))"
    line = rf"list_last(regexp_extract_all({tail}, '(?:最终答案|答案){space}*(?:是|为|:){space}*([^\n]+)', 1))"
    return rf"nullif(regexp_replace(coalesce(regexp_replace({boxed}, '{_STRIP}', '', 'g'), regexp_replace({line}, '{_STRIP}', '', 'g')), '[。.」】]+$', ''), '')"


def _open_verdict_sql(gold: str, declared: str) -> str:
    """True where the declared text is the key, as a whole or in its first clause; else nothing."""
    clause = f"regexp_extract({declared}, '^[^,。;!?]*', 0)"
    return f"CASE WHEN {declared} IS NOT NULL AND {_NORM.format(gold)} <> '' AND ({_NORM.format(declared)} = {_NORM.format(gold)} OR {_NORM.format(clause)} = {_NORM.format(gold)}) THEN true END"


_WRITTEN = "CASE ascii(right(id, 1)) % 3 WHEN 0 THEN '最终答案: ' || gold || '。' WHEN 1 THEN '答案:x' || chr(10) || '\\boxed{' || gold || '}' ELSE 'so ' || gold END"


@query(f"""WITH {_CTE_SAMPLES}, w AS (SELECT id, gold, {_WRITTEN} AS output FROM s WHERE options IS NULL AND gold IS NOT NULL), r AS (SELECT *, {_declared_sql('output')} AS declaration FROM w)
SELECT id, output, declaration, {_open_verdict_sql('gold', 'declaration')} AS correct FROM r""")
def extract_text_whole(spark: SparkSession, d: str) -> DataFrame:
    """Keys of all open questions, written in known forms: what is read back, and the verdict."""
    form = F.ascii(F.right("id", F.lit(1))) % 3
    text = F.when(form == 0, F.concat(F.lit("最终答案: "), F.col("gold"), F.lit("。"))).when(form == 1, F.concat(F.lit("答案:x\n\\boxed{"), F.col("gold"), F.lit("}"))).otherwise(F.concat(F.lit("so "), F.col("gold")))
    rows = _samples(spark, d).where("options is null and gold is not null").select("id", "gold", "options", text.alias("output"))
    read = rows.withColumn("declaration", grading.declared(F.col("output"), F.col("options")))
    return read.select("id", "output", "declaration", grading.rule_verdict(F.col("gold"), F.col("options"), F.col("declaration")).alias("correct"))


@query()
def extract_choice_whole(spark: SparkSession, d: str) -> DataFrame:
    """As extract_choice_grade, with all letters of the key."""
    rows = _samples(spark, d).where("options is not null and gold <> ''").withColumn("list", F.array_join(F.split("gold", ""), "、"))
    form = F.ascii(F.right("id", F.lit(1))) % 4
    text = F.when(form == 0, F.concat(F.lit("最终答案:"), F.col("list"))).when(form == 1, F.concat(F.lit("x \\boxed{"), F.col("gold"), F.lit("}"))).when(form == 2, F.concat(F.lit("故选 "), F.col("list"), F.lit("。"))).otherwise(F.concat(F.lit("答案："), F.col("list")))
    read = rows.withColumn("output", text).withColumn("declaration", grading.declared(F.col("output"), F.col("options")))
    return read.select("id", "output", "declaration", grading.rule_verdict(F.col("gold"), F.col("options"), F.col("declaration")).alias("correct"))


@query("SELECT doc_id, regexp_extract(text, '^[^,。;!?]*', 0) AS clause FROM documents WHERE text IS NOT NULL")
def first_clauses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", first_clause(F.col("text")).alias("clause"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN false END AS correct FROM documents")
def judge_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies of a judge in several forms, of which only a boolean counts."""
    forms = ['ok {"correct": true, "reason": "x"}', '{"correct": false}', '{"correct": "true"}', "no verdict", '{"other": true}']
    reply = F.get(F.array(*map(F.lit, forms)), (F.col("doc_id") % 5).cast("int"))
    return table(spark, d, "documents").select("doc_id", judge_reply(reply).alias("correct"))


@query(f"""WITH {_CTE_SAMPLES}, w AS (SELECT id, question, gold, {_WRITTEN} AS output FROM s WHERE options IS NULL AND gold IS NOT NULL), r AS (SELECT *, {_declared_sql('output')} AS declaration FROM w)
SELECT id, left(question, 1500) AS question, left(gold, 500) AS gold, right(output, 1500) AS output FROM r WHERE {_open_verdict_sql('gold', 'declaration')} IS NULL""")
def judge_inputs(spark: SparkSession, d: str) -> DataFrame:
    """What a judge reads of the open questions on which the rules abstain."""
    form = F.ascii(F.right("id", F.lit(1))) % 3
    rows = _samples(spark, d).where("options is null and gold is not null")
    text = F.when(form == 0, F.concat(F.lit("最终答案: "), F.col("gold"), F.lit("。"))).when(form == 1, F.concat(F.lit("答案:x\n\\boxed{"), F.col("gold"), F.lit("}"))).otherwise(F.concat(F.lit("so "), F.col("gold")))
    return grading.judge_prompts(rows, rows.select("id", text.alias("output")))


@query(f"""WITH {_CTE_SAMPLES} SELECT id, CASE WHEN options IS NOT NULL THEN 'Choose: ' || question || coalesce(list_reduce(list_transform(list_sort(map_entries(options)), lambda e: chr(10) || e.key || '. ' || coalesce(e.value, '')), lambda a, b: a || b), '') || '!' ELSE 'Answer: ' || question END AS prompt
FROM s WHERE options IS NULL OR cardinality(options) > 0 UNION ALL SELECT id, 'Choose: ' || question || '!' FROM s WHERE cardinality(options) = 0""")
def prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    """The rendered questions in the template of their kind."""
    return chat.prompts(_samples(spark, d), "Choose: {}!", "Answer: {}")


@query(f"WITH {_CTE_SAMPLES} SELECT row_number() OVER (ORDER BY id) - 1 AS ord, id, question, gold, cot FROM s")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All samples written as JSON lines in the order of ids and read back with their line numbers."""
    path = stage_path(spark)
    write_jsonl(_samples(spark, d).select(F.col("id").alias("place"), "id", "question", "gold", "cot"), path, "place")
    return read_jsonl(spark, path, "id string, question string, gold string, cot string")


@query(f"""WITH {_CTE_SAMPLES}, w AS (SELECT *, CASE WHEN length(id) % 5 = 4 THEN NULL WHEN options IS NULL THEN {_WRITTEN} ELSE 'x ' || chr(92) || 'boxed{{' || left(gold, 1) || '}}' END AS output FROM s WHERE gold IS NOT NULL),
r AS (SELECT *, CASE WHEN options IS NULL THEN {_declared_sql('output')} END AS text FROM w),
v AS (SELECT *, CASE WHEN options IS NULL THEN {_open_verdict_sql('gold', 'text')} WHEN output IS NOT NULL AND gold <> '' THEN left(gold, 1) = gold END AS rule, length(question) % 3 <> 0 AS asked, CASE WHEN length(question) % 3 = 1 THEN length(question) % 2 = 0 END AS word FROM r)
SELECT id, CASE WHEN length(id) % 5 = 4 THEN NULL ELSE coalesce(rule, CASE WHEN asked THEN word END) END AS correct, CASE WHEN length(id) % 5 = 4 THEN 'missing' WHEN rule IS NOT NULL THEN 'rule' WHEN asked THEN 'llm' ELSE 'abstain' END AS method FROM v""")
def grade_with_judge(spark: SparkSession, d: str) -> DataFrame:
    """Keys written as answers, a fifth of them missing: verdicts of the rules, and of a table of a judge's words where they abstain."""
    rows = _samples(spark, d).where("gold is not null")
    form = F.ascii(F.right("id", F.lit(1))) % 3
    open_ = F.when(form == 0, F.concat(F.lit("最终答案: "), F.col("gold"), F.lit("。"))).when(form == 1, F.concat(F.lit("答案:x\n\\boxed{"), F.col("gold"), F.lit("}"))).otherwise(F.concat(F.lit("so "), F.col("gold")))
    text = F.when(F.col("options").isNull(), open_).otherwise(F.concat(F.lit("x \\boxed{"), F.left("gold", F.lit(1)), F.lit("}")))
    outputs = rows.where(F.length("id") % 5 != 4).select("id", text.alias("output"))
    n = F.length("question")
    words = rows.where(n % 3 != 0).select("id", F.when(n % 3 == 1, n % 2 == 0).alias("correct"))
    return grading.grade(rows, outputs, words).select("id", "correct", "method")


def _graded(spark: SparkSession, d: str) -> DataFrame:
    """id, run, set_name, correct: the last answer of each run and item, with a verdict derived from its key."""
    rows = table(spark, d, "outputs").where("id is not null").select("out_id", "id", F.col("run_name").alias("run"), "set_name")
    newest = rows.groupBy("run", "id").agg(F.max(F.struct("out_id", "set_name")).alias("m")).select("run", "id", "m.*")
    return newest.select("id", "run", "set_name", F.when(F.col("out_id") % 7 != 0, (F.col("out_id") % 5).isin(0, 1, 2)).alias("correct"))


_CTE_GRADED = """
graded AS (SELECT id, run_name AS run, arg_max(set_name, out_id) AS set_name, CASE WHEN max(out_id) % 7 <> 0 THEN max(out_id) % 5 IN (0, 1, 2) END AS correct FROM outputs WHERE id IS NOT NULL GROUP BY id, run_name),
tally AS (SELECT run, set_name, count(*) AS n, count(*) FILTER (correct) AS correct, count(*) FILTER (correct IS NULL) AS abstained FROM graded GROUP BY ALL),
rates AS (SELECT *, correct / n AS acc, abstained / n AS abstain_rate, correct / n AS p, CAST(n AS DOUBLE) AS m FROM tally),
wilson AS (SELECT run, set_name, n, correct, abstained, acc, abstain_rate, greatest(0.0::DOUBLE, (p + (1.96::DOUBLE * 1.96::DOUBLE) / (2.0::DOUBLE * m)) / (1.0::DOUBLE + (1.96::DOUBLE * 1.96::DOUBLE) / m) - 1.96::DOUBLE * sqrt(p * (1.0::DOUBLE - p) / m + (1.96::DOUBLE * 1.96::DOUBLE) / (4.0::DOUBLE * m * m)) / (1.0::DOUBLE + (1.96::DOUBLE * 1.96::DOUBLE) / m)) AS ci_low,
least(1.0::DOUBLE, (p + (1.96::DOUBLE * 1.96::DOUBLE) / (2.0::DOUBLE * m)) / (1.0::DOUBLE + (1.96::DOUBLE * 1.96::DOUBLE) / m) + 1.96::DOUBLE * sqrt(p * (1.0::DOUBLE - p) / m + (1.96::DOUBLE * 1.96::DOUBLE) / (4.0::DOUBLE * m * m)) / (1.0::DOUBLE + (1.96::DOUBLE * 1.96::DOUBLE) / m)) AS ci_high FROM rates)"""


@query(f"WITH {_CTE_GRADED} SELECT run, id, CASE WHEN correct IS NULL THEN 'abstain' WHEN correct THEN 'correct' ELSE 'wrong' END AS verdict FROM graded")
def verdict_names(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d).select("run", "id", verdict_name(F.col("correct")).alias("verdict"))


@query(f"WITH {_CTE_GRADED} SELECT * FROM wilson")
def run_tally_wilson(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.tally(_graded(spark, d), "run", "set_name")


@query(f"""WITH {_CTE_GRADED} SELECT w.run, w.set_name, w.n, w.acc, b.acc AS base_acc, CASE WHEN w.run <> 'base' THEN (w.acc - b.acc) * 100 END AS delta,
CASE WHEN w.run = 'base' OR b.acc IS NULL THEN NULL WHEN b.acc BETWEEN w.ci_low AND w.ci_high THEN 'flat' WHEN w.acc > b.acc THEN 'up' ELSE 'down' END AS delta_class
FROM wilson w LEFT JOIN wilson b ON b.set_name = w.set_name AND b.run = 'base'""")
def baseline_delta_class(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.against_baseline(evaluation.tally(_graded(spark, d), "run", "set_name"), "base")


@query(f"""WITH {_CTE_GRADED} SELECT set_name, count(*) AS questions, count(*) FILTER (NOT was AND now) AS fixed, count(*) FILTER (was AND NOT now) AS broken, count(*) FILTER (NOT was AND now) - count(*) FILTER (was AND NOT now) AS net
FROM (SELECT a.set_name, coalesce(a.correct, false) AS was, coalesce(b.correct, false) AS now FROM graded a JOIN graded b USING (id) WHERE a.run = 'base' AND b.run = 'dpo-v2') GROUP BY set_name""")
def transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    g = _graded(spark, d)
    return evaluation.transitions(g.where("run = 'base'").select("id", "set_name", "correct"), g.where("run = 'dpo-v2'").select("id", "correct"), "set_name")


RUNS = ["base-v2", "sft-v2", "sft-r1-v2", "dpo-v2"]


def _bucketed(spark: SparkSession, d: str) -> DataFrame:
    wide = evaluation.common_questions(_graded(spark, d), RUNS, "set_name")
    b = evaluation.bucket(F.col("`base-v2`"), [F.col("`sft-v2`"), F.col("`sft-r1-v2`")], F.col("`dpo-v2`"))
    return wide.select("set_name", "id", b.alias("bucket"))


_CTE_BUCKETS = f"""{_CTE_GRADED},
four AS (SELECT * FROM graded WHERE run IN ('base-v2', 'sft-v2', 'sft-r1-v2', 'dpo-v2')),
wide AS (SELECT set_name, id, bool_or(correct) FILTER (run = 'base-v2') AS b, bool_or(correct) FILTER (run = 'sft-v2') AS s1, bool_or(correct) FILTER (run = 'sft-r1-v2') AS s2, bool_or(correct) FILTER (run = 'dpo-v2') AS p, count(DISTINCT run) AS k FROM four GROUP BY set_name, id),
common AS (SELECT * FROM wide w WHERE k = (SELECT count(DISTINCT run) FROM four f WHERE f.set_name = w.set_name)),
bucketed AS (SELECT set_name, id, CASE WHEN b AND (s1 IS NOT NULL OR s2 IS NOT NULL) AND NOT coalesce(s1, false) AND NOT coalesce(s2, false) THEN 'regression' WHEN NOT coalesce(b, false) AND p THEN 'dpo_fix'
WHEN coalesce(b, true) AND coalesce(s1, true) AND coalesce(s2, true) AND coalesce(p, true) THEN 'all_correct' WHEN NOT coalesce(b, false) AND NOT coalesce(s1, false) AND NOT coalesce(s2, false) AND NOT coalesce(p, false) THEN 'all_wrong' ELSE 'mixed' END AS bucket FROM common)"""


@query(f"WITH {_CTE_BUCKETS} SELECT set_name, bucket, count(*) AS questions FROM bucketed GROUP BY ALL")
def bucket_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _bucketed(spark, d).groupBy("set_name", "bucket").agg(F.count(F.lit(1)).alias("questions"))


@query(f"WITH {_CTE_BUCKETS} SELECT set_name, bucket, id, pos FROM (SELECT *, row_number() OVER (PARTITION BY set_name, bucket ORDER BY id) AS pos FROM bucketed) WHERE pos <= 8")
def common_ids_buckets(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.first_of_bucket(_bucketed(spark, d), 8, "set_name").select("set_name", "bucket", "id", F.col("pos").cast("bigint").alias("pos"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of two thirds of the answers: the others have not been scored yet."""
    return _graded(spark, d).where(F.length("id") % 3 != 0).select("id", "run", "correct", F.lit("rule").alias("method"))


_NEWEST = "newest AS (SELECT id, run_name AS run, max_by(coalesce(output, chr(0)), out_id) AS o FROM outputs WHERE id IS NOT NULL GROUP BY id, run_name), answers AS (SELECT n.id, n.run, nullif(o, chr(0)) AS output, CASE WHEN length(n.id) % 3 <> 0 THEN g.correct END AS correct, CASE WHEN length(n.id) % 3 <> 0 THEN 'rule' END AS method FROM newest n JOIN graded g ON g.id = n.id AND g.run = n.run)"


def _newest(spark: SparkSession, d: str) -> DataFrame:
    """id, run, output: the last answer of each run and item."""
    rows = table(spark, d, "outputs").where("id is not null").select("out_id", "id", F.col("run_name").alias("run"), "output")
    return rows.groupBy("run", "id").agg(F.max(F.struct("out_id", "output")).alias("m")).select("run", "id", F.col("m.output").alias("output"))


@query(f"WITH {_CTE_GRADED}, {_NEWEST} SELECT id, run, length(output) AS chars, correct, method FROM answers")
def outputs_left_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Answers with their verdicts; those without one stay."""
    return evaluation.with_verdicts(_newest(spark, d), _scored(spark, d)).select("id", "run", F.length("output").alias("chars"), "correct", "method")


LABELS = {"regression": "worse after tuning", "dpo_fix": "mended by preferences", "all_correct": "all right", "all_wrong": "all wrong", "mixed": "mixed"}
_LABEL_SQL = "CASE bucket " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " END"
_CTE_CHOSEN = "chosen AS (SELECT set_name, id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY set_name, bucket ORDER BY id) AS pos FROM bucketed) WHERE pos <= 8)"
_SPLIT_SQL = f"""CASE WHEN contains(output, '</think>') THEN regexp_replace(regexp_replace(regexp_extract(output, '(?s)\\A(.*)</think>(.*)\\z', 1), '\\A<think>', ''), '{{strip}}', '', 'g') WHEN output IS NOT NULL THEN '' END AS thinking,
CASE WHEN contains(output, '</think>') THEN regexp_replace(regexp_extract(output, '(?s)\\A(.*)</think>(.*)\\z', 2), '{{strip}}', '', 'g') ELSE regexp_replace(output, '{{strip}}', '', 'g') END AS conclusion""".replace("{strip}", _STRIP)


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.first_of_bucket(_bucketed(spark, d), 8, "set_name").select("set_name", "id", "bucket")


@query(f"""WITH {_CTE_SAMPLES}, {_CTE_BUCKETS}, {_NEWEST}, {_CTE_CHOSEN}, parts AS (SELECT *, {_SPLIT_SQL} FROM answers)
SELECT c.set_name, c.id, bucket, {_LABEL_SQL} AS label, s.source, s.question, s.gold, cardinality(s.options) AS n_options, cardinality(s.meta) AS n_meta, run, correct, method, left(thinking, 7000) AS thinking, length(thinking) > 7000 AS thinking_cut,
CASE WHEN length(conclusion) > 7000 THEN left(conclusion, 3500) || chr(10) || chr(10) || '……（中段省略）……' || chr(10) || chr(10) || right(conclusion, 3500) ELSE conclusion END AS conclusion, length(thinking) AS thinking_chars, length(conclusion) AS conclusion_chars
FROM chosen c JOIN s ON s.id = c.id LEFT JOIN parts p ON p.id = c.id""")
def replay_payload(spark: SparkSession, d: str) -> DataFrame:
    """The chosen questions with the answers of all runs as shown, one row per answer."""
    answers = evaluation.with_verdicts(_newest(spark, d), _scored(spark, d))
    shown = evaluation.replay(_chosen(spark, d), _samples(spark, d), answers, labels=LABELS)
    each = shown.select("set_name", "id", "bucket", "label", "source", "question", "gold", F.size("options").cast("bigint").alias("k"), F.size("meta").cast("bigint").alias("m"), F.explode_outer("answers").alias("run", "a"))
    sizes = [F.when(F.col(c) >= 0, F.col(c)).alias(n) for c, n in (("k", "n_options"), ("m", "n_meta"))]  # null maps have the size -1
    parts = ["correct", "method", "thinking", "thinking_cut", "conclusion", "thinking_chars", "conclusion_chars"]
    return each.select("set_name", "id", "bucket", "label", "source", "question", "gold", *sizes, "run", *(F.col(f"a.{p}") for p in parts))


@query(f"WITH {_CTE_BUCKETS}, {_CTE_CHOSEN} SELECT set_name, id, bucket FROM chosen WHERE set_name = 'cmexam-test' AND bucket = 'mixed'")
def replay_filter(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.filtered(_chosen(spark, d), "cmexam-test", "mixed")


@query(f"WITH {_CTE_BUCKETS}, {_CTE_CHOSEN} SELECT CAST(list_position(['regression', 'dpo_fix', 'mixed', 'all_wrong', 'all_correct'], bucket) - 1 AS BIGINT) AS place, bucket FROM (SELECT DISTINCT bucket FROM chosen)")
def buckets_shown(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.buckets_present(_chosen(spark, d)).select(F.col("place").cast("bigint").alias("place"), "bucket")


@query(f"""WITH {_CTE_GRADED} SELECT w.run, w.set_name, CASE WHEN w.run = 'base' OR b.acc IS NULL THEN NULL WHEN w.acc BETWEEN b.ci_low AND b.ci_high THEN 'flat' WHEN w.acc > b.acc THEN 'up' ELSE 'down' END AS delta_class
FROM wilson w LEFT JOIN wilson b ON b.set_name = w.set_name AND b.run = 'base'""")
def within_base_interval(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.within_base(evaluation.tally(_graded(spark, d), "run", "set_name"), "base")


@query(f"WITH {_CTE_GRADED} SELECT run, set_name, n, round(acc * 100, 1) AS acc, round(ci_low * 100, 1) AS ci_low, round(ci_high * 100, 1) AS ci_high, round(abstain_rate * 100, 1) AS abstain_rate FROM wilson")
def summary_rows(spark: SparkSession, d: str) -> DataFrame:
    """Tallies in per cent with one digit, as a summary shows them."""
    t = evaluation.tally(_graded(spark, d), "run", "set_name")
    return t.select("run", "set_name", "n", *(F.round(F.col(c) * 100, 1).alias(c) for c in ("acc", "ci_low", "ci_high", "abstain_rate")))


@query(f"""SELECT out_id, thinking_chars, conclusion, conclusion_chars FROM (SELECT DISTINCT out_id, length(t) AS thinking_chars, length(c) AS conclusion_chars,
CASE WHEN length(c) > 200 THEN left(c, 100) || chr(10) || chr(10) || '……（中段省略）……' || chr(10) || chr(10) || right(c, 100) ELSE c END AS conclusion
FROM (SELECT out_id, CASE WHEN contains(output, '</think>') THEN regexp_replace(regexp_replace(regexp_extract(output, '(?s)\\A(.*)</think>(.*)\\z', 1), '\\A<think>', ''), '{_STRIP}', '', 'g') WHEN output IS NOT NULL THEN '' END AS t,
CASE WHEN contains(output, '</think>') THEN regexp_replace(regexp_extract(output, '(?s)\\A(.*)</think>(.*)\\z', 2), '{_STRIP}', '', 'g') ELSE regexp_replace(output, '{_STRIP}', '', 'g') END AS c FROM outputs))""")
def split_thinking(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "outputs").dropDuplicates(["out_id"])
    return rows.select("out_id", *evaluation.answer_view(F.col("output"), 200)).select("out_id", "thinking_chars", "conclusion", "conclusion_chars")


@query("""WITH graded AS (SELECT DISTINCT out_id, out_id % 3 = 0 AS human, CASE WHEN out_id % 7 <> 0 THEN out_id % 5 IN (0, 1, 2) END AS correct FROM outputs)
SELECT *, CASE WHEN judged > 0 THEN agree / judged ELSE 0 END AS rate, CASE WHEN total > 0 THEN abstain / total ELSE 0 END AS abstain_rate, agree / judged >= 0.95::DOUBLE AND judged >= 50 AS fit FROM (SELECT count(*) AS total, count(*) FILTER (correct IS NOT NULL) AS judged,
count(*) FILTER (correct = human) AS agree, count(*) FILTER (correct <> human) AS disagree, count(*) FILTER (correct IS NULL) AS abstain FROM graded)""")
def calibrate_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "outputs").select("out_id").distinct()
    return grading.calibration(rows.select((F.col("out_id") % 3 == 0).alias("human_correct"), F.when(F.col("out_id") % 7 != 0, (F.col("out_id") % 5).isin(0, 1, 2)).alias("correct")))


_PAIRS_SQL = """r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(solution), i) AS rank FROM c WHERE cls = 'correct') WHERE rank <= 2),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5('42:' || id || '#' || i), i) AS place FROM c WHERE cls = 'wrong') WHERE place <= 2),
k AS (SELECT id, count(*) AS wrongs FROM w GROUP BY id)"""
_CTE_SOLUTIONS = """
sol AS (SELECT id, i - 1 AS i, solutions[i] AS solution FROM (SELECT DISTINCT ON (id) id, solutions FROM dpo_samples WHERE id IS NOT NULL), generate_series(1, len(solutions)) AS g(i) WHERE solutions[i] IS NOT NULL)"""


@query(f"""WITH {_CTE_SOLUTIONS}, c AS (SELECT *, CASE length(solution) % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'wrong' ELSE 'drop' END AS cls FROM sol),
{_PAIRS_SQL}
SELECT r.id, r.rank, CAST(r.i AS INT) AS chosen_i, CAST(w.i AS INT) AS rejected_i, r.solution AS chosen, w.solution AS rejected FROM r JOIN k USING (id) JOIN w ON w.id = r.id AND w.place = (r.rank - 1) % wrongs + 1""")
def dpo_pairs(spark: SparkSession, d: str) -> DataFrame:
    each = grading.exploded(table(spark, d, "dpo_samples"))
    m = F.length("solution") % 3
    classes = each.withColumn("cls", F.when(m == 0, "correct").when(m == 1, "wrong").otherwise("drop"))
    made = grading.pairs(classes)
    return made.select("id", F.col("rank").cast("bigint").alias("rank"), "chosen_i", "rejected_i", "chosen", "rejected")


_CTE_ARBITRATED = f"""{_CTE_SAMPLES}, {_CTE_SOLUTIONS},
read AS (SELECT sol.*, gold, {_declared_sql('solution')} AS declaration FROM sol JOIN s USING (id)),
c AS (SELECT id, i, solution, CASE WHEN {_open_verdict_sql('gold', 'declaration')} THEN 'correct' WHEN declaration IS NULL THEN 'drop' ELSE CASE length(solution) % 4 WHEN 0 THEN 'correct' WHEN 3 THEN 'drop' ELSE 'wrong' END END AS cls FROM read)"""


def _arbitrated(spark: SparkSession, d: str) -> DataFrame:
    """Classes by the rules and, for what they leave open, a table of a judge's words derived from lengths."""
    samples, dpo = _samples(spark, d), table(spark, d, "dpo_samples")
    n = F.length("solution") % 4
    words = grading.to_arbitrate(dpo, samples).where(n != 3).select("key", (n == 0).alias("correct"))
    return grading.classified(dpo, samples, arbitrated=words)


@query(f"WITH {_CTE_ARBITRATED} SELECT id, CAST(i AS INT) AS i, declaration, {_open_verdict_sql('gold', 'declaration')} AS correct FROM read")
def grade_solutions(spark: SparkSession, d: str) -> DataFrame:
    """Rule verdict on every sampled solution of the open questions."""
    asked = _samples(spark, d).select("id", "gold", "options")
    read = grading.exploded(table(spark, d, "dpo_samples")).join(asked, "id").withColumn("declaration", grading.declared(F.col("solution"), F.col("options")))
    return read.select("id", "i", "declaration", grading.rule_verdict(F.col("gold"), F.col("options"), F.col("declaration")).alias("correct"))


@query(f"WITH {_CTE_ARBITRATED} SELECT id, CAST(i AS INT) AS i, cls FROM c")
def classify_arbitrated(spark: SparkSession, d: str) -> DataFrame:
    return _arbitrated(spark, d).select("id", "i", "cls")


@query(f"""WITH {_CTE_ARBITRATED}, {_PAIRS_SQL} SELECT r.id, r.rank, s.question AS user_text, r.solution AS assistant_text, w.solution AS rejected_response
FROM r JOIN k USING (id) JOIN w ON w.id = r.id AND w.place = (r.rank - 1) % wrongs + 1 JOIN s ON s.id = r.id""")
def dpo_records(spark: SparkSession, d: str) -> DataFrame:
    """Preference records of the real solutions, classified by rules and a judge's words."""
    made = grading.pair_records(grading.pairs(materialise(_arbitrated(spark, d))), _samples(spark, d))
    return made.select("id", F.col("rank").cast("bigint").alias("rank"), F.col("messages")[0]["content"].alias("user_text"), F.col("messages")[1]["content"].alias("assistant_text"), "rejected_response")


@query()
def dpo_pairs_compat(spark: SparkSession, d: str) -> DataFrame:
    """As the pairs of dpo_records, with wrong solutions drawn by Python's generator, which SQL has not."""
    return grading.pairs_compat(materialise(_arbitrated(spark, d)))


@query(f"""WITH {_CTE_SOLUTIONS} SELECT id, CAST(i AS INT) AS i, coalesce(CASE WHEN length(solution) % 2 = 0 THEN 'correct' END, 'drop') AS cls FROM sol""")
def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Classes looked up in a label cache by id#i; what the cache lacks is dropped."""
    dpo = table(spark, d, "dpo_samples")
    labels = grading.exploded(dpo).where(F.length("solution") % 2 == 0).select(F.concat("id", F.lit("#"), F.col("i").cast("string")).alias("key"), F.lit("correct").alias("cls"))
    return grading.classified(dpo, table(spark, d, "samples"), labels).select("id", "i", "cls")


# ---- joins with checkpoints -------------------------------------------------------------------


@query(f"WITH {_CTE_SAMPLES} SELECT id FROM items WHERE id NOT IN (SELECT id FROM outputs WHERE run_name = 'base' AND id IS NOT NULL)")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items that the run has not answered yet."""
    done = table(spark, d, "outputs").where("run_name = 'base'").select("id")
    return remaining(_train_items(spark, d)[1].select("id"), done)


@query("SELECT run_name, id, max(out_id) AS out_id FROM outputs WHERE id IS NOT NULL GROUP BY run_name, id")
def checkpoint_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "outputs").where("id is not null").withColumn("key", F.concat_ws("\x1f", "run_name", "id"))
    return last_wins(rows.select("key", "run_name", "id", "out_id").dropDuplicates(["out_id"]), "key", "out_id").select("run_name", "id", "out_id")


@query(f"""WITH {_CTE_SAMPLES}, o AS (SELECT id, max(out_id) AS out_id FROM outputs WHERE run_name = 'base' AND id IS NOT NULL GROUP BY id)
SELECT eval_set, count(*) AS n, count(o.out_id) AS answered, count(*) - count(o.out_id) AS missing FROM items LEFT JOIN o USING (id) GROUP BY eval_set""")
def missing_outputs(spark: SparkSession, d: str) -> DataFrame:
    answered = table(spark, d, "outputs").where("run_name = 'base' and id is not null").groupBy("id").agg(F.max("out_id").alias("out_id"))
    rows = _train_items(spark, d)[1].join(answered, "id", "left")
    return rows.groupBy("eval_set").agg(F.count(F.lit(1)).alias("n"), F.count("out_id").alias("answered"), (F.count(F.lit(1)) - F.count("out_id")).alias("missing"))


@query(f"""WITH {_CTE_SAMPLES}, o AS (SELECT DISTINCT out_id, id, length(output) AS chars FROM outputs WHERE id IS NOT NULL) SELECT id, greatest(max(coalesce(chars, 0)), 1) AS longest FROM o JOIN items USING (id) GROUP BY id""")
def longest_answer(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "outputs").where("id is not null").join(_train_items(spark, d)[1].select("id"), "id")
    return rows.groupBy("id").agg(F.greatest(F.max(F.coalesce(F.length("output"), F.lit(0))), F.lit(1)).cast("bigint").alias("longest"))


# ---- load test --------------------------------------------------------------------------------


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests: level, latency as total time, a first token at a third of it, tokens from the key."""
    e = table(spark, d, "events")
    return e.select(
        (F.col("user_id") % 7).alias("level"), (F.col("event_id") % 2).alias("label"), (F.col("value") / 3).alias("ttft_ms"), F.col("value").alias("total_ms"),
        (F.col("event_id") % 50).alias("out_tokens"), (F.col("event_type") != "error").alias("ok"), F.lit(60.0).alias("wall_s"),
    )


def _levels_sql(by: str) -> str:
    return f"""r AS (SELECT user_id % 7 AS level, event_id % 2 AS label, value / 3 AS ttft_ms, value AS total_ms, event_id % 50 AS out_tokens, event_type <> 'error' AS ok FROM events),
t AS (SELECT *, (total_ms - ttft_ms) / greatest(1, out_tokens - 1) AS tpot_ms FROM r),
a AS (SELECT {by}, ttft_ms, row_number() OVER (PARTITION BY {by} ORDER BY ttft_ms) AS i, count(*) OVER (PARTITION BY {by}) AS n FROM t WHERE ok AND ttft_ms IS NOT NULL),
b AS (SELECT {by}, tpot_ms, row_number() OVER (PARTITION BY {by} ORDER BY tpot_ms) AS i, count(*) OVER (PARTITION BY {by}) AS n FROM t WHERE ok AND tpot_ms IS NOT NULL),
pa AS (SELECT {by}, max(ttft_ms) FILTER (i = least(n, floor(n * 0.5::DOUBLE) + 1)) AS ttft_p50, max(ttft_ms) FILTER (i = least(n, floor(n * 0.95::DOUBLE) + 1)) AS ttft_p95 FROM a GROUP BY {by}),
pb AS (SELECT {by}, max(tpot_ms) FILTER (i = least(n, floor(n * 0.5::DOUBLE) + 1)) AS tpot_p50, max(tpot_ms) FILTER (i = least(n, floor(n * 0.95::DOUBLE) + 1)) AS tpot_p95 FROM b GROUP BY {by}),
c AS (SELECT {by}, count(*) FILTER (ok) AS requests, count(*) FILTER (NOT ok) AS failed, sum(out_tokens) FILTER (ok) / 60.0::DOUBLE AS output_tok_s, count(*) FILTER (ok) / 60.0::DOUBLE AS req_per_s, 60.0::DOUBLE AS wall_s FROM t GROUP BY {by}),
lv AS (SELECT {by}, requests, failed, ttft_p50, ttft_p95, tpot_p50, tpot_p95, output_tok_s, req_per_s, wall_s FROM c LEFT JOIN pa USING ({by}) LEFT JOIN pb USING ({by}))"""


@query(f"WITH {_levels_sql('level')} SELECT * FROM lv")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return loadtest.levels(_requests(spark, d), ["level"])


@query(f"WITH {_levels_sql('level, label')}, p AS (SELECT label, max(coalesce(output_tok_s, 0)) AS peak FROM lv GROUP BY label) SELECT a.peak AS peak_before, b.peak AS peak_after, (b.peak / a.peak - 1) * 100 AS gain FROM p a, p b WHERE a.label = 0 AND b.label = 1")
def peak_compare(spark: SparkSession, d: str) -> DataFrame:
    return loadtest.gain(loadtest.levels(_requests(spark, d), ["level", "label"]), "0", "1")


@query("SELECT c_custkey, greatest(c_custkey * 3, 12) AS requests, CASE WHEN c_custkey >= 1000 THEN printf('%.1f', c_custkey / 1000) || 'k' ELSE CAST(c_custkey AS VARCHAR) END AS short_name FROM customer")
def request_counts(spark: SparkSession, d: str) -> DataFrame:
    """Requests of levels, and counts as shown."""
    return table(spark, d, "customer").select("c_custkey", loadtest.requests_at(F.col("c_custkey")).alias("requests"), short_count(F.col("c_custkey")).alias("short_name"))


@query("""SELECT o_orderkey, CASE WHEN v > 0 THEN ceil(v / power(10.0::DOUBLE, floor(log10(v)))) * power(10.0::DOUBLE, floor(log10(v))) ELSE 0 END AS axis_end FROM (SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) + 0.5::DOUBLE AS v FROM orders)""")
def axis_ends(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", nice_max(F.col("o_orderkey").cast("double") + 0.5).alias("axis_end"))


@query("SELECT i, p_partkey FROM (SELECT generate_series AS i FROM generate_series(0, 99999)) JOIN part ON i % (SELECT count(*) FROM part) = p_partkey")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    """A hundred thousand requests over all prompts in turn."""
    prompts = table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("ord"))
    return sampling.round_robin(prompts, 100_000).select("i", "p_partkey")


@query("SELECT source, avg(length(question)) AS mean_chars FROM samples GROUP BY source")
def mean_prompt_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples").groupBy("source").agg(F.avg(F.length("question")).alias("mean_chars"))


# ---- packed fields ----------------------------------------------------------------------------


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return multivalue.explode_values(spread(table(spark, d, "cmexam_raw")))
