"""Registered queries of the corpus operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbrook.llm import frequent, leaks, mixing, percentiles, repetition
from plumbrook.sources.folder import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# 1. Most frequent items

SHARE = 0.005
TOP = 100


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    records = frequent.value_runs(table(spark, folder, "dq_record"), ["item_id", "customer_id"])
    return records.unionByName(frequent.count_runs(frequent.once_per_partition(table(spark, folder, "dp_item"))))


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return frequent.items_above(_runs(spark, folder), SHARE).select("column_name", "item")


@query
def p1_top_items(spark: SparkSession, folder: str) -> DataFrame:
    return frequent.top_items(_runs(spark, folder), TOP)


_ITEMS = """
WITH once AS (SELECT load_id, partition_no, column_name, item, MAX(item_count) AS item_count FROM dp_item GROUP BY ALL),
v AS (SELECT 'item_id' AS column_name, item_id AS item, 1 AS n FROM dq_record
  UNION ALL SELECT 'customer_id', customer_id, 1 FROM dq_record
  UNION ALL SELECT column_name, item, COALESCE(item_count, 0) FROM once WHERE column_name IS NOT NULL),
c AS (SELECT column_name, item, CAST(SUM(n) AS BIGINT) AS item_count FROM v WHERE trim(item, ' ') <> '' GROUP BY ALL),
t AS (SELECT *, CAST(SUM(item_count) OVER (PARTITION BY column_name) AS BIGINT) AS column_total,
  CAST(ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY item_count DESC, item) AS INTEGER) AS rank_no FROM c)
"""
SQL["p1_found"] = f"{_ITEMS} SELECT column_name, item FROM t WHERE item_count >= {SHARE} * column_total"
SQL["p1_top_items"] = f"{_ITEMS} SELECT column_name, rank_no, item, item_count, column_total FROM t WHERE rank_no <= {TOP}"


# 4. Percentiles

TOLERANCE = 0.25


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    records, accepted = table(spark, folder, "dq_record"), table(spark, folder, "dp_quantile")
    off = percentiles.deviations(records, "measure", ["group_code"], accepted, TOLERANCE)
    return off.select("group_code", "pct").distinct()


@query
def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """All accepted percentiles beside the present ones, from the states of the loads' days added up."""
    records = table(spark, folder, "dq_record").withColumn("day", F.to_date("updated_at"))
    days = percentiles.bucket_counts(records, "measure", ["day", "group_code"])
    states = percentiles.merge_counts(days, ["group_code"])
    found = percentiles.percentiles(states, ["group_code"], table(spark, folder, "dp_quantile"))
    return found.withColumn("estimate", F.round("estimate", 6))


_RANKED = """
WITH v AS (SELECT group_code, measure AS v FROM dq_record WHERE measure IS NOT NULL AND NOT isnan(measure)),
r AS (SELECT group_code, v, ROW_NUMBER() OVER (PARTITION BY group_code ORDER BY v) AS k, COUNT(*) OVER (PARTITION BY group_code) AS n FROM v)
"""
SQL["p4_found"] = f"""{_RANKED}
SELECT DISTINCT q.group_code, q.pct FROM dp_quantile q JOIN r ON r.group_code IS NOT DISTINCT FROM q.group_code
  AND r.k = GREATEST(1, (q.pct * r.n + 99) // 100)
WHERE abs(r.v - q.accepted_value) > {TOLERANCE} * abs(q.accepted_value)"""


# 6. Evaluation texts in training text


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


@query
def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every test item with the number of documents that hold it."""
    items = table(spark, folder, "eval_item")
    found = leaks.leaks(table(spark, folder, "documents"), items).groupBy("eval_id").agg(F.count(F.lit(1)).alias("documents"))
    return items.join(found, "eval_id", "left").select("eval_id", "suite_name", F.coalesce("documents", F.lit(0)).alias("documents"))


# 7. Mixing sources to target weights


def _counted(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents, written once: both the plan and the mix use them."""
    return written(mixing.token_counts(table(spark, folder, "documents")), "tokens")


@query
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "mix_target")
    planned = mixing.plan(mixing.token_counts(table(spark, folder, "documents")), targets)
    short = planned.where("falls_short").select(F.col("source").alias("name"))
    return targets.join(short, mixing.plain(F.col("source")) == F.col("name"), "left_semi").select("source").distinct()


@query
def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix with the number of times each is used."""
    counted = _counted(spark, folder)
    return mixing.mix(counted, mixing.plan(counted, table(spark, folder, "mix_target")))


@query
def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source."""
    counted = _counted(spark, folder)
    planned = mixing.plan(counted, table(spark, folder, "mix_target"))
    return mixing.actual_shares(mixing.mix(counted, planned), planned)


@query
def p7_plan(spark: SparkSession, folder: str) -> DataFrame:
    """The plan of the mix where size is in characters."""
    planned = mixing.plan(mixing.character_counts(table(spark, folder, "documents")), table(spark, folder, "mix_target"))
    return planned.select("source", "documents", F.col("tokens").alias("characters"), "falls_short", (F.col("clamped_in").isNotNull()).alias("is_clamped"), F.round("repetitions", 6).alias("repetitions"))


_SIZES = """
WITH d AS (SELECT lower(trim(source, ' ')) AS source, COALESCE(length(text), 0) AS size FROM documents WHERE trim(source, ' ') <> ''),
s AS (SELECT source, COUNT(*) AS documents, SUM(size) AS size FROM d GROUP BY 1),
m AS (SELECT lower(trim(source, ' ')) AS source, SUM(COALESCE(target_share, 0)) AS w, MAX(COALESCE(max_repeats, 0)) AS cap FROM mix_target WHERE trim(source, ' ') <> '' GROUP BY 1),
t AS (SELECT SUM(size) AS total FROM d),
r AS (SELECT m.*, COALESCE(documents, 0) AS documents, COALESCE(size, 0) AS size, cap * COALESCE(size, 0) AS room FROM m LEFT JOIN s USING (source)),
-- In the order of room per share a first part is clamped; the level of the rest is what is left per share.
o AS (SELECT *, room / w AS ratio, COALESCE(SUM(room) OVER before, 0) AS taken, 1 - COALESCE(SUM(w) OVER before, 0) AS open_share FROM r WHERE w > 0
  WINDOW before AS (ORDER BY room / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT arg_min((total - taken) / open_share, taken) AS level FROM o, t WHERE ratio >= (total - taken) / open_share)
"""
SQL["p7_plan"] = f"""{_SIZES}
SELECT r.source, CAST(documents AS BIGINT) AS documents, CAST(size AS BIGINT) AS characters, w > 0 AND room < w * total AS falls_short,
  w > 0 AND (level IS NULL OR room / w < level) AS is_clamped,
  round(CASE WHEN size = 0 OR w <= 0 THEN 0 ELSE LEAST(CASE WHEN level IS NULL OR room / w < level THEN room ELSE level * w END / size, cap) END, 6) AS repetitions
FROM r, t, lvl"""

# Characters stand in for tokens here: the cases do not depend on the tokenizer, as their margins are wide.
SQL["p7_found"] = """
WITH d AS (SELECT lower(trim(source, ' ')) AS name, COALESCE(length(text), 0) AS size FROM documents WHERE trim(source, ' ') <> ''),
s AS (SELECT name, SUM(size) AS size FROM d GROUP BY 1), t AS (SELECT SUM(size) AS total FROM d)
SELECT DISTINCT m.source FROM mix_target m LEFT JOIN s ON s.name = lower(trim(m.source, ' ')), t WHERE m.max_repeats * COALESCE(s.size, 0) < m.target_share * t.total"""


# 8. Repetition inside a document


def _decided(spark: SparkSession, folder: str) -> DataFrame:
    measured = written(repetition.measures(table(spark, folder, "documents")), "measures")
    scored = repetition.strata(measured)
    return repetition.rejected(scored, repetition.sure_cutoffs(scored.where("is_held_out")))


@query
def p8_method(spark: SparkSession, folder: str) -> DataFrame:
    """Documents under risk-controlled cutoffs on repeated sentences and paragraphs, learnt from held out ones."""
    return _decided(spark, folder).drop("good")


@query
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.measures(table(spark, folder, "documents"), parts=False).where(repetition.is_repetitive()).select("doc_id")


@query
def p8_risks(spark: SparkSession, folder: str) -> DataFrame:
    """What the cutoffs do to the documents that were not held out, per stratum."""
    return repetition.risks(_decided(spark, folder))


@query
def p8_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words and repeated words of every document."""
    return repetition.measures(table(spark, folder, "documents"), parts=False).select("doc_id", "word_count", "repeated_words")


@query
def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of repeated words, sentences and paragraphs of every document."""
    measured = repetition.measures(table(spark, folder, "documents"))
    share = F.coalesce(F.col("repeated_words") / F.nullif(F.col("word_count"), F.lit(0)), F.lit(0.0))
    return measured.select("doc_id", "word_count", share.alias("repeated_share"), "repeated_sentences", "repeated_paragraphs")


_RUNS = """
WITH d AS (SELECT doc_id, regexp_extract_all(nfc_normalize(lower(regexp_replace(regexp_replace(COALESCE(text, ''), '\\p{Cf}', '', 'g'), '<[^<>]{0,40}>', ' ', 'g'))), '[\\p{L}\\p{N}]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM d),
g AS (SELECT doc_id, k, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS run FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
again AS (SELECT doc_id, k FROM (SELECT *, MIN(k) OVER (PARTITION BY doc_id, run) AS first FROM g WHERE run IS NOT NULL) WHERE k > first),
marked AS (SELECT DISTINCT doc_id, k + j AS k FROM again, range(5) x(j)),
n AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS word_count, (SELECT COUNT(*) FROM marked m WHERE m.doc_id = d.doc_id) AS repeated_words FROM d)
"""
# All compatibility characters of the corpus are beside words, so that NFC gives the words of NFKC here.
SQL["p8_words"] = f"{_RUNS} SELECT doc_id, word_count, repeated_words FROM n"
SQL["p8_found"] = f"{_RUNS} SELECT doc_id FROM n WHERE word_count > 0 AND repeated_words * 10 >= word_count * 3"

_BLANK = "[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]"


def _parts(cut: str) -> str:
    """The share of characters in parts that stood earlier; character 1 stands between parts."""
    key = f"trim(regexp_replace(lower(part), '{_BLANK}+', ' ', 'g'), ' ')"
    return (
        f"SELECT doc_id, SUM(CASE WHEN k > first THEN length(key) ELSE 0 END) / NULLIF(SUM(length(key)), 0) AS share FROM (SELECT *, MIN(k) OVER (PARTITION BY doc_id, key) AS first FROM "
        f"(SELECT doc_id, k, {key} AS key FROM (SELECT doc_id, unnest(string_split({cut}, chr(1))) AS part, generate_subscripts(string_split({cut}, chr(1)), 1) AS k FROM documents))) GROUP BY doc_id"
    )


SQL["p8_shares"] = f"""{_RUNS},
sentences AS ({_parts(f"regexp_replace(regexp_replace(text, '([.!?…]){_BLANK}+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g')")}),
paragraphs AS ({_parts(f"regexp_replace(text, '\\n{_BLANK}*\\n', chr(1), 'g')")})
SELECT n.doc_id, word_count, CASE WHEN word_count = 0 THEN 0 ELSE repeated_words / word_count END AS repeated_share, COALESCE(s.share, 0) AS repeated_sentences, COALESCE(p.share, 0) AS repeated_paragraphs
FROM n LEFT JOIN sentences s USING (doc_id) LEFT JOIN paragraphs p USING (doc_id)"""

_STEP, _OFFSET = percentiles._scale(percentiles.ACCURACY)
SQL["p4_percentiles"] = f"""{_RANKED},
x AS (SELECT q.*, r.n AS group_count, r.v FROM dp_quantile q JOIN r ON r.group_code IS NOT DISTINCT FROM q.group_code AND r.k = GREATEST(1, (q.pct * r.n + 99) // 100)),
b AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE sign(v) * (ceil(ln(abs(v)) / {_STEP!r}) + {_OFFSET}) END AS s FROM x)
SELECT group_code, pct, accepted_value, group_count, CAST(s AS INTEGER) AS bucket,
  round(CASE WHEN s = 0 THEN 0 ELSE sign(s) * exp((abs(s) - {_OFFSET}) * {_STEP!r}) * {1 - percentiles.ACCURACY!r} END, 6) AS estimate FROM b"""

_LEAKS = """
WITH words AS (SELECT FALSE AS is_item, doc_id AS id, text FROM documents UNION ALL SELECT TRUE, eval_id, item_text FROM eval_item),
cut AS (SELECT DISTINCT is_item, id, regexp_extract_all(nfc_normalize(lower(regexp_replace(regexp_replace(COALESCE(text, ''), '\\p{Cf}', '', 'g'), '<[^<>]{0,40}>', ' ', 'g'))), '[\\p{L}\\p{N}]+') AS w FROM words),
item AS (SELECT id AS eval_id, w, len(w) AS n, LEAST(12, len(w)) AS size FROM cut WHERE is_item AND len(w) > 0), doc AS (SELECT id AS doc_id, w, len(w) AS n FROM cut WHERE NOT is_item AND len(w) > 0),
ig AS (SELECT DISTINCT eval_id, size, array_to_string(w[i : i + size - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, n - size + 2)) AS i FROM item)),
dg AS (SELECT DISTINCT doc_id, size, array_to_string(w[i : i + size - 1], ' ') AS gram FROM (SELECT doc_id, w, size, unnest(range(1, n - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM item) z WHERE n >= size)),
whole AS (SELECT DISTINCT doc_id, eval_id FROM ig JOIN dg USING (size, gram)),
-- Long items with enough words in a document; then the longest common subsequence with every stretch, by bit vectors.
iw AS (SELECT eval_id, n, word, COUNT(*) AS c, SUM(CAST(1 AS HUGEINT) << CAST(k - 1 AS HUGEINT)) AS mask FROM (SELECT eval_id, n, unnest(w) AS word, unnest(range(1, n + 1)) AS k FROM item WHERE n >= 20) GROUP BY ALL),
dw AS (SELECT doc_id, word, k FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, n + 1)) AS k FROM doc)),
cand AS (SELECT doc_id, eval_id, n FROM (SELECT DISTINCT doc_id, word FROM dw) JOIN iw USING (word) GROUP BY ALL HAVING SUM(c) * 10 >= n * 7),
hit AS (SELECT c.doc_id, c.eval_id, c.n, dw.k, iw.mask FROM cand c JOIN dw USING (doc_id) JOIN iw ON iw.eval_id = c.eval_id AND iw.word = dw.word),
stretch AS (SELECT a.doc_id, a.eval_id, a.n, a.k, list(b.mask ORDER BY b.k) AS masks FROM hit a JOIN hit b ON b.doc_id = a.doc_id AND b.eval_id = a.eval_id AND b.k BETWEEN a.k AND a.k + a.n * 3 // 2 - 1 GROUP BY ALL HAVING COUNT(*) * 10 >= a.n * 7),
held AS (SELECT doc_id, eval_id, n, list_reduce(list_prepend((CAST(1 AS HUGEINT) << CAST(n AS HUGEINT)) - 1, masks), lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((CAST(1 AS HUGEINT) << CAST(n AS HUGEINT)) - 1)) AS v FROM stretch)
SELECT doc_id, eval_id FROM whole UNION SELECT doc_id, eval_id FROM held WHERE (n - bit_count(v)) * 10 >= n * 7"""
SQL["p6_found"] = _LEAKS
SQL["p6_items"] = f"SELECT e.eval_id, e.suite_name, COUNT(f.doc_id) AS documents FROM eval_item e LEFT JOIN ({_LEAKS}) f USING (eval_id) GROUP BY ALL"
