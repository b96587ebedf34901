"""One query for each operator over its whole table, and SQL where SQL can express the result."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policyloom.llm.ann import nearest_neighbours
from policyloom.llm.audit import audit_filters, document_failures
from policyloom.llm.dialogue import damage, repair_conversations
from policyloom.llm.licenses import TEMPLATES, LicenseSettings, scan_licenses
from policyloom.llm.minhash import NearSettings, near_duplicates
from policyloom.llm.mixing import mix_sources, sized_rows, words_taken
from policyloom.llm.packing import pack
from policyloom.llm.quality import quality
from policyloom.llm.substrings import dedup_substrings
from policyloom.llm.suffixes import dedup_suffixes
from policyloom.llm.tokens import read_token_shards, scratch_folder, write_token_shards
from policyloom.llm.urls import Rule, Vocabulary, url_verdict
from policyloom.llm.warc import read_archives, write_archives

URL_RULES = (
    Rule("com/", "allow"), Rule("example.com/en/", "block"), Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"), Rule("net/fr/", "block"),
)
_VOCABULARY = Vocabulary()


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the notices of its SQL, which has none of fewer than five words
    return scan_licenses(_read(spark, sf_dir, "documents"), TEMPLATES)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), NearSettings(words=3, percent=85))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_token_shards(
        _read(spark, sf_dir, "documents"), scratch_folder(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json")
    )
    return read_token_shards(shards)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_suffixes(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    judged = pages.select("page_id", url_verdict(F.col("url"), URL_RULES, _VOCABULARY).alias("v"))
    return judged.select("page_id", "v.host", "v.path", "v.rule", "v.verdict", "v.strict_hits", "v.soft_hits")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", quality(F.col("text")).alias("q")).select("doc_id", "q.*")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(sized_rows(_read(spark, sf_dir, "documents")))
    return words_taken(mix).select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each conversation before damage, a null one included; counts of none left are zeros."""
    rows = _read(spark, sf_dir, "conversations")
    repair = repair_conversations(damage(rows))
    every = rows.groupBy("conv_id").agg(F.lit(0).alias("zero"))
    counts, hashes = repair.summary().withColumnRenamed("conv_id", "c"), repair.hashes().withColumnRenamed("conv_id", "h")
    found = every.join(counts, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("h")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        "conv_id", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of the five filters over all documents; see ``document_failures`` for nulls and ties."""
    return audit_filters(document_failures(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back; ``write_archives`` says what holds for nulls and repeated rows."""
    records = read_archives(write_archives(_read(spark, sf_dir, "pages"), scratch_folder(spark, "warc")), payloads=False)

    def page(record: str) -> Column:
        return F.nullif(F.regexp_extract(record, "^<urn:row:([^:]*):", 1), F.lit("")).cast("long")

    return records.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )


QUERIES = {
    query.__name__: query
    for query in (
        op1_license_scans, op2_near_duplicates, op3_token_files, op4_substring_dedup, op5_packing, op6_suffix_dedup,
        op7_url_filters, op8_quality_rules, op9_source_mix, op10_nearest_neighbours, op11_conversation_repair, op12_filter_audit, op13_warc,
    )
}


def _quoted(term: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in term)


def _hits(terms: tuple[str, ...]) -> str:
    """How many of the terms an address holds at word boundaries."""
    one = "regexp_matches(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^0-9A-Za-z]){}($|[^0-9A-Za-z])')"
    return " + ".join(f"CAST({one.format(_quoted(t))} AS BIGINT)" for t in terms)


_RULES_SQL = ", ".join(f"('{r.rule}', '{r.rule.partition('/')[0]}', '/{r.rule.partition('/')[2]}', '{r.verdict}')" for r in URL_RULES)
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _notices() -> str:
    """Rows (license, template, number of shingles, shingle) of all notices."""
    width, rows = LicenseSettings().words, []
    for name, texts in TEMPLATES.items():
        for k, text in enumerate(texts):
            words = re.findall("[0-9a-z\x80-\U0010ffff]+", text.lower())
            shingles = {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}
            rows += [f"('{name}', {k}, {len(shingles)}, '{s}')" for s in sorted(shingles)]
    return ", ".join(rows)


ORACLE = {
    "op1_license_scans": rf"""
WITH notices(license, template, n_shingles, s) AS (VALUES {_notices()}),
w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
sh AS (SELECT doc_id, i - 1 AS place, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w))
SELECT doc_id, license, template, count(DISTINCT s) AS n_matched, n_shingles::BIGINT AS n_shingles, min(place) AS first_word
FROM sh JOIN notices USING (s) GROUP BY doc_id, license, template, n_shingles
HAVING 100 * count(DISTINCT s) >= {LicenseSettings().percent} * n_shingles
""",
    "op2_near_duplicates": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id <= coalesce(y, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least_of ON x = doc_id
""",
    "op4_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
windows AS (SELECT doc_id, s, array_to_string(ws[s : s + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w)),
later AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op7_url_filters": f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, {_hits(_VOCABULARY.strict)} AS strict_hits, {_hits(_VOCABULARY.soft)} AS soft_hits,
    translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rule, rule_host, rule_path, verdict) AS (VALUES {_RULES_SQL}),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rules.verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT p.page_id, host, path, rule,
  coalesce(f.verdict, CASE WHEN strict_hits > 0 OR soft_hits >= {_VOCABULARY.soft_hits} THEN 'block' ELSE 'allow' END) AS verdict,
  strict_hits, soft_hits
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id
""",
    "op12_filter_audit": rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, {_WORDS.format("t")} AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (
  SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(least < doc_id, false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, mask),
x(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a
  JOIN x b ON b.c <> a.c JOIN x c ON c.c NOT IN (a.c, b.c) JOIN x d ON d.c NOT IN (a.c, b.c, c.c) JOIN x e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
steps AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS prior FROM orders, range(1, 6) r(step)),
counted AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (prior | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & prior = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & prior > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & prior = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & prior = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM m, steps GROUP BY part, filter_order, step, bit, prior)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
""",
    "op13_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
d AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(x, 5 * i::INT + 1, 5))::INT) AS v FROM s)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(v, lambda y: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((y >> k) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d
""",
}
