"""Queries of the llm problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewake.llm import credentials, formdups, leakage, mixing, pii, splitting
from tracewake.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "analysis_tasks"), keep_small=False).where("piece_no = 0").selectExpr("id AS task_id")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "analysis_tasks"))


def p2_pieces_joined(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each item give together: their number and size are within bounds, and the text is the item's."""
    out = splitting.joined(p2_pieces(spark, d))
    return out.select("id", (F.col("longest") <= splitting.LIMIT).alias("within"), (F.col("n_pieces") > 1).alias("cut"), "digest")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return formdups.same_pairs(table(spark, d, "analysis_tasks"))


def p3_membership(spark: SparkSession, d: str) -> DataFrame:
    return formdups.membership(table(spark, d, "analysis_tasks")).select("id", "record_id")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return formdups.distinct_records(table(spark, d, "analysis_tasks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "analysis_tasks")
    return credentials.credential_lines(tasks, credentials.fit(tasks))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "analysis_tasks")
    return credentials.redacted(tasks, credentials.fit(tasks))


def p6_redacted_back(spark: SparkSession, d: str) -> DataFrame:
    """The digest of each diff after its changed lines are put back."""
    tasks = table(spark, d, "analysis_tasks")
    out = credentials.redacted(tasks, credentials.fit(tasks))
    return out.where("redacted IS NOT NULL").select("task_id", F.sha2(credentials.put_back(F.col("redacted"), F.col("changed")), 256).alias("digest"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).where(F.col("run_tokens") >= leakage.MIN_RUN).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_chosen(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mixture(table(spark, d, "documents"), targets), targets)


def p8_shares_kept(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.kept(mixing.mixture(table(spark, d, "documents"), targets), targets)


_KEY = b"a key of the caller"


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.replacements(table(spark, d, "documents"), table(spark, d, "name_lexicon"), _KEY).select("doc_id", "kind", "value")


def p9_redacted_back(spark: SparkSession, d: str) -> DataFrame:
    """The digest of each text after its values are put back for the placeholders, in order; equal to that of the text."""
    out = pii.redacted(table(spark, d, "documents"), table(spark, d, "name_lexicon"))
    return out.select("doc_id", F.sha2(pii.put_back(F.col("redacted"), F.col("values")), 256).alias("digest"))


def p9_surrogates_back(spark: SparkSession, d: str) -> DataFrame:
    """The digest of each text after its values are put back for the surrogates, and how many surrogates equal their value."""
    out = pii.with_surrogates(table(spark, d, "documents"), table(spark, d, "name_lexicon"), _KEY)
    same = F.size(F.filter("replaced", lambda x: x["value"] == x["surrogate"])).cast("long")
    return out.select("doc_id", F.sha2(pii.swapped_back(F.col("text"), F.col("replaced")), 256).alias("digest"), same.alias("unchanged"))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "documents"), table(spark, d, "name_lexicon"))


def p9_surrogates(spark: SparkSession, d: str) -> DataFrame:
    return pii.with_surrogates(table(spark, d, "documents"), table(spark, d, "name_lexicon"), _KEY)


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p2_pieces_joined, p3_found, p3_membership, p3_records, p6_found, p6_redacted, p6_redacted_back, p7_found, p7_leaks, p8_chosen, p8_shares, p8_shares_kept, p9_found, p9_redacted, p9_redacted_back, p9_surrogates, p9_surrogates_back)}

_FOLD = "replace(translate(lower({x}), 'ſς', 'sσ'), 'ß', 'ss')"
_BARE = r"regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', '', 'g')"
_RECORDS = (
    r"""
WITH t AS (SELECT id, coalesce(input_diff, '') AS d, coalesce(input_desc, '') AS x FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at) AS r FROM analysis_tasks WHERE id IS NOT NULL) WHERE r = 1),
  f AS (SELECT id, x, string_split(chr(10) || FOLD_D, chr(10) || 'diff --git') AS s,
          list_filter(regexp_split_to_array(FOLD_X, '[;；|｜\r\n]+'), lambda p: regexp_matches(p, '\S')) AS p,
          CASE WHEN regexp_matches(x, '^\s*\{') AND json_valid(x) THEN x::JSON END AS j FROM t),
  k AS (SELECT id, BARE_HEAD || array_to_string(list_sort(list_transform(s[2:], lambda y: 'diffgit' || BARE_Y)), '') AS dk,
          CASE WHEN json_type(j) = 'OBJECT' AND len(json_keys(j)) > 0 THEN array_to_string(list_sort(list_transform(json_keys(j), lambda y: BARE_FIELD)), '')
               WHEN len(p) > 1 AND len(list_filter(p, lambda y: regexp_matches(y, '^\s*\p{L}[\p{L}\p{N}_ ./()-]{0,40}\s*[:：]'))) = len(p) THEN array_to_string(list_sort(list_transform(p, lambda y: BARE_Y)), '')
               ELSE BARE_X END AS xk FROM f)
""".replace("FOLD_D", _FOLD.format(x="d"))
    .replace("FOLD_X", _FOLD.format(x="x"))
    .replace("BARE_HEAD", _BARE.format(x="s[1]"))
    .replace("BARE_FIELD", _BARE.format(x=_FOLD.format(x="y || coalesce(json_extract_string(j, '$.\"' || y || '\"'), '')")))
    .replace("BARE_Y", _BARE.format(x="y"))
    .replace("BARE_X", _BARE.format(x=_FOLD.format(x="x")))
)
_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9ß-öø-ɏ]+|[㐀-䶿一-鿿豈-﫿]')"
_GRAMS = "SELECT DISTINCT {i}, array_to_string(w[n : n + 19], ' ') AS g FROM (SELECT {i}, w, unnest(range(1, len(w) - 18)) AS n FROM (SELECT {i}, " + _TOKENS + " AS w FROM {t} WHERE text IS NOT NULL AND {i} IS NOT NULL))"
_SOURCE = "regexp_replace(lower(trim(source)), '[\\s_]+', '-', 'g')"

SQL = {
    "p2_found": "SELECT DISTINCT id AS task_id FROM analysis_tasks WHERE id IS NOT NULL AND strlen(input_diff) > 6000",
    "p2_pieces_joined": "SELECT id, true AS \"within\", strlen(input_diff) > 6000 AS cut, sha256(input_diff) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at) AS r FROM analysis_tasks WHERE id IS NOT NULL AND input_diff IS NOT NULL) WHERE r = 1",
    "p3_membership": f"{_RECORDS} SELECT k.id, m.record_id FROM k JOIN (SELECT dk, xk, min(id) AS record_id FROM k GROUP BY dk, xk HAVING count(*) > 1) m ON k.dk = m.dk AND k.xk = m.xk",
    "p3_found": f"{_RECORDS} SELECT a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.dk = b.dk AND a.xk = b.xk AND a.id < b.id",
    "p3_records": f"{_RECORDS} SELECT min(id) AS record_id, count(*) AS copies FROM k GROUP BY dk, xk",
    "p6_redacted_back": "SELECT id AS task_id, sha256(input_diff) AS digest FROM (SELECT id, arg_min(struct_pack(d := input_diff), loaded_at).d AS input_diff FROM analysis_tasks WHERE id IS NOT NULL GROUP BY id) WHERE input_diff IS NOT NULL",
    "p8_shares_kept": f"SELECT {_SOURCE} AS source, true AS share_kept, true AS cap_kept, {_SOURCE} IN (SELECT {_SOURCE} FROM documents WHERE text <> '' AND source IS NOT NULL) AS used FROM mix_targets GROUP BY 1, 4",
    "p9_redacted_back": "SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id IS NOT NULL",
    "p9_surrogates_back": "SELECT doc_id, sha256(text) AS digest, 0::BIGINT AS unchanged FROM documents WHERE doc_id IS NOT NULL",
    "p7_found": f"SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.format(i='doc_id', t='documents')}) d JOIN ({_GRAMS.format(i='item_id', t='eval_items')}) i USING (g)",
}
