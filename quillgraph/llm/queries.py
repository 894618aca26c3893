"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.common import documents


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.bpe_transducer import encode_decode

    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.token_planes import read_shards, write_shards

    return read_shards(write_shards(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op9_window_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.window_doubling import remove_repeats

    return remove_repeats(documents(spark, sf_dir))


def op10_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.golay_simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_labellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.pii_labellers import personal_data

    return personal_data(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.quality_rules import quality

    return quality(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op4_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.weak_labels import weak_quality

    return weak_quality(documents(spark, sf_dir))


def op6_secret_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.secret_index import secrets

    return secrets(documents(spark, sf_dir))


def op7_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.toxicity_trees import toxicity

    return toxicity(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op8_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.latent_decontamination import leaks

    return leaks(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 returns that SQL can say, too."""
    return op3_quality_rules(spark, sf_dir).drop("kept", "probability")


def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 returns that SQL can say, too."""
    return op1_pii_labellers(spark, sf_dir).drop("spans", "n_added")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 returns that SQL can say, too."""
    return op6_secret_index(spark, sf_dir).drop("spans", "n_added")


def queries() -> dict:
    operators = (op1_pii_labellers, op2_token_planes, op3_quality_rules, op4_weak_labels, op5_byte_bpe, op6_secret_index, op7_toxicity_trees, op8_latent_decontamination, op9_window_doubling, op10_golay_simhash)
    return {f.__name__: f for f in (*operators, base_quality, base_personal_data, base_secrets)}


_WORD = r"[^\x20\x09-\x0D]"
BASE_QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w FROM documents),
dup AS (SELECT r, sum(c - 1) AS n FROM (SELECT r, line, count(*) AS c FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY ALL) GROUP BY r),
win AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT r, k FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT win.r, unnest(range(i, i + 5)) AS p FROM win JOIN rep ON win.r = rep.r AND win.k = rep.k) GROUP BY r),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN dup USING (r) LEFT JOIN cov USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
"""


def _spans_sql(kinds: list[tuple[str, str, str]]) -> str:
    """Counts and digest of base spans: (kind, expression, what a match ``t`` (its second group ``g``) must pass)."""
    parts = []
    for k, (kind, pattern, test) in enumerate(kinds):
        p = pattern.replace("'", "''")
        group = f"regexp_extract_all(t, '{p}', 2)" if test == "length(g) >= 12" else "m"
        parts.append(f"""f{k} AS (SELECT r, m, {group} AS gs, string_split_regex(t, '{p}') AS gaps FROM (SELECT r, t, regexp_extract_all(t, '{p}') AS m FROM d)),
s{k} AS (SELECT * FROM (SELECT r, '{kind}' AS kind, {k} AS rank, m[i] AS t, gs[i] AS g, list_sum(list_transform(gaps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS a FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f{k})) WHERE {test})""")
    union = " UNION ALL ".join(f"SELECT r, kind, rank, a::BIGINT AS a, (a + length(t))::BIGINT AS e FROM s{k}" for k in range(len(kinds)))
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, *_ in kinds)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), {", ".join(parts)}, u AS ({union})
SELECT doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, rank) FILTER (kind IS NOT NULL), '')) AS base_sha256 FROM d LEFT JOIN u USING (r) GROUP BY r, doc_id"""


_DIGITS = "regexp_replace(t, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({_DIGITS}), i, 1)::INT WHEN substr(reverse({_DIGITS}), i, 1)::INT > 4 THEN 2 * substr(reverse({_DIGITS}), i, 1)::INT - 9 ELSE 2 * substr(reverse({_DIGITS}), i, 1)::INT END)) % 10 = 0"
BASE_PERSONAL_SQL = _spans_sql([
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "NOT list_contains(list_transform(string_split(t, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(left(ltrim(x, '0'), 3) AS INT), 0) > 255), true)"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
])
BASE_SECRETS_SQL = _spans_sql([
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(g) >= 12"),
    ("access", "AKIA[A-Z0-9]+", "length(t) >= 18"),
    ("hex", "[0-9a-f]+", "length(t) >= 16"),
])
OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (k) WHERE doc_id > m),
g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n, coalesce(len(ps), 0) AS r, CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p)), lambda p: w[p]) END AS ws FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(coalesce(array_to_string(ws, ' '), '')) AS kept_sha256 FROM kept
"""


def oracle_sql() -> dict[str, str]:
    """SQL has no XXH64, no tokenisers and no training: it can say all of op9, and the base
    columns of op1, op3 and op6.  The tests run all operators against slow versions."""
    return {"op9_window_doubling": OP9_SQL, "base_quality": BASE_QUALITY_SQL, "base_personal_data": BASE_PERSONAL_SQL, "base_secrets": BASE_SECRETS_SQL}
