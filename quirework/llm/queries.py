"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audit, bpe, language, lattice, lines, mixing, packing, phrases, pii, quality, secrets, simhash, template
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup(table(spark, sf_dir, "documents"))
    return done.select("_d.doc_id", "_lines.n_lines", "_lines.n_dropped",
                       F.sha2("_lines.kept", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.accepted(F.col("failures"), "base")).alias("base_failed"),
        quality.accepted(F.col("failures")).alias("kept"), "failures")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op4_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = template.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("_d.doc_id", "_d.source", F.col("_block").alias("block"),
                        F.col("_epoch").alias("epoch"), F.col("_slot").alias("slot"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def tokenizer() -> dict:
    """Files of the byte-level vocabulary; the same files are installed on every executor."""
    import public_tokenizers as P

    return {"path": P.path("byte_bpe_50k.json"), "ranks": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **tokenizer())


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_classes(table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(table(spark, sf_dir, "documents")))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenizer()
    coded = bpe.encode(table(spark, sf_dir, "documents"), files["path"], files["pattern"])
    digests = coded.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
                           F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return bpe.decode(digests, files["path"]).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit.interactions(audit.counts(rows))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_quality_rules, op3_secrets, op4_html_template, op5_mixing, op6_language, op7_simhash, op8_packing, op9_lattice, op10_pii,
    op11_bpe, op12_filter_audit, op13_collocations)}

SPACES_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORD_SQL = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op1_line_dedup": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines
              FROM documents),
each AS (SELECT r, i, lines[i] AS line,
                translate(trim(lines[i], {SPACES_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz') AS k
         FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs)),
many AS (SELECT k FROM each WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
done AS (SELECT r, count(*) AS n_lines, count(many.k) AS n_dropped,
                coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (many.k IS NULL), '') AS kept
         FROM each LEFT JOIN many USING (k) GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM done JOIN docs USING (r)
""",
    "op2_quality_rules": rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
                     regexp_extract_all(coalesce(text, ''), '{WORD_SQL}') AS w FROM documents),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
line AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM docs),
dup AS (SELECT r, count(*) AS n_lines,
               count(*) FILTER (has) - count(DISTINCT x) FILTER (has) AS n_dup_lines
        FROM (SELECT r, x, regexp_matches(x, '{WORD_SQL}') AS has FROM line) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             n_dup_lines, n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up,
             length(regexp_replace(t, '[^\pL]', '', 'g')) AS letters,
             (length(t) - length(replace(t, '!!', ''))) // 2 AS shouts
      FROM docs JOIN dup USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
        + (CASE WHEN n_repeat_words * 100 > n_words * 50 THEN 2 ELSE 0 END)
        + (CASE WHEN n_symbols * 100 > n_words * 25 THEN 4 ELSE 0 END)
        + (CASE WHEN n_dup_lines * 100 > n_lines * 50 THEN 8 ELSE 0 END)
        + (CASE WHEN up * 100 > letters * 50 THEN 16 ELSE 0 END)
        + (CASE WHEN shouts * 100 > n_words * 25 THEN 32 ELSE 0 END)
        + (CASE WHEN word_chars < n_words * 2 OR word_chars > n_words * 20 THEN 64 ELSE 0 END) AS failures
      FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures::BIGINT AS failures FROM f
""",
    "op12_filter_audit": rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                     regexp_extract_all(coalesce(text, ''), '{WORD_SQL}') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM docs GROUP BY t),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
rows_ AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
                  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
                  regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails
          FROM docs JOIN firsts USING (t) LEFT JOIN known USING (doc_id)),
masks AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM rows_ GROUP BY part, fails),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS i),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o
           FROM letter a, letter b, letter c, letter d, letter e
           WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT filter_order, o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
hits AS (SELECT part, filter_order, step, o[step] AS v, n, good, toxic, fails[o[step]] AS here,
                list_bool_or(list_transform(o[1:step - 1], lambda k: fails[k])) IS TRUE AS before,
                len(list_filter(fails, lambda f: f)) AS n_fails
         FROM steps, masks),
sums AS (SELECT part, filter_order, step, v,
                coalesce(sum(n) FILTER (NOT before AND NOT here), 0)::BIGINT AS kept,
                coalesce(sum(n) FILTER (NOT before AND here), 0)::BIGINT AS removed,
                coalesce(sum(n) FILTER (before AND here), 0)::BIGINT AS redundant,
                coalesce(sum(n) FILTER (here AND n_fails = 1), 0)::BIGINT AS unique_fails,
                coalesce(sum(good) FILTER (NOT before AND here), 0)::BIGINT AS good_lost,
                coalesce(sum(toxic) FILTER (NOT before AND here), 0)::BIGINT AS toxic_lost
         FROM hits GROUP BY part, filter_order, step, v)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, v))::BIGINT AS shapley FROM sums
""",
    "op13_collocations": r"""
WITH pieces AS (SELECT row_number() OVER () AS r, lang, piece FROM (
       SELECT coalesce(lang, 'und') AS lang,
              unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
words AS (SELECT r, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, w[i:i + m - 1] AS g FROM (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS m FROM spots)),
often AS (SELECT lang, g, count(*)::HUGEINT AS f FROM grams GROUP BY lang, g HAVING count(*) >= 100),
longer AS (SELECT DISTINCT c.lang, c.g FROM often c JOIN often b ON c.lang = b.lang AND len(b.g) = len(c.g) + 1
           AND (b.g[1:len(c.g)] = c.g OR b.g[2:] = c.g) AND 100 * b.f >= 100 * c.f),
cuts AS (SELECT lang, g, f, unnest(range(1, len(g))) AS k FROM often WHERE len(g) > 1),
rated AS (SELECT c.lang, c.g, c.f AS a, c.k, x.f AS l, y.f AS r, n, (1000 * c.f * n) // (x.f * y.f) AS score
          FROM cuts c JOIN often x ON x.lang = c.lang AND x.g = c.g[1:c.k]
          JOIN often y ON y.lang = c.lang AND y.g = c.g[c.k + 1:] JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM rated WHERE (lang, g) NOT IN (SELECT (lang, g) FROM longer)
         QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase FROM best)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked
QUALIFY rank <= 2000
""",
}
