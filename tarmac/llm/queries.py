"""The thirteen operators over their whole tables, as queries, and the SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import (
    bpe_codec, collocations, decontaminate, exact_dedup, jaccard_join, line_dedup, packing, quality_rules, rule_ensemble, spelling, substring_dedup, token_counts, token_files,
)
from tarmac.llm.workspace import Workspace, read_table


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; the folder is the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


WORDS, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = read_table(spark, sf_dir, "documents"), Workspace(spark, "op1")
    rules = quality_rules.learn_rules(quality_rules.labelled_sample(docs, read_table(spark, sf_dir, "labels")), ws)
    return quality_rules.judge(docs, rules)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.substring_dedup(docs, Workspace(spark, "op2"))
    return out.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = read_table(spark, sf_dir, "documents"), Workspace(spark, "op3")
    ensemble = rule_ensemble.learn(rule_ensemble.training_rows(docs, read_table(spark, sf_dir, "labels")), ws)
    return rule_ensemble.classify(docs, ensemble)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), vocabulary(PIECES))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"), Workspace(spark, "op5"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_decode(read_table(spark, sf_dir, "documents"), vocabulary(WORDS))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "op7")
    manifest = token_files.write_token_files(read_table(spark, sf_dir, "documents"), vocabulary(WORDS), ws.path("files"), ws)
    return token_files.read_token_files(manifest, ws.path("files"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.line_dedup(docs, Workspace(spark, "op8"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary(WORDS), Workspace(spark, "op9")).drop("ids")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"), Workspace(spark, "op10"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"), Workspace(spark, "op11"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(read_table(spark, sf_dir, "documents"), Workspace(spark, "op12"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"), Workspace(spark, "op13"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_substring_dedup, op3_quality_classifier, op4_token_counts, op5_jaccard_join,
        op6_bpe_codec, op7_token_files, op8_line_dedup, op9_packing, op10_exact_dedup, op11_decontaminate, op12_spelling_variants, op13_collocations,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_TOKEN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLE_SQL: dict[str, str] = {
    "op10_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM h WINDOW w AS (PARTITION BY text_sha256)""",
    # Every window of 35 words as text; words under a repeated one are taken out by their places.
    "op2_substring_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
        w AS (SELECT r, i, array_to_string(ws[i : i + 34], ' ') AS win FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM d WHERE len(ws) >= 35)),
        x AS (SELECT r, i FROM w WHERE win IN (SELECT win FROM w GROUP BY win HAVING count(*) > 1)),
        gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS i FROM x),
        p AS (SELECT r, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i FROM d),
        k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM p ANTI JOIN gone USING (r, i) GROUP BY r)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)""",
    # Every pair of sets with a shingle in common, counted in full.
    "op5_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS ws FROM documents),
        s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i : i + 4], ' ') for i in generate_series(1, len(ws) - 4)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM d),
        g AS (SELECT r, doc_id, len(sh) AS n, unnest(sh) AS g FROM s WHERE doc_id IS NOT NULL),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r, a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(least.b, s.doc_id)) AS component_id FROM s LEFT JOIN least ON least.a = s.doc_id""",
    # Every window of every item against every run of as many words.
    "op11_decontaminate": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_TOKEN}) AS ws FROM documents),
        it AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_TOKEN}) AS ws, least(len(ws), 10) AS m FROM benchmark),
        win AS (SELECT DISTINCT item, m, array_to_string(ws[i : i + m - 1], ' ') AS g FROM (SELECT item, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM it WHERE m > 0)),
        spot AS (SELECT r, m, ws, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM win)),
        occ AS (SELECT DISTINCT r, i, m, item FROM (SELECT r, i, m, array_to_string(ws[i : i + m - 1], ' ') AS g FROM spot) JOIN win USING (m, g)),
        hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + m - 1)) AS p FROM occ) GROUP BY r),
        its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM occ WHERE item IS NOT NULL) GROUP BY r)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)""",
    # The checksum byte by byte from a table of 256; words one edit apart share what is left without one code point.
    "op12_spelling_variants": f"""
        WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, x: xor(c >> 1, 3988292384 * (c & 1)), CAST(b AS BIGINT))) AS t),
        runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
        sums AS (SELECT run, k, xor(4294967295, list_reduce(list_transform(range(octet_length(x)), lambda i: CAST(concat('0x', hex(x)[2 * i + 1 : 2 * i + 2]) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS h
                 FROM (SELECT run, k, encode(concat(doc_id, ':', run)) AS x FROM runs), t),
        words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN concat(left(run, CAST(h % length(run) AS INT)), substr(run, CAST(h % length(run) AS INT) + 2)) ELSE run END AS word, k FROM sums)
                  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
        less AS (SELECT word, n, i, concat(left(word, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words)),
        near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
                 UNION SELECT less.word, words.word, words.n FROM less JOIN words ON less.rest = words.word
                 UNION SELECT words.word, less.word, less.n FROM less JOIN words ON less.rest = words.word),
        best AS (SELECT word, count(*) AS n_near, max(near_n) AS top_n, arg_min(near, (-near_n, near)) AS top FROM near GROUP BY word),
        f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 2 * n THEN top END AS form, CASE WHEN top_n >= 2 * n THEN top_n END AS form_n FROM words LEFT JOIN best USING (word)),
        follow AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT follow.word, f.word, f.form FROM follow JOIN f ON f.word = follow.next)
        SELECT f.word, f.form, follow.at AS root, f.n, f.n_near, f.form_n FROM f JOIN follow USING (word) WHERE follow.next IS NULL""",
    # All phrases of two to five words, all their cuts, all their longer phrases.
    "op13_collocations": f"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
        f AS (SELECT lang, phrase, m, count(*) AS f FROM (
                  SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m)))
              GROUP BY ALL),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
        c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 100),
        cut AS (SELECT lang, phrase, a, k, array_to_string(ws[1 : k], ' ') AS first, array_to_string(ws[k + 1 :], ' ') AS rest FROM (SELECT lang, phrase, a, ws, unnest(generate_series(1, m - 1)) AS k FROM c)),
        s AS (SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, n, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
              FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.first JOIN f y ON y.lang = cut.lang AND y.phrase = cut.rest JOIN n ON n.lang = cut.lang),
        least AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inner_of AS (SELECT DISTINCT lang, array_to_string(ws[i : i + j - 1], ' ') AS phrase, a FROM (
                         SELECT lang, ws, a, j, unnest(generate_series(1, m - j + 1)) AS i FROM (SELECT lang, ws, a, m, unnest(generate_series(2, m - 1)) AS j FROM c))),
        kept AS (SELECT * FROM least l WHERE NOT EXISTS (SELECT 1 FROM inner_of o WHERE o.lang = l.lang AND o.phrase = l.phrase AND 100 * o.a >= 100 * l.a))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= 2000""",
}
