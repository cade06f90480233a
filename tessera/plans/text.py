"""Line, text and file queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.lines import explode_lines, grade
from tessera.operators.ranking import rank_files
from tessera.plans.base import query, table

_LINES = """lines AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))"""
_COUNT = lambda pattern: f"(length(s) - length(regexp_replace(s, '{pattern}', '', 'g')))"
_LETTERS, _DIGITS, _SPACES, _ALNUM = _COUNT(r"\p{L}"), _COUNT(r"\p{Nd}"), _COUNT(r"\s"), _COUNT(r"[\p{L}\p{N}]")
_CONTROLS = _COUNT(r"\p{C}") + " - " + _COUNT(r"[\t\n\r]")
_QUALITY = rf"""{_LINES},
st AS (SELECT doc_id, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM lines),
f AS (SELECT *, length(s) AS n, {_LETTERS} AS letters, {_DIGITS} AS digits, {_SPACES} AS spaces, {_ALNUM} AS alnum, {_CONTROLS} AS controls,
  regexp_extract_all(s, '[\p{{L}}\p{{Nl}}\p{{No}}]{{2,}}') AS words, string_split(s, '') AS chars FROM st),
g AS (SELECT *, len(words) >= 3 AS a1, letters / n >= 0.25 AS a2, spaces / n >= 0.08 AS a3, coalesce(list_sum(list_transform(words, lambda w: length(w))) / len(words), 0) >= 3 AS a4,
  n <= 300 AND (regexp_matches(s, '^\s*[-*•]\s+\S+') OR regexp_matches(s, '^\s*#{{1,6}}\s+\S+') OR regexp_matches(s, '^\s*[A-Za-z0-9_#.\-$ ]{{2,80}}\s*[:=]\s*\S+') OR regexp_matches(s, '^\s*"?[A-Za-z0-9_#.\-$ ]+"?\s*:\s*') OR regexp_matches(s, '^\s*\S.*?\s{{2,}}\S.*$')) AS a5,
  digits / n >= 0.45 AS b1, (n - alnum - spaces) / n >= 0.45 AS b2, spaces / n < 0.02 AND n > 60 AS b3, regexp_matches(s, '\S{{80,}}') AS b4, regexp_matches(s, '^[0-9a-fA-F\s:,-]{{40,}}$') AS b5, regexp_matches(s, '^[A-Za-z0-9+/=_-]{{80,}}$') AND spaces = 0 AS b6,
  spaces / n < 0.05 AND list_sum(list_transform(list_distinct(chars), lambda c: -((n - length(replace(s, c, ''))) / n) * log2((n - length(replace(s, c, ''))) / n))) >= 4.5 AS b7,
  list_max(list_transform(range(1, greatest(n - 19, 2)), lambda i: CASE WHEN trim(substr(s, i, 1)) <> '' AND n >= 21 AND substr(s, i, 21) = repeat(substr(s, i, 1), 21) THEN 1 ELSE 0 END)) = 1 AS rep FROM f),
q AS (SELECT doc_id, line_no, CASE WHEN s = '' THEN 'empty' WHEN n < 2 THEN 'too_short' WHEN controls / n > 0.02 THEN 'many_control_chars' WHEN rep THEN 'repeated_char_noise'
  WHEN regexp_matches(s, '^\s*[-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?(?:[\s,;]+[-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?){{5,}}\s*$') THEN 'numeric_array' END AS early,
  least(1.0, greatest(0.0, CAST(0 AS DOUBLE) + CASE WHEN a1 THEN 0.35 ELSE 0 END + CASE WHEN a2 THEN 0.2 ELSE 0 END + CASE WHEN a3 THEN 0.15 ELSE 0 END + CASE WHEN a4 THEN 0.1 ELSE 0 END + CASE WHEN a5 THEN 0.7 ELSE 0 END
   - CASE WHEN b1 THEN 0.25 ELSE 0 END - CASE WHEN b2 THEN 0.25 ELSE 0 END - CASE WHEN b3 THEN 0.25 ELSE 0 END - CASE WHEN b4 THEN 0.3 ELSE 0 END - CASE WHEN b5 THEN 0.35 ELSE 0 END - CASE WHEN b6 THEN 0.3 ELSE 0 END - CASE WHEN b7 THEN 0.2 ELSE 0 END)) AS sc,
  concat_ws(', ', CASE WHEN a1 THEN 'has_words' END, CASE WHEN a2 THEN 'enough_letters' END, CASE WHEN a3 THEN 'has_spacing' END, CASE WHEN a4 THEN 'reasonable_word_length' END, CASE WHEN a5 THEN 'structured_text' END, CASE WHEN b1 THEN 'too_many_digits' END,
   CASE WHEN b2 THEN 'too_many_symbols' END, CASE WHEN b3 THEN 'dense_no_spaces' END, CASE WHEN b4 THEN 'long_dense_token' END, CASE WHEN b5 THEN 'hex_like' END, CASE WHEN b6 THEN 'base64_like' END, CASE WHEN b7 THEN 'high_entropy_dense_text' END) AS rs FROM g),
gate AS (SELECT doc_id, line_no, CASE WHEN early IS NULL AND sc >= 0.3 THEN 'keep' ELSE 'drop' END AS kind, CAST(CASE WHEN early IN ('repeated_char_noise', 'numeric_array') THEN 0.05 WHEN early IS NOT NULL THEN 0.0 ELSE round(sc, 6) END AS DOUBLE) AS score, coalesce(early, rs) AS reason FROM q)"""


@query(f"WITH {_QUALITY} SELECT * FROM gate")
def line_quality_gate(spark, sf):
    lines = explode_lines(table(spark, sf, "documents"))
    return grade(lines).select("doc_id", "line_no", "quality.kind", "quality.score", "quality.reason")


@query(f"WITH {_QUALITY} SELECT kind, reason, count(*) AS n FROM gate GROUP BY ALL")
def line_quality_reasons(spark, sf):
    return line_quality_gate(spark, sf).groupBy("kind", "reason").agg(F.count("*").alias("n"))


@query(
    "WITH c AS (SELECT doc_id, length(text) AS n, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> ''), k AS (SELECT doc_id, n, ch, count(*) AS m FROM c GROUP BY ALL)"
    " SELECT doc_id, round(sum(-(m / n) * log2(m / n)), 6) AS entropy, count(*) AS n_kinds FROM k GROUP BY doc_id"
)
def doc_char_entropy(spark, sf):
    docs = table(spark, sf, "documents").filter("text <> ''").select("doc_id", T.text_entropy("text").alias("e"))
    return docs.select("doc_id", F.round("e.entropy", 6).alias("entropy"), "e.n_kinds")


@query(
    r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS s FROM documents), k AS (SELECT doc_id, s, regexp_replace(s, '\s+', '', 'g') AS d FROM l WHERE s <> ''),
    e AS (SELECT doc_id, length(s) AS n, NOT regexp_matches(s, '^[#$]') AND length(s) >= 60 AND regexp_matches(d, '^[0-9][0-9A-Za-z@+\-.]+$') AND (length(d) - length(regexp_replace(d, '[\p{L}@]', '', 'g'))) / greatest(1, length(d)) >= 0.35 AS enc, contains(upper(s), '##XYDATA') OR contains(upper(s), '##PEAKTABLE') AS mark FROM k),
    a AS (SELECT doc_id, count(*) AS lines, sum(n) AS total, count(*) FILTER (enc) AS m, coalesce(sum(n) FILTER (enc), 0) AS chars, bool_or(mark) AS mark FROM e GROUP BY doc_id)
    SELECT d.doc_id, coalesce(lines >= 3 AND ((m >= 3 AND chars / total >= 0.45) OR (mark AND chars / total >= 0.65)), false) AS noisy FROM documents d LEFT JOIN a USING (doc_id)"""
)
def noisy_payload_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.is_noisy_payload("text").alias("noisy"))


@query(
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[‐-―]', '-', 'g'), '^\s+|\s+$', '', 'g')) AS evidence_form,
    sha256(regexp_replace(regexp_replace(lower(text), '[^a-z0-9%/+-]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS label_form,
    substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64) AS slug FROM documents"""
)
def normalised_text(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.sha2(T.normalise_evidence("text"), 256).alias("evidence_form"), F.sha2(T.normalise_label("text"), 256).alias("label_form"), T.slug("text").alias("slug")
    )


@query(
    r"""SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, CASE WHEN ceil(length(text) / 4) <= 64 THEN text ELSE regexp_replace(substr(text, 1, 244), '\s+$', '') || ' [truncated]' END AS cut,
    CASE WHEN length(text) > 500 THEN substr(text, 1, 497) || '...' ELSE text END AS preview FROM documents"""
)
def token_estimates(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.estimated_tokens("text").alias("tokens"), T.truncate_tokens("text", 64).alias("cut"), T.shorten("text").alias("preview"))


@query(
    r"""WITH n AS (SELECT doc_id, regexp_extract_all(text, '[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?') AS x FROM documents) SELECT doc_id, CAST(len(x) AS BIGINT) AS n_numbers, TRY_CAST(x[1] AS DOUBLE) AS first_number, round(coalesce(list_max(list_transform(x, lambda v: TRY_CAST(v AS DOUBLE))), 0), 6) AS largest FROM n"""
)
def numbers_from_text(spark, sf):
    n = T.numbers("text")
    return table(spark, sf, "documents").select("doc_id", F.size(n).cast("long").alias("n_numbers"), T.first_number("text").alias("first_number"), F.round(F.coalesce(F.array_max(n), F.lit(0.0)), 6).alias("largest"))


@query(
    """SELECT o_orderkey AS id, unnest(['status', 'price', 'priority']) AS key, unnest([o_orderstatus, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' EUR', o_orderpriority]) AS value FROM orders"""
)
def kv_extract(spark, sf):
    o = table(spark, sf, "orders")
    lines = F.concat(F.lit("# order\nstatus = "), F.col("o_orderstatus"), F.lit("\n  price: "), F.floor("o_totalprice").cast("long").cast("string"), F.lit(" EUR\n=\npriority:"), F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("id"), F.explode(T.key_values(lines)).alias("kv")).select("id", "kv.key", "kv.value")


@query(
    r"""SELECT page_id, CASE WHEN contains(lower(html), 'mhz') THEN 'MHz' WHEN contains(lower(html), 'khz') THEN 'kHz' WHEN contains(lower(html), 'hz') THEN 'Hz' WHEN contains(lower(html), 'ppm') THEN 'ppm' WHEN contains(lower(html), 'kelvin') THEN 'K' WHEN contains(lower(html), 'celsius') THEN '°C'
      WHEN contains(lower(html), 'percent') THEN '%' WHEN contains(lower(html), '%') THEN '%' WHEN contains(lower(html), 'minute') THEN 'min' WHEN contains(lower(html), 'second') THEN 's' END AS unit,
    concat_ws(',', CASE WHEN regexp_matches(lower(html), 'acquisition|processing|experiment') THEN 'activity' END, CASE WHEN regexp_matches(lower(html), 'instrument|software|device|equipment|sensor') THEN 'agent' END, CASE WHEN regexp_matches(lower(html), 'temperature|solvent|pressure|condition') THEN 'condition' END,
      CASE WHEN regexp_matches(lower(html), '\b(method|procedure|protocol|plan|sampling)\b') THEN 'method' END, CASE WHEN regexp_matches(lower(html), 'frequency|width|count|points|range|axis|threshold') THEN 'quantity' END, CASE WHEN regexp_matches(lower(html), 'file|format|download|license') THEN 'resource' END) AS hints FROM pages"""
)
def units_and_hints(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.infer_unit("html").alias("unit"), F.array_join(T.semantic_hints("html"), ",").alias("hints"))


@query(
    r"""WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3))) AS term FROM documents) SELECT term, count(*) AS n_docs FROM t GROUP BY term"""
)
def term_document_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(T.terms("text"))).alias("term"))
    return docs.groupBy("term").agg(F.count("*").alias("n_docs"))


@query(
    """WITH f AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path, length(html) AS bytes FROM pages), e AS (SELECT *, CASE WHEN contains(path, '.') THEN lower(list_last(string_split(path, '.'))) ELSE '' END AS ext FROM f)
    SELECT page_id, path, ext, CASE WHEN ext IN ('png','jpg','jpeg','gif','bmp','tif','tiff','webp','svg') THEN 'image' WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('csv','xls','xlsx','ods') THEN 'table' WHEN ext = 'zip' THEN 'archive' ELSE 'plain_text' END AS file_type, substr(sha256(path), 1, 5) AS chunk_group FROM e"""
)
def file_inventory(spark, sf):
    files = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    ext = T.file_extension("path")
    return files.select("page_id", "path", ext.alias("ext"), T.file_type(ext).alias("file_type"), T.chunk_group_id("path").alias("chunk_group"))


@query(
    r"""WITH s AS (SELECT page_id, url, length(html) AS b, lower(url) AS u, CASE WHEN contains(url, '.') THEN '.' || lower(list_last(string_split(url, '.'))) ELSE '' END AS e FROM pages),
    p AS (SELECT page_id, url, round(greatest(0.0, least(1.0, CAST(0.2 AS DOUBLE) + CASE WHEN regexp_matches(u, 'readme|metadata|manifest|method|protocol') THEN 0.45 ELSE 0 END + CASE WHEN regexp_matches(u, 'sample|instrument|experiment|report|summary') THEN 0.25 ELSE 0 END
      + CASE WHEN e IN ('.md','.txt','.csv','.tsv','.json','.yaml','.yml','.xml','.xlsx','.xls','.pdf') THEN 0.2 ELSE 0 END + CASE WHEN e IN ('.ipynb','.py','.r','.m') THEN 0.1 ELSE 0 END - CASE WHEN e IN ('.png','.jpg','.jpeg','.tif','.tiff','.zip','.gz','.raw','.h5','.hdf5','.npy') THEN 0.25 ELSE 0 END - CASE WHEN b > 100000 THEN 0.1 ELSE 0 END)), 2) AS score FROM s)
    SELECT page_id, url, score, row_number() OVER (ORDER BY score DESC, url, page_id) AS rank FROM p"""
)
def file_ranking(spark, sf):
    files = table(spark, sf, "pages").select("page_id", "url", F.length("html").alias("bytes"))
    return rank_files(files, "url", "bytes", "page_id").select("page_id", "url", "score", "rank")
